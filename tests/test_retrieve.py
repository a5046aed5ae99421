"""Retrieval through small in-memory indexes: guards, isolation, ties, populations."""

import math
import os
import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import embed
from quillon.operators import events as ev
from quillon.operators import retrieve as rt
from quillon.plans.queries import QUERIES
from quillon.plans.settings import MODES, Retrieval


def index(spark, rows, settings=Retrieval()):
    """rows: (user, session, text, timestamp, vector)"""
    data = [(i, "app", u, s, "user", "user", t, ts, v) for i, (u, s, t, ts, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "seq long, app_name string, user_id string, session_id string, author string, role string, t string, timestamp double, embedding array<float>")
    return ev.entries(df.withColumn("parts", ev.text_part("t")), settings, tools=False)


def ask(spark, entries, text, user="owner", mode="fused", vector=(1.0, 1.0), session="", settings=Retrieval(), k=None):
    q = spark.createDataFrame([(1, "app", user, session, text, list(vector))], "query_id long, app_name string, user_id string, session_id string, text string, q_embedding array<float>")
    return rt.retrieve(entries, q, mode, settings, k).orderBy("position").collect()


def test_identifier_guard_rejects_nearby_records(spark):
    e = index(spark, [("owner", "s1", "Patient/SYN-KNOWN-001 takes metformin.", 1.0, [1.0, 1.0])])
    s = Retrieval(top_k=1, guard_identifiers=True)
    assert ask(spark, e, "Medication for Patient/SYN-MISSING-001?", settings=s) == []
    assert ask(spark, e, "Medication for Patient/SYN-KNOWN-001?", settings=s)[0].text == "Patient/SYN-KNOWN-001 takes metformin."


@pytest.mark.parametrize("mode", MODES)
def test_scopes_are_isolated(spark, mode):
    e = index(spark, [("owner", "s1", "The user's preferred color is blue.", 1.0, [1.0, 1.0])])
    assert ask(spark, e, "preferred color", user="other", mode=mode) == []
    assert ask(spark, e, "preferred color", mode=mode)[0].doc_id == 0


def test_ties_are_deterministic(spark):
    e = index(spark, [("owner", "s1", "alpha identifier exact", 1.0, [0.0, 1.0]), ("owner", "s2", "meaning concept without lexical overlap", 2.0, [1.0, 0.0])])
    first = [r.doc_id for r in ask(spark, e, "alpha", mode="rrf", vector=(1.0, 0.0), k=1)]
    assert first == [r.doc_id for r in ask(spark, e.repartition(3), "alpha", mode="rrf", vector=(1.0, 0.0), k=1)] and len(first) == 1


@pytest.mark.parametrize(
    "query, entry, ok",
    [
        ("Medication for Patient/SYN-EXACT-001?", "Patient/SYN-EXACT-001 takes metformin.", True),
        ("Medication for Patient/SYN-EXACT-001?", "Patient/SYN-NEAR-001 takes metformin.", False),
        ("Which plan did we choose?", "The selected plan was blue.", True),
        ("PMID: 12 and topic A1", "pmid 12, Topic  a1", False),
        ("PMID:12 and topic A1", "pmid:12, Topic  a1", True),
    ],
)
def test_identifier_namespaces(spark, query, entry, ok):
    df = spark.createDataFrame([(query, entry)], "q string, e string")
    assert df.select(tx.compatible(tx.identifier_keys("q"), tx.identifier_keys("e")).alias("x")).first().x is ok


def test_bm25_uses_scope_counts_and_candidate_lengths(spark):
    """Document frequency and count are the scope's; average length is that of the session's entries."""
    e = index(spark, [("owner", "s1", "alpha beta gamma delta", 1.0, None), ("owner", "s2", "alpha words words words words words", 2.0, None), ("owner", "s2", "nothing shared here at", 3.0, None)])
    (r,) = ask(spark, e, "alpha", mode="bm25", session="s1", settings=Retrieval(cross_session=False))
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    assert r.sparse_score == pytest.approx(idf * 2.5 / (1 + 1.5)) and r.doc_id == 0


def test_blank_queries_modes_and_limits(spark):
    e = index(spark, [("owner", "s1", "alpha beta gamma delta", 1.0, [1.0, 0.0])])
    assert ask(spark, e, "   ") == []
    assert ask(spark, e, "alpha", k=0) == []
    with pytest.raises(ValueError):
        ask(spark, e, "alpha", mode="other")
    with pytest.raises(ValueError):
        ask(spark, e, "alpha", k=-1)


def test_short_texts_partial_events_and_default_time(spark):
    rows = [(0, "tiny", False, 0.0), (1, "long enough text", True, 1.0), (2, "long enough text", False, 0.0)]
    df = spark.createDataFrame(rows, "seq long, t string, partial boolean, timestamp double").withColumn("parts", ev.text_part("t")).withColumn("app_name", F.lit("a")).withColumn("user_id", F.lit("u"))
    (r,) = ev.entries(df, tools=False).collect()
    assert r.doc_id == 0 and r.created_at > 1e9 and r.source_kind == "assistant"


def test_ranks_are_permutations(spark):
    rows = [("owner", "s", f"alpha item number {i} " + "beta " * (i % 3), float(i), [float(i % 4), 1.0]) for i in range(12)]
    e = index(spark, rows)
    for mode in ("fused", "rrf", "cascade"):
        got = ask(spark, e, "alpha beta", mode=mode, k=12)
        assert {r.position for r in got} == set(range(len(got)))
        assert len({r.dense_rank for r in got}) == len(got) == len({r.sparse_rank for r in got})


def test_policies_are_separate_indexes(spark):
    e = index(spark, [("owner", "s1", "Patient/SYN-1 takes metformin daily", 1.0, [1.0, 1.0])])
    both = e.withColumn("policy", F.lit("plain")).withColumn("budget", F.lit(1)).unionByName(e.withColumn("policy", F.lit("fused_hybrid")).withColumn("budget", F.lit(1)))
    q = spark.createDataFrame([(1, "app", "owner", "Patient/SYN-2?", [1.0, 1.0])], "query_id long, app_name string, user_id string, text string, q_embedding array<float>")
    qs = q.withColumn("policy", F.lit("plain")).withColumn("budget", F.lit(1)).unionByName(q.withColumn("policy", F.lit("fused_hybrid")).withColumn("budget", F.lit(1)))
    from quillon.plans.settings import retrieval_for

    got = rt.retrieve_by_policy(both, qs, {(p, 1): retrieval_for(p, {}) for p in ("plain", "fused_hybrid")}, "dense", 5).collect()
    assert [r.policy for r in got] == ["plain"]


def test_distinct_texts_are_encoded_once(spark):
    df = spark.createDataFrame([("a",), ("a",), ("bb",), (None,)], "text string")
    out = embed.embedded(df, lambda s: s.map(lambda t: [float(len(t))]), prefix="x").collect()
    assert sorted((r.text or "", r.embedding[0]) for r in out) == [("", 1.0), ("a", 2.0), ("a", 2.0), ("bb", 3.0)]


def test_identifiers_query_reads_whole_texts(spark, tmp_path):
    """Identifiers after the 200th character of a document count, as by brute force over the whole record."""
    late = "filler words " * 40 + "PMID: 98765 of Patient/ZZ-9 in FHIR"
    rows = [(1, late), (2, "short PMID: 11"), (3, "x " * 300), (4, "word " * 5000 + "Patient/END-1")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["identifiers"][0](spark, str(tmp_path)).collect()}
    for i, text in rows:
        record = f"Note PMID: {i % 5} of Patient/SYN-{i % 7}, topic  T{i % 3} FHIR. {text}"
        assert got[i].n == len(re.findall("(?i)" + tx.IDENTIFIERS, record))
        for name, pattern in tx.NAMESPACES.items():
            found = {" ".join(m.group(0).lower().split()) for m in re.finditer(f"(?i){pattern}", record)}
            assert getattr(got[i], name) == "|".join(sorted(found)), (i, name)


def events_of(spark, rows):
    df = spark.createDataFrame([(i, "app", u, s, "user", "user", t, float(i)) for i, u, s, t in rows], "seq long, app_name string, user_id string, session_id string, author string, role string, t string, timestamp double")
    return df.withColumn("parts", ev.text_part("t"))


def test_an_index_is_appended_to(spark, tmp_path):
    from quillon.operators import index as ix

    path = f"file://{tmp_path}/index"
    rows = [(i, "owner" if i % 3 else "other", "s", f"alpha entry number {i}") for i in range(20)]
    q = spark.createDataFrame([(1, "app", "owner", "alpha 17"), (2, "app", "nobody", "alpha")], "query_id long, app_name string, user_id string, text string")
    assert ix.retrieve(path, q, "bm25").collect() == []
    assert ix.append(path, events_of(spark, rows[:7]), tools=False) == 1
    assert ix.append(path, events_of(spark, rows[7:]), tools=False) == 2
    assert ix.append(path, events_of(spark, rows[7:]), tools=False, batch=2) == 2  # replayed
    whole = ev.entries(events_of(spark, rows), tools=False)
    key = lambda df: sorted((r.user_id, r.doc_id, r.text) for r in df.collect())
    assert key(ix.entries(spark, path)) == key(whole)
    assert key(ix.entries(spark, path, [("app", "other")])) == [x for x in key(whole) if x[0] == "other"]
    assert sorted(map(tuple, ix.document_frequency(spark, path).collect())) == sorted(map(tuple, ev.document_frequency(whole).collect()))
    assert sorted((r.user_id, r.n_docs) for r in ix.scope_counts(spark, path).collect()) == [("other", 7), ("owner", 13)]
    got = ix.retrieve(path, q, "bm25", top_k=3).orderBy("position").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in rt.retrieve(whole, q, "bm25", top_k=3).orderBy("position").collect()] and got[0].text == "alpha entry number 17"
    ix.reset(spark, path)
    assert ix.entries(spark, path) is None


def test_policies_have_indexes_of_their_own(spark, tmp_path):
    from quillon.operators import index as ix

    root = f"file://{tmp_path}/policies"
    ix.store_for(root, events_of(spark, [(0, "owner", "s", "Patient/SYN-1 takes metformin")]), "fused_hybrid", 1, {}, tools=False)
    ix.store_for(root, events_of(spark, [(0, "owner", "s", "Patient/SYN-1 takes metformin")]), "plain", 1, {}, tools=False)
    q = spark.createDataFrame([(1, "app", "owner", "Patient/SYN-2 metformin?")], "query_id long, app_name string, user_id string, text string")
    n = lambda *key: ix.retrieve_for(root, q, *key, {}, "bm25", 5).count()
    assert (n("fused_hybrid", 1), n("plain", 1), n("plain", 2)) == (0, 1, 0)
    ix.reset(spark, root)
    assert n("plain", 1) == 0


def test_bm25_without_a_threshold_returns_zero_scores_too(spark):
    e = index(spark, [("owner", "s1", "alpha beta gamma delta", 1.0, None), ("owner", "s1", "nothing shared with it", 2.0, None)])
    got = ask(spark, e, "alpha", mode="bm25", settings=Retrieval(min_score=0.0))
    assert [(r.doc_id, r.score > 0) for r in got] == [(0, True), (1, False)]


def test_embeddings_are_kept_between_calls(spark, tmp_path):
    cache, log = f"file://{tmp_path}/cache", f"{tmp_path}/log"

    def encode(s):
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in s)
        return s.map(lambda t: [float(len(t))])

    df = lambda *texts: spark.createDataFrame([(t,) for t in texts], "text string")
    assert sorted(r.q_embedding[0] for r in embed.embedded_queries(df("a", "a", "bb"), encode, Retrieval(query_prefix="x"), cache).collect()) == [2.0, 2.0, 3.0]
    assert sorted(r.q_embedding[0] for r in embed.embedded_queries(df("ccc", "bb"), encode, Retrieval(query_prefix="x"), cache).collect()) == [3.0, 4.0]
    assert sorted(open(log).read().split()) == ["xa", "xbb", "xccc"]
    os.remove(f"{tmp_path}/cache/batch=2/_SUCCESS")  # as a job leaves it that failed: its texts are encoded again, none is there twice
    again = embed.embedded_queries(df("ccc", "bb", "dddd"), encode, Retrieval(query_prefix="x"), cache)
    assert sorted(r.q_embedding[0] for r in again.collect()) == [3.0, 4.0, 5.0]
    assert sorted(open(log).read().split()) == ["xa", "xbb", "xccc", "xccc", "xdddd"]
    assert embed.embedded_entries(df("a"), encode).first().embedding == [1.0]


def test_a_loader_runs_once_a_worker(spark, tmp_path):
    log = f"{tmp_path}/log"

    def load():
        with open(log, "a") as f:
            f.write("x")
        return lambda s: s.map(lambda t: [float(len(t))])

    df = spark.range(200).select(F.col("id").cast("string").alias("text")).repartition(8)
    out = embed.embedded(df, embed.Loader("test-lengths", load))
    assert out.agg(F.sum(F.element_at("embedding", 1))).first()[0] == 10 + 2 * 90 + 3 * 100
    assert 1 <= len(open(log).read()) <= 4  # workers, not tasks


def test_large_scopes_are_numbered_in_sequence(spark):
    rows = [(i * 7919 % 1000, "owner" if i % 5 else "other", "s", f"entry text number {i * 7919 % 1000}") for i in range(1000)]
    got = ev.entries(events_of(spark, rows).repartition(7), tools=False).collect()
    for user in ("owner", "other"):
        texts = [f"entry text number {i}" for i, u, _, _ in sorted(rows) if u == user]
        assert [r.text for r in sorted((r for r in got if r.user_id == user), key=lambda r: r.doc_id)] == texts
        assert sorted(r.doc_id for r in got if r.user_id == user) == list(range(len(texts)))
