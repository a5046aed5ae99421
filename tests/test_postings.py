"""Inverted lists of a stored index: the same rows as scoring every entry, from few blocks."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import events as ev
from quillon.operators import index, postings
from quillon.operators import retrieve as rt
from quillon.plans.settings import Retrieval

COLUMNS = ("query_id", "position", "doc_id", "score", "sparse_score", "dense_score", "dense_rank", "sparse_rank", "text")


def events(spark, rows):
    data = [(i, "app", u, s, a, "user" if a == "user" else "model", t, float(i)) for i, (u, s, a, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "seq long, app_name string, user_id string, session_id string, author string, role string, t string, timestamp double")
    return df.withColumn("parts", ev.text_part("t"))


def corpus(n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    odds = [1 / (i + 1) for i in range(60)]
    return [(r.choice(["a", "a", "b"]), r.choice(["s1", "s2"]), r.choice(["user", "tool", "helper"]), "start " + " ".join(r.choices(words, odds, k=r.randint(3, 40)))) for _ in range(n)]


def questions(spark, n=12, seed=2):
    r = random.Random(seed)
    rows = [(i, "app", r.choice(["a", "b", "none"]), "s1", " ".join(f"w{r.randrange(62)}" for _ in range(r.randint(1, 5))), [1.0, 0.0]) for i in range(n)] + [(99, "app", "a", "s1", "  ", [1.0, 0.0]), (98, "app", "a", "s1", "start", [1.0, 0.0])]
    return spark.createDataFrame(rows, "query_id long, app_name string, user_id string, session_id string, text string, q_embedding array<float>")


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*[F.round(c, 9).alias(c) if c.endswith("score") else c for c in COLUMNS]).collect())


@pytest.fixture
def stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    path, rows = str(tmp_path / "index"), corpus(400)
    for part in (rows[:150], rows[150:]):
        index.append(path, events(spark, part).withColumn("embedding", F.array(F.lit(1.0), F.col("seq") % 7)), tools=False)
    return path


@pytest.mark.parametrize("settings, k", [(Retrieval(), 5), (Retrieval(), 0), (Retrieval(), 60), (Retrieval(k1=0.4, b=1.0), 3), (Retrieval(min_score=2.0), 4), (Retrieval(cross_session=False), 5)])
def test_bm25_equals_scoring_every_entry(spark, stored, settings, k):
    q = questions(spark)
    want = rows_of(rt.retrieve(index.entries(spark, stored), q, "bm25", settings, k))
    assert rows_of(index.retrieve(stored, q, "bm25", settings, k)) == want
    assert bool(want) == (k > 0)


def test_other_modes_read_lists(spark, stored):
    q = questions(spark, 6)
    for mode in ("fused", "union"):
        assert rows_of(index.retrieve(stored, q, mode)) == rows_of(rt.retrieve(index.entries(spark, stored), q, mode))


def test_few_ranges_are_scored_and_tokens_are_not_read(spark, stored, monkeypatch):
    scored = []
    real = postings._scored
    monkeypatch.setattr(postings, "_scored", lambda found, ranges, settings: scored.append(ranges.count()) or real(found, ranges, settings))
    r = questions(spark).where("user_id = 'a'").limit(4)
    out = index.retrieve(stored, r, "bm25", top_k=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "tokens" not in plan
    lists = index.lists(spark, stored).blocks
    assert scored[0] <= 4 and scored[1] < 4 * lists.where("user_id = 'a'").select("block").distinct().count() * 0.9


def test_blocks_bound_what_they_hold(spark, stored):
    b = index.lists(spark, stored).blocks
    odd = b.where((F.size("docs") != F.col("n")) | (F.array_max(F.transform("docs", lambda p: p["tf"])) != F.col("max_tf")) | (F.array_min(F.transform("docs", lambda p: p["dl"])) != F.col("min_dl")) | (F.array_max(F.transform("docs", lambda p: p["importance"])) != F.col("max_importance")))
    assert odd.count() == 0 and b.count() > 500
    terms = index.entries(spark, stored).select("user_id", F.explode("tokens").alias("term")).groupBy("user_id", "term").agg(F.count(F.lit(1)).alias("n"))
    held = b.select("user_id", "term", F.explode("docs").alias("p")).groupBy("user_id", "term").agg(F.sum("p.tf").alias("n"))
    assert terms.exceptAll(held).count() == held.exceptAll(terms).count() == 0
    assert postings.of_terms(b, spark.createDataFrame([("app", "a", "w1")], "app_name string, user_id string, term string")).select("term").distinct().collect()[0].term == "w1"


@pytest.mark.parametrize("mode, session", [("bm25", True), ("fused", False), ("rrf", False)])
def test_guard_as_a_join_equals_the_test_of_each_pair(spark, tmp_path, mode, session):
    """Queries that name none, one or several spaces, repeats of an identifier, other scopes; stored and not."""
    r = random.Random(9)
    names = [lambda: f"Patient/SYN-{r.randrange(3)}", lambda: f"PMID: {r.randrange(3)}", lambda: f"topic T{r.randrange(2)}"]
    named = lambda n: " ".join(x for _ in range(n) for x in [r.choice(names)()] * r.randint(1, 2))
    rows = [(u, s, a, f"{t} {named(r.randint(0, 4))}") for u, s, a, t in corpus(80)]
    asked = [(i, "app", r.choice(["a", "b", "none"]), "s1" if i % 3 else None, f"start w{r.randrange(5)} {named(i % 4)}", [1.0, 0.0]) for i in range(16)]
    q = spark.createDataFrame(asked, "query_id long, app_name string, user_id string, session_id string, text string, q_embedding array<float>")
    e = events(spark, rows).withColumn("embedding", F.array(F.lit(1.0), F.col("seq") % 7))
    settings = Retrieval(guard_identifiers=True, cross_session=not session, top_k=100)
    path = str(tmp_path / "index")
    for part in (e.where("seq < 30"), e.where("seq >= 30")):
        index.append(path, part, settings, tools=False)
    got, plain = index.retrieve(path, q, mode, settings), rt.retrieve(index.entries(spark, path), q, mode, settings)
    assert rows_of(got) == rows_of(plain)
    best = rt.retrieve(index.entries(spark, path), q, "fused", Retrieval(cross_session=not session, top_k=100, min_score=0.0)).select("query_id", "doc_id", F.col("text").alias("e_text"))
    pairs = best.join(q.select("query_id", "text"), "query_id").where(tx.compatible(tx.identifier_keys("text"), tx.identifier_keys("e_text"))).select("query_id", "doc_id")
    every = rt.retrieve(index.entries(spark, path), q, "fused", Retrieval(guard_identifiers=True, cross_session=not session, top_k=100, min_score=0.0)).select("query_id", "doc_id")
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, pairs.collect())) != []


def test_questions_to_an_index_prune_its_partitions(spark, tmp_path):
    path = str(tmp_path / "index")
    index.append(path, events(spark, [(f"u{i}", "s", "user", f"a note of user {i}, PMID: {i}") for i in range(30)]), tools=False)
    q = spark.createDataFrame([("app", "u7")], "app_name string, user_id string")
    held = index.entries(spark, path, queries=q)
    assert "dynamicpruning" in held._jdf.queryExecution().executedPlan().toString().lower()
    assert "u7" in {r.user_id for r in held.collect()} and held.count() < 30
    assert "dynamicpruning" in index.lists(spark, path, q).identifiers._jdf.queryExecution().executedPlan().toString().lower()
