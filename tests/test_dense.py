"""The dense mode in blocks, and ranks that many tasks make: the same rows as by windows over whole queries."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import dense
from quillon.operators import events as ev
from quillon.operators import retrieve as rt
from quillon.plans.settings import Retrieval


@pytest.fixture
def entries(spark):
    r = random.Random(3)
    vectors = [[r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)] for _ in range(9)] + [[0.0] * 4, None, [1.0, None, 0.0, 0.0], [1.0, 0.0]]
    rows = [(i, "app", r.choice("aab"), "s", r.choice(["user", "tool"]), "user", f"entry number {i} " + r.choice(["", "Patient/X-1 "]), float(r.randrange(5)), r.choice(vectors)) for i in range(150)]
    df = spark.createDataFrame(rows, "seq long, app_name string, user_id string, session_id string, author string, role string, t string, timestamp double, embedding array<float>")
    return ev.entries(df.withColumn("parts", ev.text_part("t")), Retrieval(), tools=False)


def test_blocks_equal_windows(spark, entries, monkeypatch):
    monkeypatch.setattr(dense, "ENTRIES", 8)
    monkeypatch.setattr(dense, "QUERIES", 3)
    r = random.Random(4)
    q = spark.createDataFrame([(i, "app", r.choice(["a", "b", "none"]), "", "what is it", [r.choice([-1.0, 0.5, 1.0]) for _ in range(4)]) for i in range(10)] + [(50, "app", "a", "", "zero", [0.0] * 4), (51, "app", "a", "", "short", [1.0, 1.0])], "query_id long, app_name string, user_id string, session_id string, text string, q_embedding array<float>")
    for k in (0, 4, 40):
        blocks = rt.retrieve(entries, q, "dense", Retrieval(), k)
        plain = rt.retrieve(entries, q, "dense", Retrieval(cross_session=False), k)  # blank sessions admit all
        tell = lambda df: sorted(tuple(x) for x in df.drop("text").select(*[F.round(c, 9).alias(c) if c.endswith("score") else F.col(c) for c in df.drop("text").columns]).collect())
        assert tell(blocks) == tell(plain) and bool(tell(plain)) == (k > 0)


def test_places_are_those_of_a_window(spark):
    r = random.Random(5)
    rows = spark.createDataFrame([(0 if r.random() < 0.6 else r.randrange(4), i, float(r.randrange(6))) for i in range(500)], "query_id long, doc_id long, x double")
    want = rows.withColumn("n", (F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("x").desc(), "doc_id")) - 1).cast("long"))
    assert sorted(rt.placed(rows, "x", "n").select("query_id", "doc_id", "x", "n").collect()) == sorted(want.collect())


def test_entries_are_copied_for_their_own_scope_only(spark, monkeypatch):
    """queries of other scopes do not add to the times that a scope's entries are dealt."""
    monkeypatch.setattr(dense, "QUERIES", 4)
    e = spark.range(60).selectExpr("'a' app_name", "concat('u', id % 3) user_id", "id doc_id", "1d created_at", "1d importance", "array(1d) embedding")
    q = spark.range(12).selectExpr("id query_id", "'a' app_name", "concat('u', id % 3) user_id", "array(1d) q_embedding")
    dealt = lambda n: dense._dealt(e, q.where(f"query_id < {n}"), lambda left, right: pa.table({"e": [len(left)], "q": [len(right)]}), "e long, q long").groupBy().sum().first()
    assert tuple(dealt(12)) == (60, 12)
    monkeypatch.setattr(dense, "QUERIES", 2)
    assert tuple(dealt(12)) == (120, 12)
    assert dealt(0)[1] in (0, None)


def test_first_rows_are_those_of_a_full_sort():
    """only rows that reach the k-th score are sorted; ties at it go by time and doc."""
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 200):
        score, at, doc = r.integers(0, 4, n) / 4, r.integers(0, 3, n).astype(float), r.permutation(n)
        for k in (0, 1, 5, 300):
            assert dense._first(k, score, at, doc).tolist() == np.lexsort((doc, -at, -score))[:k].tolist()


def test_dense_mode_writes_no_tokens(spark, monkeypatch):
    """entries that are no written table yet, as those just embedded, are written without what the dense mode does not read."""
    e = spark.createDataFrame([("a", "u", "s", i, f"text {i}", "user", 1.0, float(i), [f"t{i}"], 1, [1.0, float(i)]) for i in range(9)], "app_name string, user_id string, session_id string, doc_id long, text string, source_kind string, importance double, created_at double, tokens array<string>, n_tokens long, embedding array<double>")
    q = spark.createDataFrame([(1, "a", "u", "t3", [1.0, 3.0])], "query_id long, app_name string, user_id string, text string, q_embedding array<double>")
    written, write = [], rt.stored
    monkeypatch.setattr(rt, "stored", lambda df, name: written.append(set(df.columns)) or write(df, name))
    got = {mode: [r.doc_id for r in rt.retrieve(e, q, mode, top_k=2).orderBy("position").collect()] for mode in ("dense", "fused")}
    assert got["dense"][0] == 3 and got["fused"][0] == 3
    assert ["tokens" in c for c in written] == [False, True]


def test_cosines_are_those_of_sql(duck):
    """bit for bit, of counts, of floats and of one row alone; else near ties are ranked otherwise than in SQL."""
    r = np.random.default_rng(2)
    for e, v in ((r.integers(0, 90, (300, 9)), r.integers(0, 30, 9)), (r.standard_normal((300, 64)), r.standard_normal(64)), (r.standard_normal((1, 64)), r.standard_normal(64))):
        e, v = (x.astype(np.float32).astype(float) for x in (e, v))  # as tables hold them; products of these are exact
        vectors = pa.table({"i": range(len(e)), "e": e.tolist(), "v": [v.tolist()] * len(e)})  # noqa: F841
        want = [x for (x,) in duck.execute("select list_cosine_similarity(e, v) from vectors order by i").fetchall()]
        got = [d for _, _, d in dense.cosines(pa.table({"embedding": e.tolist()}), pa.table({"q_embedding": [v.tolist()]}))]
        assert got[0].tolist() == want
    huge = dense.Vectors(np.array([[1e100, 0.0], [1e-100, 0.0], [0.0, 0.0]]))
    assert huge.cosines(np.array([1e100, 0.0])).tolist() == [1.0, 1.0, 0.0] and huge.cosines(np.array([1e-100, 0.0])).tolist() == [1.0, 1.0, 0.0]


@pytest.mark.parametrize("mode", ["dense", "union"])
def test_vectors_of_one_direction_tie(spark, mode):
    """multiples of the query's vector all have cosine 1, so time and doc_id tell them apart."""
    v = [1.0, 2.0, 3.0]
    e = spark.createDataFrame([("a", "u", "s", i, f"text {i}", "user", 1.0, 1.0, [f"t{i}"], 1, [(i + 1) * x for x in v]) for i in range(40)], "app_name string, user_id string, session_id string, doc_id long, text string, source_kind string, importance double, created_at double, tokens array<string>, n_tokens long, embedding array<double>")
    q = spark.createDataFrame([(1, "a", "u", "none", v)], "query_id long, app_name string, user_id string, text string, q_embedding array<double>")
    got = rt.retrieve(e, q, mode, top_k=40).orderBy("position").collect()
    assert [(r.doc_id, r.dense_score, r.dense_rank) for r in got] == [(i, 1.0, i) for i in range(40)]
