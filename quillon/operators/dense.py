"""The dense mode in blocks: entries and queries meet as matrices, only the best of each block leave a task.

A task holds up to ENTRIES entries of a scope and about QUERIES of its queries; entries are copied only for scopes' further QUERIES. The first pass gives
the k best of each block, which are merged; the second counts, for each entry that is returned, those
of a block that are nearer, so ranks are exact and no pair is ever a row. A scope of any size is dealt
over its blocks. Cosines are made step by step as SQL's ``list_cosine_similarity`` makes
them of float vectors, so what ties there ties here.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import events as ev
from quillon.plans.settings import Retrieval
from quillon.sources.tables import materialize

SCOPE = ev.SCOPE
ENTRIES, QUERIES = 4096, 512
KEYS = [*SCOPE, "block", "part"]
BEST = "query_id long, doc_id long, created_at double, importance double, dense double, score double"
NEARER = "query_id long, doc_id long, nearer long"


def _vectors(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all vectors, first number of each)."""
    c = lists.combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.append(0, np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False)))


class Vectors:
    """Vectors of one length, by component, and the sums of their squares."""

    def __init__(self, rows: np.ndarray):
        self.columns = np.ascontiguousarray(rows.T)
        self.squares = self._summed(self.columns)

    def _summed(self, factors: np.ndarray) -> np.ndarray:
        """Sums of products added component by component; numpy's own sums go in another order."""
        out = np.zeros(self.columns.shape[1])
        for c, x in zip(self.columns, factors, strict=True):
            out += c * x
        return out

    def cosines(self, v: np.ndarray) -> np.ndarray:
        """Cosines with v: one root, of the product of both squares; a vector of length 0 counts as 1."""
        square = Vectors(v[None, :]).squares[0]
        with np.errstate(over="ignore"):
            both = self.squares * square
        one = lambda n: np.where(n == 0, 1.0, n)
        apart = one(np.sqrt(self.squares)) * one(np.sqrt(square))  # where the product is beyond the range of numbers, or 0
        return np.clip(self._summed(v) / np.where((both > 0) & np.isfinite(both), np.sqrt(both), apart), -1.0, 1.0)


def cosines(left: pa.Table, right: pa.Table):
    """For each query, its row and the rows and cosines of the entries whose vectors are as long."""
    (e, at), (q, of) = _vectors(left.column("embedding")), _vectors(right.column("q_embedding"))
    size = np.diff(at)
    kept: dict[int, tuple[np.ndarray, Vectors]] = {}
    for i in range(len(right)):
        v = q[of[i] : of[i + 1]]
        if len(v) not in kept:
            rows = np.flatnonzero(size == len(v))
            kept[len(v)] = rows, Vectors(e[at[:-1][rows][:, None] + np.arange(len(v))])
        rows, m = kept[len(v)]
        yield i, rows, m.cosines(v)


def _first(k: int, score: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the first k by score and time downwards, then by doc; only what reaches the k-th score is sorted."""
    some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k]) if 0 < k < len(score) else np.arange(len(score))
    return some[np.lexsort((doc[some], -at[some], -score[some]))[:k]]


def _dealt(entries: DataFrame, queries: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(entries, queries) of every block of each scope."""
    n = max(1, -(-(queries.groupBy(*SCOPE).count().agg(F.max("count")).first()[0] or 0) // QUERIES))  # of the scope with most queries
    part = F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int").alias("part")
    block = F.expr(f"doc_id div {ENTRIES}").alias("block")
    left = entries.select(*SCOPE, block, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"), "doc_id", "created_at", "importance", "embedding")
    right = queries.withColumn("part", part).join(entries.select(*SCOPE, block).distinct(), SCOPE)
    return left.groupBy(*KEYS).cogroup(right.groupBy(*KEYS)).applyInArrow(run, schema)


def best(entries: DataFrame, queries: DataFrame, settings: Retrieval, k: int) -> DataFrame:
    """The rows that the dense mode can return, with their ranks: entries of the query's scope by cosine * importance."""
    known = entries.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull())).select(*SCOPE, "doc_id", "created_at", "importance", F.col("embedding").cast("array<double>").alias("embedding"))
    q = queries.where(F.col("q_embedding").isNotNull() & F.forall("q_embedding", lambda x: x.isNotNull())).select(*SCOPE, "query_id", F.col("q_embedding").cast("array<double>").alias("q_embedding"))
    least = settings.min_score

    def top(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, at, weight = (left.column(c).to_numpy() for c in ("doc_id", "created_at", "importance"))
        query, out = right.column("query_id").to_numpy(), []
        for i, rows, dense in cosines(left, right):
            score = np.maximum(0.0, dense) * weight[rows]
            some = np.flatnonzero(score >= least)
            rows, dense, score = rows[some], dense[some], score[some]
            some = _first(k, score, at[rows], doc[rows])
            out.append((np.full(len(some), query[i]), doc[rows[some]], at[rows[some]], weight[rows[some]], dense[some], score[some]))
        names = [x.split()[0] for x in BEST.split(", ")]
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), *[pa.float64()] * 4)], names=names)

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("created_at").desc(), "doc_id")  # k rows of each block
    found = materialize(_dealt(known, q, top, BEST).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n"), "dense-best")
    wanted = q.join(found.groupBy("query_id").agg(F.collect_list(F.struct("dense", "doc_id")).alias("w")), "query_id").select(*SCOPE, "query_id", "q_embedding", F.col("w.dense").alias("d"), F.col("w.doc_id").alias("ids"))

    def nearer(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, out = left.column("doc_id").to_numpy(), []
        query, d, ids = (right.column(c).to_pylist() for c in ("query_id", "d", "ids"))
        for i, rows, dense in cosines(left, right):
            out += [(query[i], y, int(((dense > x) | ((dense == x) & (doc[rows] < y))).sum())) for x, y in zip(d[i], ids[i], strict=True)]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in NEARER.split(", ")])

    ranks = _dealt(known, wanted, nearer, NEARER).groupBy("query_id", "doc_id").agg(F.sum("nearer").alias("dense_rank"))
    return found.join(ranks, ["query_id", "doc_id"]).select(
        "query_id", "doc_id", "created_at", "importance", "dense", "score", "dense_rank",
        F.lit(0.0).alias("bm25"), F.col("doc_id").alias("sparse_rank"), (F.col("dense") >= least).alias("dense_eligible"), F.lit(False).alias("sparse_eligible"),
    )
