"""Inverted lists of an index, in blocks that know the most their postings can score.

A block is what a term has in BLOCK consecutive doc_ids of a scope: its postings, and of these the
largest tf, the smallest length and the largest importance, which bound the BM25 share of each under
any settings. Blocks of all terms cover the same ranges of doc_ids, so the bounds of a query's terms
add up to a bound of every document in a range.

``best`` reads bounds only, takes the range of each query that promises most, scores it, and from the
k-th score on knows which other ranges can hold a result: those alone are scored, so the rows are
exactly those of scoring everything. A range and its queries meet in a task, of which k documents of each
query leave it, and then, for the few that are returned, how many come before them; no pair of query and
document is a row. Lists are stored by a hash of scope and term and sorted, so a
question reads the partitions, and within them the row groups, of its own terms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import events as ev
from quillon.operators.dense import _first
from quillon.plans.settings import Retrieval
from quillon.sources.tables import materialize

SCOPE = ev.SCOPE
BLOCK, BUCKETS, FILES, QUERIES = 4096, 64, 4, 16384
KEYS = [*SCOPE, "block", "part"]
BEST = "query_id long, doc_id long, created_at double, importance double, bm25 double, score double"
BEFORE = "query_id long, doc_id long, sparse_rank long"
UNIT = float(1 << 44)
_SLACK = 1e-9  # of rounding, relative


def bucket() -> Column:
    return F.pmod(F.xxhash64(*SCOPE, "term"), F.lit(BUCKETS)).cast("int")


def blocks(entries: DataFrame) -> DataFrame:
    """(*SCOPE, term, block, n, max_tf, min_dl, max_importance, docs) of index entries; docs: (doc_id, tf, dl, importance, created_at) in order."""
    dealt = entries.select(*SCOPE, F.expr(f"doc_id div {BLOCK}").alias("block"), "doc_id", F.col("n_tokens").alias("dl"), "importance", "created_at", "tokens").repartition(*SCOPE, "block")
    one = dealt.select(*SCOPE, F.explode("tokens").alias("term"), "block", "doc_id", "dl", "importance", "created_at")  # in the task that has the range, so no posting is shuffled
    counted = one.groupBy(*SCOPE, "term", "block", "doc_id", "dl", "importance", "created_at").agg(F.count(F.lit(1)).alias("tf"))
    posting = F.struct("doc_id", "tf", "dl", "importance", "created_at")
    return counted.groupBy(*SCOPE, "term", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.max("importance").alias("max_importance"), F.sort_array(F.collect_list(posting)).alias("docs")
    )


def write(entries: DataFrame, path: str) -> None:
    """The blocks of entries as a table under path, partitioned by ``bucket``."""
    by = ["bucket", *SCOPE, "term", "block"]  # dealt by hash, as ranges are sampled, which would make the blocks twice
    blocks(entries).withColumn("bucket", bucket()).repartition("bucket", F.col("block") % FILES).sortWithinPartitions(*by).write.mode("overwrite").partitionBy("bucket").parquet(path)


def of_terms(lists: DataFrame, terms: DataFrame) -> DataFrame:
    """The blocks of the terms (*SCOPE, term), from the partitions that can hold them: at most BUCKETS numbers go to the driver."""
    terms = terms.select(*SCOPE, "term").distinct().withColumn("bucket", bucket())
    held = [r.bucket for r in terms.select("bucket").distinct().collect()]
    return lists.where(F.col("bucket").isin(held)).join(terms, ["bucket", *SCOPE, "term"], "left_semi").drop("bucket")


def share(tf: Column, dl: Column, settings: Retrieval) -> Column:
    """BM25's factor of one term in one document, without idf; grows with tf, falls with dl."""
    length = F.lit(1.0 - settings.b) + F.lit(settings.b) * (dl / F.col("avgdl"))
    return (tf * (settings.k1 + 1.0)) / (tf + F.lit(settings.k1) * length)


def total(one: Column) -> Column:
    """Sum of shares as integers, so that the order of summing cannot tell equal texts apart, to some 1e-12."""
    return F.sum(F.rint(one * F.lit(UNIT)).cast("long")) / F.lit(UNIT)


class Meeting:
    """The postings of a range of documents."""

    def __init__(self, left: pa.Table, settings: Retrieval):
        left, self.settings, docs = left.combine_chunks(), settings, left.column("docs").combine_chunks()
        docs = docs.chunk(0) if isinstance(docs, pa.ChunkedArray) else docs
        ends = np.cumsum(docs.value_lengths().to_numpy(zero_copy_only=False))
        self.rows: dict[str, list[slice]] = {}  # a range that two batches share has two lists
        for term, a, b in zip(left.column("term").to_pylist(), np.append(0, ends), ends):
            self.rows.setdefault(term, []).append(slice(a, b))
        doc, self.tf, self.dl, weight, at = (docs.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tf", "dl", "importance", "created_at"))
        self.doc, some, self.place = np.unique(doc, return_index=True, return_inverse=True)
        self.weight, self.at = weight[some], at[some]

    def bm25(self, terms: list, idf: list, avgdl: float) -> np.ndarray:
        s, sums = self.settings, np.zeros(len(self.doc), np.int64)
        for term, w in zip(terms, idf, strict=True):
            for rows in self.rows.get(term, ()):
                tf = self.tf[rows]
                length = (1.0 - s.b) + s.b * (self.dl[rows] / avgdl)
                sums[self.place[rows]] += np.rint(w * ((tf * (s.k1 + 1.0)) / (tf + s.k1 * length)) * UNIT).astype(np.int64)
        return sums / UNIT


@dataclass(frozen=True)
class Found:
    """The blocks of the queries' terms, and (query_id, *SCOPE, avgdl, part, terms, idf) of the queries."""

    lists: DataFrame
    queries: DataFrame
    parts: int
    k: int

    def run(self, ranges: DataFrame, settings: Retrieval, f: Callable[[Meeting, dict, np.ndarray], list], schema: str) -> DataFrame:
        """f(range, query, bm25) of each of the ranges (query_id, block, ...)."""
        columns = [x.split() for x in schema.split(", ")]
        kinds = {"long": pa.int64(), "double": pa.float64()}

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if len(left) and len(right):
                m = Meeting(left, settings)
                for batch in right.to_batches(1024):
                    out += [f(m, q, m.bm25(q["terms"], q["idf"], q["avgdl"])) for q in batch.to_pylist()]
            data = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[] for _ in columns]
            return pa.table([pa.array(c, kinds[t]) for c, (_, t) in zip(data, columns, strict=True)], names=[n for n, _ in columns])

        right = ranges.join(self.queries, "query_id")
        left = self.lists.join(right.select(*SCOPE, "block").distinct(), [*SCOPE, "block"], "left_semi").select(*SCOPE, "block", "term", "docs")
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))) if self.parts > 1 else F.lit(0))
        return left.groupBy(*KEYS).cogroup(right.groupBy(*KEYS)).applyInArrow(meet, schema)


def _scored(found: Found, ranges: DataFrame, settings: Retrieval) -> DataFrame:
    """The first documents of each of the ranges (query_id, block), at most k that reach the least score, or one."""
    k = max(found.k, 1)

    def keep(m: Meeting, q: dict, bm25: np.ndarray) -> list:
        score = bm25 * m.weight
        some = np.flatnonzero((score >= settings.min_score) & (bm25 > 0))
        some = some[_first(k, score[some], m.at[some], m.doc[some])]
        return [np.full(len(some), q["query_id"]), m.doc[some], m.at[some], m.weight[some], bm25[some], score[some]]

    return found.run(ranges, settings, keep, BEST)


def _ranked(found: Found, ranges: DataFrame, chosen: DataFrame, settings: Retrieval) -> DataFrame:
    """chosen with ``sparse_rank``: how many documents of the ranges come before each by bm25, then by doc_id."""
    wanted = ranges.join(chosen.groupBy("query_id").agg(F.collect_list(F.struct("doc_id", "bm25")).alias("c")), "query_id").select("query_id", "block", F.col("c.doc_id").alias("ids"), F.col("c.bm25").alias("of"))

    def count(m: Meeting, q: dict, bm25: np.ndarray) -> list:
        before = [((bm25 > x) | ((bm25 == x) & (m.doc < y))).sum() for x, y in zip(q["of"], q["ids"], strict=True)]
        return [np.full(len(before), q["query_id"]), q["ids"], before]

    ranks = found.run(wanted, settings, count, BEFORE).groupBy("query_id", "doc_id").agg(F.sum("sparse_rank").alias("sparse_rank"))
    return chosen.join(ranks, ["query_id", "doc_id"])


def best(lists: DataFrame, weights: DataFrame, settings: Retrieval, k: int) -> DataFrame:
    """(query_id, doc_id, created_at, importance, bm25, score, position, sparse_rank): of each query its k best documents by bm25 * importance.

    weights: (query_id, *SCOPE, term, idf, avgdl). Ranks by bm25 are those among all documents.
    """
    weights = materialize(weights, "lists-weights")
    held = of_terms(lists, weights)
    asked = weights.groupBy("query_id", *SCOPE, "avgdl").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("x"))
    parts = max(1, -(-(asked.groupBy(*SCOPE).count().agg(F.max("count")).first()[0] or 0) // QUERIES))
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")
    found = Found(held, materialize(asked.select("query_id", *SCOPE, "avgdl", part, F.col("x.term").alias("terms"), F.col("x.idf").alias("idf")), "lists-queries"), parts, k)
    bound = F.col("idf") * share(F.col("max_tf"), F.col("min_dl"), settings)
    bounds = held.join(weights, [*SCOPE, "term"]).groupBy("query_id", "block")
    ranges = materialize(bounds.agg(F.sum(bound).alias("most"), F.max("max_importance").alias("top"), F.max("n").alias("n")), "lists-ranges")
    promise = F.struct((F.col("n") >= k).alias("enough"), (F.col("most") * F.col("top")).alias("score"), "block")
    first = ranges.groupBy("query_id").agg(F.max(promise)["block"].alias("block"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("created_at").desc(), "doc_id")  # at most k rows of each range
    sample = _scored(found, first, settings).withColumn("place", F.row_number().over(order))
    least = materialize(sample.where(F.col("place") == max(k, 1)).select("query_id", F.col("score").alias("least")), "lists-least")
    highest = ranges.groupBy("query_id").agg(F.max("top").alias("highest"))
    # what is returned scores ``least`` or more, so its bm25 is least / highest or more; so is the bm25 of all that ranks above it
    floor = highest.join(least, "query_id", "left").select("query_id", (F.greatest(F.coalesce("least", F.lit(0.0)), F.lit(float(settings.min_score))) / F.col("highest") * (1.0 - _SLACK)).alias("floor"))
    needed = materialize(ranges.join(floor, "query_id").where(F.col("most") >= F.col("floor")).select("query_id", "block"), "lists-needed")
    rows = _scored(found, needed, settings).withColumn("position", F.row_number().over(order).cast("long") - 1).where(F.col("position") < k)
    return _ranked(found, needed, materialize(rows, "lists-best"), settings)
