"""All modes, with session filter and guard, in blocks: entries and queries of a scope meet as arrays and no pair is ever a row.

A task holds a block of entries, with their tokens and vectors, and up to QUERIES queries of their scope. Passes
over the blocks give sums and maxima of each query's candidates, then the best of each block, and last, for the
few rows that can be returned, how many candidates of a block come before them; what leaves a task is bounded by
k, and partial results are summed up. ``rrf``, whose score is made of ranks, takes the best of both lists so far
down that what lies beyond both cannot be returned; where that is not so yet, it takes four times as many.
Shares of BM25 are summed as integers, so equal texts tie exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as tx
from quillon.operators import events as ev
from quillon.operators.dense import Vectors, _vectors
from quillon.operators.postings import UNIT
from quillon.plans.settings import Retrieval
from quillon.sources.tables import materialize

SCOPE = ev.SCOPE
LEAST, MOST, BLOCKS, QUERIES, DEPTH = 4096, 32768, 128, 512, 256
KEYS = [*SCOPE, "block", "part"]
ROWS = "query_id long, doc_id long, created_at double, importance double, dense double, bm25 double, score double, arm int"


def _table(schema: str, *columns) -> pa.Table:
    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    names = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def _flat(lists: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """(values, first of each row) of a list column; null is empty."""
    c = lists.combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return c.flatten(), np.append(0, np.cumsum(pc.fill_null(c.value_lengths(), 0).to_numpy(zero_copy_only=False)))


class Meeting:
    """A block of entries and the queries of its scope."""

    def __init__(self, left: pa.Table, right: pa.Table, settings: Retrieval):
        self.settings, self.right = settings, right
        self.doc, self.at, self.weight, self.dl = (left.column(c).to_numpy() for c in ("doc_id", "created_at", "importance", "n_tokens"))
        self.query = right.column("query_id").to_numpy()
        self.session = left.column("session_id").to_pylist() if "q_session" in right.column_names else None
        self.lexical, self.vectors = "idf" in right.column_names, "q_embedding" in right.column_names
        if self.session is not None:
            self.session, self.wanted = np.array(self.session, object), right.column("q_session").to_pylist()
        if "q_ids" in right.column_names:
            self.named, self.named_at, self.ask, self.ask_at = self._hits(left.column("ids"), right.column("q_ids"))
            self.spaces = [x.split(":", 1)[0] for x in _flat(right.column("q_ids"))[0].to_pylist()]
        else:
            self.spaces = None
        if self.lexical:
            (at, found, self.term, self.term_at) = self._hits(left.column("tokens"), right.column("terms"))
            key, self.tf = np.unique(at * len(self.doc) + found, return_counts=True)
            self.of, self.hit = np.divmod(key, max(1, len(self.doc)))
            self.idf = _flat(right.column("idf"))[0].to_numpy()
            self.avgdl = right.column("avgdl").to_numpy()
        if self.vectors:
            (e, at), (q, of) = _vectors(left.column("embedding")), _vectors(right.column("q_embedding"))
            self.e, self.e_at, self.q, self.q_of, self.size, self.kept = e, at, q, of, np.diff(at), {}

    @staticmethod
    def _hits(lists: pa.ChunkedArray, asked: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
        """(number of the value, row) of what is asked in lists, (number, first of each row) of what is asked."""
        values, at = _flat(lists)
        wants, of = _flat(asked)
        known = wants.unique()
        number = pc.fill_null(pc.index_in(values, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        return number[number >= 0], row[number >= 0], pc.index_in(wants, known).to_numpy(zero_copy_only=False).astype(np.int64), of

    def _admitted(self, i: int) -> np.ndarray:
        some = np.ones(len(self.doc), bool)
        if self.session is not None and self.wanted[i]:
            some &= self.session == self.wanted[i]
        if self.spaces is not None:
            asked = range(self.ask_at[i], self.ask_at[i + 1])
            for space in {self.spaces[j] for j in asked}:
                has = np.zeros(len(self.doc), bool)
                has[self.named_at[np.isin(self.named, [self.ask[j] for j in asked if self.spaces[j] == space])]] = True
                some &= has
        return some

    def _bm25(self, i: int) -> np.ndarray:
        s, total = self.settings, np.zeros(len(self.doc), np.int64)
        for j in range(self.term_at[i], self.term_at[i + 1]):
            a, b = np.searchsorted(self.of, [self.term[j], self.term[j] + 1])
            rows, tf = self.hit[a:b], self.tf[a:b]
            length = (1.0 - s.b) + s.b * (self.dl[rows] / self.avgdl[i])
            total[rows] += np.rint(self.idf[j] * ((tf * (s.k1 + 1.0)) / (tf + s.k1 * length)) * UNIT).astype(np.int64)
        return total / UNIT

    def _dense(self, i: int) -> np.ndarray:
        """Cosines; what has no vector of the query's length, or nulls in it, has none."""
        out, v = np.full(len(self.doc), np.nan), self.q[self.q_of[i] : self.q_of[i + 1]]
        if len(v) == 0:
            return out
        if len(v) not in self.kept:
            rows = np.flatnonzero(self.size == len(v))
            self.kept[len(v)] = rows, Vectors(self.e[self.e_at[:-1][rows][:, None] + np.arange(len(v))])
        rows, m = self.kept[len(v)]
        out[rows] = m.cosines(v)
        return out

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(len(self.query)):
            yield i, np.flatnonzero(self._admitted(i))

    def pairs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(query, entries, cosines, BM25) of each query's candidates."""
        for i, rows in self.candidates():
            dense = self._dense(i)[rows] if self.vectors else np.zeros(len(rows))
            yield i, rows, dense, self._bm25(i)[rows] if self.lexical else np.zeros(len(rows))


def _before(values: np.ndarray, doc: np.ndarray, of: list, ids: list) -> np.ndarray:
    """How many (value, doc) come before each of (of, ids) by value downwards, then by doc; no value comes last."""
    values = np.where(np.isnan(values), -np.inf, values)
    of = np.array([-np.inf if x is None or np.isnan(x) else x for x in of])
    ordered = np.sort(values)
    lo, hi = np.searchsorted(ordered, of, "left"), np.searchsorted(ordered, of, "right")
    out = len(values) - hi
    for j in np.flatnonzero(hi > lo):
        out[j] += ((values == of[j]) & (doc < ids[j])).sum()
    return out


class Blocks:
    """Entries dealt in blocks, and how queries meet them."""

    def __init__(self, entries: DataFrame, q: DataFrame, settings: Retrieval, vectors: bool, lexical: bool, named: DataFrame | None):
        self.settings, self.lexical = settings, lexical
        self.filtered = not settings.cross_session or named is not None
        columns = ["doc_id", "created_at", "importance", "n_tokens", "session_id", *(["tokens"] if lexical else [])]
        clean = lambda c: F.when(F.forall(c, lambda x: x.isNotNull()), F.col(c).cast("array<double>")).otherwise(F.array().cast("array<double>"))
        e = entries.select(*SCOPE, *columns, *([F.coalesce(clean("embedding"), F.array().cast("array<double>")).alias("embedding")] if vectors else []))
        key = lambda space, name: F.concat(space.cast("string"), F.lit(":"), name)
        if named is not None:
            e = materialize(e.join(named.groupBy(*SCOPE, "doc_id").agg(F.collect_list(key(F.col("space"), F.col("key"))).alias("ids")), [*SCOPE, "doc_id"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>"))), "blocks-entries")
        known = F.lit(True)
        for c in SCOPE:
            known = known & F.col(c).isNotNull()
        counts = entries.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(1.0), F.avg("n_tokens")).alias("avgdl"), F.max("importance").alias("top"), F.max("created_at").alias("now"))
        self.scopes = materialize(counts.where(known), "blocks-scopes")
        total, self.largest, self.top = self.scopes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("top"), F.lit(0.0))).first()
        self.size = min(MOST, max(LEAST, -(-total // BLOCKS)))
        most = q.groupBy(*SCOPE).count().agg(F.max("count")).first()[0] or 0
        self.parts = max(1, -(-most // QUERIES))
        block = F.expr(f"doc_id div {self.size}").alias("block")
        self.entries = e.where(known).select("*", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))))
        self.ranges = self.scopes.select(*SCOPE, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {self.size}"))).alias("block"))
        ids = tx.identifier_list(F.col("q_keys"))
        self.q = q.where(known).select(
            *SCOPE, "query_id", *(["q_session"] if not settings.cross_session else []), "q_terms", "w", F.pmod(F.xxhash64("query_id"), F.lit(self.parts)).cast("int").alias("part"),
            *([F.coalesce(clean("q_embedding"), F.array().cast("array<double>")).alias("q_embedding")] if vectors else []),
            *([F.transform(ids, lambda x: key(x["space"], x["key"])).alias("q_ids")] if named is not None else []),
        )

    def run(self, queries: DataFrame, f: Callable[[Meeting], pa.Table], schema: str, tokens: bool = True) -> DataFrame:
        """f of every block and the queries of its scope."""
        settings = self.settings

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return _table(schema, *[[] for _ in schema.split(", ")])
            return f(Meeting(left, right, settings))

        left = self.entries if tokens else self.entries.drop("tokens", "embedding")
        return left.groupBy(*KEYS).cogroup(queries.join(self.ranges, SCOPE).groupBy(*KEYS)).applyInArrow(meet, schema)

    def weighed(self, df: DataFrame) -> DataFrame:
        """The queries with terms, idf and avgdl, the latter of their candidates; df: (*SCOPE, term, df)."""
        base = self.q.join(self.scopes.select(*SCOPE, "n", "avgdl"), SCOPE)
        if self.filtered:
            lengths = "query_id long, dl long, m long"

            def measure(m: Meeting) -> pa.Table:
                found = [(m.query[i], m.dl[rows].sum(), len(rows)) for i, rows in m.candidates()]
                return _table(lengths, *zip(*found, strict=True))

            mean = self.run(self.q.drop("q_terms", "q_embedding"), measure, lengths, tokens=False).groupBy("query_id").agg(F.sum("dl").alias("dl"), F.sum("m").alias("m"))
            base = base.drop("avgdl").join(mean, "query_id").where("m > 0").withColumn("avgdl", F.greatest(F.lit(1.0), F.col("dl") / F.col("m"))).drop("dl", "m")
        idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        terms = base.select(*SCOPE, "query_id", "n", F.explode("q_terms").alias("term")).join(df, [*SCOPE, "term"]).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", idf.alias("idf")))).alias("x"))
        none = lambda kind: F.array().cast(f"array<{kind}>")
        return base.join(terms, "query_id", "left").select(*[c for c in base.columns if c not in ("q_terms", "n")], F.coalesce("x.term", none("string")).alias("terms"), F.coalesce("x.idf", none("double")).alias("idf"))


def frequencies(entries: DataFrame, q: DataFrame) -> DataFrame:
    """(*SCOPE, term, df) of the queries' terms."""
    known = q.select(*SCOPE, F.explode("q_terms").alias("term")).distinct()
    return entries.select(*SCOPE, F.explode(F.array_distinct("tokens")).alias("term")).join(known, [*SCOPE, "term"], "left_semi").groupBy(*SCOPE, "term").agg(F.count(F.lit(1)).alias("df"))


def _ranked(b: Blocks, queries: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen with dense_rank and sparse_rank among the queries' candidates."""
    schema = "query_id long, doc_id long, dense_rank long, sparse_rank long"
    wanted = queries.join(chosen.groupBy("query_id").agg(F.collect_list(F.struct("doc_id", "dense", "bm25")).alias("c")), "query_id").select(*queries.columns, F.col("c.doc_id").alias("ids"), F.col("c.dense").alias("ds"), F.col("c.bm25").alias("bs"))

    def count(m: Meeting) -> pa.Table:
        ids, ds, bs = (m.right.column(c).to_pylist() for c in ("ids", "ds", "bs"))
        out = [(np.full(len(ids[i]), m.query[i]), ids[i], _before(dense, m.doc[rows], ds[i], ids[i]), _before(bm25, m.doc[rows], bs[i], ids[i])) for i, rows, dense, bm25 in m.pairs()]
        return _table(schema, *[np.concatenate(c) for c in zip(*out, strict=True)])

    ranks = b.run(wanted, count, schema).groupBy("query_id", "doc_id").agg(F.sum("dense_rank").alias("dense_rank"), F.sum("sparse_rank").alias("sparse_rank"))
    return chosen.join(ranks, ["query_id", "doc_id"])


def best(entries: DataFrame, q: DataFrame, mode: str, settings: Retrieval, k: int, named: DataFrame | None, df: DataFrame | None) -> DataFrame:
    """The rows that the mode returns, with scores, ranks and ``position``."""
    b = Blocks(entries, q, settings, mode != "bm25", mode != "dense", named)
    queries = materialize(b.weighed(frequencies(entries, q) if df is None else df) if b.lexical else b.q.drop("q_terms"), "blocks-queries")
    if mode in ("fused", "union", "cascade", "rrf"):
        stats = "query_id long, s_max double, now double"

        def peaks(m: Meeting) -> pa.Table:
            found = [(m.query[i], bm25.max(), m.at[rows].max()) for i, rows, _, bm25 in m.pairs() if len(rows)]
            return _table(stats, *(zip(*found, strict=True) if found else [[], [], []]))

        peak = b.run(queries.drop("q_embedding"), peaks, stats).groupBy("query_id").agg(F.max("s_max").alias("s_max"), F.max("now").alias("now"))
        queries = materialize(queries.join(peak, "query_id"), "blocks-peaks")
    order = [F.col("score").desc(), F.col("created_at").desc(), F.col("doc_id")]
    first = lambda rows, n, *by, over=("query_id",): rows.withColumn("_n", F.row_number().over(Window.partitionBy(*over).orderBy(*by))).where(F.col("_n") <= n)

    def rows_of(keep: Callable) -> Callable[[Meeting], pa.Table]:
        """The rows that keep(meeting, query, rows, dense, bm25) names, as (arm, places, scores)."""

        def run(m: Meeting) -> pa.Table:
            out = []
            for i, rows, dense, bm25 in m.pairs():
                for arm, some, score in keep(m, i, rows, dense, bm25):
                    at = rows[some]
                    out.append((np.full(len(some), m.query[i]), m.doc[at], m.at[at], m.weight[at], dense[some], bm25[some], score[some], np.full(len(some), arm, np.int32)))
            return _table(ROWS, *([np.concatenate(c) for c in zip(*out, strict=True)] if out else [[] for _ in range(8)]))

        return run

    whole = lambda rows: rows.withColumn("dense", F.when(~F.isnan("dense"), F.col("dense")))
    if mode == "rrf":
        rows = _reciprocal(b, queries, settings, k, rows_of, whole)
        out = first(rows, k, *order)
    else:

        def keep(m: Meeting, i: int, rows, dense, bm25):
            d = np.where(dense > 0, dense, 0.0)
            if mode in ("fused", "union", "cascade"):
                top, now, w = (m.right.column(c)[i].as_py() for c in ("s_max", "now", "w"))
                s = 1.0 / (1.0 + np.exp(-(bm25 - 0.5 * top))) if top > 0 else np.zeros(len(rows))
            if mode == "fused":
                score = w * d + (1.0 - w) * s + 1e-9 * np.power(0.5, np.maximum(0.0, now - m.at[rows]) / settings.half_life_seconds)
            elif mode == "union":
                score = np.maximum(d, s)
            elif mode == "cascade":
                score = bm25 if top > 0 else d
            else:
                score = bm25 if mode == "bm25" else d
            score = score * m.weight[rows]
            newest, doc = -m.at[rows], m.doc[rows]
            if mode == "union":
                for arm, by, ok in ((0, dense, dense >= settings.min_score), (1, bm25, bm25 > 0)):
                    some = np.flatnonzero(ok)
                    yield arm, some[np.lexsort((doc[some], newest[some], -by[some]))[:k]], score
            else:
                some = np.flatnonzero(score >= settings.min_score)
                yield 0, some[np.lexsort((doc[some], newest[some], -score[some]))[:k]], score

        found = materialize(whole(b.run(queries, rows_of(keep), ROWS)), "blocks-best")
        if mode == "union":
            by = F.when(F.col("arm") == 0, F.col("dense")).otherwise(F.col("bm25")).desc()
            chosen = first(found, k, by, *order[1:], over=("query_id", "arm")).drop("_n").dropDuplicates(["query_id", "doc_id"])
        else:
            chosen = first(found, k, *order).drop("_n")
        ranked = _ranked(b, queries, materialize(chosen, "blocks-chosen"))
        out = first(ranked, k, *([F.least("dense_rank", "sparse_rank"), F.greatest("dense", "bm25").desc(), F.col("doc_id")] if mode == "union" else order))
    return out.select("query_id", "doc_id", "created_at", "importance", "dense", "bm25", "score", "dense_rank", "sparse_rank", (F.col("dense") >= settings.min_score).alias("dense_eligible"), (F.col("bm25") > 0).alias("sparse_eligible"), (F.col("_n") - 1).cast("long").alias("position"))


def _reciprocal(b: Blocks, queries: DataFrame, settings: Retrieval, k: int, rows_of: Callable, whole: Callable) -> DataFrame:
    """All rows that rrf can return, with ranks and scores."""
    base, weights = settings.rrf_k + 1, (settings.dense_weight, settings.sparse_weight)
    depth = max(DEPTH, 4 * k)
    while True:

        def keep(m: Meeting, i: int, rows, dense, bm25, depth=depth):
            doc = m.doc[rows]
            for arm, by, ok in ((0, dense, dense >= settings.min_score), (1, bm25, bm25 > 0)):
                some = np.flatnonzero(ok)
                yield arm, some[np.lexsort((doc[some], -by[some]))[:depth]], by

        found = whole(b.run(queries, rows_of(keep), ROWS))
        # an arm's eligible rows come first in it, so the place among them is the rank
        place = F.row_number().over(Window.partitionBy("query_id", "arm").orderBy(F.col("score").desc(), "doc_id")) - 1
        part = F.when(F.col("arm") == 0, F.lit(weights[0])).otherwise(F.lit(weights[1])) / (F.col("_r") + base)
        listed = found.withColumn("_r", place).where(F.col("_r") < depth).withColumn("_part", part)
        same = ["query_id", "doc_id", "created_at", "importance", "bm25"]
        beyond = [F.when(F.count_if(F.col("arm") == a) == 0, F.lit(weights[a] / (depth + base))).otherwise(0.0) for a in (0, 1)]
        listed = materialize(listed.groupBy(*same).agg(F.max("dense").alias("dense"), (F.sum("_part") * F.col("importance")).alias("low"), ((F.sum("_part") + beyond[0] + beyond[1] + 1e-11) * F.col("importance")).alias("high")), "rrf-listed")
        least = listed.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("low").desc()))).where(F.col("_n") == max(k, 1)).select("query_id", F.col("low").alias("least"))
        floor = F.greatest(F.coalesce("least", F.lit(0.0)), F.lit(float(settings.rrf_min_score))) * (1.0 - 1e-9)
        reach = b.top * (sum(weights) / (depth + base) + 1e-11)  # the most that a row beyond both lists can score
        if depth >= b.largest or queries.select("query_id").join(least, "query_id", "left").where(floor <= reach).limit(1).count() == 0:
            break
        depth *= 4
    chosen = materialize(listed.join(least, "query_id", "left").where(F.col("high") >= floor).select(*same, "dense"), "rrf-chosen")
    rows = _ranked(b, queries, chosen).join(queries.select("query_id", "now"), "query_id")
    reciprocal = lambda a, rank, ok: F.when(ok, F.lit(weights[a]) / (F.col(rank) + base)).otherwise(0.0)
    decay = F.pow(F.lit(0.5), F.greatest(F.lit(0.0), F.col("now") - F.col("created_at")) / settings.half_life_seconds)
    score = reciprocal(0, "dense_rank", F.col("dense") >= settings.min_score) + reciprocal(1, "sparse_rank", F.col("bm25") > 0) + 1e-12 * decay
    return rows.withColumn("score", score * F.col("importance")).where(F.col("score") >= settings.rrf_min_score)
