"""Multi-signal retrieval for many queries at once.

Entries and queries meet on the scope (app_name, user_id) alone, so no row of another scope can be
returned. Document frequencies and counts are of the whole scope; average length, newest time,
largest score and ranks are of a query's candidates, after the session filter and the identifier
guard. Lexical scores are an equi-join on (scope, term) with entry terms that some query of the
scope has; they never touch entries without a shared term. The ``bm25`` mode without filters reads
nothing else, of a stored index its inverted lists (``postings``), and of these only ranges of documents
that can hold a result. The ``dense`` mode without filters compares blocks of vectors (``dense``), all
else blocks of entries with tokens and vectors (``blocks``); neither returns pairs.

Entries and queries are written tables (or are written first), so that no text is analysed twice and
their sizes in bytes are known: which side of a join is broadcast is decided by them, within the
session's threshold. Hot scopes are left to adaptive skew joins. No window holds all of a query's
rows: the best are cut to k in each task, and ranks of those that are returned are counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as tx
from quillon.operators import events as ev
from quillon.operators import blocks
from quillon.operators import dense as dense_blocks
from quillon.operators import postings
from quillon.plans.settings import MODES, Retrieval
from quillon.sources.tables import is_stored, materialize, stored

SCOPE = ev.SCOPE


@dataclass(frozen=True)
class Lists:
    """What a stored index has beside its entries: ``postings`` blocks, (*SCOPE, term, df), (*SCOPE, n_docs, n_tokens), ``identifiers``."""

    blocks: DataFrame
    df: DataFrame
    scopes: DataFrame
    identifiers: DataFrame | None = None


def analysed(queries: DataFrame, settings: Retrieval) -> DataFrame:
    """Queries that are not blank, with their distinct terms, identifiers and dense weight."""
    keys = tx.identifier_keys("text")
    precise = tx.has_identifier(F.col("q_keys")) | tx.has_anchor("q_text")
    extra = [F.col("q_embedding")] if "q_embedding" in queries.columns else []
    return (
        queries.where(F.length(tx.normalize("text")) > 0)
        .select("query_id", *SCOPE, (F.col("session_id") if "session_id" in queries.columns else F.lit("")).alias("q_session"), F.col("text").alias("q_text"), keys.alias("q_keys"), F.array_distinct(tx.tokens("text")).alias("q_terms"), *extra)
        .withColumn("w", F.when(precise, settings.dense_weight).otherwise(settings.semantic_dense_weight))
    )


def identifiers(entries: DataFrame) -> DataFrame:
    """(*SCOPE, doc_id, space, key): the identifiers that each entry names, once each."""
    return entries.select(*SCOPE, "doc_id", F.explode(tx.identifier_list(tx.identifier_keys("text"))).alias("x")).select(*SCOPE, "doc_id", "x.space", "x.key")


def _lengths(entries: DataFrame, q: DataFrame, candidates: DataFrame | None, lists: Lists | None = None) -> DataFrame:
    """(query_id, n, avgdl): entries of the scope, and average length of the candidates, which are the whole scope if None."""
    average = lambda c: F.greatest(F.lit(1.0), c).alias("avgdl")
    if lists is None:
        scopes = entries.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n"), average(F.avg("n_tokens")))
    else:
        scopes = lists.scopes.select(*SCOPE, F.col("n_docs").alias("n"), average(F.col("n_tokens") / F.col("n_docs")))
    scope = q.select("query_id", *SCOPE).join(scopes, SCOPE).select("query_id", "n", "avgdl")
    return scope if candidates is None else scope.drop("avgdl").join(candidates.groupBy("query_id").agg(average(F.avg("dl"))), "query_id")


def _query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", *SCOPE, F.explode("q_terms").alias("term"))


def _weights(q_terms: DataFrame, df: DataFrame, lengths: DataFrame) -> DataFrame:
    """(query_id, *SCOPE, term, idf, avgdl)."""
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return q_terms.join(df, [*SCOPE, "term"]).join(lengths, "query_id").select("query_id", *SCOPE, "term", idf.alias("idf"), "avgdl")


def lexical(entries: DataFrame, queries: DataFrame, lengths: DataFrame, settings: Retrieval, also: tuple[str, ...] = (), lists: Lists | None = None) -> DataFrame:
    """(query_id, doc_id, *also, bm25) of all pairs that share a term; lengths: (query_id, n, avgdl) as ``_lengths`` has them."""
    q_terms = _query_terms(queries)
    known = q_terms.select(*SCOPE, "term").distinct()
    if lists is None:
        e_terms = (
            entries.select(*SCOPE, "doc_id", *also, F.col("n_tokens").alias("dl"), F.explode("tokens").alias("term"))
            .join(known, [*SCOPE, "term"], "left_semi")
            .groupBy(*SCOPE, "doc_id", *also, "dl", "term")
            .agg(F.count(F.lit(1)).alias("tf"))
        )
        df = e_terms.groupBy(*SCOPE, "term").agg(F.count(F.lit(1)).alias("df"))
    else:
        found = postings.of_terms(lists.blocks, known).select(*SCOPE, "term", F.explode("docs").alias("p"))
        e_terms, df = found.select(*SCOPE, "term", "p.doc_id", "p.tf", "p.dl", *[F.col(f"p.{c}") for c in also]), lists.df.join(known, [*SCOPE, "term"], "left_semi")
    one = F.col("idf") * postings.share(F.col("tf"), F.col("dl"), settings)
    return e_terms.join(_weights(q_terms, df, lengths), [*SCOPE, "term"]).groupBy("query_id", "doc_id", *also).agg(postings.total(one).alias("bm25"))


def _first(rows: DataFrame, k: int, *by: Column | str, name: str = "_n") -> DataFrame:
    """The first k rows of each query, numbered from 1. Each task cuts its own rows to k before they are shuffled."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col(name) <= k)


def placed(rows: DataFrame, score: str, name: str) -> DataFrame:
    """rows of a written table (query_id, doc_id, ...) with their place among the query's rows by score, from 0.

    Queries are range-partitioned, so one with many rows is ranked by many tasks: each numbers its
    piece, and the pieces' counts, one row for each query and task, are summed up.
    """
    by = [F.col("query_id"), F.col(score).desc(), F.col("doc_id")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = materialize(rows.select("query_id", "doc_id", score).repartitionByRange(n, *by).sortWithinPartitions(*by).select("query_id", "doc_id", F.monotonically_increasing_id().alias("_at")), "ranks")
    piece = F.shiftright("_at", 33).alias("_piece")  # the number of the task
    sizes = at.groupBy("query_id", piece).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("query_id").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("query_id", "_piece", (before - F.col("_from")).alias("_shift"))
    places = at.select("*", piece).join(shift, ["query_id", "_piece"]).select("query_id", "doc_id", (F.col("_at") + F.col("_shift")).alias(name))
    return rows.join(places, ["query_id", "doc_id"])


def _best(rows: DataFrame, k: int, settings: Retrieval) -> DataFrame:
    """The k best of rows with scores; ``position`` counts from 0."""
    rows = rows.where(F.col("score") >= settings.min_score)
    return _first(rows, k, F.col("score").desc(), F.col("created_at").desc(), F.col("doc_id")).withColumn("position", (F.col("_n") - 1).cast("long")).drop("_n")


def retrieve(entries: DataFrame, queries: DataFrame, mode: str = "fused", settings: Retrieval = Retrieval(), top_k: int | None = None, lists: Lists | None = None) -> DataFrame:
    """The best entries of each query's scope, at most top_k, with their scores and ranks.

    queries: (query_id, app_name, user_id, text), session_id where sessions are filtered, q_embedding
    in all modes but bm25. entries: see ``events.entries``, with ``embedding`` in all modes but bm25.
    lists: of a stored index, used in place of the entries' tokens.
    Blank queries and empty scopes return nothing; an unknown mode or a negative top_k is an error.
    """
    if mode not in MODES:
        raise ValueError(f"unknown retrieval mode: {mode}")
    k = settings.top_k if top_k is None else int(top_k)
    if k < 0:
        raise ValueError("top_k must not be negative")
    if mode == "dense" and not is_stored(entries):
        entries = entries.drop("tokens")  # neither shuffled with the vectors nor written
    entries, q = stored(entries, "index-entries"), materialize(analysed(queries, settings), "index-queries")
    filtered = not settings.cross_session or settings.guard_identifiers
    if mode == "bm25" and not filtered and settings.min_score > 0:
        best = _lexical_only(entries, q, settings, k, lists)
    elif mode == "dense" and not filtered and settings.min_score > 0:
        best = _best(dense_blocks.best(entries, q, settings, k), k, settings)
    else:
        named = None
        if settings.guard_identifiers:
            named = lists.identifiers if lists is not None and lists.identifiers is not None else identifiers(entries)
        best = blocks.best(entries, q, mode, settings, k, named, None if lists is None else lists.df)
    shown = entries.select(*SCOPE, "doc_id", "text", "source_kind", "session_id")  # texts join the few rows that are returned
    return best.join(q.select("query_id", *SCOPE), "query_id").join(shown, [*SCOPE, "doc_id"]).select(
        "query_id", "position", "text", "score", F.col("dense").alias("dense_score"), F.col("bm25").alias("sparse_score"), "source_kind", "session_id", "created_at",
        "importance", "doc_id", "dense_rank", "sparse_rank", F.lit(mode).alias("retrieval_mode"), "dense_eligible", "sparse_eligible", F.lit(True).alias("retrieved"),
    )


def _lexical_only(entries: DataFrame, q: DataFrame, settings: Retrieval, k: int, lists: Lists | None) -> DataFrame:
    """The bm25 mode's best rows, all with a shared term as no other can pass a threshold above 0. Ranks are counted; dense_rank is the place in the scope."""
    lengths = _lengths(entries, q, None, lists)
    if lists is None:
        rows = lexical(entries, q, lengths, settings, also=("created_at", "importance"))
        rows = materialize(rows.where(F.col("bm25") > 0), "lexical")
        chosen = materialize(_best(rows.withColumn("score", F.col("bm25") * F.col("importance")), k, settings), "lexical-best")
        mine = chosen.select("query_id", F.col("doc_id").alias("_doc"), F.col("bm25").alias("_bm25"))
        before = (F.col("bm25") > F.col("_bm25")) | ((F.col("bm25") == F.col("_bm25")) & (F.col("doc_id") < F.col("_doc")))
        ranks = rows.select("query_id", "doc_id", "bm25").join(mine, "query_id").groupBy("query_id", "_doc").agg(F.count_if(before).alias("sparse_rank"))
        chosen = chosen.join(ranks.withColumnRenamed("_doc", "doc_id"), ["query_id", "doc_id"])
    else:
        terms = _query_terms(q)
        chosen = materialize(postings.best(lists.blocks, _weights(terms, lists.df.join(terms.select(*SCOPE, "term").distinct(), [*SCOPE, "term"], "left_semi"), lengths), settings, k), "lexical-best")
    return (
        chosen.withColumn("dense", F.lit(0.0))
        .withColumn("dense_rank", F.col("doc_id"))
        .withColumn("dense_eligible", F.lit(0.0) >= settings.min_score)
        .withColumn("sparse_eligible", F.col("bm25") > 0)
    )


def entries_by_policy(events_: DataFrame, policies: dict[tuple[str, int], Retrieval], **options) -> DataFrame:
    """Index entries of the same events under each (policy, budget), with its own settings."""
    out = None
    for (policy, budget), settings in policies.items():
        part = ev.entries(events_, settings, **options).withColumn("policy", F.lit(policy)).withColumn("budget", F.lit(budget))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no policies given")
    return out


def retrieve_by_policy(entries: DataFrame, queries: DataFrame, policies: dict[tuple[str, int], Retrieval], mode: str, top_k: int) -> DataFrame:
    """Retrieval where entries and queries carry ``policy`` and ``budget``: one separate index for each pair.

    ``policies`` is a value, not process state: forgetting it, or dropping a pair's rows, resets.
    """
    out = None
    for (policy, budget), settings in policies.items():
        mine = lambda df: df.where((F.col("policy") == policy) & (F.col("budget") == budget)).drop("policy", "budget")
        part = retrieve(mine(entries), mine(queries), mode, settings, top_k).withColumn("policy", F.lit(policy)).withColumn("budget", F.lit(budget))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no policies given")
    return out
