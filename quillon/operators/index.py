"""The retrieval index as tables under a folder: batches of events are appended, numbered on and counted.

``entries`` is partitioned by batch and by a hash of the scope, ``lists`` are inverted lists by batch and
a hash of scope and term, ``identifiers`` are those that entries name, ``terms`` holds the document frequencies and ``scopes`` the numbers of
entries and tokens that each batch adds. A batch counts
once its ``scopes`` are written, which is done last; nothing that was written is written again. So
an append costs what it adds, a replayed batch changes nothing, and a question about few scopes
reads few partitions. One writer at a time.

An index for each (policy, budget) is a folder of its own under a common root.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import events as ev
from quillon.operators import postings
from quillon.operators import retrieve as rt
from quillon.operators.scopes import asked, bucket, only
from quillon.plans.settings import Retrieval, retrieval_for
from quillon.sources.tables import committed, hadoop_path, materialize, no_shuffle_left, release

SCOPE = ev.SCOPE
STATS = "app_name string, user_id string, n_docs long, n_tokens long"
IDENTIFIERS = "app_name string, user_id string, doc_id long, space int, key string"
TERMS = "app_name string, user_id string, term string, df long"


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that are wholly written."""
    return committed(spark, f"{path}/scopes")


def _read(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame | None:
    done = batches(spark, path)
    if not done:
        return spark.createDataFrame([], schema) if schema else None
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/batch={b}" for b in done])


def append(path: str, events: DataFrame, settings: Retrieval = Retrieval(), order: str = "seq", tools: bool = True, batch: int | None = None) -> int:
    """Add events to the index as one batch, numbered on from the entries of their scopes; the batch's number.

    A ``batch`` that is already there is left as it is. An ``embedding`` column is kept.
    """
    spark = events.sparkSession
    done = batches(spark, path)
    batch = (done[-1] + 1 if done else 1) if batch is None else batch
    if batch in done:
        return batch
    rows = materialize(ev.analysed(events, settings, order, tools).withColumn("_row", F.monotonically_increasing_id()), "index-rows")
    placed = ev.numbered(rows, ["_seq"], scope_counts(spark, path).select(*SCOPE, "n_docs"))
    release(rows)
    by = [bucket(), *SCOPE, "doc_id"]
    laid = placed.drop("_seq").withColumn("bucket", bucket()).repartitionByRange(*by).sortWithinPartitions(*by)
    with no_shuffle_left(spark):
        laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/entries/batch={batch}")
        new = spark.read.schema(laid.schema).parquet(f"{path}/entries/batch={batch}").drop("bucket")
        release(placed)  # the entries are there once, and all else is made of them
        postings.write(new, f"{path}/lists/batch={batch}")
        rt.identifiers(new).withColumn("bucket", bucket()).repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(postings.FILES))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/identifiers/batch={batch}")
        ev.document_frequency(new).write.mode("overwrite").parquet(f"{path}/terms/batch={batch}")
        counts = new.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        counts.write.mode("overwrite").parquet(f"{path}/scopes/batch={batch}")
    return batch


def entries(spark: SparkSession, path: str, scopes: list[tuple[str, str]] | None = None, queries: DataFrame | None = None) -> DataFrame | None:
    """The entries of all batches, for ``retrieve``; None if there are none. With ``scopes`` only these; with ``queries`` only the partitions of their scopes."""
    rows = _read(spark, path, "entries")
    if rows is None:
        return None
    if scopes is not None:
        rows = only(rows, scopes)
    if queries is not None:
        rows = asked(rows, queries)
    rows = rows.drop("bucket", "batch")
    rows._quillon_path = None
    rows._quillon_stored = True
    return rows


def scope_counts(spark: SparkSession, path: str) -> DataFrame:
    """(app_name, user_id, n_docs, n_tokens) of each scope."""
    return _read(spark, path, "scopes", STATS).groupBy(*SCOPE).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def document_frequency(spark: SparkSession, path: str) -> DataFrame:
    """(app_name, user_id, term, df), summed over the batches."""
    return _read(spark, path, "terms", TERMS).groupBy(*SCOPE, "term").agg(F.sum("df").alias("df"))


def lists(spark: SparkSession, path: str, queries: DataFrame | None = None) -> rt.Lists:
    """Inverted lists, document frequencies, counts and identifiers of an index that has batches; of the last with ``queries`` only the partitions of their scopes."""
    named = _read(spark, path, "identifiers", IDENTIFIERS + ", batch int, bucket int")
    named = (named if queries is None else asked(named, queries)).drop("bucket", "batch")
    return rt.Lists(_read(spark, path, "lists").drop("batch"), document_frequency(spark, path), scope_counts(spark, path), named)


def retrieve(path: str, queries: DataFrame, mode: str = "fused", settings: Retrieval = Retrieval(), top_k: int | None = None) -> DataFrame:
    """As ``retrieve.retrieve``, of the index at path; one without batches returns nothing."""
    scopes = materialize(queries.select(*SCOPE).distinct(), "index-scopes")
    held = entries(queries.sparkSession, path, queries=scopes)
    if held is None:
        empty = queries.sparkSession.createDataFrame([], "app_name string, user_id string, session_id string, doc_id long, text string, source_kind string, importance double, created_at double, tokens array<string>, n_tokens long, embedding array<double>")
        return rt.retrieve(empty, queries, mode, settings, top_k)
    return rt.retrieve(held, queries, mode, settings, top_k, lists(queries.sparkSession, path, scopes))


def policy_path(root: str, policy: str, budget: int) -> str:
    return f"{root}/policy={quote(policy, safe='')}/budget={int(budget)}"


def store_for(root: str, events: DataFrame, policy: str, budget: int, config: Mapping[str, Any], **options) -> int:
    """Append events to the index of one (policy, budget), under the settings of its configuration."""
    return append(policy_path(root, policy, budget), events, retrieval_for(policy, config), **options)


def retrieve_for(root: str, queries: DataFrame, policy: str, budget: int, config: Mapping[str, Any], mode: str, top_k: int) -> DataFrame:
    """The best entries of the index of one (policy, budget)."""
    return retrieve(policy_path(root, policy, budget), queries, mode, retrieval_for(policy, config), top_k)


def reset(spark: SparkSession, root: str) -> None:
    """Forget every index under root."""
    fs, p = hadoop_path(spark, root)
    fs.delete(p, True)
