"""Stored tables are partitioned by a hash of the scope; a question reads the partitions of its scopes alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 64


def bucket(app_name: str | Column = "app_name", user_id: str | Column = "user_id") -> Column:
    """The partition of a scope."""
    return F.pmod(F.xxhash64(app_name, user_id), F.lit(BUCKETS)).cast("int")


def asked(table: DataFrame, scopes: DataFrame) -> DataFrame:
    """The partitions of table, which has ``bucket``, that can hold a scope (app_name, user_id) of ``scopes``.

    At most BUCKETS numbers are broadcast, so the partitions are pruned while the query runs, by the scan itself,
    whatever the sizes of both sides. Other scopes of these partitions stay.
    """
    held = scopes.select(bucket().alias("bucket")).where(F.col("bucket") >= 0).distinct()  # Spark prunes only by what is filtered
    return table.join(F.broadcast(held), "bucket", "left_semi")


def only(table: DataFrame, scopes: list[tuple[str, str]]) -> DataFrame:
    """The rows of table, which has ``bucket``, of the few named scopes."""
    held = [r.b for r in table.sparkSession.createDataFrame(list(scopes), "app_name string, user_id string").select(bucket().alias("b")).distinct().collect()]
    of = F.lit(False)
    for app, user in scopes:
        of = of | ((F.col("app_name") == app) & (F.col("user_id") == user))
    return table.where(F.col("bucket").isin(held) & of)
