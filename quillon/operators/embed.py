"""Embeddings of texts by a model that you give: each distinct text once, kept between calls.

An encoder is a function from a pandas Series of strings to one float list each, or, where it is dear
to load, a ``Loader``: the worker loads it once and keeps it for later tasks. A cache is a folder for
one model and prefix. Each call that finds texts missing adds a batch of its own, which counts once it
is wholly written; a batch that a failed job left is written anew under the same number, so a retry
encodes again but leaves nothing twice. One writer at a time. A text without an entry in the cache is
encoded, null as the prefix alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.settings import Retrieval
from quillon.sources.tables import committed, materialize

Encode = Callable[[pd.Series], pd.Series]
_LOADED: dict[str, Encode] = {}


@dataclass(frozen=True)
class Loader:
    """A function that loads an encoder, and the name under which a worker keeps what it loaded."""

    name: str
    load: Callable[[], Encode]


def _loaded(encode: Encode | Loader) -> Encode:
    if not isinstance(encode, Loader):
        return encode
    if encode.name not in _LOADED:
        _LOADED[encode.name] = encode.load()
    return _LOADED[encode.name]


def _encoded(texts: DataFrame, encode: Encode | Loader, prefix: str, out: str) -> DataFrame:
    """(_t, out) of the rows (_t)."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _loaded(encode)
        for batch in batches:
            yield pd.Series(model(batch))

    return texts.withColumn(out, run(F.concat(F.lit(prefix), F.coalesce("_t", F.lit("")))))


def embedded(df: DataFrame, encode: Encode | Loader, text: str = "text", out: str = "embedding", prefix: str = "", cache: str | None = None) -> DataFrame:
    """df with the embeddings of its texts as ``out``; of a cache only texts that it lacks are encoded."""
    spark = df.sparkSession
    once = df.select(F.col(text).alias("_t")).distinct()
    if cache is None:
        vectors = _encoded(once, encode, prefix, out)
    else:
        done = committed(spark, cache)
        read = lambda: spark.read.schema(f"_t string, {out} array<float>").option("basePath", cache).parquet(*[f"{cache}/batch={b}" for b in committed(spark, cache)]).select("_t", out)
        missing = materialize(once.join(read().select(F.col("_t").alias("_k")), F.col("_t").eqNullSafe(F.col("_k")), "left_anti") if done else once, "texts-missing")
        if not done or missing.limit(1).count():
            _encoded(missing, encode, prefix, out).write.mode("overwrite").parquet(f"{cache}/batch={done[-1] + 1 if done else 1}")
        vectors = read()
    return df.join(vectors, F.col(text).eqNullSafe(F.col("_t"))).drop("_t")


def embedded_entries(entries: DataFrame, encode: Encode | Loader, cache: str | None = None) -> DataFrame:
    """Entries with ``embedding``; passages are encoded as they are."""
    return embedded(entries, encode, cache=cache)


def embedded_queries(queries: DataFrame, encode: Encode | Loader, settings: Retrieval = Retrieval(), cache: str | None = None) -> DataFrame:
    """Queries with ``q_embedding``, encoded after the settings' instruction."""
    return embedded(queries, encode, out="q_embedding", prefix=settings.query_prefix, cache=cache)
