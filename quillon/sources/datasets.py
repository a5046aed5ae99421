"""The driver's tables as events, entries, queries and histories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import events as ev
from quillon.plans.settings import Retrieval

USERS = ("en", "de", "fr", "es")
RECORDS = 7


LETTERS = "aeiourst"


def letter_counts(texts: pd.Series) -> pd.Series:
    """The registered queries' encoder, which SQL can express: how often each of LETTERS occurs in a text, and 1."""
    return pd.Series([[*(float(t.count(c)) for c in LETTERS), 1.0] for t in texts])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if its files have fewer splits than those: one row group of texts is too much for one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def document_events(spark: SparkSession, sf_dir: str, records: bool = False, vectors: bool = False) -> DataFrame:
    """Documents as events: user = lang, session = source, authors in turn, time = doc_id + 1; with ``records`` each names one, with ``vectors`` each has an embedding."""
    d = spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    text = F.concat(F.lit("Patient/SYN-"), (F.col("doc_id") % RECORDS).cast("string"), F.lit(" "), F.col("text")) if records else F.col("text")
    turn = F.col("doc_id") % 3
    rows = d.select(
        F.lit("app").alias("app_name"), F.col("lang").alias("user_id"), F.col("source").alias("session_id"), F.col("doc_id").cast("string").alias("event_id"),
        F.when(turn == 0, "user").when(turn == 1, "tool").otherwise("helper").alias("author"), F.when(turn == 0, "user").otherwise("model").alias("role"),
        (F.col("doc_id") + 1).cast("double").alias("timestamp"), F.col("doc_id").alias("seq"), ev.text_part(text).alias("parts"),
    )
    return _with_vector(spark, sf_dir, rows, "seq", "embedding") if vectors else rows


def _with_vector(spark: SparkSession, sf_dir: str, rows: DataFrame, number: str, name: str) -> DataFrame:
    """rows with an embedding each: the one whose vec_id is the row's number modulo the number of embeddings."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").alias(name))
    return rows.withColumn("_v", F.pmod(F.col(number), F.lit(vectors.count()))).join(vectors, "_v").drop("_v")


def entries(spark: SparkSession, sf_dir: str, vectors: bool = False, records: bool = False, settings: Retrieval = Retrieval()) -> DataFrame:
    """Index entries of the documents; with ``vectors`` each has one of the embeddings."""
    return ev.entries(document_events(spark, sf_dir, records, vectors), settings, tools=False)


def queries(spark: SparkSession, sf_dir: str, vectors: bool = False, records: bool = False) -> DataFrame:
    """Benchmark items as queries of each user."""
    b = read(spark, sf_dir, "benchmark").select("item_id", "text")
    if vectors:
        b = _with_vector(spark, sf_dir, b, "item_id", "q_embedding")
    if records:
        b = b.withColumn("text", F.concat(F.lit("Patient/SYN-"), (F.col("item_id") % RECORDS).cast("string"), F.lit(" "), F.col("text")))
    b = b.select("*", F.posexplode(F.array(*[F.lit(u) for u in USERS])).alias("i", "user_id"))
    return b.select((F.col("item_id") * 10 + F.col("i")).alias("query_id"), F.lit("app").alias("app_name"), "user_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("session_id"), "text", *(["q_embedding"] if vectors else []))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as events: user = conv_id % 10, session = conv_id, time = turn + 1."""
    c = read(spark, sf_dir, "conversations")
    return c.select(
        F.lit("app").alias("app_name"), (F.col("conv_id") % 10).cast("string").alias("user_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("string").alias("event_id"),
        F.lit("inv").alias("invocation_id"), F.col("role").alias("author"), F.when(F.col("role") == "assistant", "model").otherwise(F.col("role")).alias("role"),
        (F.col("turn") + 1).cast("double").alias("timestamp"), F.col("turn").alias("seq"), ev.text_part("text").alias("parts"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as model requests."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("pos"), "role", ev.text_part("text").alias("parts"))


def nested_payload() -> Column:
    """Payloads around the events' own: wrapped, inside a list of texts, lists, patients and timelines with deep objects, plain texts."""
    p, at = F.coalesce("props", F.lit("{}")), F.col("event_id").cast("string")
    deep = ['{"patients": [{"reference": "Patient/', at, '", "name": " N', at, ' "}, {"id": ', at, '}, {"name": ""}, 7], "status": "ok", "timeline": [{"at": ', at, ', "none": null}, 5, {"at": 1}, {"at": 0}], ']
    deep += ['"nested": {"deep": {"deeper": {"deepest": {"x": ', at, '}}}}, "raw_blob": "zz", "note": "", "list": [', p, ", 1, 2, 3]}"]
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    kind = F.col("event_id") % 5
    return (
        F.when(kind == 0, text('{"result": {"data": {"output": ', p, '}}, "other": 1}'))
        .when(kind == 1, F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), p.alias("text"))).alias("content"))))
        .when(kind == 2, text("[", p, ", ", at, ', "  text   of a list ", null, [1], "x"]'))
        .when(kind == 3, text(*deep))
        .otherwise(text('"  some   text ', at, ' "'))
    )


def tool_events(spark: SparkSession, sf_dir: str, nested: bool = False) -> DataFrame:
    """The events table as tool results, with ``nested`` around its payloads."""
    payload = nested_payload() if nested else F.col("props")
    part = F.struct(F.lit(None).cast("string").alias("text"), F.lit(False).alias("thought"), F.lit(None).cast("struct<name:string,args_json:string>").alias("function_call"), F.struct(F.col("event_type").alias("name"), payload.alias("response_json")).alias("function_response"))
    return read(spark, sf_dir, "events").select(
        F.lit("app").alias("app_name"), F.col("user_id").cast("string").alias("user_id"), F.lit("s").alias("session_id"), F.col("event_id").cast("string").alias("event_id"), F.lit("tool").alias("author"),
        F.lit("model").alias("role"), (F.col("event_id") + 1).cast("double").alias("timestamp"), F.col("event_id").alias("seq"), F.array(part).cast(ev.PARTS).alias("parts"),
    )


def part_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as events of three parts: a text, some of them thoughts, a tool call or nothing, and a tool result, some without name; some events are partial."""
    e = read(spark, sf_dir, "events")
    none, at = (lambda kind: F.lit(None).cast(f"struct<name:string,{kind}:string>")), F.col("event_id")
    plain = lambda text, thought, call, answer: F.struct(text.alias("text"), thought.alias("thought"), call.alias("function_call"), answer.alias("function_response"))
    no_text = F.lit(None).cast("string")
    said = plain(F.concat(F.lit("  Note on "), "event_type", F.lit("  number "), at.cast("string"), F.lit(" ")), at % 4 == 1, none("args_json"), none("response_json"))
    asked = plain(no_text, F.lit(False), F.when(at % 3 != 0, F.struct(F.col("event_type").alias("name"), F.col("props").alias("args_json"))), none("response_json"))
    told = plain(no_text, F.lit(None).cast("boolean"), none("args_json"), F.struct(F.when(at % 5 != 0, F.col("event_type")).alias("name"), F.col("props").alias("response_json")))
    return e.select(at.cast("string").alias("event_id"), (at % 7 == 6).alias("partial"), F.array(said, asked, told).cast(ev.PARTS).alias("parts"))
