"""Events: parts to text, entries of the retrieval index, and their statistics.

An event is (app_name, user_id, session_id, event_id, invocation_id, author, role, partial,
timestamp, parts); a part is struct<text, thought, function_call<name, args_json>,
function_response<name, response_json>>. Missing columns count as null, and null parts as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as tx
from quillon.functions import tooljson
from quillon.plans.settings import Compaction, Retrieval
from quillon.sources.tables import materialize, release

PARTS = "array<struct<text:string,thought:boolean,function_call:struct<name:string,args_json:string>,function_response:struct<name:string,response_json:string>>>"
EVENT = {
    "app_name": "string", "user_id": "string", "session_id": "string", "event_id": "string", "invocation_id": "string",
    "author": "string", "role": "string", "partial": "boolean", "timestamp": "double", "parts": PARTS,
}
# -- fixed values: results depend on them ----------------------------------------------------------
MEMORY_ARGS, MEMORY_RESULT, CONTEXT_ARGS = 360, 500, 420
CALL, MEMORY_ANSWER, CONTEXT_ANSWER = "Tool call: ", "Tool result: ", "Tool result summary: "
# ----------------------------------------------------------------------------------------------


def events(df: DataFrame) -> DataFrame:
    """df with every event column, in its type; other columns stay."""
    out = df
    for c, kind in EVENT.items():
        out = out.withColumn(c, F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind))
    return out


def text_part(c: str | Column) -> Column:
    """A parts column with one text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array(F.struct(c.alias("text"), F.lit(False).alias("thought"), F.lit(None).cast("struct<name:string,args_json:string>").alias("function_call"), F.lit(None).cast("struct<name:string,response_json:string>").alias("function_response"))).cast(PARTS)


def _visible() -> Column:
    parts = F.filter(F.coalesce("parts", F.array().cast(PARTS)), lambda p: p.isNotNull())
    return F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False)))


def _with_tools(df: DataFrame, args: int, result: int, tools: bool) -> DataFrame:
    """df with _parts, _args and _results: the visible parts and their tools' texts; without ``tools`` no Python runs."""
    df = df.withColumn("_parts", _visible())
    if not tools:
        none = F.transform("_parts", lambda p: F.lit(None).cast("string"))
        return df.withColumn("_args", none).withColumn("_results", none)
    given = F.transform("_parts", lambda p: F.when(p["function_call"].isNotNull(), F.coalesce(p["function_call"]["args_json"], F.lit("null"))))
    back = F.transform("_parts", lambda p: F.when(p["function_response"].isNotNull(), F.coalesce(p["function_response"]["response_json"], F.lit("null"))))
    return df.withColumn("_args", tooljson.arguments(given, args)).withColumn("_results", tooljson.results(back, result))


def _name(part: Column) -> Column:
    return F.coalesce(part["name"], F.lit("tool"))


def _joined(lines: Column) -> Column:
    return tx.strip(F.array_join(F.filter(lines, lambda x: F.length(x) > 0), "\n"))


def memory_text(df: DataFrame, chars: int, tools: bool = True) -> DataFrame:
    """df with ``memory_text``: of each visible part its text, else its call, else its result; partial events are empty."""
    df = _with_tools(df, MEMORY_ARGS, MEMORY_RESULT, tools)

    def line(p: Column, i: Column) -> Column:
        return (
            F.when(F.length(p["text"]) > 0, tx.truncate(tx.normalize(p["text"]), chars))
            .when(p["function_call"].isNotNull(), F.concat(F.lit(CALL), _name(p["function_call"]), F.lit(" args="), F.get("_args", i)))
            .when(p["function_response"].isNotNull(), F.concat(F.lit(MEMORY_ANSWER), _name(p["function_response"]), F.lit(" summary="), F.get("_results", i)))
            .otherwise("")
        )

    text = tx.truncate(_joined(F.transform("_parts", line)), chars)
    return df.withColumn("memory_text", F.when(F.coalesce("partial", F.lit(False)), "").otherwise(text)).drop("_parts", "_args", "_results")


def context_text(df: DataFrame, settings: Compaction, partial: bool = True, tools: bool = True) -> DataFrame:
    """df with ``context_text``: of each visible part its text, call and result; partial events are empty if ``partial``."""
    df = _with_tools(df, CONTEXT_ARGS, settings.result_chars, tools)

    def lines(p: Column, i: Column) -> Column:
        shown = tx.truncate(tx.normalize(p["text"]), settings.text_chars)
        call = F.concat(F.lit(CALL), _name(p["function_call"]), F.lit(" args="), F.get("_args", i))
        answer = F.concat(F.lit(CONTEXT_ANSWER), _name(p["function_response"]), F.lit(" -> "), F.get("_results", i))
        return F.array(F.coalesce(shown, F.lit("")), F.when(p["function_call"].isNotNull(), call).otherwise(""), F.when(p["function_response"].isNotNull(), answer).otherwise(""))

    text = tx.truncate(_joined(F.flatten(F.transform("_parts", lines))), settings.event_chars)
    if partial:
        text = F.when(F.coalesce("partial", F.lit(False)), "").otherwise(text)
    return df.withColumn("context_text", text).drop("_parts", "_args", "_results")


def exact_text() -> Column:
    """The visible texts as they are, joined by line breaks and stripped."""
    return tx.strip(F.array_join(F.filter(F.transform(_visible(), lambda p: F.coalesce(p["text"], F.lit(""))), lambda t: F.length(t) > 0), "\n"))


def event_role() -> Column:
    role = tx.strip(F.coalesce("role", F.lit("")))
    return F.when(F.length(role) > 0, role).when(F.lower(F.coalesce("author", F.lit(""))) == "user", "user").otherwise("model")


def long_enough(c: str) -> Column:
    """Generates the column, once, for the rows in which it makes an entry; a filter would compute it a second time."""
    return F.explode(F.filter(F.array(F.col(c)), lambda t: F.length(t) >= tx.MIN_ENTRY_CHARS))


def created_at() -> Column:
    """The event's time in seconds; where it is missing or 0, now."""
    return F.coalesce(F.nullif("timestamp", F.lit(0.0)), F.unix_micros(F.current_timestamp()) / F.lit(1e6))


SCOPE = ["app_name", "user_id"]


def analysed(df: DataFrame, settings: Retrieval = Retrieval(), order: str = "seq", tools: bool = True) -> DataFrame:
    """Entries of events before they are numbered, with the ingest sequence as ``_seq``."""
    extra = ["embedding"] if "embedding" in df.columns else []
    df = memory_text(events(df), settings.entry_chars, tools)
    df = df.select(*[c for c in df.columns if c not in ("memory_text", "parts")], long_enough("memory_text").alias("memory_text")).withColumn("text", tx.normalize("memory_text"))
    df = df.withColumn("source_kind", tx.source_kind(F.col("text"), F.col("author"), F.col("role"))).withColumn("tokens", tx.tokens("text"))
    return df.select(
        *SCOPE, "session_id", F.col(order).alias("_seq"), "text", "source_kind", tx.importance(F.col("text"), F.col("source_kind")).alias("importance"),
        created_at().alias("created_at"), "tokens", F.size("tokens").cast("long").alias("n_tokens"), *extra,
    )


def numbered(rows: DataFrame, order: list[str], first: DataFrame | None = None) -> DataFrame:
    """rows, a written table with a unique ``_row``, with ``doc_id``: the place in its scope by ``order``, counted from 0 or from ``first``.

    Scopes are range-partitioned, so a large one is numbered by many tasks: each numbers its piece,
    and the pieces' counts, one row for each scope and task, are summed up. first: (*SCOPE, n_docs).
    """
    by = [*SCOPE, *order, "_row"]
    spark = rows.sparkSession
    narrow = rows.select(*by).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    placed = materialize(narrow.select(*SCOPE, "_row", F.monotonically_increasing_id().alias("_at")), "index-places")
    piece = F.shiftright("_at", 33).alias("_piece")  # the number of the task
    sizes = placed.groupBy(*SCOPE, piece).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*SCOPE).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*SCOPE, "_piece", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_shift"))
    if first is not None:
        same = [F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in SCOPE]
        shift = shift.alias("s").join(first.alias("f"), same, "left").select("s.*", "f.n_docs").withColumn("_shift", F.col("_shift") + F.coalesce("n_docs", F.lit(0))).drop("n_docs")
    null_safe = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in SCOPE]
    ids = placed.select("*", piece).alias("p").join(shift.alias("s"), [*null_safe, F.col("p._piece") == F.col("s._piece")]).select("p._row", (F.col("p._at") + F.col("s._shift")).alias("doc_id"))
    out = materialize(rows.join(ids, "_row").drop("_row"), "index-entries")
    release(placed)
    return out


def entries(df: DataFrame, settings: Retrieval = Retrieval(), order: str = "seq", tools: bool = True) -> DataFrame:
    """Index entries of events, written as a table. ``order`` names the ingest sequence; doc_id counts from 0 in each scope.

    Events whose text has fewer than 12 characters, before white space is normalised, are not entries.
    Equal places in the sequence are numbered in the order they are read. An ``embedding`` column is passed through.
    """
    rows = materialize(analysed(df, settings, order, tools).withColumn("_row", F.monotonically_increasing_id()), "index-rows")
    out = numbered(rows, ["_seq"])
    release(rows)
    slim = out.drop("_seq")
    slim._quillon_path = out._quillon_path
    return slim


def document_frequency(entries: DataFrame) -> DataFrame:
    """(app_name, user_id, term, df): in how many entries of a scope each term occurs."""
    terms = entries.select("app_name", "user_id", F.explode(F.array_distinct("tokens")).alias("term"))
    return terms.groupBy("app_name", "user_id", "term").agg(F.count(F.lit(1)).alias("df"))


def scope_stats(entries: DataFrame) -> DataFrame:
    """(app_name, user_id, n_docs, avgdl) of each scope."""
    return entries.groupBy("app_name", "user_id").agg(F.count(F.lit(1)).alias("n_docs"), F.greatest(F.lit(1.0), F.avg("n_tokens")).alias("avgdl"))
