"""Compaction of histories to a character budget.

Histories of any number are compacted in one job: the recent window is a row_number limit, so each
history is an array of at most ``recent_events`` items, on which the budget walks are array folds.
If all texts fit they stay; else the newest that fit are kept (the newest always; gaps may arise),
and one memory text made of the best lines of the others comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as tx
from quillon.operators.events import context_text, event_role, events, exact_text, text_part
from quillon.plans.settings import Compaction

# -- fixed values: results depend on them ----------------------------------------------------------
LINE_CHARS, LEAST_BUDGET = 500, 500
USER_BONUS, RESULT_BONUS, CALL_BONUS, RECORD_BONUS, ASSISTANT_MALUS = 40, 35, 20, 18, 20
MEMORY_ID = "context-memory"
EVENTS_HEADER = "Compressed prior conversation memory. Use it only as background; the latest user request and the following recent messages are authoritative.\n"
CONTENTS_HEADER = "Compressed prior conversation memory. Use it only as background; the latest user request is authoritative.\n"
EVENTS_FALLBACK = "- Older conversation context was omitted because it exceeded the context budget."
CONTENTS_FALLBACK = "- Older model-request context was omitted because it exceeded the context budget."
# ----------------------------------------------------------------------------------------------


def line_score(line: Column, index: Column, total: Column) -> Column:
    low = F.lower(line)
    has = lambda s: F.contains(low, F.lit(s))
    bonus = lambda when, n: F.when(when, n).otherwise(F.lit(0))
    return (
        index
        + bonus(F.startswith(low, F.lit("- user:")), total + USER_BONUS)
        + bonus(has("tool result summary:"), total + RESULT_BONUS)
        + bonus(has("tool call:"), total + CALL_BONUS)
        + bonus(has("patient/") | has("pmid") | has("fhir"), F.lit(RECORD_BONUS))
        - bonus(F.startswith(low, F.lit("- assistant:")), F.lit(ASSISTANT_MALUS))
    )


def best_lines(lines: Column, budget: Column) -> Column:
    """Of array<string>: repeats dropped, greedily by score what fits in budget, in their first order."""
    total = F.size(lines)
    rated = F.transform(lines, lambda x, i: F.struct((-line_score(x, i, total)).cast("long").alias("rank"), i.cast("long").alias("i"), x.alias("line"), tx.text_key(x).alias("key")))
    once = F.filter(rated, lambda x, i: (F.length(x["key"]) > 0) & ~F.exists(F.slice(rated, F.lit(1), i), lambda y: y["key"] == x["key"]))
    chosen = "array<struct<i:bigint,line:string>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(chosen).alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + F.length(x["line"]) <= budget
        return F.struct(
            (acc["used"] + F.when(fits, F.length(x["line"])).otherwise(0)).cast("long").alias("used"),
            F.when(fits, F.concat(acc["taken"], F.array(F.struct(x["i"].alias("i"), x["line"].alias("line"))))).otherwise(acc["taken"]).cast(chosen).alias("taken"),
        )

    taken = F.aggregate(F.array_sort(once), start, step, lambda a: a["taken"])
    return F.transform(F.array_sort(taken), lambda x: x["line"])


def kept_places(items: Column, budget: Column) -> Column:
    """Places of array<struct<place, text, ...>> that are kept, walking from the newest."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] + F.length(x["text"]) <= budget) | (F.size(acc["kept"]) == 0)
        return F.struct(
            (acc["used"] + F.when(fits, F.length(x["text"])).otherwise(0)).cast("long").alias("used"),
            F.when(fits, F.concat(acc["kept"], F.array(x["place"]))).otherwise(acc["kept"]).alias("kept"),
        )

    return F.aggregate(F.reverse(items), start, step, lambda a: a["kept"])


def recent(df: DataFrame, keys: list[str], order: str, n: int, place: str | None = None) -> DataFrame:
    """The last n rows of each history; ``place`` names a column for their places, all different, the last being -1."""
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    out = df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n)
    return (out.withColumn(place, -F.col("_n").cast("long")) if place else out).drop("_n")


def _packed(rows: DataFrame, keys: list[str], budget: Column, memory_chars: int, header: str, fallback: str) -> DataFrame:
    """One row a history: items (place, text, line, ...) sorted, kept places, and memory text or null.

    rows: keys, _budget and ``item``, a struct that begins with place, text, line.
    """
    memory = F.least(F.lit(memory_chars), F.greatest(F.lit(LEAST_BUDGET), F.floor(budget / 4))).cast("long")
    return (
        rows.groupBy(*keys, "_budget")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
        .withColumn("_total", F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"])))
        .withColumn("_memory", memory)
        .withColumn("_keep", F.greatest(F.lit(LEAST_BUDGET).cast("long"), budget - F.col("_memory")))
        .withColumn("kept", F.when(F.col("_total") <= budget, F.transform("items", lambda x: x["place"])).otherwise(kept_places(F.col("items"), F.col("_keep"))))
        .withColumn("over", F.filter("items", lambda x: ~F.array_contains("kept", x["place"])))
        .withColumn("_lines", best_lines(F.transform("over", lambda x: x["line"]), F.col("_memory")))
        .withColumn("_lines", F.when(F.size("_lines") > 0, F.col("_lines")).otherwise(F.array(F.lit(fallback))))
        .withColumn("memory", F.when(F.size("over") > 0, tx.truncate(F.concat(F.lit(header), F.array_join("_lines", "\n")), F.col("_memory").cast("int"))))
    )


def compact_events(df: DataFrame, settings: Compaction = Compaction(), keys: list[str] | None = None, order: str = "seq", tools: bool = True) -> DataFrame:
    """Compacted histories of events: keys, position, author, role, event_id, invocation_id, timestamp, text, parts, is_memory.

    A history is the events of one (app_name, user_id, session_id), or of ``keys``, ordered by ``order``;
    events with equal ``order`` have each a place of its own, in any order.
    """
    keys = keys or ["app_name", "user_id", "session_id"]
    df = recent(events(df), keys, order, settings.recent_events, "_place")
    df = context_text(df, settings, tools=tools).where(F.length("context_text") > 0).withColumn("_role", event_role())
    author = F.when(F.length(F.coalesce("author", F.lit(""))) > 0, F.col("author")).otherwise(F.col("_role"))
    label = F.when(F.col("_role").isin("model", "assistant") & ~author.isin("user", "model"), author).when(F.col("_role") == "model", "assistant").otherwise(F.col("_role"))
    line = F.concat(F.lit("- "), label, F.lit(": "), tx.truncate(tx.normalize("context_text"), LINE_CHARS))
    item = F.struct(F.col("_place").alias("place"), F.col("context_text").alias("text"), line.alias("line"), "author", F.col("_role").alias("role"), "event_id", "invocation_id", "timestamp")
    packed = _packed(df.select(*keys, F.lit(settings.context_chars).cast("long").alias("_budget"), item.alias("item")), keys, F.col("_budget"), settings.memory_chars, EVENTS_HEADER, EVENTS_FALLBACK)
    none = F.lit(None).cast("string")
    oldest = F.get("over", F.lit(0))
    made = F.struct(F.lit(None).cast("long").alias("place"), F.col("memory").alias("text"), none.alias("line"), F.lit("user").alias("author"), F.lit("user").alias("role"), F.lit(MEMORY_ID).alias("event_id"), F.coalesce(oldest["invocation_id"], F.lit("")).alias("invocation_id"), F.coalesce(oldest["timestamp"], F.lit(0.0)).alias("timestamp"))
    kept = F.filter("items", lambda x: F.array_contains("kept", x["place"]))
    out = packed.select(*keys, F.posexplode(F.when(F.col("memory").isNotNull(), F.concat(F.array(made), kept)).otherwise(kept)).alias("position", "x"))
    return out.select(*keys, F.col("position").cast("long").alias("position"), "x.author", "x.role", "x.event_id", "x.invocation_id", "x.timestamp", "x.text", text_part(F.col("x.text")).alias("parts"), F.col("x.place").isNull().alias("is_memory"))


def compact_contents(df: DataFrame, settings: Compaction = Compaction(), key: str = "request_id", order: str = "pos", tools: bool = True) -> DataFrame:
    """Compacted model requests: key, position, role, text, parts, is_memory, is_current.

    df: key, order, role, parts and optionally ``current_user_text``. The current message is the last
    user content with that text, or the last one if none is given; it stays as it is, comes last, and
    what follows it is dropped. If the given text is not found, all contents are prior ones. Contents
    with equal ``order`` have each a place of its own, in any order; of those equal to the current one
    in order, role and text none is a prior one.
    """
    out = [key, "position", "role", "text", "parts", "is_memory", "is_current"]
    df = events(df)
    exact = exact_text()
    if settings.recent_events == 0:
        last = recent(df, [key], order, 1)
        return last.select(key, F.lit(0).cast("long").alias("position"), "role", exact.alias("text"), "parts", F.lit(False).alias("is_memory"), F.lit(True).alias("is_current"))
    wanted = tx.normalize("current_user_text") if "current_user_text" in df.columns else F.lit("")
    df = df.withColumn("_exact", exact).withColumn("_tie", F.xxhash64("role", "_exact"))
    is_current = (F.col("role") == "user") & ((wanted == "") | (tx.normalize("_exact") == wanted))
    place = F.struct(order, "_tie")
    # the current message is an aggregate, which sums up before it is shuffled; of the rest only the newest are sorted
    latest = df.where(is_current).groupBy(key).agg(F.max(place).alias("_at"), F.max_by(F.struct("role", "_exact", "parts"), place).alias("_cur"))
    current = latest.select(key, F.lit(1 << 62).alias("position"), "_cur.role", F.col("_cur._exact").alias("text"), "_cur.parts", F.lit(False).alias("is_memory"), F.lit(True).alias("is_current"))
    rest = df.drop("_exact").join(latest.select(key, "_at", F.length("_cur._exact").alias("_size")), key, "left").where(F.col("_at").isNull() | (place < F.col("_at")))
    budget = F.greatest(F.lit(LEAST_BUDGET), F.lit(settings.context_chars) - F.coalesce("_size", F.lit(0))).cast("long")
    prior = recent(rest, [key], order, settings.recent_events, "_place").withColumn("_budget", budget)
    prior = context_text(prior, settings, partial=False, tools=tools).where(F.length("context_text") > 0)
    role = F.when(F.col("role").isin("model", "assistant"), "model").otherwise("user")
    line = F.concat(F.when(role == "model", "- assistant: ").otherwise("- user: "), tx.truncate(tx.normalize("context_text"), LINE_CHARS))
    item = F.struct(F.col("_place").alias("place"), F.col("context_text").alias("text"), line.alias("line"), role.alias("role"))
    packed = _packed(prior.select(key, "_budget", item.alias("item")), [key], F.col("_budget"), settings.memory_chars, CONTENTS_HEADER, CONTENTS_FALLBACK)
    made = F.struct(F.lit(None).cast("long").alias("place"), F.col("memory").alias("text"), F.lit(None).cast("string").alias("line"), F.lit("user").alias("role"))
    kept = F.filter("items", lambda x: F.array_contains("kept", x["place"]))
    rows = packed.select(key, F.posexplode(F.when(F.col("memory").isNotNull(), F.concat(F.array(made), kept)).otherwise(kept)).alias("position", "x"))
    rows = rows.select(key, F.col("position").cast("long").alias("position"), "x.role", "x.text", text_part(F.col("x.text")).alias("parts"), F.col("x.place").isNull().alias("is_memory"), F.lit(False).alias("is_current"))
    both = rows.unionByName(current)
    return both.withColumn("position", (F.row_number().over(Window.partitionBy(key).orderBy("position")) - 1).cast("long")).select(out)
