"""Rendering ranked entries as one bounded prompt text for each query.

Lines are taken in rank order; one that would exceed the budget is skipped and later, shorter ones
still get their chance. Line breaks and the header do not count against the budget, the final cut
of the whole text does. A query without a line has no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx

# -- fixed values: results depend on them ----------------------------------------------------------
LINE_CHARS = 420
INDEX_HEADER = "Retrieved matched-index memory. Use only when relevant to the latest user request; do not override newer session context.\n"
STORE_HEADER = "Retrieved long-term memory. Use only when relevant to the latest user request; do not override newer session context.\n"
# ----------------------------------------------------------------------------------------------


def pack(lines: Column, budget: int | Column) -> Column:
    """Of array<string>, those that fit one after the other in budget characters; what does not fit is skipped."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("taken"))

    def step(acc: Column, line: Column) -> Column:
        fits = acc["used"] + F.length(line) <= budget
        return F.struct(
            (acc["used"] + F.when(fits, F.length(line)).otherwise(0)).cast("long").alias("used"),
            F.when(fits, F.concat(acc["taken"], F.array(line))).otherwise(acc["taken"]).alias("taken"),
        )

    return F.aggregate(lines, start, step, lambda a: a["taken"])


def _render(results: DataFrame, line: Column, header: str, max_chars: int, cut) -> DataFrame:
    ranked = results.select("query_id", F.struct("position", line.alias("line")).alias("x")).groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    taken = pack(F.transform("xs", lambda x: x["line"]), max_chars)
    return ranked.select("query_id", taken.alias("taken")).where(F.size("taken") > 0).select("query_id", F.lit("user").alias("role"), cut(F.concat(F.lit(header), F.array_join("taken", "\n"))).alias("text"))


def _text() -> Column:
    return tx.truncate(tx.normalize("text"), LINE_CHARS)


def index_context(results: DataFrame, max_chars: int) -> DataFrame:
    """(query_id, role, text) of multi-signal results (query_id, position, source_kind, session_id, text); cut hard."""
    line = F.concat(F.lit("- "), F.coalesce("source_kind", F.lit("memory")), F.lit(" session="), F.coalesce("session_id", F.lit("")), F.lit(": "), _text())
    return _render(results, line, INDEX_HEADER, max_chars, lambda c: F.substring(c, 1, max_chars))


def store_context(results: DataFrame, max_chars: int) -> DataFrame:
    """(query_id, role, text) of results of the hashed store; the session shows only where there is one; cut with an ellipsis."""
    session = F.coalesce("session_id", F.lit(""))
    line = F.concat(F.lit("- "), F.col("source_kind"), F.when(F.length(session) > 0, F.concat(F.lit(" session="), session)).otherwise(""), F.lit(": "), _text())
    return _render(results, line, STORE_HEADER, max_chars, lambda c: tx.truncate(c, max_chars))
