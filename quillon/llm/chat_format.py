"""Chat formatting into budgeted training windows, with DataFrame functions only.

Every conversation is cut at turn borders into windows. Prefix sums of turn tokens (words plus a
constant for the marks) place each turn in a cell of fixed size: turns wholly inside a cell form
one window, a turn that crosses a cell's border is a window of its own. That needs no sequential
walk, so a conversation of any length is spread over tasks: sums are taken by blocks of turn
numbers first. A window repeats the conversation's system turn and the turns that fit in
``history`` tokens before it; of its own turns the assistant's texts are under the loss mask, what
is repeated is masked, so each assistant text is a target once.

Defined cases. Null text: empty. Null role: a role of its own, read back as null. Null conv_id:
one conversation. Null turn: before all others. Rows of one conversation with equal turn are
ordered by role, then text; repeated rows stay. Only a first turn with role ``system`` in a
conversation of two or more turns is retained. A turn is never cut or dropped: a window is above
the budget only if its system turn, or one turn, is too long. Other columns play no part.

Template: ``<s>[INST] text [/INST]</s>`` with OUT for assistant, SYS for system, ``ROLE:name`` for
other roles and NONE for null. In texts a backslash becomes ``\\e``; ``<`` and ``[`` that begin a
control string become ``\\l`` and ``\\b``; reading back reverses this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import clean_columns, table

BUDGET, HISTORY, MARKS, BLOCK = 2048, 256, 4, 128
TAGS = (("user", "INST"), ("assistant", "OUT"), ("system", "SYS"))


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\e"))
    c = F.regexp_replace(c, r"<(?=/?s>)", r"\\l")
    return F.regexp_replace(c, r"\[(?=/?(?:INST|OUT|SYS|ROLE|NONE)[\]:])", r"\\b")


def unescape(c: Column) -> Column:
    for a, b in (("\\l", "<"), ("\\b", "["), ("\\r", "]"), ("\\e", "\\")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _tags(role: Column) -> tuple[Column, Column]:
    name = F.replace(F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b")), F.lit("]"), F.lit("\\r"))
    begin, end = F.concat(F.lit("ROLE:"), name), F.lit("ROLE")
    for r, tag in TAGS:
        begin, end = F.when(role == r, tag).otherwise(begin), F.when(role == r, tag).otherwise(end)
    return F.when(role.isNull(), "NONE").otherwise(begin), F.when(role.isNull(), "NONE").otherwise(end)


def _marked(role: Column, text: Column) -> Column:
    """struct(before, body, after) of one turn."""
    begin, end = _tags(role)
    return F.struct(F.concat(F.lit("<s>["), begin, F.lit("] ")).alias("before"), escape(text).alias("body"), F.concat(F.lit(" [/"), end, F.lit("]</s>")).alias("after"))


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, n_turns, n_repeated, formatted, loss): loss is array<struct<start, length>> in code points.

    ``n_repeated`` turns at a window's beginning were in an earlier window already.
    """
    if not 0 <= history <= budget // 4:
        raise ValueError("history must be at most a quarter of the budget")
    rows = (
        clean_columns(conversations, "conv_id", "turn", "role", "text")
        .withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("k", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
        .withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))))
        .withColumn("tok", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + MARKS)
    )
    order = Window.partitionBy("k").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("k")
    blocks = (
        rows.groupBy("k", "block")
        .agg(F.sum("tok").alias("sum_tok"), F.count(F.lit(1)).alias("n"), F.min(F.struct("turn", "role", "text", "tok")).alias("head"))
        .withColumn("base", F.coalesce(F.sum("sum_tok").over(before), F.lit(0)))
        .withColumn("base_n", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("head", F.first("head").over(order))
        .withColumn("has_sys", (F.col("head.role") == "system") & (F.sum("n").over(whole) > 1))
        .withColumn("has_sys", F.coalesce("has_sys", F.lit(False)))
        .select("k", "block", "base", "base_n", "has_sys", F.when(F.col("has_sys"), F.col("head.text")).alias("sys"), F.when(F.col("has_sys"), F.col("head.tok")).otherwise(0).alias("sys_tok"))
    )
    inside = Window.partitionBy("k", "block").orderBy("turn", "role", "text")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cell = F.greatest(F.lit(budget - history) - F.col("sys_tok"), F.lit(budget // 4))
    turns = (
        rows.withColumn("cum", F.sum("tok").over(upto))
        .withColumn("rn", F.row_number().over(inside))
        .join(blocks, ["k", "block"])
        .withColumn("idx", F.col("base_n") + F.col("rn") - 1)
        .where("not (has_sys and idx = 0)")
        .withColumn("s", F.col("base") + F.col("cum") - F.col("tok") - F.col("sys_tok"))
        .withColumn("cell", cell.cast("long"))
        .withColumn("c", F.floor(F.col("s") / F.col("cell")))
        .withColumn("w", 2 * F.col("c") + F.when(F.col("s") + F.col("tok") <= (F.col("c") + 1) * F.col("cell"), 0).otherwise(1))
    )
    own = turns.groupBy("k", "w").agg(F.min("s").alias("start"))
    last = F.greatest(F.col("w"), 2 * F.floor((F.col("s") + history) / F.col("cell")) + 1)
    placed = (
        turns.withColumn("own", F.col("w"))
        .withColumn("w", F.explode(F.sequence("w", last)))
        .join(own, ["k", "w"])
        .where((F.col("own") == F.col("w")) | (F.col("s") >= F.col("start") - history))
        .withColumn("is_own", F.col("own") == F.col("w"))
        .withColumn("t", _marked(F.col("role"), F.col("text")))
        .withColumn("target", F.col("is_own") & F.coalesce(F.col("role") == "assistant", F.lit(False)))
    )
    pieces = F.array_sort("pieces")
    sys = _marked(F.lit("system"), F.col("sys"))
    zero = F.struct(F.coalesce(F.length("sys_text"), F.lit(0)).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["t"]["before"])
        span = F.array(F.struct(begin.cast("long").alias("start"), F.length(x["t"]["body"]).cast("long").alias("length")))
        return F.struct(
            (begin + F.length(x["t"]["body"]) + F.length(x["t"]["after"])).cast("long").alias("at"),
            F.when(x["target"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    joined = lambda t: F.concat(t["before"], t["body"], t["after"])
    return (
        placed.groupBy("k", "w")
        .agg(
            F.first("conv_id").alias("conv_id"),
            F.first("has_sys").alias("has_sys"),
            F.first("sys").alias("sys"),
            F.min(F.when(F.col("is_own"), F.col("idx"))).alias("first_own"),
            F.sum((~F.col("is_own")).cast("long")).alias("n_history"),
            F.collect_list(F.struct("idx", "t", "target")).alias("pieces"),
        )
        .withColumn("pieces", pieces)
        .withColumn("sys_text", F.when(F.col("has_sys"), joined(sys)))
        .withColumn("is_first", F.col("first_own") == F.col("has_sys").cast("long"))
        .select(
            "conv_id",
            F.col("w").alias("window"),
            (F.size("pieces") + F.col("has_sys").cast("int")).cast("long").alias("n_turns"),
            (F.col("n_history") + (F.col("has_sys") & ~F.col("is_first")).cast("long")).alias("n_repeated"),
            F.concat(F.coalesce("sys_text", F.lit("")), F.array_join(F.transform("pieces", lambda x: joined(x["t"])), "")).alias("formatted"),
            F.aggregate("pieces", zero, step, lambda a: a["spans"]).alias("loss"),
        )
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """windows with ``turns``: array<struct<role, text>> of the turns that are not repeated, parsed from ``formatted``."""
    parts = F.split("formatted", "</s>", -1)
    body = r"(?s)^<s>\[(INST|OUT|SYS|NONE|ROLE:[^\]]*)\] (.*) \[/(?:INST|OUT|SYS|NONE|ROLE)\]$"

    def parse(p: Column) -> Column:
        tag = F.regexp_extract(p, body, 1)
        role = unescape(F.substring(tag, 6, 1 << 30))
        for r, t in TAGS:
            role = F.when(tag == t, r).otherwise(role)
        return F.struct(F.when(tag != "NONE", role).alias("role"), unescape(F.regexp_extract(p, body, 2)).alias("text"))

    fresh = F.slice(parts, F.col("n_repeated").cast("int") + 1, (F.col("n_turns") - F.col("n_repeated")).cast("int"))
    return windows.withColumn("turns", F.transform(fresh, parse))


def digest(windows: DataFrame) -> DataFrame:
    """Per conversation, what the windows' texts and masks hold when they are read back."""
    w = read_turns(windows)
    said = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    target = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))), "")
    per = w.select("conv_id", "window", F.size("turns").cast("long").alias("n"), said.alias("said"), target.alias("target"), F.length("formatted").cast("long").alias("chars"))
    whole = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", c))), lambda x: x[c]), "")
    return (
        per.groupBy("conv_id")
        .agg(F.sum("n").alias("n_turns"), whole("said").alias("said"), whole("target").alias("target"), F.sum("chars").alias("formatted_chars"))
        .select(
            "conv_id",
            "n_turns",
            F.sha2("said", 256).alias("turns_sha256"),
            F.length("target").cast("long").alias("loss_chars"),
            F.sha2("target", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = clean_columns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    extra = spark.sql("select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    return digest(format_windows(conversations.unionByName(extra)))


SQL = rf"""
with rows0 as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (
  select *, row_number() over o - 1 as idx, count(*) over (partition by conv_id) as n,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {MARKS} as tok,
    length(text) + length(text) - length(replace(text, chr(92), ''))
      + len(regexp_extract_all(text, '</?s>')) + len(regexp_extract_all(text, '\[/?(?:INST|OUT|SYS|ROLE|NONE)[\]:]'))
      + case role when 'user' then 22 when 'assistant' then 20 when 'system' then 20 end as chars
  from rows0 window o as (partition by conv_id order by turn nulls first, role nulls first, text)),
u as (
  select *, first_value(role) over p = 'system' and n > 1 as has_sys, sum(tok) over p - tok as before,
    first_value(tok) over p as tok0, first_value(chars) over p as chars0
  from t window p as (partition by conv_id order by idx rows between unbounded preceding and current row)),
v as (
  select *, before - case when has_sys then tok0 else 0 end as s,
    greatest({BUDGET - HISTORY} - case when has_sys then tok0 else 0 end, {BUDGET // 4}) as cell
  from u where not (has_sys and idx = 0)),
x as (
  select *, 2 * (s // cell) + case when s + tok <= (s // cell + 1) * cell then 0 else 1 end as w from v),
w as (select conv_id, w, min(s) as start, any_value(case when has_sys then chars0 else 0 end) as sys_chars from x group by all),
f as (
  select conv_id, sum(c) as formatted_chars from (
    select w.conv_id, x.chars as c from w join x on w.conv_id = x.conv_id and (x.w = w.w or (x.w < w.w and x.s >= w.start - {HISTORY}))
    union all select conv_id, sys_chars from w) group by 1),
a as (
  select conv_id, count(*) as n_turns, sha256(string_agg(concat(coalesce(role, ''), chr(10), text, chr(10)), '' order by idx)) as turns_sha256,
    coalesce(string_agg(text, '' order by idx) filter (role = 'assistant'), '') as target
  from t group by 1)
select a.conv_id, n_turns, turns_sha256, cast(length(target) as bigint) as loss_chars, sha256(target) as loss_sha256,
  cast(formatted_chars as bigint) as formatted_chars
from a join f using (conv_id)
"""
