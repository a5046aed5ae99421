from pyspark.sql import functions as F

from quillon.operators import compact
from quillon.operators import events as ev
from quillon.operators import render
from quillon.plans.settings import Compaction


def history(spark, rows):
    """rows: (seq, author, role, text)"""
    df = spark.createDataFrame(rows, "seq long, author string, role string, t string").withColumn("parts", ev.text_part("t"))
    return df.withColumn("app_name", F.lit("a")).withColumn("user_id", F.lit("u")).withColumn("session_id", F.lit("s")).withColumn("invocation_id", F.concat(F.lit("i"), F.col("seq"))).withColumn("timestamp", F.col("seq") + 1.0)


def run(spark, rows, settings):
    return compact.compact_events(history(spark, rows), settings, tools=False).orderBy("position").collect()


def test_everything_stays_if_it_fits(spark):
    got = run(spark, [(i, "user", "user", f"text {i}") for i in range(5)] + [(9, "user", "user", None)], Compaction())
    assert [r.text for r in got] == [f"text {i}" for i in range(5)] and not any(r.is_memory for r in got)


def test_recent_window(spark):
    rows = [(i, "user", "user", f"text {i}") for i in range(5)]
    assert [r.text for r in run(spark, rows, Compaction(recent_events=2))] == ["text 3", "text 4"]
    assert run(spark, rows, Compaction(recent_events=0)) == []


def test_newest_is_kept_gaps_arise_and_memory_comes_first(spark):
    s = Compaction(context_chars=1000)  # 500 for the memory, 500 for what is kept
    rows = [(0, "user", "user", "old " + "q" * 60), (1, "helper", "model", "w" * 480), (2, "user", "user", "small"), (3, "bot", "model", "z" * 490)]
    got = run(spark, rows, s)
    assert [(r.is_memory, r.role, r.text[:5]) for r in got[1:]] == [(False, "user", "small"), (False, "model", "zzzzz")]
    m = got[0]
    assert m.is_memory and m.author == "user" and m.event_id == "context-memory" and m.invocation_id == "i0" and m.timestamp == 1.0
    assert m.text.startswith(compact.EVENTS_HEADER) and "- user: old" in m.text and len(m.text) <= 500
    assert "helper" not in m.text  # its line does not fit beside the user's
    got = run(spark, [(0, "user", "user", "x" * 900), (1, "user", "user", "y" * 1900)], s)
    assert [r.text[0] for r in got] == ["C", "y"] and compact.EVENTS_FALLBACK in got[0].text


def test_lines_are_rated_and_repeats_dropped(spark):
    lines = ["- assistant: a", "- user: b", "- user:  B", "- tool: tool result summary: c", "- helper: PMID 3"]
    df = spark.createDataFrame([(lines,)], "l array<string>")
    pick = lambda n: df.select(compact.best_lines(F.col("l"), F.lit(n)).alias("x")).first().x
    assert pick(1000) == [lines[0], lines[1], *lines[3:]]
    assert pick(len(lines[1])) == [lines[1]]
    assert pick(len(lines[1]) + len(lines[3])) == [lines[1], lines[3]]


def contents(spark, rows, current=None):
    df = spark.createDataFrame([(1, i, r, t, current) for i, (r, t) in enumerate(rows)], "request_id long, pos long, role string, t string, current_user_text string").withColumn("parts", ev.text_part("t"))
    return [(r.role, r.text, r.is_current) for r in compact.compact_contents(df, Compaction(), tools=False).orderBy("position").collect()]


def test_current_user_message(spark):
    rows = [("user", "one"), ("assistant", "two"), ("user", " three "), ("model", "after")]
    assert contents(spark, rows) == [("user", "one", False), ("model", "two", False), ("user", "three", True)]
    assert contents(spark, rows, "one") == [("user", "one", True)]
    assert contents(spark, rows, "absent") == [("user", "one", False), ("model", "two", False), ("user", "three", False), ("model", "after", False)]
    assert contents(spark, [("system", "s"), ("model", "m")]) == [("user", "s", False), ("model", "m", False)]


def test_rendering_skips_what_does_not_fit(spark):
    rows = [(1, 0, "user", "s1", "x" * 500), (1, 1, "tool", "", "tiny"), (1, 2, "user", "s2", "y" * 90), (2, 0, "user", "s", "z" * 300)]
    df = spark.createDataFrame(rows, "query_id long, position long, source_kind string, session_id string, text string")
    (r,) = render.index_context(df, 130).collect()
    assert r.query_id == 1 and r.text == (render.INDEX_HEADER + "- tool session=: tiny\n- user session=s2: " + "y" * 90)[:130]
    (r,) = render.store_context(df, 130).collect()
    assert r.text.endswith("...") and len(r.text) <= 130


def test_an_author_names_the_line_of_a_model_or_assistant(spark):
    """Whatever the role is called, an author of its own names the line; a role of another kind stays."""
    big = "y" * 1900
    cases = [("helper", "assistant", "helper"), ("helper", "model", "helper"), ("model", "assistant", "assistant"), ("user", "model", "assistant"), (None, "assistant", "assistant"), ("helper", "system", "system"), ("helper", "user", "user")]
    for author, role, label in cases:
        got = run(spark, [(0, author, role, "old words"), (1, "user", "user", big)], Compaction(context_chars=1000))
        assert f"- {label}: old words" in got[0].text, (author, role)


def test_equal_places_are_places_of_their_own(spark):
    """Of two events with one order only as many are kept as the budget holds."""
    rows = [(3, "user", "user", "a" * 480), (3, "user", "user", "b" * 480), (3, "user", "user", "c" * 480)]
    got = run(spark, rows, Compaction(context_chars=1000))
    assert [r.is_memory for r in got] == [True, False] and len(got[1].text) == 480
    df = spark.createDataFrame([(1, 0, "user", "one"), (1, 0, "user", "two")], "request_id long, pos long, role string, t string").withColumn("parts", ev.text_part("t"))
    both = compact.compact_contents(df, Compaction(), tools=False).collect()
    assert sorted(r.text for r in both) == ["one", "two"] and sum(r.is_current for r in both) == 1
