import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import hashing, tooljson
from quillon.operators import events as ev
from quillon.operators import hashed
from quillon.plans.settings import Compaction, Hashed, compaction_from_env, hashed_from_env, retrieval_for


@pytest.mark.parametrize(
    "value, want",
    [
        ({"b": 1, "a": "x  y", "raw_blob": 1, "html": 2, "none": None, "zero": 0, "no": False, "empty": []}, '{"a": "x y", "b": 1, "no": false, "zero": 0}'),
        ({"result": {"data": {"output": {"ok": True}}}}, '{"ok": true}'),
        ({"content": [{"text": '{"k": 1}'}]}, '{"k": 1}'),
        ({"content": [{"text": "plain"}, {"text": "[1]"}, {"n": 1}]}, '{"count": 2, "first_items": ["plain", [1]]}'),
        (list(range(9)), '{"count": 9, "first_items": [0, 1, 2, 3, 4]}'),
        ({"patients": [{"reference": "Patient/7", "name": " N "}, {"id": "8"}, 3]}, '{"patients": {"count": 3, "first_ids": ["7", "8"], "first_names": ["N"]}}'),
        ({"timeline": [1, {"a": 1}, {"b": 2}, {"c": 3}]}, '{"timeline": {"count": 4, "first_items": [{"a": 1}, {"b": 2}]}}'),
        ({"a": {"b": {"c": {"d": {"e": 1}}}}}, '{"a": {"b": {"c": {"summary": "{\\"d\\": {\\"e\\": 1}}"}}}}'),
        ("  text ", '"text"'),
        (None, "null"),
    ],
)
def test_compact_result(value, want):
    assert tooljson.compact_result(value, 10_000) == want


def test_first_keys_survive_and_length_is_bounded():
    value = {f"k{i:02d}": i for i in range(20)} | {"status": "fine", "items": ["i" * 300] * 5}
    got = json.loads(tooljson.compact_result(value, 10_000))
    assert len(got) == 16 and got["status"] == "fine" and got["items"]["count"] == 5 and len(got["items"]["first_items"][0]) == 220
    assert len(tooljson.compact_result(value, 50)) <= 50


def test_parts_of_an_event(spark):
    parts = "array(named_struct('text', ' hi  there ', 'thought', false, 'function_call', null, 'function_response', null), named_struct('text', 'hidden', 'thought', true, 'function_call', null, 'function_response', null), named_struct('text', null, 'thought', null, 'function_call', named_struct('name', 'f', 'args_json', '{\"b\":1,\"a\":2}'), 'function_response', named_struct('name', 'g', 'response_json', '{\"ok\":true}')))"
    df = ev.events(spark.sql(f"select {parts} as parts"))
    r = ev.context_text(ev.memory_text(df, 900), Compaction()).first()
    assert r.memory_text == 'hi there\nTool call: f args={"a": 2, "b": 1}'
    assert r.context_text == 'hi there\nTool call: f args={"a": 2, "b": 1}\nTool result summary: g -> {"ok": true}'


def test_hashed_vector(spark):
    got = spark.createDataFrame([(["abc", "abc", "de"],), ([],), (None,)], "t array<string>").select(hashing.hashed_vector("t", 64).alias("v")).collect()
    i, s = hashing.slot("abc", 64)
    j, t = hashing.slot("de", 64)
    assert i != j
    assert got[0].v == {i: pytest.approx(2 * s / math.sqrt(5)), j: pytest.approx(t / math.sqrt(5))}
    assert got[1].v == {} and got[2].v is None


def test_vector_json(spark):
    df = spark.createDataFrame([({10: 0.5, 2: -1.0}, '{"2": -1.0, "x": 1, "7": "a", "10": 0.5}'), ({}, "[1]"), ({}, "no json")], "v map<int,double>, t string")
    got = df.select(hashing.vector_json("v").alias("j"), hashing.load_vector("t").alias("m")).collect()
    assert got[0].j == '{"2":-1.0,"10":0.5}' and got[0].m == {2: -1.0, 10: 0.5}
    assert [r.m for r in got[1:]] == [{}, {}]


def _events(spark, rows):
    df = spark.createDataFrame(rows, "user_id string, session_id string, event_id string, t string, timestamp double")
    return df.withColumn("app_name", F.lit("app")).withColumn("author", F.lit("user")).withColumn("role", F.lit("user")).withColumn("parts", ev.text_part("t"))


def test_store_round_trip(spark, tmp_path):
    s = Hashed(enabled=True, path=f"file://{tmp_path}/store", max_entries=3, min_score=0.01)
    hashed.store(_events(spark, [("u", "s1", "1", "the blue plan was chosen", 1.0), ("u", "s1", "1", "the blue plan was chosen", 1.0), ("u", "s2", "2", "The  blue plan was chosen", 2.0), ("u", "s2", "3", "short", 3.0)]), s)
    assert hashed.read_store(spark, s).count() == 2
    hashed.store(_events(spark, [("u", "s1", "1", "the blue plan was chosen", 1.0), ("v", "s", "9", "another tenant has a blue plan", 9.0), ("v", "s", "10", "and one more about a red plan", 10.0)]), s)
    rows = hashed.read_store(spark, s).orderBy("created_at").collect()
    assert [r.created_at for r in rows] == [2.0, 9.0, 10.0]  # retention is over all tenants
    q = spark.createDataFrame([(1, "app", "u", "s2", "blue plan"), (2, "app", "w", "s", "blue plan"), (3, "app", "v", "s", "blue plan"), (4, "app", "v", "s", " "), (5, "app", "v", "s", "?")], "query_id long, app_name string, user_id string, session_id string, text string")
    got = hashed.retrieve(hashed.read_store(spark, s), q, s).orderBy("query_id", "position").collect()
    assert [(r.query_id, r.created_at) for r in got][0] == (1, 2.0) and {r.query_id for r in got} == {1, 3}
    assert hashed.retrieve(hashed.read_store(spark, s), q, Hashed()).count() == 0
    hashed.store(_events(spark, [("u", "s1", "7", "never stored, not enabled", 1.0)]), Hashed(path=s.path))
    assert hashed.read_store(spark, s).count() == 3


def _files(path):
    return {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


@pytest.mark.parametrize("merged", [2, 32])
def test_store_in_batches_equals_rewriting_it(spark, tmp_path, monkeypatch, merged):
    """Sizes that change, late rows, repeats, ties of time, rows that come again after they were dropped."""
    monkeypatch.setattr(hashed, "MERGED", merged)
    path = f"file://{tmp_path}/store"
    r = random.Random(5)
    want = spark.createDataFrame([], hashed.COLUMNS)
    known = {}
    for step, size in enumerate([6, 6, 3, 9, 9, 0, 4]):
        rows = [(r.choice("uv"), "s", str(r.randrange(12)), f"a text of some length, number {r.randrange(4)}", float(r.randrange(1, 6))) for _ in range(r.randint(0, 6))]
        rows = [(u, s, e, t, known.setdefault((u, s, e, t), at)) for u, s, e, t, at in rows]
        s = Hashed(enabled=True, path=path, max_entries=size)
        events = _events(spark, rows)
        before = _files(tmp_path / "store" / "rows") if step else {}
        hashed.store(events, s, tools=False)
        kept = hashed.retain(hashed.insert_ignore(want, hashed.rows(events, s, tools=False)), size).drop("vector").collect()
        got = hashed.read_store(spark, s).drop("vector").collect()
        assert sorted(got) == sorted(kept)
        want = spark.createDataFrame(kept, want.drop("vector").schema).withColumn("vector", F.lit(None).cast("map<int,double>")).select(want.columns)
        if merged == 32:
            after = _files(tmp_path / "store" / "rows")
            assert before == {f: t for f, t in after.items() if f in before}  # nothing is written again
            assert all(f"batch={step + 1}/" in str(f) for f in after.keys() - before.keys())
    if merged == 2:
        assert len(list((tmp_path / "store" / "rows").iterdir())) <= 2 * (merged + 2)


def test_questions_to_a_store_prune_its_partitions(spark, tmp_path):
    s = Hashed(enabled=True, path=f"file://{tmp_path}/store", min_score=0.01)
    hashed.store(_events(spark, [(f"u{i}", "s", "1", f"the blue plan number {i}", 1.0) for i in range(40)]), s, tools=False)
    q = spark.createDataFrame([(1, "app", "u7", "s", "blue plan number 7"), (2, "app", None, "s", "blue plan"), (3, "app", "none", "s", "blue plan")], "query_id long, app_name string, user_id string, session_id string, text string")
    rows = hashed.asked(hashed._rows(spark, s.path, hashed._batches(spark, s.path)), q)
    assert "dynamicpruning" in rows._jdf.queryExecution().executedPlan().toString().lower()
    assert "u7" in {r.user_id for r in rows.collect()} and rows.count() < 40
    assert [tuple(r) for r in hashed.retrieve_stored(q, s).collect()] == [tuple(r) for r in hashed.retrieve(hashed.read_store(spark, s), q, s).collect()] != []
    assert hashed.retrieve_stored(q, Hashed(enabled=True, path=s.path + "-none")).count() == 0


def test_scan_dedupes_after_the_cap(spark):
    rows = [("u", "s", str(i), f"same text of many rows {i % 2}", i + 1.0) for i in range(10)]
    store = hashed.rows(_events(spark, rows), tools=False, vectors=False)
    q = spark.createDataFrame([(1, "app", "u", "s", "text")], "query_id long, app_name string, user_id string, session_id string, text string")
    got = hashed.scan(store, q.drop("session_id", "text"), Hashed(enabled=True, scan_rows=1)).collect()
    assert [r.created_at for r in got] == [10.0]
    assert sorted(r.created_at for r in hashed.scan(store, q.drop("session_id", "text"), Hashed(enabled=True)).collect()) == [9.0, 10.0]


def test_streaming_ingest(spark, tmp_path):
    from quillon.streaming import ingest

    _events(spark, [("u", "s1", "1", "the blue plan was chosen", 1.0), ("u", "s1", "1", "the blue plan was chosen", 1.0)]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    s = Hashed(enabled=True, path=f"file://{tmp_path}/store")
    q = ingest.start(stream, s, f"{tmp_path}/ck", tools=False, availableNow=True)
    q.awaitTermination(120)
    assert hashed.read_store(spark, s).count() == 1


def test_settings():
    assert hashed_from_env("M", {}) == Hashed()
    assert hashed_from_env("M", {"M_ENABLED": " Yes", "M_TOP_K": "99", "M_MIN_SCORE": "x", "M_MAX_ENTRIES": "1"}) == Hashed(enabled=True, top_k=30, max_entries=100)
    assert compaction_from_env("M", {"M_RECENT_EVENTS": "500", "M_CONTEXT_MAX_CHARS": ""}) == Compaction(recent_events=120)
    assert retrieval_for("fused_hybrid", {"long_term_top_k": "7"}).guard_identifiers and retrieval_for("x", {"long_term_top_k": "7"}).top_k == 7


def test_deep_payloads_are_texts(spark):
    deep = "[" * 200_000 + "]" * 200_000
    r = spark.createDataFrame([([deep, '{"a": 1}'],)], "t array<string>").select(tooljson.results("t", 50).alias("r"), tooljson.arguments("t", 50).alias("a")).first()
    assert len(r.r[0]) <= 50 and len(r.a[0]) <= 50 and r.r[1] == r.a[1] == '{"a": 1}'


def _canonical(value, n):
    text = " ".join(json.dumps(value, ensure_ascii=False, sort_keys=True).split())
    return text if len(text) <= n else text[: n - 3].rstrip() + "..."


def test_registered_tool_queries_against_python(spark, sf):
    """Flat payloads, which the events table has: their compact form is their canonical JSON without empty values."""
    from quillon.plans.queries import QUERIES

    rows = spark.read.parquet(f"{sf}/events.parquet").collect()
    args = {r.event_id: r.args for r in QUERIES["tool_arguments"][0](spark, sf).collect()}
    texts = {r.event_id: r.memory_text for r in QUERIES["tool_results"][0](spark, sf).collect()}
    assert len(args) == len(texts) == len(rows) > 0
    for r in rows:
        value = json.loads(r.props) if r.props is not None else None
        assert args[r.event_id] == (None if value is None else _canonical(value, 60))
        assert all(not isinstance(v, (dict, list)) for v in (value or {}).values())
        kept = {k: v for k, v in value.items() if v not in (None, "")} if value is not None else None
        assert texts[r.event_id] == f"Tool result: {r.event_type} summary={_canonical(kept, 500)}"


def test_store_retrieve_against_python(spark, sf):
    """The whole registered query: hashed vectors, newest 600 of a scope, repeats, scores and order."""
    import hashlib
    import re

    from quillon.plans.queries import QUERIES
    from quillon.sources.datasets import USERS

    def tokens(text):
        out = []
        for t in re.findall(r"[A-Za-z0-9][A-Za-z0-9_.:/-]{1,}", text.casefold()):
            out += [t] + [p for sep in "/-" if sep in t for p in t.split(sep) if len(p) >= 2]
        return out

    def vector(text):
        v = {}
        for t in tokens(text):
            d = hashlib.blake2b(t.encode(), digest_size=8).digest()
            i = int.from_bytes(d[:4], "big") % 512
            v[i] = v.get(i, 0) + (1 if d[4] % 2 == 0 else -1)
        n = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {i: x / n for i, x in v.items()}

    short = lambda t, n: t if len(t) <= n else t[: n - 3].rstrip() + "..."
    store = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = short(short(" ".join((r.text or "").split()), 900).strip(), 900)
        if len(text) >= 12:
            kind = "tool" if "tool result:" in text.lower() or r.doc_id % 3 == 1 else "user" if r.doc_id % 3 == 0 else "assistant"
            ids = len(re.findall(r"(?i)\b(?:Patient/[A-Za-z0-9_.-]+|PMID[:\s]*\d+|topic\s+[A-Z0-9]+|FHIR|CKD)\b", text))
            weight = max(0.1, 1.0 + {"user": 1.2, "tool": 1.0, "assistant": 0.2}[kind] + min(1.0, ids * 0.25) - (0.3 if len(text) > 600 and kind == "assistant" else 0))
            store.setdefault(r.lang, []).append((r.doc_id + 1.0, text, kind, r.source, weight, vector(text)))
    want = []
    for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        for k, user in enumerate(USERS):
            q = vector(b.text or "")
            seen, found = set(), []
            for t, text, kind, session, weight, v in sorted(store.get(user, []), key=lambda x: -x[0])[:600]:
                if text.casefold() in seen:
                    continue
                seen.add(text.casefold())
                score = sum(x * v.get(i, 0.0) for i, x in q.items()) * weight
                if q and score >= 0.01:
                    found.append((score, t, text, kind, session))
            found.sort(key=lambda x: (-round(x[0], 9), -x[1]))
            want += [(b.item_id * 10 + k, i, text, round(score, 5), kind, session, t) for i, (score, t, text, kind, session) in enumerate(found[:5])]
    got = [(r.query_id, r.position, r.text, round(r.score, 5), r.source_kind, r.session_id, r.created_at) for r in QUERIES["store_retrieve"][0](spark, sf).collect()]
    assert len(want) > 50
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:3] == b[:3] and a[4:] == b[4:] and abs(a[3] - b[3]) < 2e-5
