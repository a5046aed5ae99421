"""Tool arguments and results as short canonical JSON.

Payloads are dynamic and nested, which Spark's typed JSON functions cannot express; the work is done
in Arrow batches, on arrays of JSON texts so that one Python call serves all parts of an event.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values: results depend on them ----------------------------------------------------------
FIRST_KEYS = (
    "ok", "run_id", "status", "summary", "message", "patient_count",
    "patients_with_conditions", "population_size_requested", "imported_bundles",
    "failed_bundles", "resource_counts", "patient", "patients", "timeline",
    "condition_counts", "selected_condition_counts", "results", "items", "content",
)
PATIENT_ID_KEYS = ("reference", "fhir_reference", "synthea_reference", "patient_id", "fhir_patient_id", "id")
WRAPPERS = ("result", "data", "output")
BULKY = ("blob", "raw", "base64", "bytes")
BULKY_NAMES = frozenset({"html", "xml", "pdf", "document", "bundle"})
MAX_KEYS, MAX_DEPTH, SCALAR_CHARS, DEEP_CHARS = 16, 2, 220, 600
LIST_ITEMS, TOP_ITEMS, PATIENTS, UNWRAPS = 3, 5, 5, 4
# ----------------------------------------------------------------------------------------------


def _short(text: str, n: int) -> str:
    text = " ".join(text.split())
    return text if len(text) <= n else text[: n - 3].rstrip() + "..."


def dump(value: Any, n: int) -> str:
    """Canonical JSON of value in at most n characters."""
    try:
        return _short(json.dumps(value, ensure_ascii=False, sort_keys=True, default=str), n)
    except (TypeError, ValueError, RecursionError):
        return _short(str(value), n)


def _scalar(value: Any) -> Any:
    return _short(value, SCALAR_CHARS) if isinstance(value, str) else value


def _patients(items: list) -> dict[str, Any]:
    shown = [p for p in items[:PATIENTS] if isinstance(p, dict)]

    def name_of(p: dict) -> str:
        given = (str(p.get(k) or "").strip() for k in PATIENT_ID_KEYS)
        return next(filter(None, given), "").removeprefix("Patient/")

    lists = {"first_ids": list(map(name_of, shown)), "first_names": [str(p.get("name") or "").strip() for p in shown]}
    return {"count": len(items)} | {k: kept for k, v in lists.items() if (kept := [x for x in v if x])}


def _listing(items: list, n: int, depth: int, only_maps: bool = False) -> dict[str, Any]:
    head = [x for x in items[:n] if isinstance(x, dict) or not only_maps]
    return {"count": len(items), "first_items": [_mapping(x, depth) if isinstance(x, dict) else _scalar(x) for x in head]}


def _value(key: str, item: Any, depth: int) -> Any:
    match item:
        case list() if key == "patients":
            return _patients(item)
        case list():
            return _listing(item, LIST_ITEMS, depth + 1, only_maps=key == "timeline")
        case dict():
            return _mapping(item, depth + 1)
    return _scalar(item)


def _mapping(value: dict, depth: int = 0) -> dict[str, Any]:
    if depth > MAX_DEPTH:
        return {"summary": dump(value, DEEP_CHARS)}
    rank = {k: i for i, k in enumerate(FIRST_KEYS)}
    wanted = [k for k in value if k.lower() not in BULKY_NAMES and not any(b in k.lower() for b in BULKY)]
    wanted.sort(key=lambda k: rank.get(k, len(rank)))  # stable: the rest stays in its order
    empty = lambda x: x is None or (isinstance(x, (str, list, dict)) and not x)
    return {k: _value(k, value[k], depth) for k in wanted[:MAX_KEYS] if not empty(value[k])}


def _parsed(text: str) -> Any:
    """The JSON value, or the text itself where it is none or is nested too deep to be read."""
    try:
        return json.loads(text)
    except (json.JSONDecodeError, RecursionError):
        return text


def unwrap(value: Any) -> Any:
    """What a tool's answer wraps: nested result objects, then a list of text contents."""
    for _ in range(UNWRAPS):
        inner = [value[k] for k in WRAPPERS if isinstance(value.get(k), (dict, list, str))] if isinstance(value, dict) else []
        if not inner:
            break
        value = inner[0]
    content = value.get("content") if isinstance(value, dict) else None
    if isinstance(content, list):
        texts = [x.get("text") for x in content if isinstance(x, dict)]
        found = [_parsed(t) for t in texts if isinstance(t, str)]
        if found:
            return found[0] if len(found) == 1 else found
    return value


def compact_result(value: Any, n: int) -> str:
    value = unwrap(value)
    if isinstance(value, dict):
        return dump(_mapping(value), n)
    if isinstance(value, list):
        return dump(_listing(value, TOP_ITEMS, 0), n)
    return dump(_scalar(value), n)


def _load(text: str | None) -> Any:
    return None if text is None else _parsed(text)


def results(column: str | Column, n: int) -> Column:
    """array<string> of JSON -> array<string> of compact tool results; null stays null."""

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda xs: None if xs is None else [None if x is None else compact_result(_load(x), n) for x in xs])

    return run(column)


def arguments(column: str | Column, n: int) -> Column:
    """array<string> of JSON -> array<string> of canonical JSON; null stays null, what is empty becomes {}."""

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda xs: None if xs is None else [None if x is None else dump(_load(x) or {}, n) for x in xs])

    return run(column)
