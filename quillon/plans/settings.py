"""Settings of the three engines, and loading them from environment variables.

Values out of range are clamped when they come from the environment only; what does not parse is
the default. The variables' common prefix is a parameter.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

MODES = ("dense", "bm25", "fused", "union", "rrf", "cascade")
#: Policies whose index guards identifiers.
GUARDED_POLICIES = frozenset({"fused_hybrid", "dense_guarded_hybrid"})
TRUE = frozenset({"1", "true", "yes", "on"})
DEFAULT_PREFIX = "QUILLON"


@dataclass(frozen=True)
class Retrieval:
    """Multi-signal retrieval. ``max_chars`` is not read by retrieval itself; the renderer takes its own."""

    entry_chars: int = 900
    top_k: int = 5
    min_score: float = 0.02
    max_chars: int = 1800
    model: str = "BAAI/bge-small-en-v1.5"
    dimensions: int = 384
    query_prefix: str = "Represent this sentence for searching relevant passages: "
    cross_session: bool = True
    rrf_k: int = 60
    rrf_min_score: float = 0.005
    dense_weight: float = 0.6
    sparse_weight: float = 0.4
    semantic_dense_weight: float = 0.85
    guard_identifiers: bool = False
    half_life_seconds: float = 31_536_000.0
    k1: float = 1.5
    b: float = 0.75


@dataclass(frozen=True)
class Hashed:
    """The persistent store with feature-hashed vectors."""

    enabled: bool = False
    path: str = ".cache/hashed-entries"
    max_entries: int = 8000
    entry_chars: int = 900
    top_k: int = 5
    min_score: float = 0.08
    max_chars: int = 1800
    dimensions: int = 512
    cross_session: bool = True
    scan_rows: int = 600


@dataclass(frozen=True)
class Compaction:
    """Character budgets of history compaction."""

    recent_events: int = 24
    context_chars: int = 24_000
    event_chars: int = 2_000
    text_chars: int = 1_400
    result_chars: int = 1_000
    memory_chars: int = 4_000


def _number(env: Mapping[str, str], name: str, default, low, high):
    kind = type(default)
    try:
        value = kind(env.get(name, "").strip())
    except ValueError:
        value = default
    return max(low, min(value, high))


def _flag(env: Mapping[str, str], name: str, default: bool) -> bool:
    raw = env.get(name, "").strip().lower()
    return raw in TRUE if raw else default


def hashed_from_env(prefix: str = DEFAULT_PREFIX, env: Mapping[str, str] | None = None) -> Hashed:
    env, d = os.environ if env is None else env, Hashed()
    get = lambda name, default, low, high: _number(env, f"{prefix}_{name}", default, low, high)
    path = env.get(f"{prefix}_DATABASE_PATH", "").strip()
    return Hashed(
        enabled=_flag(env, f"{prefix}_ENABLED", False),
        path=os.path.expanduser(path) if path else d.path,
        max_entries=get("MAX_ENTRIES", 8000, 100, 200_000),
        entry_chars=get("ENTRY_MAX_CHARS", 900, 160, 10_000),
        top_k=get("TOP_K", 5, 1, 30),
        min_score=get("MIN_SCORE", 0.08, 0.0, 1.0),
        max_chars=get("MAX_CHARS", 1800, 200, 20_000),
        dimensions=get("VECTOR_DIMS", 512, 64, 4096),
        cross_session=_flag(env, f"{prefix}_CROSS_SESSION", True),
    )


def compaction_from_env(prefix: str = DEFAULT_PREFIX, env: Mapping[str, str] | None = None) -> Compaction:
    env = os.environ if env is None else env
    get = lambda name, default, low, high: _number(env, f"{prefix}_{name}", default, low, high)
    return Compaction(
        recent_events=get("RECENT_EVENTS", 24, 0, 120),
        context_chars=get("CONTEXT_MAX_CHARS", 24_000, 4_000, 200_000),
        event_chars=get("CONTEXT_EVENT_MAX_CHARS", 2_000, 300, 20_000),
        text_chars=get("CONTEXT_TEXT_MAX_CHARS", 1_400, 200, 20_000),
        result_chars=get("CONTEXT_TOOL_RESULT_MAX_CHARS", 1_000, 200, 20_000),
        memory_chars=get("CONTEXT_MEMORY_CHARS", 4_000, 500, 40_000),
    )


def retrieval_for(policy: str, config: Mapping[str, Any], guarded: frozenset[str] = GUARDED_POLICIES) -> Retrieval:
    """Settings of one policy's index from a configuration mapping."""
    d = Retrieval()
    pick = lambda key, default: type(default)(config.get(key, default))
    return Retrieval(
        entry_chars=pick("long_term_entry_max_chars", d.entry_chars),
        top_k=pick("long_term_top_k", d.top_k),
        min_score=pick("long_term_min_score", d.min_score),
        max_chars=pick("long_term_max_chars", d.max_chars),
        model=config.get("fused_model_name", d.model),
        cross_session=pick("include_cross_session", d.cross_session),
        dense_weight=pick("fused_dense_weight", d.dense_weight),
        sparse_weight=pick("fused_sparse_weight", d.sparse_weight),
        semantic_dense_weight=pick("fused_semantic_dense_weight", d.semantic_dense_weight),
        guard_identifiers=policy in guarded,
        rrf_k=pick("fused_rrf_k", d.rrf_k),
        rrf_min_score=pick("fused_rrf_min_score", d.rrf_min_score),
    )
