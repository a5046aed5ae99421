"""Text kernel as Column builders; the same rules as DuckDB expressions stand in ``quillon.plans.sql``.

White space is what str.isspace says, lengths are code points, and case folding is str.casefold.
An expression that a rule needs more than once is bound by ``let``, so that it is computed once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# -- fixed values: results depend on them ----------------------------------------------------------
STOPWORDS = (
    "about", "across", "after", "answer", "current", "earlier", "exactly",
    "give", "only", "our", "please", "recorded", "returned", "the", "this",
    "use", "what", "when", "which", "and", "that", "was", "has", "for", "with",
    "from", "into", "were", "they", "them", "their", "there", "these", "those",
    "your", "you", "are", "did", "had", "have", "been", "being",
)
TOKEN = r"[A-Za-z0-9][A-Za-z0-9_.:/-]{1,}"
IDENTIFIERS = r"\b(?:Patient/[A-Za-z0-9_.-]+|PMID[:\s]*\d+|topic\s+[A-Z0-9]+|FHIR|CKD)\b"
NAMESPACES = {
    "patient": r"\bPatient/[A-Za-z0-9_.-]+\b",
    "pmid": r"\bPMID[:\s]*\d+\b",
    "topic": r"\btopic\s+[A-Z0-9]+\b",
}
ANCHOR = r"\b[A-Z]{2,}(?:-[A-Z0-9]+)+\b"
EDGE = "./:-_"
MIN_ENTRY_CHARS = 12
# ----------------------------------------------------------------------------------------------

#: str.isspace as a character class; Java's \s misses some of it.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: SPACE for Java, which tries the class's ranges one by one: most characters are ruled out by two ranges first.
_FAR = r"(?![\x21-\x84\xa1-\x{167f}])"
_SPACE = _FAR + SPACE
#: A run of white space that is not one space already: the many single ones of a text are no matches.
RUN = rf"{_FAR}(?: {_SPACE}|{SPACE.replace("\\x20", "\\x1f")})(?:{_SPACE})*+"
_END = rf"{_FAR}{SPACE}++\z"
#: What case folding changes in lower-case text: one letter for one, and one for several.
FOLDS = {chr(c): chr(c).casefold() for c in range(128, 0x20000) if not 0xD800 <= c < 0xE000 and chr(c).lower() == chr(c) != chr(c).casefold()}
SINGLE = {a: b for a, b in FOLDS.items() if len(b) == 1}
SEVERAL = {a: b for a, b in FOLDS.items() if len(b) > 1}
SEVERAL_CLASS = "[" + "".join(SEVERAL) + "]"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it and whatever the optimizer moves."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def normalize(c: str | Column) -> Column:
    """Null is empty; runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), RUN, " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{_FAR}(?:\A{SPACE}++|{SPACE}++\z)", "")


def truncate(c: str | Column, n: int | Column) -> Column:
    """At most n characters: beyond that the first n - 3, stripped on the right, and an ellipsis."""
    if isinstance(n, int) and n < 3:
        raise ValueError("a length limit below 3 has no room for the ellipsis")
    n = F.lit(n) if isinstance(n, int) else n
    return let(_col(c), lambda v: F.when(F.length(v) <= n, v).otherwise(F.concat(F.regexp_replace(F.substring(v, F.lit(1), n - 3), _END, ""), F.lit("..."))))


def casefold(c: str | Column) -> Column:
    def several(v: Column) -> Column:
        out = v
        for a, b in SEVERAL.items():
            out = F.replace(out, F.lit(a), F.lit(b))
        return F.when(v.rlike(SEVERAL_CLASS), out).otherwise(v)

    beyond = lambda v: let(F.translate(v, "".join(SINGLE), "".join(SINGLE.values())), several)
    return let(F.lower(_col(c)), lambda v: F.when(F.length(v) == F.octet_length(v), v).otherwise(beyond(v)))


PIECE = 1 << 20  # bytes of text that are analysed at a time
_STOP = pa.array(STOPWORDS)
_LETTER = bytes(c < 128 and chr(c).isalnum() for c in range(256))  # 1: a token begins with it
_INSIDE = bytes(_LETTER[c] or chr(c) in EDGE for c in range(256))  # 1: a token goes on with it


def _compound(token: str) -> list[str]:
    return [p for sep in "/-" if sep in token for p in token.split(sep) if len(p) >= 2]


def _folded(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """(UTF-8 of the case-folded texts, first of each and the end); texts are Python objects only where they are not ASCII."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = data[at[0] : at[-1]].to_pybytes() if data else b""
    if raw.isascii():
        return raw.lower(), at - at[0]
    parts = [t.casefold().encode() for t in texts.to_pylist()]
    return b"".join(parts), np.append(0, np.cumsum([len(x) for x in parts]))


def _runs(data: bytes, marks: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each run of bytes with mark 1; none goes on into the next text."""
    some, mask = at[1:] > at[:-1], np.frombuffer(data.translate(marks), bool)
    begins, ends = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1]
    ends[:-1] &= ~mask[1:]
    first, last = at[:-1][some], at[1:][some] - 1
    begins[first], ends[last] = mask[first], mask[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _strings(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    step = np.zeros(len(data) + 1, np.int8)
    step[first] += 1
    step[end] -= 1
    kept = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(0, np.cumsum(end - first)).astype(np.int32)), pa.py_buffer(kept))


def _tokens(texts: pa.Array, index: bool) -> pa.Array:
    """The tokens of each text, none of which is null; of the index: stripped, without short ones and stop words.

    A run of what tokens may have holds one token, from its first letter or digit to the run's end, and
    stripped to its last one; so both are found on bytes, and only compound tokens are Python objects.
    """
    lower, at = _folded(texts)
    (word, word_end), (run, run_end) = _runs(lower, _LETTER, at), _runs(lower, _INSIDE, at)
    data = np.frombuffer(lower, np.uint8)
    of = np.searchsorted(run, word, "right") - 1
    first = np.flatnonzero(np.diff(of, prepend=-1))
    begin, whole = word[first], run_end[of[first]]
    end = word_end[np.append(first[1:], len(of))[: len(first)] - 1] if index else whole
    kept = end - begin >= 2
    begin, whole, end = begin[kept], whole[kept], end[kept]
    found = _strings(data, begin, end)
    if index:
        kept = ~pc.is_in(found, _STOP).to_numpy(zero_copy_only=False)
        found, begin, whole = found.filter(pa.array(kept)), begin[kept], whole[kept]
    row = np.searchsorted(at[1:], begin, "right")
    joint = np.flatnonzero((data == ord("/")) | (data == ord("-")))
    token = np.searchsorted(begin, joint, "right") - 1
    token = np.unique(token[(token >= 0) & (joint < whole[token])]) if len(begin) else token[:0]
    if len(token):
        parts = [_compound(lower[begin[t] : whole[t]].decode()) for t in token]
        behind = np.repeat(token, [len(x) for x in parts])
        more = pa.array([p for x in parts for p in x], pa.string())
        found = pa.concat_arrays([found, more]).take(pa.array(np.insert(np.arange(len(row)), behind + 1, len(row) + np.arange(len(more)))))
        row = np.append(row, row[behind])
    count = np.bincount(row, minlength=len(texts))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), found)


def _index_tokens(texts: pa.Array) -> pa.Array:
    return _tokens(texts, True)


def _hash_tokens(texts: pa.Array) -> pa.Array:
    return _tokens(texts, False)


def _in_pieces(batch: pa.Array, of: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """of(texts) of each piece of the batch, null as empty: at most PIECE bytes, or one text."""
    batch = pc.fill_null(batch.combine_chunks() if isinstance(batch, pa.ChunkedArray) else batch, "")
    n = pc.binary_length(batch).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = np.append(0, np.cumsum(n)[:-1]) // PIECE
    cuts = [*np.flatnonzero(np.diff(piece, prepend=-1)), len(n)] if len(n) else [0]
    made = [of(batch.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.string()))


def _split(c: str | Column, of: Callable[[pa.Array], pa.Array]) -> Column:
    def run(batch: pa.Array) -> pa.Array:
        return _in_pieces(batch, of)

    return F.arrow_udf(run, ArrayType(StringType()))(_col(c))


def tokens(c: str | Column) -> Column:
    """Index tokens: edges stripped, short ones and stop words dropped; compound tokens also give their parts.

    In Arrow batches, as lambdas over each token take ten times as long in Spark.
    """
    return _split(c, _index_tokens)


def hash_tokens(c: str | Column) -> Column:
    """Tokens of the hashed vectors: as they are, stop words too; compound tokens also give their parts."""
    return _split(c, _hash_tokens)


def identifier_count(c: str | Column) -> Column:
    return F.regexp_count(F.coalesce(_col(c), F.lit("")), F.lit("(?iU)" + IDENTIFIERS))


def identifier_keys(c: str | Column) -> Column:
    """struct of one array of distinct normalised identifiers for each namespace."""
    text = F.coalesce(_col(c), F.lit(""))
    return F.struct(*[F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"(?iU)({p})"), 1), lambda m: normalize(casefold(m)))).alias(k) for k, p in NAMESPACES.items()])


def compatible(query_keys: Column, entry_keys: Column) -> Column:
    """Every namespace that the query names shares an identifier with the entry."""
    out = F.lit(True)
    for k in NAMESPACES:
        out = out & ((F.size(query_keys[k]) == 0) | F.arrays_overlap(query_keys[k], entry_keys[k]))
    return out


def identifier_list(keys: Column) -> Column:
    """Identifiers of all namespaces as array<struct<space, key>>; a space is a power of 2, so those found sum up by bits."""

    def of(space: int, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(space).alias("space"), x.alias("key")))

    return F.concat(*[of(1 << i, keys[k]) for i, k in enumerate(NAMESPACES)])


def named_spaces(keys: Column) -> Column:
    """The spaces that have an identifier, summed."""
    out = F.lit(0)
    for i, k in enumerate(NAMESPACES):
        out = out + F.when(F.size(keys[k]) > 0, 1 << i).otherwise(0)
    return out


def has_identifier(keys: Column) -> Column:
    out = F.lit(False)
    for k in NAMESPACES:
        out = out | (F.size(keys[k]) > 0)
    return out


def has_anchor(c: str | Column) -> Column:
    """A code of capitals with hyphens, such as AB-12; case counts."""
    return F.coalesce(_col(c), F.lit("")).rlike("(?U)" + ANCHOR)


def source_kind(text: Column, author: Column, role: Column) -> Column:
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(F.contains(low(text), F.lit("tool result:")) | (low(author) == "tool"), "tool")
        .when((low(role) == "user") | (low(author) == "user"), "user")
        .otherwise("assistant")
    )


def importance(text: Column, kind: Column) -> Column:
    base = F.when(kind == "user", F.lit(1.0) + F.lit(1.2)).when(kind == "tool", F.lit(1.0) + F.lit(1.0)).otherwise(F.lit(1.0) + F.lit(0.2))
    found = F.least(F.lit(1.0), identifier_count(text).cast("double") * F.lit(0.25))
    long_ = F.when((F.length(text) > 600) & (kind == "assistant"), F.lit(0.3)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.1), base + found - long_)


def text_key(c: str | Column) -> Column:
    """What texts are compared by when they are de-duplicated."""
    return casefold(normalize(c))
