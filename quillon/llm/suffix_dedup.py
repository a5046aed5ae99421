"""Repeated passages by sparse suffix arrays.

Of all suffixes (at word starts) only those at minimisers are retained: the least 25-gram hash in
each window of 26 places. Any window of MIN_WORDS = 50 words holds one whole such 25-gram, at the
same place in each of its copies, so it belongs to one suffix, and equal windows to suffixes of
equal 25-grams. A suffix carries the hash of its 25-gram and 24 bits of each word around it that its
windows reach: those before it, nearest first, and those after it, 37 on average. Suffixes are sorted
by content, the 25-gram and then the words after it, with Spark's range partitioning down to
(document, place), so a passage that a third of all documents share is dealt over tasks too.

Two neighbours of equal 25-gram are extended: to the right by what their words after it have in
common, to the left by those before it. Where a 25-gram has two suffixes that is all they share. Where
it has more, the longest match of two need not be between neighbours, as the order knows only the right
side; there the windows that each suffix extends to are compared all at once, in pieces of at most about
HELD_ROWS suffixes where a run is longer or touches a partition's border. In such a piece all but the
least document of a window are settled, as that one is earlier; what the least ones share with other
pieces is found by an aggregation of (25-gram, window), joined back. So every window that two
documents have is found, whatever else shares its 25-gram, and its least document is known.

Result, one row per document and text with a passage of 50 or more words that another document has too:
``spans`` are word ranges [begin, end) of all such passages, ``cut`` those which a document with a
smaller doc_id has; cutting them keeps each passage's earliest copy.

Defined cases. Null, empty and short texts, and passages repeated only within one document: no
span. Null doc_id: not compared. Rows of equal doc_id are one document, whose texts don't repeat one
another; each text has spans of its own, known by a hash of it. An empty table gives an
empty result. Texts of any length are read whole. Ties: of equal passages the one in the smallest
doc_id stays. Other columns, whatever their names, are passed through by ``cut_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Words, clean_columns, fresh, grams, in_arrow, materialize, mix, partitions, spread_join, table, text_buffers, tidy, word_chunks

MIN_WORDS, GRAM = 50, 25
WINDOW = MIN_WORDS - GRAM + 1
BYTES, HELD_ROWS, STEP, BITS = 3, 5_000, 1 << 20, 40
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SUFFIX = "key long, doc long, t long, pos int, before binary, after binary"
_SCHEMA = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("t", pa.int64()), ("pos", pa.int32()), ("before", pa.binary()), ("after", pa.binary())])


def minimisers(w: Words, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, n-gram selected, hash) of each window of ``window`` n-grams; a window lies in one text."""
    g = grams(w.hash, gram)
    n = len(g) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g[:0]
    low = np.uint64((1 << 24) - 1)
    least = np.empty(n, np.int64)
    for lo in range(0, n, STEP):  # a piece has fewer than 2**24 places
        part = g[lo : lo + STEP + window - 1]
        m = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while width * 2 <= window:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < window:
            m = np.minimum(m[: len(m) - (window - width)], m[window - width :])
        least[lo : lo + STEP] = (m & low).astype(np.int64) + lo
    of = w.of()
    start = np.flatnonzero(of[:n] == of[gram + window - 2 :][:n])
    return start, least[start], g


def _digest():
    return F.xxhash64(F.col("text").isNull(), "text")


def _words(raw: np.ndarray, begin: np.ndarray, n: np.ndarray, step: int) -> pa.Array:
    """BYTES of each of n words from ``begin`` on, forwards or backwards."""
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    data = raw[np.repeat(begin, n) + step * k]
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.append(0, np.cumsum(n)) * BYTES).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def suffixes(docs: DataFrame) -> DataFrame:
    """(key, doc, t, pos, before, after): of each retained 25-gram its hash, its first word and the words around it that its windows hold."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in word_chunks(batch.column(2)):
                start, place, g = minimisers(w)
                if not len(start):
                    continue
                run = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                first, last, gram = start[run], start[np.append(run[1:], len(start)) - 1], place[run]
                raw = np.ascontiguousarray((w.hash >> np.uint64(64 - 8 * BYTES)).astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :BYTES]
                before, after = _words(raw, gram - 1, gram - first, -1), _words(raw, gram + GRAM, last + MIN_WORDS - gram - GRAM, 1)
                text = w.of()[first]
                own = [batch.column(c).slice(at, to - at).take(pa.array(text)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(g[gram].view(np.int64)), *own, pa.array((gram - w.first[text]).astype(np.int32)), before, after], schema=_SCHEMA)

    known = clean_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc"), _digest().alias("t"), "text").where("doc is not null and text is not null")
    return known.transform(in_arrow, cut, SUFFIX)


def _context(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each row) of a column of packed words."""
    c = rows.column(name)
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    _, off, data = c.buffers()
    offsets = np.frombuffer(off, np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
    raw = (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]].reshape(-1, BYTES)
    words = np.zeros(len(raw), np.uint64)
    for i in range(BYTES):
        words |= raw[:, i].astype(np.uint64) << np.uint64(8 * i)
    return words, (offsets - offsets[0]) // BYTES


def _in_common(words: np.ndarray, first: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words rows i and j begin with alike, pair by pair."""
    n = np.minimum(first[i + 1] - first[i], first[j + 1] - first[j])
    pair = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    differ = np.flatnonzero(words[first[i][pair] + k] != words[first[j][pair] + k])
    same = n.copy()
    np.minimum.at(same, pair[differ], k[differ])
    return same


def _prefixes(words: np.ndarray, first: np.ndarray, seed: np.uint64) -> np.ndarray:
    """Running sums of hashes of (word, place in the row), one more than words."""
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    return np.append(np.uint64(0), np.cumsum(mix(words + place.astype(np.uint64) * seed)))


def _windows(before: tuple[np.ndarray, np.ndarray], after: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number in the row, hash) of each window of suffixes: 24 to 0 words less before the 25-gram, as many more after it."""
    left, right = np.diff(before[1]), np.diff(after[1])
    n = left + right - (MIN_WORDS - GRAM) + 1
    row = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    back = left[row] - number
    ahead = MIN_WORDS - GRAM - back
    sums = [_prefixes(*before, _LEFT), _prefixes(*after, _RIGHT)]
    total = mix(sums[0][before[1][row] + back] - sums[0][before[1][row]]) + (sums[1][after[1][row] + ahead] - sums[1][after[1][row]])
    return row, number, (mix(total) >> np.uint64(64 - BITS)).astype(np.int64)


_OUT = "doc long, t long, first int, last int, cut boolean, key long, hash long, most long"
_OUT_SCHEMA = pa.schema([("doc", pa.int64()), ("t", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("cut", pa.bool_()), ("key", pa.int64()), ("hash", pa.int64()), ("most", pa.int64())])


def _spans(doc: np.ndarray, t: np.ndarray, first: np.ndarray, last: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(doc), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(t), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(cut), none, none, none], schema=_OUT_SCHEMA)


def _ranges(row: np.ndarray, number: np.ndarray, some: np.ndarray, doc: np.ndarray, t: np.ndarray, begin: np.ndarray, cut: bool) -> pa.RecordBatch:
    """(doc, t, first, last, cut) of each run of marked windows of a suffix."""
    go_on = np.zeros(len(some), bool)
    go_on[1:] = some[1:] & some[:-1] & (row[1:] == row[:-1])
    first = np.flatnonzero(some & ~go_on)
    last = np.flatnonzero(some & ~np.concatenate([go_on[1:], [False]]))
    r = row[first]
    return _spans(doc[r], t[r], begin[r] + number[first], begin[r] + number[last] + MIN_WORDS, np.full(len(r), cut))


def _pairs(rows: pa.Table, at: np.ndarray) -> pa.RecordBatch:
    """The ranges of neighbours at, at + 1 of one 25-gram, extended to both sides."""
    (left, right), (doc, t, pos) = (_context(rows, c) for c in ("before", "after")), (rows.column(c).to_numpy() for c in ("doc", "t", "pos"))
    at = at[doc[at] != doc[at + 1]]
    back, ahead = _in_common(*left, at, at + 1), _in_common(*right, at, at + 1)
    long = back + GRAM + ahead >= MIN_WORDS
    at, back, ahead = at[long], back[long], ahead[long]
    both = np.concatenate([at, at + 1])
    least = np.tile(np.minimum(doc[at], doc[at + 1]), 2)
    return _spans(doc[both], t[both], pos[both] - np.tile(back, 2), pos[both] + GRAM + np.tile(ahead, 2), doc[both] > least)


def _settled(rows: pa.Table, opens: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The ranges of sorted suffixes; of those that ``opens`` marks also the windows in their least document here."""
    key = rows.column("key").to_numpy()
    same = np.concatenate([[False], key[1:] == key[:-1], [False]])
    pair = np.flatnonzero(same[1:-1] & ~same[:-2] & ~same[2:] & ~opens[:-1] & ~opens[1:])
    if len(pair):
        yield _pairs(rows, pair)
    many = same[:-1] | same[1:] | opens
    many[pair] = many[pair + 1] = False
    rows, opens = rows.filter(pa.array(many)), opens[many]
    if not rows.num_rows:
        return
    key, doc, t, pos = (rows.column(c).to_numpy() for c in ("key", "doc", "t", "pos"))
    run = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    before, after = _context(rows, "before"), _context(rows, "after")
    row, number, hash_ = _windows(before, after)
    begin = pos - np.diff(before[1])
    # windows of one run meet: 23 bits of run and BITS of hash
    kinds, group = np.unique((run[row].astype(np.int64) << BITS) | hash_, return_inverse=True)
    least, most = np.full(len(kinds), np.iinfo(np.int64).max), np.full(len(kinds), np.iinfo(np.int64).min)
    np.minimum.at(least, group, doc[row])
    np.maximum.at(most, group, doc[row])
    later = least[group] < doc[row]
    yield _ranges(row, number, (least < most)[group], doc, t, begin, False)
    yield _ranges(row, number, later, doc, t, begin, True)
    left = np.flatnonzero(opens[row] & ~later)
    r, n = row[left], len(left)
    yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(t[r]), pa.array((begin[r] + number[left]).astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.array(key[r]), pa.array(hash_[left]), pa.array(most[group[left]])], schema=_OUT_SCHEMA)


def neighbours(sorted_: DataFrame) -> DataFrame:
    """Ranges that equal 25-grams share in a piece of a run; with ``key`` and ``hash``, at ``first``, windows that other pieces may have too."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_key = None, None  # the suffixes of a run that may go on; the key of a run that has other pieces
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            key = t.column("key").to_numpy()
            open_key = key[0] if open_key is None else open_key  # the partition's first run may begin in another
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield from _settled(t.slice(0, last), key[:last] == open_key)
            held = t.slice(last)
            if held.num_rows > HELD_ROWS:
                yield from _settled(held, np.ones(held.num_rows, bool))
                held, open_key = None, key[-1]
        if held is not None:
            yield from _settled(held, np.ones(held.num_rows, bool))

    return sorted_.transform(in_arrow, compare, _OUT)


def _left_open(windows: DataFrame) -> DataFrame:
    """(doc, t, first, last, cut) of the windows (key, hash, doc, t, first, most) that two documents have; most: the piece's greatest document of it."""
    shared = windows.groupBy("key", "hash").agg(F.min("doc").alias("least"), F.max("most").alias("most")).where("least < most").drop("most")
    found = spread_join(windows.drop("most"), ["key", "hash"], shared)
    return found.select("doc", "t", "first", (F.col("first") + MIN_WORDS).alias("last"), (F.col("least") < F.col("doc")).alias("cut"))


def _merge(spans):
    """Sorted, touching or overlapping ranges made one."""
    kind = "array<struct<first:int,last:int>>"

    def step(acc, x):
        top = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(top["first"].alias("first"), F.greatest(top["last"], x["last"]).alias("last"))))
        return F.when((F.size(acc) > 0) & (x["first"] <= F.get(acc, F.size(acc) - 1)["last"]), joined).otherwise(F.concat(acc, F.array(x))).cast(kind)

    step_ = lambda acc, x: F.when(F.size(acc) == 0, F.array(x).cast(kind)).otherwise(step(acc, x))
    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step_)


@tidy("suffix-result")
def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, t, n_words, spans, cut) of every text; t is a hash of it."""
    order = ["key", "after", "doc", "pos"]
    found = materialize(neighbours(suffixes(docs).repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)), "suffix-ranges")
    rest = _left_open(found.where("key is not null").select("key", "hash", "doc", "t", "first", "most"))
    ranges = found.where("key is null").select("doc", "t", "first", "last", "cut").unionByName(rest)
    both = ranges.groupBy("doc", "t", "first", "last").agg(F.max("cut").alias("cut"))
    span = F.struct("first", "last")
    return (
        both.groupBy("doc", "t")
        .agg(_merge(F.collect_list(span)).alias("spans"), _merge(F.collect_list(F.when(F.col("cut"), span))).alias("cut"))
        .select(F.col("doc").alias("doc_id"), "t", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"]).alias("n_words"), "spans", "cut")
    )


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans, cut): the passages of 50 words or more that other documents have too."""
    return passages(docs).drop("t")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs without the passages that a document with a smaller doc_id has; texts keep all else, byte for byte."""
    columns = docs.columns
    id_, t_, cut = fresh(docs, "_id", "_t", "_cut")
    cuts = passages(docs).where(F.size("cut") > 0).select(F.col("doc_id").alias(id_), F.col("t").alias(t_), F.col("cut").alias(cut))
    same = (F.col("doc_id").cast("long") == F.col(id_)) & (_digest() == F.col(t_))
    joined = docs.join(cuts.hint("merge"), same, "left").drop(id_, t_)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index("text")
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if spans:
                    data, offsets = text_buffers(pa.array([texts[i]]), lower=False)
                    w = Words(data, offsets)
                    raw, keep, done = data.tobytes(), [], 0
                    for s in spans:
                        keep.append(raw[done : w.start[s["first"]]])
                        done = int(w.end[s["last"] - 1])
                    texts[i] = (b"".join(keep) + raw[done:]).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(at).type) if c == at else batch.column(c) for c in range(len(columns))], names=columns)

    return joined.transform(in_arrow, apply, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
