"""Shared plumbing: memory of workers, connected components, joins on hot keys, word hashing.

Word hashing works on the UTF-8 buffer of an Arrow column, in chunks of bounded size, so that no
Python object is made per document or word. A word is a maximal run of ASCII letters, digits and
non-ASCII bytes of the lower-cased text; everything else separates.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.tables import materialize, new_path, release, tidy  # noqa: F401

CHUNK_BYTES = 1_000_000
SEGMENT = 1 << 18


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- memory of Python workers -----------------------------------------------------------------------


@functools.cache
def _libc():
    try:
        c = ctypes.CDLL("libc.so.6")
        c.mallopt, c.malloc_trim  # noqa: B018
        return c
    except (OSError, AttributeError):
        return None


@functools.cache
def _frugal() -> None:
    """Once a process: large arrays are mapped one by one, so that they go back to the system when they are freed."""
    pa.set_memory_pool(pa.system_memory_pool())
    if _libc():
        _libc().mallopt(-3, 1 << 22)  # M_MMAP_THRESHOLD; setting it also stops its growth
        _libc().mallopt(-1, 1 << 23)  # M_TRIM_THRESHOLD


#: What a worker keeps from one task to the next: how to drop it, by the name of who uses it.
KEPT: dict[str, Callable[[], None]] = {}


def lean(f: Callable, keeps: str | None = None) -> Callable:
    """f, a generator over Arrow batches, in a worker that keeps nothing but what ``keeps`` names for the next task."""

    @functools.wraps(f)
    def run(batches):
        _frugal()
        for name in [n for n in KEPT if n != keeps]:
            KEPT.pop(name)()
        try:
            yield from f(batches)
        finally:
            _POWERS.clear()
            pa.default_memory_pool().release_unused()
            if _libc():
                _libc().malloc_trim(0)

    return run


TASK_BYTES = 64 << 20


def packed(df: DataFrame) -> DataFrame:
    """df in fewer partitions where they are smaller than TASK_BYTES and more than two a core, as small files make them.

    Each task that writes costs the file system some calls and the executor some processes.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return df.coalesce(most) if most < 1 << 31 else df  # an unknown size counts as the largest


BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def in_arrow(df: DataFrame, f: Callable, schema, keeps: str | None = None) -> DataFrame:
    """df.mapInArrow(f, schema) in lean workers; the session's batches become at most BATCH bytes, or one row, whatever a row's size."""
    conf = df.sparkSession.conf
    if conf.get(BATCH[0]).rstrip("b") != str(BATCH[1]):
        conf.set(BATCH[0], str(BATCH[1]))
    names = df.columns
    if not any(set(c) & set(".`") for c in names):
        return df.mapInArrow(lean(f, keeps), schema)

    def named(batches):
        yield from f(b.rename_columns(names) for b in batches)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(lean(named, keeps), schema)  # it cannot name columns with dots


# -- connected components -------------------------------------------------------------------------


def _follow(point: DataFrame) -> DataFrame:
    """Pointers (id, to) followed once more; a target without a pointer of its own is a root."""
    return point.join(point.select(F.col("id").alias("to"), F.col("to").alias("on")), "to", "left").select("id", F.coalesce("on", "to").alias("to"))


LOCAL_EDGES = 200_000


def _finish(edges: DataFrame) -> DataFrame:
    """(id, to) of at most LOCAL_EDGES edges in one task: to = smallest id reachable."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not pairs:
            return
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        i, j = at[: len(a)], at[len(a) :]
        root = np.arange(len(ids))
        while True:
            before = root.copy()
            low = np.minimum(root[i], root[j])
            for side in (root[i], root[j], i, j):
                np.minimum.at(root, side, low)
            root = root[root]
            if np.array_equal(root, before):
                break
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "to"])

    return edges.select("a", "b").repartition(1).transform(in_arrow, join, "id long, to long")


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges (a long, b long) -> (id, component), component = smallest id.

    Every round points each node at the neighbour that is least in a per-round hash order, follows
    four pointers at once and contracts; the hash order makes the expected number of rounds
    logarithmic even on sorted chains. Once at most LOCAL_EDGES edges are left - counted, a few
    megabytes whatever the input - one task joins them. Hub nodes only meet partially aggregated minima and
    two-column rows. Nodes without edges are not returned. Rows with nulls and loops are ignored.
    """
    spark = edges.sparkSession
    live = materialize(
        edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct(),
        name + "-edges",
    )
    maps: list[DataFrame] = []
    turn = 0
    while (left := live.count()) > LOCAL_EDGES:
        rank = lambda c: F.xxhash64(F.lit(turn), F.col(c))
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = (
            both.groupBy("a")
            .agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("v"))).alias("m"))
            .select(F.col("a").alias("id"), F.least(F.struct(rank("a").alias("r"), F.col("a").alias("v")), F.col("m"))["v"].alias("to"))
        )
        point = materialize(point, name + "-point")
        point = materialize(_follow(_follow(point)), name + "-point")
        maps.append(point)
        nxt = (
            live.join(point.select(F.col("id").alias("a"), F.col("to").alias("ra")), "a")
            .join(point.select(F.col("id").alias("b"), F.col("to").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        nxt = materialize(nxt, name + "-edges")
        release(live)
        live = nxt
        turn += 1
    if left:
        maps.append(materialize(_finish(live), name + "-point"))
    if not maps:
        return live.select(F.col("a").alias("id"), F.col("b").alias("component"))
    full = maps[-1]
    for point in reversed(maps[:-1]):
        later = full.select(F.col("id").alias("to"), F.col("to").alias("root"))
        full = point.join(later, "to", "left").select("id", F.coalesce("root", "to").alias("to"))
    if len(maps) == 1 and left:
        return full.select("id", F.col("to").alias("component"))
    full = materialize(full, name + "-roots") if len(maps) > 1 else full
    least = full.groupBy("to").agg(F.min("id").alias("component"))
    out = materialize(full.join(least, "to").select("id", "component"), name)
    release(*maps, full, live)
    return out


# -- joins on keys of which one may be hot ---------------------------------------------------------


MAX_HOT = 10_000


def spread_join(rows: DataFrame, key: str | list[str], side: DataFrame, per: int = 2000, counts: DataFrame | None = None, grows: bool = False) -> DataFrame:
    """rows join side on key, where side has one row per key and rows may have any number.

    Of the keys with more than ``per`` rows, the MAX_HOT with the most are dealt over ceil(n / per)
    copies of their side row, so no task gets a whole hot key; any other key has ``per`` rows or at
    most one in MAX_HOT of all. Counts are pre-aggregated before they are shuffled, and the table of
    hot keys, MAX_HOT rows at most, is broadcast, so rows are not shuffled by the bare key.
    ``counts`` gives the number ``n`` of rows of each key where it is known; a side that ``grows``
    with the data is shuffled at every size.
    """
    key = [key] if isinstance(key, str) else key
    if counts is None:
        counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    n = counts.select(*key, F.ceil(F.col("n") / F.lit(per)).cast("int").alias("_n"))
    hot = F.broadcast(n.where("_n > 1").orderBy(F.col("_n").desc(), *key).limit(MAX_HOT))
    names = [c for c in rows.columns if c not in key]
    dealt = rows.join(hot, key, "left").withColumn("_s", F.pmod(F.xxhash64(*names), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    copies = side.join(hot, key, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    return dealt.join(copies.hint("merge") if grows else copies, [*key, "_s"]).drop("_s")


# -- hashing of words -----------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SEED = np.random.default_rng(20240229)
_TABLE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    _IS_WORD[_c] = True
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("b", ())) < n:
        size = max(n, SEGMENT + 4096)
        for k, base in (("b", _BASE), ("i", _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS["b"][:n], _POWERS["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of a few texts: ``hash`` per word, byte ``start``/``end`` in the buffer, ``first`` word of each text.

    ``first`` has one entry more than there are texts. The bytes are worked on in segments of about
    SEGMENT bytes that end between words, so what is held beside the words does not grow with a text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _IS_WORD):
        base = int(offsets[0])
        data = data[base : int(offsets[-1])]
        self.data, self.offsets = data, offsets = data, (offsets - base).astype(np.int64)
        n, lo, parts = len(data), 0, []
        while lo < n:
            hi = lo + SEGMENT
            while hi < n:  # on to the next end of a word or text
                rest = data[hi - 1 : hi + SEGMENT]
                gap = np.flatnonzero(~is_word[rest])
                text = int(offsets[np.searchsorted(offsets, hi)])
                hi = min(text, hi - 1 + int(gap[0]) if len(gap) else hi + SEGMENT)
                if len(gap) or hi == text:
                    break
            hi = max(min(hi, n), lo + 1)
            parts.append(self._segment(data[lo:hi], offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo, is_word, lo))
            lo = hi
        none = np.zeros(0, np.int64)
        self.start, self.end, self.hash = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none, none, none.astype(np.uint64))
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    @staticmethod
    def _segment(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        flag = np.zeros(n + 1, bool)
        flag[:n] = is_word[data]
        before = np.empty(n + 1, bool)
        before[0] = False
        before[1:] = flag[:n]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        start, end = np.flatnonzero(flag & (~before | cut)), np.flatnonzero(before & (~flag | cut))
        up, down = _powers(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_TABLE[data] * up[:n], out=total[1:])
        return start + base, end + base, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))

    def of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n-1 entries are missing."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[i : i + m]
    return mix(out)


def text_buffers(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def word_chunks(column: pa.Array, lower: bool = True, is_word: np.ndarray = _IS_WORD, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(from, to, Words) over slices of a text column, each of at most ``most`` bytes or of one text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at, n = 0, len(sizes)
    ends = np.cumsum(sizes)
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        data, offsets = text_buffers(column.slice(at, to - at), lower)
        yield at, to, Words(data, offsets, is_word)
        at = to


def valid_grams(w: Words, n: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all n-word shingles; with ``short`` a text of 1 to n-1 words is one shingle."""
    of = w.of()
    g = grams(w.hash, n)
    ok = of[: len(g)] == of[n - 1 :] if len(g) else np.zeros(0, bool)
    hashes, texts = g[ok], of[: len(g)][ok]
    if short:
        few = np.flatnonzero((w.count > 0) & (w.count < n))
        if len(few):
            extra = np.array([mix(np.array([int(grams(w.hash[w.first[t] : w.first[t + 1]], int(w.count[t]))[0]) ^ int(w.count[t])], np.uint64))[0] for t in few], np.uint64)
            hashes, texts = np.concatenate([hashes, extra]), np.concatenate([texts, few])
            order = np.argsort(texts, kind="stable")
            hashes, texts = hashes[order], texts[order]
    return hashes, texts


def clean_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, as they are: other columns, whatever their names, play no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def is_set(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).isNotNull()
