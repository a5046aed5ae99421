"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A first scan counts in how many documents each n-gram of the benchmark occurs. An n-gram is a seed
if it is rare - in at most RARE of the documents, or RARE_LEAST of them - or if it is not more than
twice as frequent as the rarest n-gram near it in its item that occurs at all. The second rule keeps
seeds all over a passage that is in a third of all documents, the first all n-grams of edited copies
whatever else is copied. A second scan finds seeds in whole texts and aligns the words around them
with the item (match 2, mismatch -1, gap -1); a document is contaminated by an item if the best
local score is at least ``threshold`` of a full match. That finds edited copies up to some third of
the words changed.

The benchmark goes to the tasks in blocks of at most BLOCK_GRAMS n-grams (one block for usual
sizes; each block means two scans), so what is broadcast is bounded whatever the benchmark's size.
Documents are never shuffled; only per-n-gram counts and hits are.

Items of fewer than SEED_WORDS words have no seed. They and others below ``shortest`` words (by
default MIN_WORDS: a phrase of four words is no evidence) match nothing; with ``shortest`` = 1 each
item of fewer than MIN_WORDS words is found wherever its words stand in a row, exactly.

Defined cases. Null items match nothing. Null, empty and wordless texts are clean. Null doc_id:
reported with null. Rows of equal doc_id are reported as one. Ties: of equal scores the first place.
Texts of any length are scanned whole. Empty tables give no hits. Other columns, whatever their
names, are passed through by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Words, clean_columns, grams, in_arrow, packed, table, text_buffers, word_chunks

SEED_WORDS, MIN_WORDS, THRESHOLD, BLOCK_GRAMS = 3, 5, 0.5, 500_000
RARE, RARE_LEAST, NEAR = 1e-3, 8, 8
MATCH, MISMATCH, GAP = 2, -1, -1
_SHIFT = 32


class Index:
    """Distinct n-grams of a block of items, with the (item, place) each occurs at."""

    def __init__(self, item_ids: list, words: list[np.ndarray], n: int = SEED_WORDS):
        self.item_ids, self.words, self.n = item_ids, words, n
        parts = [grams(w, n) for w in words]
        gram = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(words)), [len(p) for p in parts])
        place = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.zeros(0, np.int64)
        self._use(gram, item, place)

    def _use(self, gram: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.place = gram[order], item[order], place[order]
        self.unique, self.first = np.unique(self.gram, return_index=True)
        self.many = np.diff(np.concatenate([self.first, [len(self.gram)]]))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.unique >> np.uint64(44)).astype(np.int64)] = True

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in g, number of the distinct n-gram) of what the index holds."""
        at = np.flatnonzero(self.bits[(g >> np.uint64(44)).astype(np.int64)])
        place = np.searchsorted(self.unique, g[at])
        place[place == len(self.unique)] = 0
        ok = self.unique[place] == g[at] if len(self.unique) else np.zeros(len(at), bool)
        return at[ok], place[ok]

    def seeded(self, frequency: np.ndarray, n_docs: int) -> Index:
        """An index of the n-grams that are rare, or rare among those near them in their item."""
        df = frequency[np.searchsorted(self.unique, self.gram)]
        order = np.lexsort((self.place, self.item))
        around = np.where(df > 0, df, np.iinfo(np.int64).max)[order]
        item = self.item[order]
        least = around.copy()
        for step in range(1, NEAR + 1):
            same = item[step:] == item[:-step]
            least[step:] = np.where(same, np.minimum(least[step:], around[:-step]), least[step:])
            least[:-step] = np.where(same, np.minimum(least[:-step], around[step:]), least[:-step])
        seed = (df[order] > 0) & ((df[order] <= max(RARE_LEAST, RARE * n_docs)) | (df[order] // 2 <= least))
        keep = np.sort(order[seed])
        out = object.__new__(Index)
        out.item_ids, out.words, out.n = self.item_ids, self.words, self.n
        out._use(self.gram[keep], self.item[keep], self.place[keep])
        return out


class Phrases:
    """Short items of one number of words, found only where all their words stand in a row."""

    def __init__(self, item_ids: list, words: list[np.ndarray]):
        self.item_ids, self.n = item_ids, len(words[0])
        self.gram = np.array([grams(w, self.n)[0] for w in words], np.uint64)

    def hits(self, w: Words) -> tuple[np.ndarray, ...]:
        """As ``hits``: every item in a text once, at its first place."""
        g, ok = _inside(w, self.n)
        order = np.argsort(self.gram, kind="stable")
        low, high = (np.searchsorted(self.gram[order], g, side=side) for side in ("left", "right"))
        at = np.flatnonzero((high > low) & ok)
        many = high[at] - low[at]
        item = order[np.repeat(low[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        text, place = np.repeat(w.of()[at], many), np.repeat(at, many)
        _, first = np.unique(np.stack([text, item], 1), axis=0, return_index=True)
        text, item, place = text[first], item[first], place[first] - w.first[text[first]]
        return text, item, np.ones(len(text)), place, place + self.n


def phrases(benchmark: DataFrame, shortest: int, most: int = BLOCK_GRAMS) -> Iterator[Phrases]:
    """The items of ``shortest`` to MIN_WORDS - 1 words, by their number of words, in bounded blocks."""
    held: dict[int, tuple[list, list]] = {}
    for item, w in _items(benchmark):
        if shortest <= len(w) < MIN_WORDS and len(w):
            ids, words = held.setdefault(len(w), ([], []))
            ids.append(item)
            words.append(w)
            if len(ids) >= most:
                yield Phrases(*held.pop(len(w)))
    for ids, words in held.values():
        yield Phrases(ids, words)


def _items(benchmark: DataFrame) -> Iterator[tuple[int | None, np.ndarray]]:
    """(item_id, words) of the items, streamed to the driver."""
    for row in clean_columns(benchmark, "item_id", "text").where("text is not null").orderBy("item_id").toLocalIterator():
        data, offsets = text_buffers(pa.array([row["text"]]))
        yield row["item_id"], Words(data, offsets).hash


def blocks(benchmark: DataFrame, n: int = SEED_WORDS, most: int = BLOCK_GRAMS) -> Iterator[Index]:
    """Indexes over the items, in blocks by item_id, streamed to the driver one at a time."""
    ids: list = []
    words: list[np.ndarray] = []
    held = 0
    for item, w in _items(benchmark):
        if len(w) < max(MIN_WORDS, n):
            continue
        if held and held + len(w) > most:
            yield Index(ids, words, n)
            ids, words, held = [], [], 0
        ids.append(item)
        words.append(w)
        held += len(w)
    if ids:
        yield Index(ids, words, n)


def _inside(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(all n-grams, whether each lies in one text)."""
    g = grams(w.hash, n)
    of = w.of()
    return g, of[: len(g)] == of[n - 1 :] if len(g) else np.zeros(0, bool)


def document_frequency(docs: DataFrame, index: Index) -> tuple[np.ndarray, int]:
    """(in how many documents each distinct n-gram of the index occurs, number of documents)."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        total = np.zeros(len(index.unique), np.int64)
        n_docs = 0
        for batch in batches:
            n_docs += batch.num_rows
            for _, _, w in word_chunks(batch.column(0)):
                g, ok = _inside(w, index.n)
                at, gram = index.find(g)
                gram, at = gram[ok[at]], at[ok[at]]
                pair = np.unique(w.of()[at] * len(total) + gram)
                total += np.bincount(pair % len(total), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some])), pa.array(np.concatenate([[n_docs], total[some]]))], names=["gram", "n"])

    out = np.zeros(len(index.unique) + 1, np.int64)  # the last is the number of documents
    for r in clean_columns(docs, "text").transform(in_arrow, count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r.gram] = r.n
    return out[:-1], int(out[-1])


def align(items: list[np.ndarray], regions: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of item i with region i, for all i at once: (score, begin, end) with begin and end in the region.

    A cell holds score << 32 | column its alignment began at, so a maximum carries both.
    """
    n = len(items)
    la, lr = max(map(len, items)), max(map(len, regions))
    a, r = np.zeros((n, la), np.uint64), np.ones((n, lr), np.uint64)
    for i, (x, y) in enumerate(zip(items, regions, strict=True)):
        a[i, : len(x)] = x
        r[i, : len(y)] = y
    one = np.int64(1 << _SHIFT)
    column = np.arange(lr, dtype=np.int64)
    slope = -GAP * column * one
    above = np.tile(column, (n, 1))
    best = np.zeros(n, np.int64)
    end = np.zeros(n, np.int64)
    for i in range(la):
        same = a[:, i, None] == r
        before = np.concatenate([np.zeros((n, 1), np.int64), above[:, :-1]], axis=1)
        fresh = before < one  # score 0: an alignment may begin here
        before = np.where(fresh, column, before)
        h = np.maximum(before + np.where(same, MATCH * one, MISMATCH * one), above + GAP * one)
        h = np.maximum.accumulate(h + slope, axis=1) - slope
        h = np.where(h < one, column, h)
        top = h.argmax(axis=1)
        value = h[np.arange(n), top]
        better = (value >> _SHIFT) > (best >> _SHIFT)
        best, end = np.where(better, value, best), np.where(better, top + 1, end)
        above = h
    return best >> _SHIFT, best & (one - 1), end


def hits(w: Words, index: Index, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, score, first word, end word) of all items found in the texts, the best place of each."""
    g, ok = _inside(w, index.n)
    at, gram = index.find(g)
    gram, at = gram[ok[at]], at[ok[at]]
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none.astype(float), none, none
    reps = index.many[gram]
    entry = np.repeat(index.first[gram] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
    item = index.item[entry]
    length = np.array([len(x) for x in index.words])[item]
    text = np.repeat(w.of()[at], reps)
    begin = np.repeat(at, reps) - w.first[text] - index.place[entry]
    cell = begin // length  # an item's places within its own length share a region
    key = np.unique(np.stack([text, item, cell], 1), axis=0)
    text, item, cell = key.T
    length = np.array([len(x) for x in index.words])[item]
    low = np.maximum(cell * length - length // 2 - 1, 0)
    high = np.minimum((cell + 2) * length + length // 2 + 1, w.count[text])
    score, first, end = np.zeros(len(text)), np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        step = max(1, 400_000 // (3 * int(length[order[at]]) + 3))
        part = order[at : at + step]
        step = max(1, 400_000 // (3 * int(length[part].max()) + 3))
        part = part[:step]
        s, f, e = align([index.words[i] for i in item[part]], [w.hash[w.first[t] + lo : w.first[t] + hi] for t, lo, hi in zip(text[part], low[part], high[part], strict=True)])
        score[part], first[part], end[part] = s / (MATCH * length[part]), low[part] + f, low[part] + e
        at += len(part)
    keep = np.flatnonzero(score >= threshold)
    keep = keep[np.lexsort((first[keep], -score[keep], item[keep], text[keep]))]
    if len(keep):
        new = np.concatenate([[True], (text[keep][1:] != text[keep][:-1]) | (item[keep][1:] != item[keep][:-1])])
        keep = keep[new]
    return text[keep], item[keep], score[keep], first[keep], end[keep]


def _searches(docs: DataFrame, benchmark: DataFrame, threshold: float, shortest: int) -> Iterator:
    """(item_ids, function of Words that returns what ``hits`` does) as a broadcast, for each block of the benchmark."""
    context = docs.sparkSession.sparkContext
    for index in blocks(benchmark):
        yield context.broadcast((index.item_ids, Search(index.seeded(*document_frequency(docs, index)), threshold)))
    if shortest < MIN_WORDS:
        for some in phrases(benchmark, shortest):
            yield context.broadcast((some.item_ids, some.hits))


class Search:
    def __init__(self, index: Index, threshold: float):
        self.index, self.threshold = index, threshold

    def __call__(self, w: Words) -> tuple[np.ndarray, ...]:
        return hits(w, self.index, self.threshold)


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shortest: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): the benchmark items found in each document, words counted from 0."""
    spark = docs.sparkSession
    slim = clean_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for shared in _searches(docs, benchmark, threshold, shortest):

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, search = shared.value
            ids = pa.array(items, pa.int64())
            for batch in batches:
                for at, to, w in word_chunks(batch.column(1)):
                    text, item, score, first, end = search(w)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at).take(pa.array(text)), ids.take(pa.array(item)), pa.array(score), pa.array(first), pa.array(end)], names=["doc_id", "item_id", "score", "first_word", "end_word"])

        found = slim.transform(in_arrow, scan, "doc_id long, item_id long, score double, first_word long, end_word long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long")
    best = F.max(F.struct("score", (-F.col("first_word")).alias("f"), "end_word")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.score").alias("score"), (-F.col("b.f")).alias("first_word"), F.col("b.end_word").alias("end_word"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shortest: int = MIN_WORDS) -> DataFrame:
    """The documents that no benchmark item is found in, with all their columns."""
    columns = docs.columns
    out = packed(docs)
    for shared in _searches(docs, benchmark, threshold, shortest):

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            _, search = shared.value
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for at, _, w in word_chunks(batch.column(columns.index("text"))):
                    good[at + search(w)[0]] = False
                yield batch.filter(pa.array(good))

        out = out.transform(in_arrow, keep, docs.schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
