"""Line dedup by deletion neighbourhoods, up to one edited word.

Lines are compared as sequences of white-space separated words. Two lines are within one word edit
(substitution, insertion or deletion) exactly if deleting the same place of both, or one place of
the longer, leaves the same words. Every line emits the hashes of itself and of all its one-word
deletions; equal keys are joined: lines with equal (rest, place) differ in that place's word, and a
line equal to another's rest lacks one word of it. All members of a (rest, place) group are within
one edit of each other, so each is linked to the group's earliest line alone, however large the
group. Each link is verified by the edit distance of the words. A line goes if the same line, or
one within the edit bound, comes earlier in (doc_id, line) order. A distinct line is known by where
it comes first: doc_id, line and a hash of that row's text.

Before that, equal lines are one. An exact filter keeps the neighbourhoods small: of two lines
within one edit, the first or the last half of the words is equal, so only lines that share half of
their words' hash (3 keys a line on average, not one a word) with another line emit deletions.

Lines of fewer than MIN_WORDS words are not compared for an edit: one word of few is another line.
``edit_words`` says from how many words on they are, 1 compares all. ``shortest`` says from how many words on equal lines are one: 1, so that exact repeats of any line
that has words go.

Defined cases. Lines of fewer than ``shortest`` words - blank ones always - are kept and not
compared. Null text: one empty line. Null doc_id: lines are kept and not compared. Of rows of one
doc_id, lines of equal number are at the same place: the same line is a repeat there, of lines within
an edit neither comes earlier and both stay. Rows of equal doc_id and text keep the same lines. Ties:
the first in (doc_id, line) order stays. Texts and lines of any length are read whole. An empty table gives an
empty result. Other columns, whatever their names, are passed through by ``dedup_lines``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillon.llm.common import _NOT_SPACE, CHUNK_BYTES, Words, clean_columns, fresh, in_arrow, materialize, mix, packed, release, spread_join, table, text_buffers, tidy, word_chunks

MIN_WORDS, SHORTEST = 5, 1
_P, _S, _N = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number in the text, first word) of every line; first word has one entry more."""
    newline = np.flatnonzero(w.data == 10)
    text = np.concatenate([np.arange(len(w.count)), np.searchsorted(w.offsets, newline, side="right") - 1])
    start = np.concatenate([w.offsets[:-1], newline + 1])
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    number = np.arange(len(text)) - np.searchsorted(text, text)
    return text, number, np.concatenate([np.searchsorted(w.start, start), [len(w.start)]])


def _sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def _places(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, place in the line) of each word."""
    n = np.diff(first)
    line = np.repeat(np.arange(len(n)), n)
    return line, np.arange(len(line)) - np.repeat(first[:-1] - first[0], n)


def _list(values: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _slim(docs: DataFrame) -> DataFrame:
    """(doc_id, t, text); t is a hash of the text."""
    return clean_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").isNull(), "text").alias("t"), "text")


def lines(docs: DataFrame, edit_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, t, line, n, h1, h2, keys) of every line; t is a hash of its row's text, h1 and h2 identify its words, keys its halves."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in word_chunks(batch.column(2), lower=False, is_word=_NOT_SPACE):
                text, number, first = _lines(w)
                n = np.diff(first)
                line, place = _places(first)
                ahead = _sums(mix(w.hash + place.astype(np.uint64) * _P))
                back = _sums(mix(w.hash + (n[line] - 1 - place).astype(np.uint64) * _S))
                h1 = mix(ahead[first[1:]] - ahead[first[:-1]] + n.astype(np.uint64) * _N)
                h2 = mix((back[first[1:]] - back[first[:-1]]) ^ _N)
                keys = []
                for half in (n // 2, (n - 1) // 2):
                    half = np.maximum(half, 0)
                    tag = half.astype(np.uint64) * _N
                    keys.append(mix(ahead[first[:-1] + half] - ahead[first[:-1]] + tag))
                    keys.append(mix((back[first[1:]] - back[first[1:] - half]) ^ mix(tag + np.uint64(1))))
                k = np.stack(keys, 1)
                n_keys = np.where(n < edit_words, 0, np.where(n % 2 == 1, 2, 4))
                flat = k[np.arange(4)[None, :] < n_keys[:, None]]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(at, to - at).take(pa.array(text)) for c in (0, 1)], pa.array(number.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), _list(flat, n_keys)],
                    names=["doc_id", "t", "line", "n", "h1", "h2", "keys"],
                )

    return packed(_slim(docs)).transform(in_arrow, scan, "doc_id long, t long, line int, n int, h1 long, h2 long, keys array<long>")


def _joined(w: Words, first: np.ndarray, which: np.ndarray) -> pa.Array:
    """The words of some lines, single-spaced."""
    n = np.diff(first)[which]
    words = np.repeat(first[:-1][which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    size = w.end[words] - w.start[words] + 1  # each with the byte after it, which becomes a space
    upto = np.cumsum(size)
    raw = np.append(w.data, np.uint8(32))[np.repeat(w.start[words] - (upto - size), size) + np.arange(int(size.sum()))]
    raw[upto - 1] = 32
    ends = np.append(0, upto)[np.append(0, np.cumsum(n))]
    some = n > 0
    keep = np.ones(len(raw), bool)
    keep[ends[1:][some] - 1] = False
    gone = np.append(0, np.cumsum(some))
    return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(ends - gone), pa.py_buffer(raw[keep]))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, t, line, text) of the wanted lines (doc, t, line): their words, single-spaced."""
    lists = wanted.groupBy("doc", "t").agg(F.sort_array(F.collect_list("line")).alias("want"))  # at most the lines of one text
    rows = _slim(docs).withColumnRenamed("doc_id", "doc").dropDuplicates(["doc", "t"]).join(lists, ["doc", "t"]).select("doc", "t", "text", "want")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in word_chunks(batch.column(2), lower=False, is_word=_NOT_SPACE):
                text, _, first = _lines(w)
                want = batch.column(3).slice(at, to - at)
                row = np.repeat(np.arange(to - at), pc.list_value_length(want).to_numpy(zero_copy_only=False))
                number = want.flatten()
                which = np.searchsorted(text, row) + number.to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, to - at).take(pa.array(row)) for c in (0, 1)], number, _joined(w, first, which).cast(pa.string())], names=["doc", "t", "line", "text"])

    return rows.transform(in_arrow, cut, "doc long, t long, line int, text string")


def _neighbourhoods(texts: DataFrame) -> DataFrame:
    """(rest, place, doc, line, t) of every line's one-word deletions, and (hash, -1, doc, line, t) of the line."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in word_chunks(batch.column(3), lower=False, is_word=_NOT_SPACE):
                first = w.first
                n = w.count
                line, place = _places(first)
                here = _sums(mix(w.hash + place.astype(np.uint64) * _P))
                moved = _sums(mix(w.hash + (place - 1).astype(np.uint64) * _P))
                words = np.arange(len(line))
                less = (n[line] - 1).astype(np.uint64) * _N
                rest = mix(here[words] - here[first[line]] + moved[first[line + 1]] - moved[words + 1] + less)
                whole = mix(here[first[1:]] - here[first[:-1]] + n.astype(np.uint64) * _N)
                which = np.concatenate([line, np.arange(len(n))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([rest, whole]).view(np.int64)), pa.array(np.concatenate([place, np.full(len(n), -1)]).astype(np.int32)), *[batch.column(c).slice(at, to - at).take(pa.array(which)) for c in (0, 2, 1)]],
                    names=["rest", "place", "doc", "line", "t"],
                )

    return texts.transform(in_arrow, emit, "rest long, place int, doc long, line int, t long")


def _alike(a: Words, b: Words) -> np.ndarray:
    """Whether the edit distance of the word sequences of two texts is at most 1, pair by pair: what both begin and end with leaves one word at most."""
    na, nb = a.count, b.count
    n, most = np.minimum(na, nb), np.maximum(na, nb)
    pair = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    shared = np.zeros(len(n), np.int64)
    for ahead in (True, False):
        i, j = (a.first[pair] + k, b.first[pair] + k) if ahead else (a.first[pair + 1] - 1 - k, b.first[pair + 1] - 1 - k)
        differ = np.flatnonzero(a.hash[i] != b.hash[j])
        same = n.copy()
        np.minimum.at(same, pair[differ], k[differ])
        shared += same
    return (most - n <= 1) & (shared >= most - 1)


ID = ("doc", "line", "t")


def _verified(links: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, line, t) of the links to (to_doc, to_line, to_t) whose lines are within one edit."""
    to = texts.select(*[F.col(c).alias(f"to_{c}") for c in (*ID, "text")])
    both = spread_join(links, [f"to_{c}" for c in ID], to, grows=True).join(texts.hint("merge"), [*ID]).select(*ID, "text", "to_text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in (3, 4)))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_BYTES, side="right")))
                part = batch.slice(at, to - at)
                ok = _alike(*(Words(*text_buffers(part.column(c), lower=False), _NOT_SPACE) for c in (3, 4)))
                yield part.select([0, 1, 2]).filter(pa.array(ok))
                at = to

    return both.transform(in_arrow, check, "doc long, line int, t long").distinct()


def _place():
    return F.struct(*ID)


def _earlier(x: str, y: str):
    """Whether place y comes before place x; two rows' lines at one place don't."""
    return F.struct(F.col(f"{y}.doc"), F.col(f"{y}.line")) < F.struct(F.col(f"{x}.doc"), F.col(f"{x}.line"))


def kept_lines(docs: DataFrame, shortest: int = SHORTEST, edit_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(all lines, first occurrences): the latter (doc, line, t, near), near = a line within one edit comes earlier."""
    if not 1 <= shortest <= MIN_WORDS:
        raise ValueError(f"shortest is from 1 to {MIN_WORDS}")
    if edit_words < shortest:
        raise ValueError("lines that are compared for an edit are compared for equality too")
    every = materialize(lines(docs, edit_words), "line-all")
    firsts = materialize(
        every.where(F.col("doc_id").isNotNull() & (F.col("n") >= shortest))
        .groupBy("h1", "h2")
        .agg(F.min(F.struct(F.col("doc_id").alias("doc"), "line", "t")).alias("at"), F.first("keys").alias("keys"))
        .select("at.*", "keys"),
        "line-firsts",
    )
    halves = firsts.select(*ID, F.explode("keys").alias("key"))
    shared = materialize(halves.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "line-shared")
    wanted = spread_join(halves, "key", shared.select("key"), counts=shared, grows=True).select(*ID).distinct()
    texts = materialize(_texts(docs, wanted), "line-texts")
    around = materialize(_neighbourhoods(texts), "line-rests")
    deleted, whole = around.where("place >= 0"), around.where("place < 0")
    group = deleted.groupBy("rest", "place").agg(F.min(_place()).alias("y"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    replaced = spread_join(deleted, ["rest", "place"], group).select(_place().alias("x"), "y")
    shorter = whole.groupBy("rest").agg(F.min(_place()).alias("y"))
    longer = spread_join(deleted.select("rest", *ID), "rest", shorter).select(_place().alias("x"), "y")
    changed = longer.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    found = replaced.unionByName(changed).where(_earlier("x", "y"))
    links = materialize(found.select("x.*", *[F.col(f"y.{c}").alias(f"to_{c}") for c in ID]).distinct(), "line-links")
    near = materialize(_verified(links, texts), "line-near")
    release(shared, texts, around, links)
    return every, firsts.select(*ID).join(near.withColumn("near", F.lit(True)), [*ID], "left").withColumn("near", F.coalesce("near", F.lit(False)))


@tidy("line-kept")
def _kept(docs: DataFrame, shortest: int, edit_words: int) -> DataFrame:
    """(doc, t, lines, n_near): the lines that stay because they are the first of their kind, and how many go as near an earlier one."""
    return kept_lines(docs, shortest, edit_words)[1].groupBy("doc", "t").agg(F.collect_list(F.when(~F.col("near"), F.col("line"))).alias("lines"), F.count_if("near").alias("n_near"))


def _cut(docs: DataFrame, shortest: int, edit_words: int) -> tuple[DataFrame, list[str]]:
    """docs with texts cut, and the names of five more columns: hash of the whole text, its lines, those not compared, first ones that stayed, near ones that went."""
    columns = docs.columns
    id_, t_, lines_, near_ = fresh(docs, "_id", "_t", "_keep", "_near")
    more = fresh(docs, "_text", "_lines", "_safe", "_first", "_gone")
    keep = _kept(docs, shortest, edit_words).toDF(id_, t_, lines_, near_)
    t = F.xxhash64(F.col("text").isNull(), "text")
    same = (F.col("doc_id").cast("long") == F.col(id_)) & (t == F.col(t_))
    joined = docs.join(keep.hint("merge"), same, "left").drop(id_, t_).withColumn(more[0], t)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, id_at = columns.index("text"), columns.index("doc_id")
        for batch in batches:
            texts = batch.column(at).to_pylist()
            ids = batch.column(id_at).is_valid().to_pylist()
            counts = []
            for i, keep in enumerate(batch.column(len(columns)).to_pylist()):
                parts = (texts[i] or "").split("\n")
                safe = [not ids[i] or len(x.encode().split()) < shortest for x in parts]
                stay = parts
                if texts[i] and ids[i]:
                    kept = set(keep or ())
                    stay = [x for j, x in enumerate(parts) if j in kept or safe[j]]
                    texts[i] = "\n".join(stay)
                counts.append((len(parts), sum(safe), len(stay) - sum(safe)))
            made = [pa.array(texts, batch.schema.field(at).type) if c == at else batch.column(c) for c in range(len(columns))]
            made += [batch.column(len(columns) + 2), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(3)], batch.column(len(columns) + 1)]
            yield pa.RecordBatch.from_arrays(made, names=[*columns, *more])

    schema = StructType([*docs.schema.fields, *[StructField(c, LongType()) for c in more]])
    return joined.withColumn(near_, F.coalesce(near_, F.lit(0))).transform(in_arrow, cut, schema), more


def dedup_lines(docs: DataFrame, shortest: int = SHORTEST, edit_words: int = MIN_WORDS) -> DataFrame:
    """docs with texts without the lines that an earlier line equals or nearly equals."""
    out, more = _cut(docs, shortest, edit_words)
    return out.drop(*more)


@tidy("line-result")
def summary(docs: DataFrame, shortest: int = SHORTEST, edit_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_kept, n_exact, n_near), counted on the cut texts: lines kept, and dropped as equal to or near an earlier one.

    Of rows of equal doc_id and text one has the first occurrences, the others repeat them.
    """
    out, (t, n_lines, n_safe, n_first, n_near) = _cut(docs.select("doc_id", "text"), shortest, edit_words)
    rows = out.groupBy("doc_id", t).agg(F.sum(n_lines).alias("n_lines"), F.sum(n_safe).alias("n_safe"), F.max(n_first).alias("n_first"), F.max(n_near).alias("n_near"))
    per = rows.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("n_lines", "n_safe", "n_first", "n_near")])
    return per.select("doc_id", "n_lines", (F.col("n_safe") + F.col("n_first")).alias("n_kept"), (F.col("n_lines") - F.col("n_safe") - F.col("n_first") - F.col("n_near")).alias("n_exact"), "n_near")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(table(spark, sf_dir, "documents"))


SQL = rf"""
with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, i, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') as ws from s, unnest(range(1, len(ls) + 1)) as t(i)),
d as (select ws, min(doc_id::hugeint * 4294967296 + i) as f, min(len(ws)) as n from l where len(ws) >= {SHORTEST} and doc_id is not null group by ws),
v as (select ws, f, p, array_to_string(list_concat(ws[1:p - 1], ws[p + 1:]), ' ') as rest from d, unnest(range(1, n + 1)) as t(p) where n >= {MIN_WORDS}),
g as (select rest, p, min(f) as lo from v group by all having count(*) > 1),
near as (
  select v.ws from v join g on v.rest = g.rest and v.p = g.p where v.f > g.lo
  union select case when v.f > d.f then v.ws else d.ws end from v join d on v.rest = array_to_string(d.ws, ' ') and d.n >= {MIN_WORDS} and v.f <> d.f),
k as (select (d.f // 4294967296)::bigint as doc_id, count(*) filter (near.ws is null) as n_first, count(near.ws) as n_near from d left join near on d.ws = near.ws group by 1),
p as (select doc_id, count(*) as n_lines, count(*) filter (len(ws) < {SHORTEST} or doc_id is null) as n_safe from l group by 1)
select p.doc_id, n_lines, n_safe + coalesce(n_first, 0) as n_kept, n_lines - n_safe - coalesce(n_first, 0) - coalesce(n_near, 0) as n_exact, coalesce(n_near, 0) as n_near
from p left join k on p.doc_id = k.doc_id
"""
