"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The symbols of many words lie in one flat array. A round finds the least pair rank of every word and
merges that pair wherever it occurs in the word, leftmost first where occurrences overlap, in all
words at once; merged places are compacted, only pairs beside them are looked up again, and a word
leaves once it has no pair. The library merges one pair at a time: highest score, then leftmost. The
rounds do the same, as a word's later occurrences wait for the next round if a merge made a pair that
is no worse than the current one, so that the library would take it first.

Words are cut where no piece of the vocabulary holds the two neighbouring characters, which no merge
can cross; a batch encodes each distinct word once. Characters outside the vocabulary become their
UTF-8 bytes' pieces. Decoding gathers the bytes of all pieces of a batch.

Models: BPE with byte fallback, identity normalisation, a leading space added and no spaces removed,
no user-defined or unused pieces; any other is refused with ValueError. The model's path is a
parameter; the pieces, scores and flags are read from the file.

Defined cases. Null and empty texts: no ids, empty decoded text. Bytes that are not UTF-8 count as
U+FFFD each. Null doc_id and repeated rows: each row is encoded. A text of any length is encoded
whole. An empty table gives an empty result. ``decode`` takes null ids as none; ids outside the
vocabulary raise. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import KEPT, clean_columns, in_arrow, packed, table, text_buffers

SPACE = 0x2581
CHUNK = 2_000_000
NONE = np.iinfo(np.int32).max

codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class Table:
    """A map from non-negative 64-bit keys to 32-bit values, looked up many at a time; NONE where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 6).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.values = np.full(len(self.keys), NONE, np.int32)
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) % len(self.keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) % len(self.keys)
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = raw[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


# -- fixed values of the model file's format: field numbers and piece types ------------------------
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_TEXT, _SCORE, _TYPE = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_MODEL_TYPE, _BYTE_FALLBACK, _SUFFIX_SPACE, _UNK_SURFACE, BPE = 3, 35, 24, 44, 2
_CHARSMAP, _ADD_PREFIX, _REMOVE_SPACES, _ESCAPE_SPACES = 2, 3, 4, 5
# --------------------------------------------------------------------------------------------------


class Model:
    """What encoding and decoding need of a model file, as flat arrays."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        entries = [dict(_fields(v)) for k, v in parts if k == _PIECES]
        trainer, normal = (dict(_fields(next((v for k, v in parts if k == n), b""))) for n in (_TRAINER, _NORMALIZER))
        kinds = np.array([e.get(_TYPE, NORMAL) for e in entries])
        if trainer.get(_MODEL_TYPE, 1) != BPE or not trainer.get(_BYTE_FALLBACK) or trainer.get(_SUFFIX_SPACE) or np.isin(kinds, (USER_DEFINED, UNUSED)).any():
            raise ValueError(f"not a BPE model with byte fallback and plain pieces: {path}")
        if normal.get(_CHARSMAP) or normal.get(_REMOVE_SPACES, 1) or not normal.get(_ADD_PREFIX, 1) or not normal.get(_ESCAPE_SPACES, 1):
            raise ValueError(f"this model changes texts before it cuts them: {path}")
        texts = [e[_TEXT].decode() for e in entries]
        scores = np.array([np.frombuffer(e.get(_SCORE, bytes(4)), "<f4")[0] for e in entries])
        self.n = len(texts)
        plain = np.flatnonzero(kinds == NORMAL)
        rank = np.unique(-scores[plain], return_inverse=True)[1]
        ids = {texts[i]: int(i) for i in plain}
        chars = sorted({c for i in plain for c in texts[i]})
        self.extra = [ord(c) for c in chars if c not in ids]  # in pieces but not a piece itself
        ids |= {chr(c): self.n + k for k, c in enumerate(self.extra)}
        self.base = self.n + len(self.extra)
        self.symbol = np.full(0x110000, -1, np.int32)
        self.symbol[[ord(c) for c in chars]] = [ids[c] for c in chars]
        keys, merged, ranks, near = [], [], [], set()
        for i, r in zip(plain.tolist(), rank.tolist(), strict=True):
            t = texts[i]
            near.update(zip(t, t[1:], strict=False))
            for k in range(1, len(t)):
                left, right = ids.get(t[:k]), ids.get(t[k:])
                if left is not None and right is not None:
                    keys.append(left * self.base + right)
                    merged.append(i)
                    ranks.append(r)
        self.merged = np.array(merged, np.int64)
        self.ranks = np.append(np.array(ranks, np.int32), NONE)
        self.pairs = Table(np.array(keys, np.int64), np.arange(len(keys)))
        self.near = Table(np.array([ids[a] * self.base + ids[b] for a, b in near], np.int64), np.ones(len(near)))
        self.byte = np.full(256, -1, np.int64)
        for i in np.flatnonzero(kinds == BYTE):
            self.byte[int(texts[i][3:5], 16)] = i
        surface = trainer.get(_UNK_SURFACE, b" \xe2\x81\x87 ")
        spoken = [b"" if k == CONTROL else surface if k == UNKNOWN else bytes([int(t[3:5], 16)]) if k == BYTE else t.replace(chr(SPACE), " ").encode() for t, k in zip(texts, kinds, strict=True)]
        self.size = np.array([len(x) for x in spoken])
        self.begin = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(spoken), np.uint8)
        self.leads = np.array([k == NORMAL and t.startswith(chr(SPACE)) for t, k in zip(texts, kinds, strict=True)])

    # -- encoding --

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of the pair in ``merged`` and ``ranks``; the last of ``ranks`` where there is none."""
        known = (left >= 0) & (right >= 0)
        found = self.pairs.get(np.where(known, left * self.base + right, 0))
        return np.where(known & (found != NONE), found, len(self.merged)).astype(np.int32)

    def merge(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, first) of words whose pairs are all merged; word w has symbols[first[w]:first[w + 1]]."""
        n_words = len(first) - 1
        word = np.repeat(np.arange(n_words), np.diff(first))
        sym = symbols.astype(np.int64)
        inside = np.append(word[1:] == word[:-1], False) if len(word) else np.zeros(0, bool)
        pair = np.full(len(sym), len(self.merged), np.int32)
        at = np.flatnonzero(inside)
        pair[at] = self._pair(sym[at], sym[at + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            rank = self.ranks[pair]
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, start)
            size = np.diff(np.append(start, len(sym)))
            live = np.repeat(least < NONE, size)
            if not live.all():
                done.append((word[~live], sym[~live]))
                sym, word, pair, rank = sym[live], word[live], pair[live], rank[live]
                size, least = size[least < NONE], least[least < NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            run = np.flatnonzero(np.concatenate([[True], hit[1:] != hit[:-1] + 1]))
            odd = (np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) & 1
            hit = self._first(hit[odd == 0], sym, word, pair)
            sym[hit] = self.merged[pair[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            hit = (np.cumsum(stay) - 1)[hit]
            sym, word, pair = sym[stay], word[stay], pair[stay]
            touched = np.zeros(len(sym) + 1, bool)
            touched[hit] = touched[hit - 1] = True
            again = np.flatnonzero(touched[:-1])
            pair[again] = len(self.merged)
            again = again[again + 1 < len(sym)]
            again = again[word[again] == word[again + 1]]
            pair[again] = self._pair(sym[again], sym[again + 1])
        if not done:
            return sym, np.zeros(n_words + 1, np.int64)
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order], np.searchsorted(word[order], np.arange(n_words + 1))

    def _first(self, hit: np.ndarray, sym: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Of the merges ``hit`` those up to a word's first one that makes a pair to be merged before the rest."""
        rank, new, n = self.ranks[pair[hit]], self.merged[pair[hit]], len(sym)
        left = np.where(hit > 0, sym[hit - 1], -1)
        if len(hit) > 1:
            beside = np.flatnonzero(hit[1:] == hit[:-1] + 2) + 1
            left[beside] = new[beside - 1]
        left = np.where((hit > 0) & (word[hit - 1] == word[hit]), left, -1)
        after = np.minimum(hit + 2, n - 1)
        right = np.where((hit + 2 < n) & (word[after] == word[hit]), sym[after], -1)
        sooner = np.flatnonzero(np.minimum(self.ranks[self._pair(left, new)], self.ranks[self._pair(new, right)]) <= rank)
        if not len(sooner):
            return hit
        cut = np.full(int(word[-1]) + 1, n)
        np.minimum.at(cut, word[hit[sooner]], hit[sooner])
        return hit[hit <= cut[word[hit]]]

    def _codes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(code points, first of each text) with spaces escaped and one before each text that is not empty."""
        data, offsets = text_buffers(column, lower=False)
        raw = data[offsets[0] : offsets[-1]].tobytes()
        try:
            text = raw.decode()
            heads = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
            first = heads[offsets - offsets[0]]
        except UnicodeDecodeError:
            each = [raw[a:b].decode(errors="each-byte") for a, b in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True)]
            text, first = "".join(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        some = np.flatnonzero(np.diff(first))
        codes = np.insert(codes, first[some], SPACE)
        codes[codes == 32] = SPACE
        grown = np.zeros(len(first), np.int64)
        grown[some + 1] = 1
        return codes, first + np.cumsum(grown)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each) of a string column."""
        codes, text = self._codes(column)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(text), np.int64)
        sym = self.symbol[codes].astype(np.int64)
        cut = np.ones(len(codes), bool)
        both = np.flatnonzero((sym[1:] >= 0) & (sym[:-1] >= 0))
        cut[both + 1] = self.near.get(sym[both] * self.base + sym[both + 1]) == NONE
        cut[text[:-1][np.diff(text) > 0]] = True
        first = np.append(np.flatnonzero(cut), len(codes))
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(first * 4), pa.py_buffer(codes)])
        coded = raw.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        example = np.empty(len(coded.dictionary), np.int64)
        example[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        size = np.diff(first)[example]
        begin = np.cumsum(size) - size
        places = np.repeat(first[example] - begin, size) + np.arange(int(size.sum()))
        unknown = -1 - codes[places].astype(np.int64)
        merged, at = self.merge(np.where(sym[places] >= 0, sym[places], unknown), np.append(begin, size.sum()))
        ids, at = self._bytes(merged, at)
        n = np.diff(at)[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.repeat(at[which] - upto[:-1], n) + np.arange(int(upto[-1]))]
        return flat, upto[np.searchsorted(first, text)]

    def _bytes(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids: those that are no piece as the pieces of their bytes."""
        odd = np.flatnonzero((sym < 0) | (sym >= self.n))
        if not len(odd):
            return sym.astype(np.int32), first
        point = [self.extra[s - self.n] if s >= 0 else -1 - s for s in sym[odd].tolist()]
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in point]
        size = np.ones(len(sym), np.int64)
        size[odd] = [len(x) for x in raw]
        end = np.cumsum(size)
        out = np.repeat(sym, size)
        inside = np.zeros(len(sym), bool)
        inside[odd] = True
        out[np.repeat(inside, size)] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return out.astype(np.int32), np.concatenate([[0], end])[first]

    # -- decoding --

    def decode(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """The texts of id sequences ids[first[i]:first[i + 1]]."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.n):
            raise ValueError("an id outside the vocabulary")
        size = self.size[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        raw = self.raw[np.repeat(self.begin[ids] - upto[:-1], size) + np.arange(int(upto[-1]))]
        # the space before a text is not part of it: that of the first piece that says anything
        says = np.append(np.flatnonzero(size), len(ids))
        lead = says[np.searchsorted(says, first[:-1])]
        lead = lead[lead < first[1:]]
        lead = lead[self.leads[ids[lead]]]
        raw = np.delete(raw, upto[lead])
        gone = np.zeros(len(upto), np.int64)
        gone[lead + 1] = 1
        ends = (upto - np.cumsum(gone))[first]
        out = pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(ends), pa.py_buffer(raw))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            whole = raw.tobytes()
            out = pa.array([whole[a:b].decode(errors="each-byte") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.large_string())
        return out


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    KEPT["pieces"] = _MODELS.clear  # until the worker has another operator's task
    return _MODELS[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _lists(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids, pa.int32()))


def _slices(sizes: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` in all, or of one row."""
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def _encoded(docs: DataFrame, path: str | None, decoded: bool) -> DataFrame:
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for at, to in _slices(pc.binary_length(batch.column(1)), CHUNK):
                ids, first = m.encode(batch.column(1).slice(at, to - at))
                columns = [batch.column(0).slice(at, to - at), _lists(ids, first)]
                if decoded:
                    columns.append(m.decode(ids, first).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text"][: len(columns)])

    slim = clean_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return packed(slim).transform(in_arrow, run, "doc_id long, ids array<int>" + ", text string" * decoded, "pieces")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row of docs (doc_id, text)."""
    return _encoded(docs, path, False)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text) of every row: its ids, and the text that they decode to."""
    return _encoded(docs, path, True)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of every row of rows (doc_id, ids)."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for at, to in _slices(pc.list_value_length(batch.column(1)), CHUNK // 4):
                part = batch.column(1).slice(at, to - at)
                n = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
                ids = part.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), m.decode(ids, np.concatenate([[0], np.cumsum(n)])).cast(pa.string())], names=["doc_id", "text"])

    slim = clean_columns(rows, "doc_id", "ids").select(F.col("doc_id").cast("long").alias("doc_id"), F.filter(F.col("ids").cast("array<int>"), lambda x: x.isNotNull()).alias("ids"))
    return slim.transform(in_arrow, run, "doc_id long, text string", "pieces")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    trip = round_trip(table(spark, sf_dir, "documents"))
    return trip.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
