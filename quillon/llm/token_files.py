"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

One file holds a run of documents in ascending doc_id order (null ids first; equal ids by a hash
of the text). Layout, little-endian: a header of 8 uint64 (magic, documents, ids, bytes an id,
documents without id, smallest doc_id, parameters of the two codes, sections are in this order);
the ids; the Elias-Fano code of the n + 1 document offsets; the one of the doc_ids less the
smallest. An Elias-Fano code keeps the low bits of each value packed and the high bits in unary;
every 256th one-bit's place is sampled in 32 bits, so ``select`` finds any value near its sample, and
``select_range`` those of a few documents, without a table of 64-bit offsets. Files are read so.

Files are written by the tasks that encode them, through the file system that the folder's URI
names, under a name of their own per attempt; a file counts once its row is in the committed
manifest, so lost executors and repeated tasks do no harm.

Defined cases. Null and empty texts: only the end id. Repeated rows and ids: each is a document.
An empty table: an empty manifest. Other columns play no part.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import KEPT, clean_columns, in_arrow, materialize, new_path, partitions, table

END_ID, SAMPLE, DOCS, CHUNK, MAX_CACHE = 1, 256, 4096, 4_000_000, 80_000_000  # the last two in bytes
_ENTRY = 200  # bytes of a cached piece besides its characters and ids
MAGIC = int.from_bytes(b"QTOKEF01", "little")
_HEADER = 8


# -- Elias-Fano -----------------------------------------------------------------------------------


class EliasFano:
    """A non-decreasing sequence of non-negative integers in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, upper: np.ndarray, lower: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.upper, self.lower, self.samples = n, low_bits, upper, lower, samples

    @staticmethod
    def encode(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = int(places[-1]) + 1 if n else 0
        if size >= 1 << 32:
            raise ValueError("a file holds fewer than 2**31 documents")
        upper = np.zeros((size + 7) // 8, np.uint8)
        np.bitwise_or.at(upper, places >> 3, (1 << (places & 7)).astype(np.uint8))
        lower = np.zeros((n * low_bits + 7) // 8, np.uint8)
        block = 8 * 4096  # a whole number of bytes whatever low_bits is
        for at in range(0, n if low_bits else 0, block):
            part = values[at : at + block, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)
            packed = np.packbits(part.astype(np.uint8).ravel(), bitorder="little")
            lower[at * low_bits // 8 : at * low_bits // 8 + len(packed)] = packed
        return EliasFano(n, low_bits, upper, lower, places[::SAMPLE].astype(np.uint32))

    def _low(self, i: int) -> int:
        bit = i * self.low_bits
        raw = int.from_bytes(self.lower[bit >> 3 : (bit + self.low_bits + 7 >> 3)].tobytes(), "little")
        return raw >> (bit & 7) & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """Value i, from the one-bits after its sample."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, rest = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = at >> 3, at & 7
        seen = 0
        while True:
            bits = np.unpackbits(self.upper[byte : byte + 64], bitorder="little")
            bits[:skip] = 0
            ones = np.flatnonzero(bits)
            if seen + len(ones) > rest:
                place = byte * 8 + int(ones[rest - seen])
                return (place - i) << self.low_bits | self._low(i)
            seen, byte, skip = seen + len(ones), byte + 64, 0

    def select_range(self, at: int, to: int) -> np.ndarray:
        """Values at to ``to``, from the one-bits between the samples around them: memory is that of the range."""
        if not 0 <= at <= to <= self.n:
            raise IndexError((at, to))
        if at == to:
            return np.zeros(0, np.int64)
        from_, last = at // SAMPLE, -(-to // SAMPLE)
        begin = int(self.samples[from_])
        end = int(self.samples[last]) if last < len(self.samples) else 8 * len(self.upper)
        bits = np.unpackbits(self.upper[begin >> 3 : (end >> 3) + 1], bitorder="little")
        bits[: begin & 7] = 0
        places = np.flatnonzero(bits)[at - from_ * SAMPLE :][: to - at] + (begin >> 3 << 3)
        high = (places - np.arange(at, to)).astype(np.uint64) << np.uint64(self.low_bits)
        first = at * self.low_bits
        bits = np.unpackbits(self.lower[first >> 3 : to * self.low_bits + 7 >> 3], bitorder="little")[first & 7 :][: (to - at) * self.low_bits]
        low = (bits.reshape(to - at, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (high | low).astype(np.int64)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.upper), len(self.lower)], "<u8")
        return b"".join(x.tobytes() for x in (head, self.upper, self.lower, self.samples.astype("<u4")))

    @staticmethod
    def from_buffer(data: np.ndarray) -> tuple[EliasFano, int]:
        n, low_bits, up, low = (int(x) for x in data[:32].view("<u8"))
        k = (n + SAMPLE - 1) // SAMPLE
        end = 32 + up + low
        samples = np.frombuffer(data[end : end + 4 * k].tobytes(), "<u4")
        return EliasFano(n, low_bits, data[32 : 32 + up], data[32 + up : end], samples), end + 4 * k


# -- tokenizing -----------------------------------------------------------------------------------


_MARKS = b".,;:!?"
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def sound_by_piece(path: str) -> bool:
    """Whether the tokenizer ignores case and drops white space before it cuts words, which it marks at their end.

    Only the form that the default tokenizer has is known to be so; any other counts as unsound.
    """
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    normal = [n["type"] for n in ((made.get("normalizer") or {}).get("normalizers") or [])]
    cuts = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    drops = cuts[0].get("type") == "Split" and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True and str(cuts[0].get("pattern", {}).get("Regex", "")).endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    return drops and normal == ["NFC", "Replace", "Lowercase"] and made["model"].get("end_of_word_suffix") == "</w>"


class Encoder:
    """Encodes text by its white-space separated pieces, each encoded once while it is in the cache.

    Sound where a tokenizer ignores case, never joins characters across ASCII white space or across
    a letter or digit and one final mark, and drops that space, as ``sound_by_piece`` tells; others
    encode whole texts. New pieces of letters alone are encoded many at once: each is one run that
    ends in an id with the end-of-word suffix, which tells them apart again.
    """

    def __init__(self, path: str, by_piece: bool | None = None):
        from tokenizers import Tokenizer

        sound = sound_by_piece(path)
        if by_piece and not sound:
            raise ValueError(f"this tokenizer cannot encode by piece: {path}")
        by_piece = sound if by_piece is None else by_piece
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}
        self.held = 0  # bytes
        self.by_piece = by_piece

    def forget(self) -> None:
        self.cache.clear()
        self.held = 0

    def _add(self, new: list[str]) -> None:
        for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.cache[p] = np.array(e.ids, self.dtype).tobytes()

    def _add_words(self, new: list[str]) -> None:
        groups = [new[i : i + 256] for i in range(0, len(new), 256)]
        width = self.dtype.itemsize
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            ends = (np.flatnonzero(self.is_end[ids]) + 1) * width
            if len(ends) != len(group):  # some piece is more than one run
                self._add(group)
                continue
            raw, at = ids.tobytes(), 0
            for p, to in zip(group, ends.tolist(), strict=True):
                self.cache[p] = raw[at:to]
                at = to

    def _ids(self, pieces: list[str]) -> list[bytes]:
        cache = self.cache
        if self.held > MAX_CACHE:
            self.forget()
        new = [p for p in pieces if p not in cache]
        self.held += sum(map(len, new)) * 2 + len(new) * _ENTRY
        if self.by_piece:
            self._add_words([p for p in new if p.isalpha()])
            new = [p for p in new if not p.isalpha()]
        for at in range(0, len(new), 20_000):
            self._add(new[at : at + 20_000])
        return [cache[p] for p in pieces]

    @staticmethod
    def _pieces(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct units, their numbers in order, units up to each text's end): a final mark after a letter or digit is a unit of its own."""
        lists = pc.ascii_split_whitespace(texts)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        words = lists.flatten()
        del lists
        low = pc.ascii_lower(words)
        named = pc.match_substring(words, "<|")  # may be a special token, where case counts
        if pc.any(named).as_py():
            low = pc.if_else(named, words, low)
        del words
        _, off, data = low.buffers()
        offsets = np.frombuffer(off, np.int64)[low.offset : low.offset + len(low) + 1] if len(low) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(1, np.uint8)
        size = np.diff(offsets)
        last = np.where(size > 1, raw[np.maximum(offsets[1:] - 1, 0)], 0)
        marked = np.isin(last, list(_MARKS)) & _ALNUM[np.where(size > 1, raw[np.maximum(offsets[1:] - 2, 0)], 0)]
        body = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(low, 0, -1), low) if len(low) else low
        coded = body.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        upto = np.concatenate([[0], np.cumsum(1 + marked)])
        code = np.empty(int(upto[-1]), np.int64)
        code[upto[:-1]] = coded.indices.to_numpy(zero_copy_only=False)
        place = np.zeros(256, np.int64)
        place[list(_MARKS)] = np.arange(len(_MARKS))
        code[upto[:-1][marked] + 1] = len(distinct) + place[last[marked]]
        return distinct + [chr(c) for c in _MARKS], code, upto[ends.astype(np.int64)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); nulls are empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.by_piece:
            distinct, code, ends = self._pieces(texts)
        else:
            distinct, code, ends = texts.to_pylist(), np.arange(len(texts)), np.arange(1, len(texts) + 1)
        ids = self._ids(distinct)
        flat = np.frombuffer(b"".join(ids), self.dtype)
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        begin = np.cumsum(n) - n
        each = n[code]
        out_end = np.cumsum(each)
        total = int(out_end[-1]) if len(out_end) else 0
        small = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
        index = np.repeat((begin[code] - (out_end - each)).astype(small), each)
        index += np.arange(total, dtype=small)
        del code, each
        upto = np.concatenate([[0], out_end])[np.concatenate([[0], ends]).astype(np.int64)]
        return flat[index], np.diff(upto)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, by_piece: bool | None = None) -> Encoder:
    key = (path, by_piece)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, by_piece)
    KEPT["tokens"] = _ENCODERS.clear  # until the worker has another operator's task
    return _ENCODERS[key]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# -- files ----------------------------------------------------------------------------------------


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, side="right")))
        yield batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at)
        at = to


MANIFEST = "shard int, path string, n_docs long, n_ids long, n_bytes long"


def write_files(docs: DataFrame, folder: str, tokenizer: str | None = None, shards: int | None = None, by_piece: bool | None = None) -> DataFrame:
    """Write docs (doc_id, text) as token files under folder; the committed manifest, one row a file."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    ordered = (
        clean_columns(docs, "doc_id", "text")
        .withColumn("_h", F.xxhash64("text"))
        .repartitionByRange(shards or partitions(spark), F.col("doc_id").asc_nulls_first(), "_h")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h")
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, by_piece)
        shard = TaskContext.get().partitionId()
        system, base = _file_system(folder)
        path = name = out = None
        lengths: list[np.ndarray] = []
        doc_ids: list[np.ndarray] = []
        n_null = n_ids = 0
        for batch in batches:
            for ids, texts in _slices(batch):
                if out is None:
                    system.create_dir(base, recursive=True)
                    name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok"
                    path = f"{base}/{name}"
                    out = system.open_output_stream(path + ".part")
                flat, n = enc.encode(texts)
                with_end = np.insert(flat, np.cumsum(n), END_ID)
                out.write(with_end.astype(enc.dtype).tobytes())
                lengths.append(n + 1)
                n_ids += len(with_end)
                n_null += ids.null_count
                doc_ids.append(pc.drop_null(ids).to_numpy(zero_copy_only=False).astype(np.int64))
        if out is None:
            return
        known = np.concatenate(doc_ids)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        least = int(known[0]) if len(known) else 0
        tail = EliasFano.encode(offsets).to_bytes() + EliasFano.encode(known.astype(np.uint64) - np.uint64(least % (1 << 64))).to_bytes()
        head = np.array([MAGIC, len(offsets) - 1, n_ids, enc.dtype.itemsize, n_null, least % (1 << 64), len(tail), 0], "<u8")
        out.write(tail + head.tobytes())  # the header stands last, as its numbers are known only then
        size = out.tell()
        out.close()
        system.move(path + ".part", path)
        uri = f"{folder}/{name}"
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": uri, "n_docs": len(offsets) - 1, "n_ids": n_ids, "n_bytes": size}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    files = ordered.transform(in_arrow, write, MANIFEST, "tokens").collect()  # one row a file
    return materialize(spark.createDataFrame(files, MANIFEST).coalesce(1), "token-manifest")


class TokenFile:
    """Random access to one file: ``offsets``, ``ids(i)``, ``doc_ids(at, to)``."""

    def __init__(self, uri: str):
        system, path = _file_system(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        magic, self.n_docs, self.n_ids, width, self.n_null, least, tail, _ = (int(x) for x in np.frombuffer(self.file.read_at(8 * _HEADER, size - 8 * _HEADER), "<u8"))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.dtype = np.dtype(f"<u{width}")
        raw = np.frombuffer(self.file.read_at(tail, size - 8 * _HEADER - tail), np.uint8)
        self.offsets, used = EliasFano.from_buffer(raw)
        self._ids, _ = EliasFano.from_buffer(raw[used:])
        self.least = least - (1 << 64) if least >= 1 << 63 else least

    def doc_ids(self, at: int, to: int) -> pa.Array:
        """doc_ids of documents at to ``to``; the first ``n_null`` documents have none."""
        known = self._ids.select_range(max(0, at - self.n_null), max(0, to - self.n_null)) + self.least
        return pa.concat_arrays([pa.nulls(to - at - len(known), pa.int64()), pa.array(known)])

    def read(self, begin: int, end: int) -> np.ndarray:
        w = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((end - begin) * w, begin * w), self.dtype)

    def ids(self, i: int) -> np.ndarray:
        return self.read(self.offsets.select(i), self.offsets.select(i + 1))


def read_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    The driver gets one row a file, for the ids before each file.
    """
    files = sorted(manifest.select("shard", "path", "n_ids").collect())
    rows, before = [], 0
    for r in files:
        rows.append((r.path, before))
        before += r.n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f = TokenFile(uri)
                for at in range(0, f.n_docs, DOCS):
                    to = min(f.n_docs, at + DOCS)
                    offsets = f.offsets.select_range(at, to + 1)
                    crc = np.empty(to - at, np.int64)
                    i = 0
                    while i < to - at:
                        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
                        part = f.read(int(offsets[i]), int(offsets[j])).astype("<u4")
                        for k in range(i, j):
                            crc[k] = zlib.crc32(part[offsets[k] - offsets[i] : offsets[k + 1] - offsets[i]])
                        i = j
                    yield pa.RecordBatch.from_arrays([f.doc_ids(at, to), pa.array(base + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], out)
    return spark.createDataFrame(rows, "path string, base long").repartition(len(rows), "path").transform(in_arrow, read, out)


def run(docs: DataFrame, folder: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    return read_files(spark, write_files(docs, folder or new_path(spark, "tokens")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(table(spark, sf_dir, "documents"))
