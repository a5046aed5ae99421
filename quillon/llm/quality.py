"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words; every passage of the whole text is encoded: byte
and hashed-word frequencies (square roots), repetition and length figures of the passage and of its
document, through a learned tanh layer. Gated attention - softmax of w.(tanh(Vh) * sigmoid(Uh)) -
weighs the passages, learned from document labels only, and a logistic layer scores the weighted
sum. The network is fitted in numpy on the driver, on at most ``max_labelled`` labelled rows, those
first in md5 order of their doc_id, as far as they have ``max_passages`` passages together (at most
70 MB of features), so what reaches the driver is bounded whatever the texts' length; nothing else
is sampled, every document is scored in full.
Labels, lang, source and doc_id are no inputs of a score; rows whose crc32(doc_id as text) mod 3
is 1 are held out from learning.

Defined cases. Null and empty texts are one passage without words and get a score. Null doc_id: not
held out, not learned from. A doc_id with several labels counts with the lowest; null labels do not
count. Without labels of both kinds all scores are the share of label 1, or 0.5 if there are none.
Repeated rows are scored each. Ties: of several texts with one labelled doc_id the one with the
least hash is learned from; a score equal to the threshold is kept. Texts of any length are scored
whole, their passages encoded in pieces. An empty table gives an empty result. Other columns,
whatever their names, pass ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import _NOT_SPACE, Words, clean_columns, in_arrow, materialize, mix, packed, release, table, word_chunks

PASSAGE, MAX_LABELLED, MAX_PASSAGES, HASHED, HIDDEN, ATTENTION, EPOCHS, BATCH, SEED = 128, 4000, 100_000, 32, 32, 16, 60, 64, 5
CHUNK = 1_000_000  # bytes of text worked on at once; features take some 60 times as much
_LINE = np.ones(256, bool)
_LINE[10] = False
N_FEATURES = 129 + HASHED + 6


def _distinct(hashes: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each of n groups."""
    key = mix(hashes + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    return np.bincount(group[order[new]], minlength=n)


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(passages x N_FEATURES, first passage of each text) of texts split at white space."""
    n_docs = len(w.count)
    per = np.maximum(1, -(-w.count // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per)])
    n = int(first[-1])
    doc = np.repeat(np.arange(n_docs), per)
    nth = np.arange(n) - first[doc]
    begin = np.where(nth == 0, w.offsets[doc], 0)
    later = np.flatnonzero(nth > 0)
    begin[later] = w.start[w.first[doc[later]] + nth[later] * PASSAGE]
    size = np.diff(np.concatenate([begin, [len(w.data)]]))
    x = np.empty((n, N_FEATURES), np.float32)
    upto, at = np.cumsum(size), 0
    while at < n:  # the bytes of some passages at once
        to = max(at + 1, int(np.searchsorted(upto, upto[at] - size[at] + CHUNK, side="right")))
        kind = np.minimum(w.data[begin[at] : upto[to - 1]], 128)
        byte = np.bincount(np.repeat(np.arange(to - at) * 129, size[at:to]) + kind, minlength=(to - at) * 129).reshape(to - at, 129)
        x[at:to, :129] = np.sqrt(byte / np.maximum(size[at:to], 1)[:, None])
        at = to
    of = w.of()
    passage = first[of] + (np.arange(len(of)) - w.first[of]) // PASSAGE
    words = np.bincount(passage, minlength=n)
    hashed = np.bincount(passage * HASHED + (w.hash % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
    length = np.bincount(passage, weights=w.end - w.start, minlength=n)
    lines = Words(w.data, w.offsets, _LINE)
    x[:, 129 : 129 + HASHED] = np.sqrt(hashed / np.maximum(words, 1)[:, None])
    tail = x[:, 129 + HASHED :]
    tail[:, 0] = np.log1p(words)
    tail[:, 1] = length / np.maximum(words, 1)
    tail[:, 2] = _distinct(w.hash, passage, n) / np.maximum(words, 1)
    tail[:, 3] = (_distinct(w.hash, of, n_docs) / np.maximum(w.count, 1))[doc]
    tail[:, 4] = np.log1p(w.count)[doc]
    tail[:, 5] = (_distinct(lines.hash, lines.of(), n_docs) / np.maximum(lines.count, 1))[doc]
    return x, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Model:
    """Passage encoder, gated attention and logistic layer."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, p: dict[str, np.ndarray] | None, base: float = 0.5):
        self.mean, self.scale, self.p, self.base = mean, scale, p, base

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        a = (t * s) @ p["w"]
        a = np.exp(a - np.maximum.reduceat(a, first[:-1])[doc])
        a = a / np.add.reduceat(a, first[:-1])[doc]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "doc": doc, "y": _sigmoid(z @ p["c"] + p["c0"][0])}

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy, with respect to each parameter."""
        p, f = self.p, self.forward(x, first)
        g = (f["y"] - y) / len(y)
        dz = (g[:, None] * p["c"])[f["doc"]]
        da = (f["h"] * dz).sum(axis=1)
        da = f["a"] * (da - np.add.reduceat(f["a"] * da, first[:-1])[f["doc"]])
        dg = da[:, None] * p["w"]
        dv = dg * f["s"] * (1 - f["t"] ** 2)
        du = dg * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["t"] * f["s"]).T @ da, "c": f["z"].T @ g, "c0": np.array([g.sum()])}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.p is None:
            return np.full(len(first) - 1, self.base)
        return self.forward((x - self.mean) / self.scale, first)["y"].astype(float)


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fit on bags x[first[i]:first[i + 1]] with labels y by Adam with weight decay."""
    y = np.asarray(y, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1), np.ones(1), None, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.02
    mean, scale = mean.astype(np.float64), scale.astype(np.float64)
    d = x.shape[1]
    p = {
        "W": rng.normal(0, d**-0.5, (d, HIDDEN)), "b": np.zeros(HIDDEN),
        "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "w": rng.normal(0, ATTENTION**-0.5, ATTENTION),
        "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "c0": np.array([np.log(y.mean() / (1 - y.mean()))]),
    }
    model = Model(mean, scale, p)
    m, v = ({k: np.zeros_like(q) for k, q in p.items()} for _ in "mv")
    turn = 0
    size = np.diff(first)
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            docs = order[at : at + BATCH]
            n = size[docs]
            begin = np.concatenate([[0], np.cumsum(n)])
            rows = np.repeat(first[docs] - begin[:-1], n) + np.arange(begin[-1])
            xb = (x[rows] - mean) / scale
            grad = model.gradient(xb, begin, y[docs])
            turn += 1
            for k, q in p.items():
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                q -= rate * (m[k] / (1 - 0.9**turn) / (np.sqrt(v[k] / (1 - 0.999**turn)) + 1e-8) + (2e-2 * q if k in "WVU" else 0))
    return model


def words(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _learned_from(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int, max_passages: int) -> DataFrame:
    """(doc_id, y, text) of the rows that the model is fitted on."""
    known = (
        clean_columns(labels, "doc_id", label)
        .where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min(label).cast("long").alias("y"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
        .limit(max_labelled)
    )
    # max_labelled rows at most, so this side is small by construction
    rows = clean_columns(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    size = F.greatest(F.lit(1), F.ceil(words() / F.lit(PASSAGE)))
    upto = Window.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = rows.select("doc_id", size.alias("n")).withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") <= max_passages).select("doc_id")
    return rows.join(F.broadcast(few), "doc_id").select("doc_id", "y", "text")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED, max_passages: int = MAX_PASSAGES) -> Model:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in word_chunks(batch.column(2), lower=False, is_word=_NOT_SPACE, most=CHUNK):
                x, first = features(w)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array([x[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["doc_id", "y", "x"])

    chosen = materialize(_learned_from(docs, labels, label, max_labelled, max_passages), "quality-rows")
    rows = chosen.transform(in_arrow, encode, "doc_id long, y long, x binary").collect()
    release(chosen)
    rows.sort(key=lambda r: r.doc_id)
    bags = [np.frombuffer(bytes(r.x), np.float32).reshape(-1, N_FEATURES) for r in rows]
    x = np.concatenate(bags) if bags else np.zeros((0, N_FEATURES), np.float32)
    return fit(x, np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64), np.array([r.y for r in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in word_chunks(batch.column(1), lower=False, is_word=_NOT_SPACE, most=CHUNK):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(shared.value.score(*features(w)))], names=["doc_id", "score"])

    return clean_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_arrow, rate, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score at least threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in word_chunks(batch.column(text), lower=False, is_word=_NOT_SPACE, most=CHUNK):
                yield batch.slice(at, to - at).filter(pa.array(shared.value.score(*features(w)) >= threshold))

    return packed(docs).transform(in_arrow, keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
