"""Near-duplicate documents: ProbMinHash signatures, banding, exact verification.

A document's shingles are its 5-word runs with their counts as weights (a text of 1 to 4 words is
one shingle). Each shingle is a Poisson process of arrivals with its weight as rate; an arrival
falls on one of REGISTERS registers, which keeps the shingle of its earliest arrival. All shingles
take their first arrivals before any takes a second, and a shingle stops once its arrivals are
later than the latest register - early termination. Registers agree with probability J_P, the
probability Jaccard similarity of the weights. BANDS x ROWS registers give a pair at 0.8 a chance
of 1 - (1 - 0.8**5)**24 > 0.9999 to share a band; pairs that do are verified by exact J_P >= 0.8.

Texts with equal words are one class before anything else. In each bucket every member is held
against three hub members first, which links nearly all of a group of copies with pairs linear in
its size. What may be left are pairs between different components of a bucket. Buckets that have
such pairs are joined to families, and the documents outside a family's largest component meet all
of the family in blocks of bounded size: a task holds two blocks, compares signatures, verifies
pairs of different components whose registers, and then four times as many, agree enough for 0.8 (by
4.3 standard deviations: a pair at 0.8 is lost there with probability 0.00002), best first, and
returns the links that join components, not pairs. So no link between different texts is lost to a
cap, and no pairs within a group are emitted.

A class is a node of its own number, never a doc_id, until the end: its component is then named after
the smallest doc_id in it.

Defined cases. Null, empty and wordless texts resemble nothing and are kept. Null doc_id: component
null, kept. Rows of one doc_id with different texts are judged each by its own text, in any order of
rows; ``dedup`` keeps one row of each kept (doc_id, text) and every row of null doc_id. Ties: the
smallest doc_id of a group stays, of its texts in the group the one with the least hash. A text of any length is compared whole; its shingles are held in memory, some
100 bytes a word. An empty table gives an empty result. Other columns, whatever their names, play no
part and pass ``dedup`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import CHUNK_BYTES, Words, clean_columns, components, in_arrow, materialize, mix, packed, release, spread_join, table, text_buffers, tidy, valid_grams, word_chunks

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 5
REGISTERS = BANDS * ROWS
MAX_DIFFERENT_BITS = 27  # of 120; at 0.8 they are 12 on average with a standard deviation of 3.3
MORE_REGISTERS = 480
MOST = 500_000  # elements whose arrivals are worked on at once
MIN_AGREEMENT, MIN_MORE_AGREEMENT = 0.643, 0.7215  # 4.3 standard deviations below 0.8 for 120 and 480 registers
LEFT, RIGHT = (512, 4_000_000), (2048, 8_000_000)  # documents and bytes of a block
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def weighted(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, hash) with counts: (hash, doc, count)."""
    key = mix(hashes + docs.astype(np.uint64) * _C[0])
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    first = order[new]
    return hashes[first], docs[first], np.diff(np.concatenate([new, [len(key)]]))


def prob_min_hash(hashes: np.ndarray, docs: np.ndarray, weights: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """(n_docs, m) element of the earliest arrival on each register."""
    q = np.full(n_docs * m, np.inf)
    z = np.zeros(n_docs * m, np.uint64)
    for at in range(0, len(hashes), MOST):  # later blocks begin with the registers of those before
        part = slice(at, at + MOST)
        _arrive(q, z, hashes[part], docs[part], weights[part].astype(float), n_docs, m)
    return z.reshape(n_docs, m)


def _arrive(q: np.ndarray, z: np.ndarray, d: np.ndarray, g: np.ndarray, rate: np.ndarray, n_docs: int, m: int) -> None:
    """Run the processes of elements d of documents g until none can be earlier than what a register holds."""
    x = np.zeros(len(d))
    turn, width = 0, 1
    while len(d):
        width = max(1, min(width, 2_000_000 // len(d)))
        step = (np.arange(turn, turn + width, dtype=np.uint64) + np.uint64(1)) * _C[1]
        bits = mix(d[:, None] + step[None, :])
        arrive = np.log((bits >> np.uint64(11)).astype(float) + 0.5)
        arrive = np.cumsum((36.7368005696771 - arrive) / rate[:, None], axis=1) + x[:, None]  # -log of a uniform in (0, 1)
        at = g[:, None] * m + ((mix(bits ^ _C[2]) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        flat_at, flat_x = at.ravel(), arrive.ravel()
        better = np.flatnonzero(flat_x < q[flat_at])
        flat_at, flat_x = flat_at[better], flat_x[better]
        np.minimum.at(q, flat_at, flat_x)
        won = flat_x == q[flat_at]
        z[flat_at[won]] = d[better[won] // width]
        latest = q.reshape(n_docs, m).max(axis=1)
        x = arrive[:, -1]
        go = x < latest[g]
        d, g, rate, x = d[go], g[go], rate[go], x[go]
        turn += width
        width = 1 if turn < 2 else width * 2


def _digest():
    return F.xxhash64(F.col("text").isNull(), F.col("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, t, h1, h2, keys, s1, s2) of documents; t is a hash of the text, null h1 marks those without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in word_chunks(batch.column(2)):
                n = to - at
                of = w.of()
                pos = (np.arange(len(of)) - w.first[of]).astype(np.uint64)
                ident = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
                some = np.flatnonzero(w.count)
                if len(some):
                    for i in (0, 1):
                        ident[i][some] = np.add.reduceat(mix(w.hash + pos * _C[i]), w.first[some])
                z = prob_min_hash(*weighted(*valid_grams(w, SHINGLE, short=True)), n)
                keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (n, 1))
                for r in range(ROWS):
                    keys = mix(keys * _C[0] + z[:, r::ROWS][:, :BANDS])
                bit = (mix(z) >> np.uint64(63)).astype(np.int64)
                half = REGISTERS // 2
                sketch = [(bit[:, i * half : (i + 1) * half] << np.arange(half)).sum(axis=1) for i in (0, 1)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
                none = pa.array(w.count == 0)
                h1 = pc.if_else(none, None, pa.array(ident[0].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), h1, pa.array(ident[1].view(np.int64)), lists, pa.array(sketch[0]), pa.array(sketch[1])], names=["doc_id", "t", "h1", "h2", "keys", "s1", "s2"])

    slim = clean_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("t"), "text")
    return packed(slim).transform(in_arrow, sign, "doc_id long, t long, h1 long, h2 long, keys array<long>, s1 long, s2 long")


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """J_P of two weightings of one list of elements."""
    if not len(a):
        return 0.0
    kinds, n = np.unique(np.stack([a, b], 1), axis=0, return_counts=True)
    a, b, n = kinds[:, 0].astype(float), kinds[:, 1].astype(float), n.astype(float)
    total = 0.0
    for k in np.flatnonzero((a > 0) & (b > 0)):
        total += n[k] / (n * np.maximum(a / a[k], b / b[k])).sum()
    return total


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Exact J_P of the weighted shingles of texts, pair by pair."""
    n = len(left)
    sides = []
    for column in (left, right):
        data, offsets = text_buffers(column)
        h, d, c = weighted(*valid_grams(Words(data, offsets), SHINGLE, short=True))
        key = mix(h + d.astype(np.uint64) * _C[3])
        order = np.argsort(key)
        sides.append((key[order], d[order], c[order]))
    (ka, da, ca), (kb, db, cb) = sides
    place = np.searchsorted(kb, ka)
    place[place == len(kb)] = 0
    shared = kb[place] == ka if len(kb) else np.zeros(len(ka), bool)
    inter = np.bincount(da[shared], minlength=n)
    na, nb = np.bincount(da, minlength=n), np.bincount(db, minlength=n)
    out = inter / np.maximum(na + nb - inter, 1)
    many = np.unique(np.concatenate([da[ca > 1], db[cb > 1]]))
    if len(many):
        left_over = np.ones(len(kb), bool)
        left_over[place[shared]] = False
        d = np.concatenate([da, db[left_over]])
        wa = np.concatenate([ca, np.zeros(left_over.sum(), np.int64)])
        wb = np.concatenate([np.where(shared, cb[place] if len(kb) else 0, 0), cb[left_over]])
        order = np.argsort(d, kind="stable")
        d, wa, wb = d[order], wa[order], wb[order]
        begin, end = np.searchsorted(d, many), np.searchsorted(d, many, side="right")
        for p, i, j in zip(many, begin, end, strict=True):
            out[p] = probability_jaccard(wa[i:j], wb[i:j])
    return out


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, text) of the classes (rep, doc_id, t), one row each. Both sides are shuffled at every size: ids grow with the data."""
    rows = clean_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("t"), "text")
    return materialize(rows.join(ids.hint("merge"), ["doc_id", "t"]).select("rep", "text").dropDuplicates(["rep"]), "dedup-texts")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of classes whose texts have J_P >= threshold."""
    side = lambda c: texts.select(F.col("rep").alias(c), F.col("text").alias(f"t{c}"))
    both = spread_join(spread_join(pairs, "a", side("a")).select("a", "b", "ta"), "b", side("b")).select("a", "b", "ta", "tb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False) for c in ("ta", "tb")))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_BYTES, side="right")))
                part = batch.slice(at, to - at)
                sim = similarities(part.column("ta"), part.column("tb"))
                yield part.select(["a", "b"]).append_column("similarity", pa.array(sim)).filter(pa.array(sim >= threshold))
                at = to

    return materialize(both.transform(in_arrow, check, "a long, b long, similarity double"), "dedup-edges")


def _alike():
    return F.bit_count(F.col("x1").bitwiseXOR(F.col("y1"))) + F.bit_count(F.col("x2").bitwiseXOR(F.col("y2"))) <= MAX_DIFFERENT_BITS


class _Bags:
    """Weighted shingles of texts: sorted distinct hashes and counts of each."""

    def __init__(self, texts: pa.Array):
        self.hashes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        for at, to, w in word_chunks(texts):
            h, d = valid_grams(w, SHINGLE, short=True)
            cut = np.searchsorted(d, np.arange(to - at + 1))
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                u, c = np.unique(h[i:j], return_counts=True)
                self.hashes.append(u)
                self.counts.append(c)

    def similarity(self, i: int, other: _Bags, j: int) -> float:
        a, b = self.hashes[i], other.hashes[j]
        if min(len(a), len(b)) == 0:
            return 0.0
        place = np.searchsorted(b, a)
        place[place == len(b)] = 0
        shared = b[place] == a
        n = int(shared.sum())
        ca, cb = self.counts[i], other.counts[j]
        if ca.max() == 1 and cb.max() == 1:
            return n / (len(a) + len(b) - n)
        rest = np.ones(len(b), bool)
        rest[place[shared]] = False
        return probability_jaccard(np.concatenate([ca, np.zeros(rest.sum(), np.int64)]), np.concatenate([np.where(shared, cb[place], 0), cb[rest]]))


def _some(texts: pa.Array, at: np.ndarray, make) -> tuple[object, np.ndarray]:
    """(make of the texts at ``at``, place of each of them in it)."""
    which, place = np.unique(at, return_inverse=True)
    return make(texts.take(pa.array(which))), place


def _block_links(left: pa.Table, right: pa.Table, threshold: float) -> list[tuple[int, int, float]]:
    """Links that join different components among the pairs of two blocks (rep, component, text)."""
    texts = [t.column("text").combine_chunks() for t in (left, right)]
    z = [_registers(t, REGISTERS) for t in texts]
    rep, comp = ([t.column(c).to_numpy() for t in (left, right)] for c in ("rep", "component"))
    found_i, found_j, found_s = [], [], []
    step = max(1, 4_000_000 // (REGISTERS * len(z[1])))
    for at in range(0, len(z[0]), step):
        agree = (z[0][at : at + step, None, :] == z[1][None, :, :]).sum(axis=2, dtype=np.int16)
        i, j = np.nonzero((agree >= MIN_AGREEMENT * REGISTERS) & (comp[0][at : at + step, None] != comp[1][None, :]))
        found_i.append(i + at)
        found_j.append(j)
        found_s.append(agree[i, j])
    i, j, s = map(np.concatenate, (found_i, found_j, found_s))
    if not len(i):
        return []
    (more_i, at_i), (more_j, at_j) = (_some(t, k, lambda t: _registers(t, MORE_REGISTERS)) for t, k in zip(texts, (i, j), strict=True))
    parts = np.array_split(np.arange(len(i)), max(1, len(i) * MORE_REGISTERS // 4_000_000))
    s = np.concatenate([(more_i[at_i[p]] == more_j[at_j[p]]).sum(axis=1) for p in parts])
    good = s >= MIN_MORE_AGREEMENT * MORE_REGISTERS
    i, j, s = i[good], j[good], s[good]
    if not len(i):
        return []
    order = np.lexsort((j, i, -s))
    i, j = i[order], j[order]
    (bags_i, at_i), (bags_j, at_j) = (_some(t, k, _Bags) for t, k in zip(texts, (i, j), strict=True))
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.setdefault(c, c)) != c:
            root[c] = root.setdefault(up, up)
            c = up
        return c

    out = []
    for x, y, p, q in zip(i.tolist(), j.tolist(), at_i.tolist(), at_j.tolist(), strict=True):
        a, b = find(int(comp[0][x])), find(int(comp[1][y]))
        if a != b and (sim := bags_i.similarity(p, bags_j, q)) >= threshold:
            root[max(a, b)] = min(a, b)
            out.append((int(rep[0][x]), int(rep[1][y]), sim))
    return out


def _family_links(texts: DataFrame, placed: DataFrame, counts: DataFrame, threshold: float) -> DataFrame | None:
    """Links between documents of different components that share a bucket; placed: (key, rep, component) of all shared buckets, counts: (key, n)."""
    per = placed.groupBy("key", "component").agg(F.min("rep").alias("rep"))
    mixed = per.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.min("rep").alias("hub")).where("kinds > 1").select("key", "hub")
    open_ = materialize(spread_join(placed, "key", mixed, counts=counts, grows=True).select("rep", "component", "hub"), "dedup-open")
    family = components(open_.select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    everyone = open_.select("rep", "component").distinct().join(family.select(F.col("id").alias("rep"), F.col("component").alias("family")), "rep")
    rows = materialize(everyone.join(texts.hint("merge"), "rep"), "dedup-families")
    release(open_)
    if not rows.limit(1).count():
        return None
    load = rows.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    parts = lambda n, size, most: F.greatest(F.ceil(n / most[0]), F.ceil(size / most[1])).cast("int")
    plan = (
        load.groupBy("family")
        .agg(F.max(F.struct("n", "component", "bytes")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
        .where("n > top.n")
        .select("family", F.col("top.component").alias("top"), parts(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes"), LEFT).alias("nl"), parts(F.col("n"), F.col("bytes"), RIGHT).alias("nr"))
    )
    every = spread_join(rows, "family", plan)
    spot = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ["family", "l", "r", "side", "rep", "component", "text"]
    left = every.where("component <> top").withColumn("l", spot("nl", 1)).withColumn("r", each("nr")).withColumn("side", F.lit(0))
    right = every.withColumn("r", spot("nr", 2)).withColumn("l", each("nl")).withColumn("side", F.lit(1))
    dealt = left.select(names).unionByName(right.select(names)).repartition("family", "l", "r").sortWithinPartitions("family", "l", "r", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(block: pa.Table) -> pa.RecordBatch | None:
            side = block.column("side").to_numpy()
            n = int((side == 0).sum())
            if n == 0 or n == len(side):
                return None
            links = _block_links(block.slice(0, n), block.slice(n), threshold)
            if not links:
                return None
            a, b, sim = zip(*links, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float64())], names=["a", "b", "similarity"])

        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            ids = [held.column(c).to_numpy() for c in ("family", "l", "r")]
            at = 0
            for to in np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1:
                if (out := done(held.slice(at, to - at).combine_chunks())) is not None:
                    yield out
                at = int(to)
            held = held.slice(at)
        if held is not None and len(held) and (out := done(held.combine_chunks())) is not None:
            yield out

    links = materialize(dealt.transform(in_arrow, compare, "a long, b long, similarity double"), "dedup-edges")
    release(rows)
    return links


def _registers(texts: pa.Array | pa.ChunkedArray, m: int) -> np.ndarray:
    """16 bits of each of m registers of each text."""
    out = []
    for at, to, w in word_chunks(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts):
        z = prob_min_hash(*weighted(*valid_grams(w, SHINGLE, short=True)), to - at, m)
        out.append((mix(z + _C[3]) >> np.uint64(48)).astype(np.uint16))
    return np.concatenate(out)


@tidy("dedup-result")
def _judged(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, t, component_id, kept) of every row."""
    signed = materialize(signatures(docs), "dedup-signatures")
    known = signed.where("h1 is not null and doc_id is not null")
    classes = known.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "t")).alias("at"), F.first("keys").alias("keys"), F.first("s1").alias("s1"), F.first("s2").alias("s2"))
    # numbers hold once they are written; nothing but the written table is read
    reps = materialize(classes.select(F.monotonically_increasing_id().alias("rep"), "h1", "h2", "at", "keys", "s1", "s2"), "dedup-classes")
    entries = reps.select("rep", F.explode("keys").alias("key"))
    shared = materialize(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "dedup-shared")
    members = materialize(spread_join(entries, "key", shared.select("key"), counts=shared, grows=True).join(reps.select("rep", "h1", "s1", "s2"), "rep"), "dedup-members")
    hubs = members.groupBy("key").agg(*[F.min(F.struct(F.xxhash64(F.lit(i), "h1").alias("h"), "rep", "s1", "s2")).alias(f"hub{i}") for i in (0, 1, 2)])
    tried = spread_join(members, "key", hubs, counts=shared).select(F.col("rep").alias("x"), F.col("s1").alias("x1"), F.col("s2").alias("x2"), F.explode(F.array("hub0", "hub1", "hub2")).alias("hub"))
    tried = tried.select("x", "x1", "x2", F.col("hub.rep").alias("y"), F.col("hub.s1").alias("y1"), F.col("hub.s2").alias("y2")).where(_alike() & (F.col("x") != F.col("y")))
    first = materialize(tried.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "dedup-pairs")
    texts = _texts(docs, members.select("rep").distinct().join(reps.select("rep", "at.*").hint("merge"), "rep"))
    edges = verified(first, texts, threshold)
    comp = components(edges)
    placed = members.select("key", "rep").join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    more = _family_links(texts, placed, shared, threshold)
    if more is not None and more.limit(1).count():
        comp = components(edges.unionByName(more))
    release(members, shared, first, texts)
    linked = comp.select(F.col("id").alias("rep"), "component").join(reps.select("rep", "at").hint("merge"), "rep")
    stays = materialize(spread_join(linked.select("rep", "component"), "component", linked.groupBy("component").agg(F.min("at").alias("stays")), grows=True).select("rep", "stays"), "dedup-stays")
    named = reps.select("rep", "h1", "h2", "at").join(stays.hint("merge"), "rep", "left").select("h1", "h2", F.coalesce("stays", "at").alias("stays"))
    rows = spread_join(known.select("doc_id", "t", "h1", "h2"), ["h1", "h2"], named, grows=True)
    judged = rows.select("doc_id", "t", F.col("stays.doc_id").alias("component_id"), (F.struct("doc_id", "t") == F.col("stays")).alias("kept"))
    alone = signed.where("h1 is null or doc_id is null").select("doc_id", "t", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return judged.unionByName(alone)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, component_id, kept) of every row; component_id is the smallest doc_id of its group."""
    return _judged(docs, threshold).drop("t")


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group; of rows with equal doc_id and text one, with null doc_id all."""
    found = _judged(docs, threshold).where("doc_id is not null")
    drop = found.where("not kept").select("doc_id", "t").distinct()
    # one struct holds the row, so no column's name matters
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("t"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = rows.join(drop.hint("merge"), ["doc_id", "t"], "left_anti")  # drop grows with the data: never broadcast
    if found.where("kept").groupBy("doc_id", "t").count().where("count > 1").limit(1).count():
        once = out.where("doc_id is not null").groupBy("doc_id", "t").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        out = once.unionByName(out.where("doc_id is null"))
    return out.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
