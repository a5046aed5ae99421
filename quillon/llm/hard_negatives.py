"""Hard negatives by exact search with a rotated, early-ended inner product.

Rows are integer vectors, floor(256 * x), and score an anchor by the integer inner product. An
anchor's positives are its best rows of the same label; the hard negatives of a positive are the best
rows of other labels that score 80 to 100 % of what the positive does.

Anchors and rows meet in blocks, so every row meets every anchor: no index, recall is 1. All vectors
are turned by the principal axes of the rows' second moments, summed over all rows; a turn leaves inner
products as they are and gathers most of them in the leading components. A block first takes the
product of the first quarter of the components. What the rest can add is at most the product of both
residual norms, plus SLACK of the norms for rounding; pairs that can't reach what is needed - the
anchor's bounds, or the best found so far in the block - are discarded, then again at half of the
components. Survivors are scored exactly in integers. The best of each block are merged by rank.

Two passes: positives, then negatives within the bounds that the positives give. Each task holds one
block of anchors and a few rows at a time; the principal axes go to the driver, the square of a
vector's length in numbers whatever the input.

Defined cases. Rows with null id, label or vector, or a component that is null or not finite, take no
part. Vectors of different lengths never meet. Rows with the anchor's own vec_id are not its
candidates; equal anchor rows are one anchor, other repeated rows are each a candidate. Ties: smaller
vec_id first. Scores beyond a long are held at its ends. Positives with a negative score have no
negatives. An empty table gives an empty result. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import clean_columns, in_arrow, materialize, partitions, table, tidy

SCALE, LABELS, MOVED, ANCHORS = 256, 10, 7, 100
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
SHARE = HIGH // (HIGH - LOW)
ANCHOR_BLOCK, ROW_BLOCK, TILE, PAIRS = 8192, 200_000, 1_000_000, 200_000
SLACK, MAX_TURNED = 1e-10, 512
_LEAST, _MOST = int(np.iinfo(np.int64).min), int(np.iinfo(np.int64).max)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; v: integers as doubles."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda x: F.when(F.abs(x * SCALE) < 2.0**53, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE)  # noqa: E731  larger ones are whole
    rows = clean_columns(vectors, "vec_id", "label", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite).select("vec_id", "label", F.transform("v", whole).alias("v"))


def axes(rows: DataFrame) -> np.ndarray | None:
    """Principal axes of the rows of the commonest length, as columns, strongest first; None if there are none or they are over MAX_TURNED."""
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    if top is None or not 0 < top.n <= MAX_TURNED:
        return None
    n = top.n

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            with np.errstate(over="ignore", invalid="ignore"):
                total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n, dtype=np.int32)), pa.array(total.ravel())], names=["at", "x"])

    sums = rows.where(F.size("v") == n).select("v").transform(in_arrow, moments, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    square = np.zeros(n * n)
    square[[r.at for r in sums]] = [r.x for r in sums]
    if not np.isfinite(square).all():
        return None
    return np.linalg.eigh(square.reshape(n, n))[1][:, ::-1]


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and b."""
    if not a.size or float(np.linalg.norm(a, axis=1).max()) * float(np.linalg.norm(b, axis=1).max()) < 2.0**62:
        return (a.astype(np.int64) * b.astype(np.int64)).sum(axis=1)
    return np.array([min(max(sum(int(x) * int(y) for x, y in zip(p, q, strict=True)), _LEAST), _MOST) for p, q in zip(a.tolist(), b.tolist(), strict=True)], np.int64)


class Turned:
    """Vectors turned by the axes: leading components, and norms of what is left after a quarter and a half of them."""

    def __init__(self, v: np.ndarray, turn: np.ndarray | None):
        self.v = v
        self.x = v @ turn if turn is not None and len(turn) == v.shape[1] else v
        n = v.shape[1]
        self.cuts = (n // 4, n // 2)
        self.rest = [np.linalg.norm(self.x[:, c:], axis=1) for c in self.cuts]
        self.norm = np.linalg.norm(v, axis=1)


def _best(key: np.ndarray, score: np.ndarray, id_: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each key: highest score, then smallest id."""
    order = np.lexsort((id_, ~score, key))  # ~x orders as -x does, and can't overflow
    key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    rank = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
    return order[rank < k]


def _real(score: np.ndarray) -> np.ndarray:
    """Scores as bounds of products: those held at a long's end have none beyond it."""
    return np.where(score == _MOST, np.inf, np.where(score == _LEAST, -np.inf, score.astype(float)))


class Block:
    """A block of anchors and the best that the rows so far give them.

    Without ``wanted`` these are rows of the anchor's label, else rows of other labels, for each of the
    scores wanted[anchor, slot] (_LEAST: none) those of LOW to HIGH % of it.
    """

    def __init__(self, id_, label, v, turn, wanted: np.ndarray | None = None):
        self.id, self.label, self.wanted = id_, label, wanted
        self.a, self.turn = Turned(v, turn), turn
        self.slots, self.k = (1, POSITIVES) if wanted is None else (wanted.shape[1], NEGATIVES)
        none = np.zeros(0, np.int64)
        self.key, self.score, self.found = none, none, none
        if wanted is not None:
            some = wanted >= 0
            self.low, self.high = np.where(some, np.ceil(wanted * (LOW / HIGH)) - 1, np.inf), _real(np.where(some, wanted, _LEAST).max(axis=1))
        else:
            self.low, self.high = np.full((len(id_), 1), -np.inf), np.full(len(id_), np.inf)

    def _floor(self) -> np.ndarray:
        """The least score by which a row can still be among an anchor's best."""
        floor = self.low.copy().ravel()
        n = np.bincount(self.key, minlength=len(floor)) if len(self.key) else np.zeros(len(floor), np.int64)
        last = np.cumsum(n)[n >= self.k] - 1  # keys are in order, best first
        full = n >= self.k
        floor[full] = np.maximum(floor[full], np.minimum(_real(self.score[last]), float(_MOST)))
        return floor.reshape(self.low.shape).min(axis=1)

    def meet(self, id_: np.ndarray, label: np.ndarray, v: np.ndarray) -> None:
        step = max(1, TILE // max(1, len(self.id)))
        for at in range(0, len(id_), step):
            self._tile(id_[at : at + step], label[at : at + step], Turned(v[at : at + step], self.turn))

    def _tile(self, id_: np.ndarray, label: np.ndarray, b: Turned) -> None:
        a, floor = self.a, self._floor()
        c0, c1 = a.cuts
        part = a.x[:, :c0] @ b.x[:, :c0].T
        room = a.rest[0][:, None] * b.rest[0] + SLACK * (a.norm[:, None] * b.norm)
        same = self.label[:, None] == label
        go = (same if self.wanted is None else ~same) & (self.id[:, None] != id_) & ~(part + room < floor[:, None]) & ~(part - room > self.high[:, None])  # what overflows stays
        pairs = np.flatnonzero(go.ravel())
        for at in range(0, len(pairs), PAIRS):
            i, j = np.divmod(pairs[at : at + PAIRS], len(id_))
            partial = part[i, j] + np.einsum("ij,ij->i", a.x[i, c0:c1], b.x[j, c0:c1])
            room_ = a.rest[1][i] * b.rest[1][j] + SLACK * (a.norm[i] * b.norm[j])
            stay = ~(partial + room_ < floor[i]) & ~(partial - room_ > self.high[i])
            i, j = i[stay], j[stay]
            self._add(i, exact(a.v[i], b.v[j]), id_[j])
            floor = self._floor()

    def _add(self, i: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if self.wanted is None:
            key = i
        else:
            want, own = self.wanted[i], score[:, None]
            fits = (want >= 0) & (own >= 0) & (own <= want)
            fits[fits] = (want - own)[fits] <= (want // SHARE)[fits]  # LOW * want <= HIGH * own
            row, slot = np.nonzero(fits)
            key, score, id_ = i[row] * self.slots + slot, score[row], id_[row]
        key, score, id_ = np.append(self.key, key), np.append(self.score, score), np.append(self.found, id_)
        top = _best(key, score, id_, self.k)
        self.key, self.score, self.found = key[top], score[top], id_[top]


def _blocks(anchors: DataFrame, rows: DataFrame, turn: np.ndarray | None, per_anchor: bool) -> DataFrame:
    """(vec_id, mark, slot, score, found): the best of each block; anchors (vec_id, mark, label, v, wanted) meet all rows."""
    spark = rows.sparkSession
    n_rows, n_anchors = rows.count(), anchors.count()
    r, s = max(3 * partitions(spark), -(-n_rows // ROW_BLOCK)), max(1, -(-n_anchors // ANCHOR_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select(each(r).alias("r"), F.pmod(F.xxhash64("vec_id", "mark"), F.lit(s)).cast("int").alias("s"), F.lit(0).alias("side"), "vec_id", "mark", "label", "v", "wanted")
    right = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(r)).cast("int").alias("r"), each(s).alias("s"), F.lit(1).alias("side"), "vec_id", F.lit(0).cast("long").alias("mark"), "label", "v", F.lit(None).cast("array<long>").alias("wanted"))
    dealt = left.unionByName(right).withColumn("n", F.size("v")).repartition("r", "s").sortWithinPartitions("r", "s", "n", "side")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, mark, now, held = None, None, None, []

        def done() -> Iterator[pa.RecordBatch]:
            if block is not None and len(block.key):
                i, slot = np.divmod(block.key, block.slots)
                yield pa.RecordBatch.from_arrays([pa.array(block.id[i]), pa.array(mark[i]), pa.array(slot.astype(np.int32)), pa.array(block.score), pa.array(block.found)], names=["vec_id", "mark", "slot", "score", "found"])

        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("r", "s", "n", "side")]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if batch.num_rows else []
            for at, to in zip([0, *cuts], [*cuts, batch.num_rows], strict=True) if batch.num_rows else []:
                part = batch.slice(at, to - at)
                group = tuple(int(k[at]) for k in keys[:3])
                if group != now:
                    yield from done()
                    block, held, now = None, [], group
                if keys[3][at] == 0:
                    held.append(part)
                    continue
                if block is None and held:
                    t = pa.Table.from_batches(held).combine_chunks()
                    mark = t.column("mark").to_numpy()
                    wanted = None if per_anchor else _padded(t.column("wanted").combine_chunks())
                    block = Block(t.column("vec_id").to_numpy(), t.column("label").to_numpy(), _matrix(t.column("v").combine_chunks(), group[2]), turn, wanted)
                    held = []
                if block is not None:
                    block.meet(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("v"), group[2]))
        yield from done()

    return dealt.transform(in_arrow, meet, "vec_id long, mark long, slot int, score long, found long")


def _array(c: pa.Array | pa.ChunkedArray) -> pa.Array:
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def _matrix(lists: pa.Array, n: int) -> np.ndarray:
    lists = _array(lists)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), n)


def _padded(lists: pa.Array) -> np.ndarray:
    """Lists of at most POSITIVES longs, filled up with _LEAST."""
    lists = _array(lists)
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(n), POSITIVES), _LEAST)
    out[np.arange(POSITIVES) < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _ranked(found: DataFrame, by: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "found")  # at most ``most`` rows of each block
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


@tidy("negatives")
def mine(vectors: DataFrame, every: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors: rows whose vec_id ``every`` divides."""
    rows = materialize(usable(vectors), "negatives-rows")
    turn = axes(rows)
    anchors = rows.where(F.col("vec_id") % every == 0).withColumn("mark", F.xxhash64("label", "v")).dropDuplicates(["vec_id", "mark"])
    anchors = materialize(anchors.withColumn("wanted", F.lit(None).cast("array<long>")), "negatives-anchors")
    by = ["vec_id", "mark"]
    best = materialize(_ranked(_blocks(anchors, rows, turn, True).drop("slot"), by, POSITIVES), "negatives-positives")
    lists = best.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "score", "found"))).alias("p"))
    wanted = anchors.drop("wanted").join(lists.select(*by, F.col("p.score").alias("wanted")), by)
    found = _ranked(_blocks(wanted, rows, turn, False), [*by, "slot"], NEGATIVES)
    of = best.select(*by, (F.col("rank") - 1).alias("slot"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(of.hint("merge"), [*by, "slot"])
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = clean_columns(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    return mine(vectors.withColumn("label", F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))))


SQL = f"""
with e as (
  select vec_id, case when vec_id % {MOVED} = 0 then (label + 1) % {LABELS} else label end as label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as a, e.vec_id as b, a.label = e.label as same, list_inner_product(a.v, e.v)::bigint as score from e as a join e on a.vec_id % {ANCHORS} = 0 and a.vec_id <> e.vec_id and len(a.v) = len(e.v)),
p as (select a, b, score from s where same qualify row_number() over (partition by a order by score desc, b) <= {POSITIVES}),
n as (
  select p.a as anchor_id, p.b as positive_id, row_number() over (partition by p.a, p.b order by s.score desc, s.b)::integer as rank, s.b as negative_id, p.score as positive_score, s.score as negative_score
  from p join s on p.a = s.a and not s.same and {LOW} * p.score <= {HIGH} * s.score and s.score <= p.score)
select * from n where rank <= {NEGATIVES}
"""
