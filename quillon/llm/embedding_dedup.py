"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Vectors are scaled to length 1, where cosine >= c means distance <= sqrt(2 - 2c). Each of L tables
buckets a vector by k quantised projections floor((a.v + b) / WIDTH). k grows with log(n), so that
unrelated vectors of a label rarely share a bucket, and L is set so that a pair exactly at the
threshold is missed with probability MISS at most. Buckets are compared in blocks of bounded size;
a block yields, for each vector, the number of partners not met in an earlier table, and its
smallest partner's group - not pairs. Equal vectors of a label are one vector with a multiplicity.

Defined cases. Vectors that are null, empty, zero, or hold null or non-finite components, and rows
with null label, link with nothing. Vectors of different lengths never link. Null vec_id: links
with nothing, component null, kept. Equal vec_ids are one node of the components; each of their
rows counts as a vector. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import clean_columns, components, in_arrow, materialize, mix, partitions, spread_join, table, tidy

THRESHOLD, WIDTH, MISS, BLOCK = 0.98, 2.0, 1e-3, 512


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that two vectors at this distance share one quantised Gaussian projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def shape(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(tables, hashes) for n vectors."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    hashes = max(4, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return math.ceil(math.log(MISS) / math.log1p(-(near**hashes))), hashes


def _projections(dim: int, tables: int, hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * hashes)), rng.uniform(0, WIDTH, tables * hashes), rng.integers(1, 1 << 63, (tables, hashes), dtype=np.uint64) | np.uint64(1)


def _keyed(vectors: DataFrame, tables: int, hashes: int, seed: int) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("vec"))
            lens = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begin = np.cumsum(lens) - lens
            group = batch.column(batch.schema.get_field_index("grp")).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            keys = np.zeros((batch.num_rows, tables), np.uint64)
            for dim in np.unique(lens):
                if dim not in made:
                    made[dim] = _projections(int(dim), tables, hashes, seed)
                a, b, mult = made[dim]
                at = np.flatnonzero(lens == dim)
                for part in np.array_split(at, max(1, len(at) // 2048)):
                    v = flat[begin[part][:, None] + np.arange(dim)]
                    v /= np.linalg.norm(v, axis=1)[:, None]
                    cell = np.floor((v @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(part), tables, hashes)
                    keys[part] = mix((mix(cell) * mult).sum(axis=2) + np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + group[part][:, None])
            flat_keys = pa.array(keys.view(np.int64).ravel())
            column = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), flat_keys)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "keys"])

    schema = ", ".join(f"{n} {t}" for n, t in vectors.dtypes) + ", keys array<bigint>"
    return vectors.transform(in_arrow, add, schema)


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each of n nodes' component under the edges (i, j)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _compare(v: np.ndarray, keys: np.ndarray, m: np.ndarray, side: np.ndarray, t: int, one: bool, threshold: float):
    """(partners met first in table t, local component) of the rows of one block pair; side: 0 or 1, ``one``: both sides are one block."""
    n = len(v)
    norm = np.linalg.norm(v, axis=1)
    links = np.zeros(n, np.int64)
    edges_i, edges_j = [], []
    for at in range(0, n, 256):
        c = (v[at : at + 256] @ v.T) / (norm[at : at + 256, None] * norm[None, :])
        ok = c >= threshold
        ok &= np.arange(n)[None, :] > np.arange(at, min(n, at + 256))[:, None]
        if not one:
            ok &= side[at : at + 256, None] != side[None, :]
        i, j = np.nonzero(ok)
        i += at
        if not len(i):
            continue
        edges_i.append(i)
        edges_j.append(j)
        fresh = np.ones(len(i), bool)
        for e in range(t):
            fresh &= keys[i, e] != keys[j, e]
        np.add.at(links, i[fresh], m[j[fresh]])
        np.add.at(links, j[fresh], m[i[fresh]])
    if not edges_i:
        return links, np.arange(n)
    return links, _local_roots(n, np.concatenate(edges_i), np.concatenate(edges_j))


@tidy("vec-result")
def link(vectors: DataFrame, threshold: float = THRESHOLD, seed: int = 8, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of rows (vec_id, label, embedding); links join vectors of equal label."""
    spark = vectors.sparkSession
    rows = clean_columns(vectors, "vec_id", "label", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    digest = F.concat(F.hex(F.xxhash64(F.lit(1), "label", "vec")), F.lit("-"), F.hex(F.xxhash64(F.lit(2), "label", "vec")))
    keyed = materialize(rows.withColumn("k", F.when(usable, digest)).withColumn("label", F.col("label").cast("string")), "vec-rows")
    classes = keyed.where("k is not null").groupBy("k").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("vec").alias("vec"), F.first("label").alias("label"))
    n = classes.count()
    tables, hashes = shape(n, threshold)
    reps = materialize(_keyed(classes.withColumn("grp", F.xxhash64("label", F.size("vec"))).drop("label"), tables, hashes, seed), "vec-keys")
    entries = reps.select("k", F.posexplode("keys").alias("t", "key"))
    size = materialize(entries.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "vec-sizes")
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("k", F.lit(3)), F.col("parts")).cast("int")
    member = (
        spread_join(entries, ["t", "key"], size, counts=size, grows=True)
        .withColumn("parts", parts)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .select("t", "key", "i", "j", "k", (F.col("own") == F.col("j")).cast("int").alias("side"))
    )
    dealt = (
        spread_join(member, "k", reps.select("k", "rep", "m", "vec", "keys"))
        .repartition(partitions(spark), "t", "key", "i", "j")
        .sortWithinPartitions("t", "key", "i", "j")
        .select("t", "key", "i", "j", "side", "k", "rep", "m", "vec", "keys")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(group: pa.Table):
            g = group.combine_chunks()
            t, i, j = (g.column(c)[0].as_py() for c in ("t", "i", "j"))
            lists = g.column("vec").chunk(0)
            lens = lists.value_lengths().to_numpy(zero_copy_only=False)
            if (lens != lens[0]).any():
                return None  # a collision of 64-bit keys between lengths
            v = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lens), -1)
            keys = g.column("keys").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(len(lens), -1)
            rep = g.column("rep").to_numpy()
            links, root = _compare(v, keys, g.column("m").to_numpy(), g.column("side").to_numpy(), t, i == j, threshold)
            some = links.astype(bool) | (root != np.arange(len(root)))
            if not some.any():
                return None
            return pa.RecordBatch.from_arrays([g.column("k").filter(pa.array(some)).combine_chunks(), pa.array(rep[some]), pa.array(links[some]), pa.array(rep[root[some]])], names=["k", "rep", "links", "near"])

        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            ids = [held.column(c).to_numpy() for c in ("t", "key", "i", "j")]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
            at = 0
            for to in change:
                if (out := done(held.slice(at, to - at))) is not None:
                    yield out
                at = int(to)
            held = held.slice(at)
        if held is not None and len(held) and (out := done(held)) is not None:
            yield out

    found = materialize(dealt.transform(in_arrow, compare, "k string, rep long, links long, near long"), "vec-links")
    counts = found.groupBy("k").agg(F.sum("links").alias("links"))
    comp = components(found.where("rep <> near").select(F.col("rep").alias("a"), F.col("near").alias("b")).unionByName(
        keyed.where("k is not null").join(reps.select("k", "rep"), "k").where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")) if _repeats(keyed) else found.where("false").select(F.col("rep").alias("a"), F.col("near").alias("b"))
    ))
    per = reps.select("k", "m").join(counts, "k", "left").select("k", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = spread_join(keyed.where("k is not null").select("k", "vec_id"), "k", per).select("vec_id", "n_links").unionByName(keyed.where("k is null").select("vec_id", F.lit(0).cast("long").alias("n_links")))
    out = out.join(comp.select(F.col("id").alias("vec_id"), "component"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", "n_links", component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _repeats(keyed: DataFrame) -> bool:
    """Whether any class has more than one row."""
    return bool(keyed.where("k is not null").groupBy("k").count().where("count > 1").limit(1).count())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))


SQL = """
with recursive e as (
  select vec_id, label, embedding::double[] as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.98),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as component_id from r group by 1),
n as (select a, count(*) as n_links from l group by 1)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings left join n on n.a = vec_id left join c on c.a = vec_id
"""
