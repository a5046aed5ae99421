"""Mixing sources to target weights: whole repeats plus one hash-seeded Bernoulli copy.

Sizes are words (runs of anything but ASCII white space; null text: 0), summed per source over all
documents. Sources in code point order, null last, get the weights in turn and share the whole sum
of sizes; a target stops at ``cap`` times its source's size, and what is over goes to the other
sources by weight until no target is above its cap (water filling, in closed form over sources
sorted by cap / weight). A document is emitted floor(rate) times, rate = target / size of its
source, and once more if a hash of seed and doc_id falls below the fraction. Such copies are
independent, so in a small source a few long documents can carry it far from its target; of TRIES
seeds each source therefore uses the one that brings its words nearest, tried in one aggregation.

Defined cases. Null source: a source of its own. Sources without words: target 0, no copies.
Null doc_id: drawn as the text "null". Rows of equal doc_id share their draw, so repeated rows get
as many copies each. An empty table gives an empty one. Other columns are passed through.

Scale: one scan of the texts for sizes, then only (doc_id, source, size) rows. The per-source
table is broadcast when it has at most MAX_BROADCAST rows; beyond that a join that deals hot
sources over several tasks is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import clean_columns, materialize, packed, release, spread_join, table, tidy

WEIGHTS, CAP, SEED, TRIES, MAX_BROADCAST = (5, 2, 1), 3, "mix-1", 16, 10_000
_BITS = 52  # a draw is exact in a double


def words(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: str = "source"):
    return F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(source)))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, _key, source_size, target) from rows (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", "rn")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rn") - 1) % len(weights) + 1).cast("long")
    ranked = (
        per.withColumn("rn", F.row_number().over(by_name))
        .withColumn("w", weight)
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("level", F.col("most").cast("double") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped_before", F.sum("most").over(by_level) - F.col("most"))
        .withColumn("w_from", F.sum("w").over(everything) - F.sum("w").over(by_level) + F.col("w"))
        .withColumn("is_capped", (F.col("total") - F.col("capped_before")) * F.col("w") >= F.col("most") * F.col("w_from"))
        .withColumn("capped", F.sum(F.when(F.col("is_capped"), F.col("most")).otherwise(0)).over(everything))
        .withColumn("w_rest", F.sum(F.when(F.col("is_capped"), 0).otherwise(F.col("w"))).over(everything))
    )
    share = ((F.col("total") - F.col("capped")) * F.col("w")).cast("double") / F.col("w_rest")
    return ranked.select("source", source_key().alias("_key"), "source_size", F.when(F.col("is_capped"), F.col("most").cast("double")).otherwise(share).alias("target"))


def _joined(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(per_source), "_key") if per_source.count() <= MAX_BROADCAST else spread_join(rows, "_key", per_source)


def _copies(seed: str, attempt):
    """How often a document is taken, by a hash of seed, attempt and doc_id."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = F.md5(F.concat(F.lit(f"{seed}-"), attempt.cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    draw = F.conv(F.substring(drawn, 1, _BITS // 4), 16, 10).cast("long").cast("double") / F.lit(float(1 << _BITS))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


@tidy("mix-sources")
def sources(slim: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """(_key, source_size, target, attempt) of each source, of rows (doc_id, source, size)."""
    wanted = materialize(targets(slim, weights, cap).select("_key", "source_size", "target"), "mix-targets")
    tried = _joined(slim.select("doc_id", "size", source_key().alias("_key")), wanted)
    sums = tried.groupBy("_key").agg(F.first("target").alias("target"), *[F.sum(F.col("size") * _copies(seed, F.lit(i))).alias(f"t{i}") for i in range(TRIES)])
    off = F.array(*[F.struct(F.abs(F.col(f"t{i}") - F.col("target")).alias("off"), F.lit(i).alias("attempt")) for i in range(TRIES)])
    best = sums.select("_key", F.array_min(off)["attempt"].alias("attempt"))
    return wanted.join(best, "_key")


def _slim(docs: DataFrame) -> DataFrame:
    return materialize(packed(clean_columns(docs, "doc_id", "source", "text")).select("doc_id", "source", words().alias("size")), "mix-sizes")


@tidy("mix-plan")
def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every document."""
    slim = _slim(docs)
    per_source = sources(slim, weights, cap, seed)
    return _joined(slim.withColumn("_key", source_key()), per_source).withColumn("copies", _copies(seed, F.col("attempt"))).drop("_key", "attempt")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs."""
    slim = _slim(docs)
    per_source = sources(slim, weights, cap, seed)
    release(slim)
    whole = packed(docs).select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), source_key().alias("_key"))
    taken = _joined(whole, per_source).withColumn("_n", _copies(seed, F.col("attempt"))).where("_n > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
p as (select source, sum(size)::bigint as source_size from d group by 1),
r as (select *, row_number() over (order by source nulls last) as rn, {CAP} * source_size as most from p),
q as (select *, case (rn - 1) % 3 when 0 then {WEIGHTS[0]} when 1 then {WEIGHTS[1]} else {WEIGHTS[2]} end::bigint as w from r),
l as (select *, sum(source_size) over ()::bigint as total,
  (sum(most) over o - most)::bigint as capped_before, (sum(w) over () - sum(w) over o + w)::bigint as w_from
  from q window o as (order by most::double / w, rn)),
c as (select *, (total - capped_before) * w >= most * w_from as is_capped from l),
t as (select source, source_size, case when is_capped then most::double
  else ((total - sum(case when is_capped then most else 0 end) over ())::bigint * w)::double / (sum(case when is_capped then 0 else w end) over ())::double end as target from c),
m as (select doc_id, size, t.source, source_size, target, case when source_size > 0 then target / source_size else 0.0::double end as rate
  from d join t on d.source is not distinct from t.source),
x as (select m.*, a, size * (floor(rate)::bigint + (('0x' || substr(md5('{SEED}-' || a || ':' || coalesce(doc_id::varchar, 'null')), 1, {_BITS // 4}))::bigint::double / {1 << _BITS}::double
  < rate - floor(rate))::bigint) as taken from m, range({TRIES}) as r(a)),
b as (select source, a from (select source, a, row_number() over (partition by source order by abs(sum(taken) - any_value(target)), a) as n from x group by source, a) where n = 1)
select doc_id, size, source_size, target, taken::bigint as taken from x join b on x.source is not distinct from b.source and x.a = b.a
"""
