"""The persistent store of hashed entries: ids, insert-or-ignore, retention, scan, retrieval.

The store is Parquet under a folder: ``rows`` by batch and a hash of the scope, and ``commits``, one
row a batch, written last. A write adds its new rows only; what retention drops is said by the oldest
row that stays, so no file is written again until MERGED batches are merged into one. A reader never
sees half a write, and a question about few scopes reads few partitions. One writer at a time.
Retention bounds the store's size (over all tenants, newest first); ties on the time go by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import hashing
from quillon.functions import text as tx
from quillon.operators.events import created_at, events, long_enough, memory_text
from quillon.operators.scopes import asked, bucket, only
from quillon.plans.settings import Hashed
from quillon.sources.tables import committed, hadoop_path, materialize, release

_UNIT = float(1 << 52)
COLUMNS = "id string, app_name string, user_id string, session_id string, invocation_id string, source_kind string, text string, vector map<int,double>, importance double, created_at double"
COMMITS = "base boolean, alive long, cut_at double, cut_id string"
MERGED = 32


def rows(df: DataFrame, settings: Hashed = Hashed(), tools: bool = True, vectors: bool = True) -> DataFrame:
    """Store rows of events; those whose text has fewer than 12 characters are none. Equal ids stay."""
    df = memory_text(events(df), settings.entry_chars, tools)
    df = df.select(*[c for c in df.columns if c not in ("memory_text", "parts")], long_enough("memory_text").alias("memory_text"))
    text = F.col("memory_text")
    whole = [F.coalesce(F.col(c), F.lit("")) for c in ("app_name", "user_id", "session_id", "invocation_id", "event_id")]
    kind = tx.source_kind(text, F.col("author"), F.col("role"))
    vector = hashing.hashed_vector(tx.hash_tokens(text), settings.dimensions) if vectors else F.lit(None).cast("map<int,double>")
    return df.select(
        F.sha2(F.concat_ws("\x00", *whole, text), 256).alias("id"), "app_name", "user_id", "session_id", whole[3].alias("invocation_id"),
        kind.alias("source_kind"), text.alias("text"), vector.alias("vector"), tx.importance(text, kind).alias("importance"), created_at().alias("created_at"),
    )


def fresh(ids: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows whose id is not among ids; of new rows with equal ids the earliest."""
    first = Window.partitionBy("id").orderBy("created_at", "session_id")
    return new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").join(ids.select("id"), "id", "left_anti")


def insert_ignore(store: DataFrame, new: DataFrame) -> DataFrame:
    """store with the ``fresh`` ones of the new rows."""
    return store.unionByName(fresh(store, new).select(store.columns))


def retain(store: DataFrame, max_entries: int) -> DataFrame:
    """The newest max_entries rows of all tenants; everything if it is not positive."""
    return store.orderBy(F.col("created_at").desc(), "id").limit(max_entries) if max_entries > 0 else store


@dataclass(frozen=True)
class Batch:
    """One write: how many rows of the store are left after it, and the oldest of them if it dropped any."""

    number: int
    base: bool
    alive: int
    cut_at: float | None
    cut_id: str | None


def _batches(spark: SparkSession, path: str) -> list[Batch]:
    """The store's writes from the last whole one on; few, as they are merged."""
    done = committed(spark, f"{path}/commits")
    if not done:
        return []
    rows = spark.read.schema(COMMITS + ", batch int").option("basePath", f"{path}/commits").parquet(*[f"{path}/commits/batch={b}" for b in done]).collect()
    found = sorted((Batch(r.batch, r.base, r.alive, r.cut_at, r.cut_id) for r in rows), key=lambda b: b.number)
    return found[max((i for i, b in enumerate(found) if b.base), default=0) :]


def _before(at: float, id_: str) -> Column:
    """Rows that are not older than the one of that time and id."""
    return (F.col("created_at") > at) | ((F.col("created_at") == at) & (F.col("id") <= id_))


def _alive(batches: list[Batch]) -> Column:
    """Rows of ``batch`` that no later write has dropped: what is left of a batch is bounded by the tightest cut after it."""
    runs: list[list] = []  # [first batch, last batch, cut]
    cut: tuple[float, str] | None = None
    for b in reversed(batches):
        if b.cut_at is not None and (cut is None or b.cut_at > cut[0] or (b.cut_at == cut[0] and b.cut_id < cut[1])):
            cut = (b.cut_at, b.cut_id)
        if runs and runs[-1][2] == cut:
            runs[-1][0] = b.number
        else:
            runs.append([b.number, b.number, cut])
    out = F.lit(False)
    for first, last, c in runs:
        out = out | (F.col("batch").between(first, last) & (F.lit(True) if c is None else _before(*c)))
    oldest = min((c[0] for _, _, c in runs if c), default=None) if all(c for _, _, c in runs) else None
    return out if oldest is None else out & (F.col("created_at") >= oldest)  # this reaches the files


def _rows(spark: SparkSession, path: str, batches: list[Batch]) -> DataFrame:
    """The store's rows with ``bucket`` and ``batch``."""
    if not batches:
        return spark.createDataFrame([], COLUMNS + ", bucket int, batch int")
    files = [f"{path}/rows/batch={b.number}" for b in batches]
    return spark.read.schema(COLUMNS + ", batch int, bucket int").option("basePath", f"{path}/rows").parquet(*files).where(_alive(batches))


def read_store(spark: SparkSession, settings: Hashed, scopes: list[tuple[str, str]] | None = None) -> DataFrame:
    """The store's rows; none if it does not exist. With ``scopes``, (app_name, user_id), only their partitions are read."""
    rows = _rows(spark, settings.path, _batches(spark, settings.path))
    return (rows if scopes is None else only(rows, scopes)).drop("bucket", "batch")


def _write(rows: DataFrame, path: str) -> None:
    by = ["bucket", "app_name", "user_id", "created_at"]
    rows.drop("batch").repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").partitionBy("bucket").parquet(path)


def _commit(spark: SparkSession, path: str, b: Batch) -> None:
    one = spark.createDataFrame([(b.base, b.alive, b.cut_at, b.cut_id)], COMMITS)
    one.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={b.number}")


def oldest_kept(rows: DataFrame, n: int) -> tuple[float, str]:
    """(created_at, id) of the n-th newest of more than n rows, ties by id.

    Times and ids are range-partitioned; from the counts of the pieces, one number a task, follows the
    piece and the place in it, and that row alone is read.
    """
    by = [F.col("created_at").desc(), F.col("id")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.select("created_at", "id").repartitionByRange(parts, *by).sortWithinPartitions(*by)
    at = materialize(sorted_.withColumn("_at", F.monotonically_increasing_id()), "store-order")
    left = n
    for piece in sorted(at.groupBy(F.shiftright("_at", 33).alias("piece")).agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["first"]):
        if left <= piece["n"]:
            found = at.where(F.col("_at") == piece["first"] + left - 1).first()
            break
        left -= piece["n"]
    release(at)
    return found.created_at, found.id


def store(df: DataFrame, settings: Hashed, tools: bool = True) -> None:
    """Add events to the store, and drop what exceeds its size; nothing if it is not enabled.

    Writes the new rows alone. Known ids are looked up in the partitions of the new rows' scopes; the
    size is kept by naming the oldest row that stays, which later reads apply to all rows up to this write.
    """
    if not settings.enabled:
        return
    spark, path = df.sparkSession, settings.path
    batches = _batches(spark, path)
    number = batches[-1].number + 1 if batches else 1
    new = materialize(rows(df, settings, tools).withColumn("bucket", bucket()), "store-rows")
    _write(fresh(asked(_rows(spark, path, batches), new), new), f"{path}/rows/batch={number}")
    added = spark.read.schema(COLUMNS).parquet(f"{path}/rows/batch={number}").count()
    alive, cut = (batches[-1].alive if batches else 0) + added, (None, None)
    if 0 < settings.max_entries < alive:
        whole = _rows(spark, path, [*batches, Batch(number, False, alive, None, None)])
        alive, cut = settings.max_entries, oldest_kept(whole, settings.max_entries)
    _commit(spark, path, Batch(number, False, alive, *cut))
    release(new)
    if len(batches) >= MERGED:
        merge(spark, settings)


def merge(spark: SparkSession, settings: Hashed) -> None:
    """Write the store's rows as one batch, without the dropped ones. What was merged stays for its readers until the next time; older files go."""
    path = settings.path
    batches = _batches(spark, path)
    if len(batches) < 2:
        return
    number = batches[-1].number + 1
    _write(_rows(spark, path, batches), f"{path}/rows/batch={number}")
    _commit(spark, path, Batch(number, True, batches[-1].alive, None, None))
    for old in [b for b in committed(spark, f"{path}/commits") if b < batches[0].number]:
        for kind in ("commits", "rows"):  # a batch without its commit is not read
            fs, p = hadoop_path(spark, f"{path}/{kind}/batch={old}")
            fs.delete(p, True)


def newest(store: DataFrame, same: list[str], settings: Hashed) -> DataFrame:
    """Of each scope the newest rows, at most scan_rows, then without repeated texts, newest kept; ``n`` is a row's place.

    Each task cuts a scope to scan_rows before rows are shuffled, so a hot scope is no burden.
    """
    latest = Window.partitionBy(*same).orderBy(F.col("created_at").desc(), "id")
    kept = store.withColumn("n", F.row_number().over(latest)).where(F.col("n") <= settings.scan_rows)
    repeat = Window.partitionBy(*same, "key").orderBy("n")
    return kept.withColumn("key", tx.text_key("text")).where(F.length("key") > 0).withColumn("_r", F.row_number().over(repeat)).where("_r = 1").drop("_r", "key")


def _same(settings: Hashed) -> list[str]:
    return ["app_name", "user_id"] + ([] if settings.cross_session else ["session_id"])


def scan(store: DataFrame, queries: DataFrame, settings: Hashed) -> DataFrame:
    """For each query the rows of its scope that ``newest`` has; they do not depend on the query."""
    same = _same(settings)
    asked = store.join(queries.select(*same).distinct(), same, "left_semi")
    return (queries.drop("session_id") if settings.cross_session else queries).join(newest(asked, same, settings), same)


def retrieve(store: DataFrame, queries: DataFrame, settings: Hashed) -> DataFrame:
    """(query_id, position, text, score, source_kind, session_id, created_at): hashed cosine times importance.

    queries: (query_id, app_name, user_id, session_id, text). Blank and tokenless ones return nothing.
    """
    empty = "query_id long, position long, text string, score double, source_kind string, session_id string, created_at double"
    if not settings.enabled:
        return queries.sparkSession.createDataFrame([], empty)
    q = queries.where(F.length(tx.normalize("text")) > 0).withColumn("q_tokens", tx.hash_tokens("text")).where(F.size("q_tokens") > 0)
    same = _same(settings)
    q = materialize(q.select("query_id", *same, hashing.hashed_vector("q_tokens", settings.dimensions).alias("q_vector")), "store-queries")
    asked = store.join(q.select(*same).distinct(), same, "left_semi")
    kept = materialize(newest(asked, same, settings), "store-newest")
    ours = kept.select(*same, "n", F.explode("vector").alias("i", "e"))
    theirs = q.select("query_id", *same, F.explode("q_vector").alias("i", "v"))
    # summed as integers: the order of summing makes no difference
    whole = F.sum(F.rint(F.col("e") * F.col("v") * F.lit(_UNIT)).cast("long"))
    alike = theirs.join(ours, [*same, "i"]).groupBy("query_id", *same, "n").agg((whole / F.lit(_UNIT)).alias("cosine"))
    if settings.min_score > 0:  # what shares no slot cannot pass
        rows = alike.join(kept, [*same, "n"])
    else:
        rows = q.drop("q_vector").join(kept, same).join(alike, ["query_id", *same, "n"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    weight = F.coalesce(F.nullif("importance", F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumn("score", F.col("cosine") * weight).where(F.col("score") >= settings.min_score)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("created_at").desc(), "n")
    return rows.withColumn("position", (F.row_number().over(best) - 1).cast("long")).where(F.col("position") < settings.top_k).select("query_id", "position", "text", "score", "source_kind", "session_id", "created_at")


def retrieve_stored(queries: DataFrame, settings: Hashed) -> DataFrame:
    """As ``retrieve``, of the store at the settings' path; only the partitions of the queries' scopes are read."""
    spark = queries.sparkSession
    rows = _rows(spark, settings.path, _batches(spark, settings.path))
    return retrieve(asked(rows, queries).drop("bucket", "batch"), queries, settings)
