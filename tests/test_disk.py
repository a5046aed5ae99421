"""What questions to a stored index leave on disk, and what they write on their way."""

import time

import pytest

from quillon.operators import postings
from quillon.operators import retrieve as rt
from quillon.plans.queries import QUERIES
from quillon.sources import tables


def shuffled(spark):
    """Bytes of shuffle files."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = [files.apply(i) for i in range(files.size())]
    return sum(f.length() for f in found if f.getName().startswith("shuffle_"))


@pytest.mark.parametrize("name", ["retrieve_policies", "render_index", "render_store", "retrieve_bm25"])
def test_little_is_left_on_disk(spark, sf, monkeypatch, name):
    """F2 to F5: shuffles end with the write that reads them, tables with the query; no table has the pairs of queries and documents."""
    before, sizes = shuffled(spark), {}
    monkeypatch.setattr(tables, "release", lambda *t, real=tables.release: sizes.update({x._quillon_path: x.count() for x in t if getattr(x, "_quillon_path", None)}) or real(*t))
    out = QUERIES[name][0](spark, sf)
    assert out.count() > 0
    pairs = spark.read.parquet(f"{sf}/documents.parquet").count() * spark.read.parquet(f"{sf}/benchmark.parquet").count()
    assert sizes and max(sizes.values()) < pairs / 4  # of 4 users, who have a fourth of the documents each
    end = time.time() + 20
    while (left := shuffled(spark) - before) > 500_000 and time.time() < end:
        time.sleep(0.5)  # files are deleted in the background
    assert left <= 500_000
    fs, p = tables.hadoop_path(spark, tables.shared_dir(spark) + "/quillon")
    assert not [x for x in sizes if fs.exists(tables.hadoop_path(spark, x)[1])]


def test_only_the_best_of_a_range_leave_its_task(spark, monkeypatch):
    """of 200 documents in 4 ranges that share a term with the query, k of each range are rows."""
    monkeypatch.setattr(postings, "BLOCK", 50)
    e = spark.range(200).selectExpr("'a' app_name", "'u' user_id", "id doc_id", "cast(id as double) created_at", "1d importance", "transform(sequence(0, id % 7), x -> if(x = 0, 'w', concat('o', x))) tokens", "1L + id % 7 n_tokens")
    weights = spark.createDataFrame([(1, "a", "u", "w", 0.5, 4.0)], "query_id long, app_name string, user_id string, term string, idf double, avgdl double")
    lists = postings.blocks(e).withColumn("bucket", postings.bucket())
    seen = []
    monkeypatch.setattr(postings, "_scored", lambda found, ranges, settings, real=postings._scored: seen.append(real(found, ranges, settings)) or seen[-1])
    got = postings.best(lists, weights, rt.Retrieval(), 3).orderBy("position").collect()
    assert [(r.doc_id, r.sparse_rank) for r in got] == [(196, 28), (189, 27), (182, 26)]
    assert [x.count() for x in seen] == [3, 12]
    assert "docs" not in str(postings.blocks(e)._jdf.queryExecution().executedPlan()).split("Exchange")[-1]
