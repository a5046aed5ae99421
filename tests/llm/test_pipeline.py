import zlib

import numpy as np
import pytest
from test_minhash import brute, edited

import corpus_pipeline
from quillon.llm import mixing, quality, token_files


@pytest.fixture
def sf_dir(docs, spark, prose, tmp_path):
    rows, labels = [], []
    for i in range(160):
        w = prose(i, 60 + i)
        if i % 10 == 3:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), f"s{i % 4}"))
        labels.append((i, int(i % 10 != 3), 0))
    rows += [(200 + k, " ".join(edited(prose(5, 65), k, k)), "s0") for k in (0, 1, 2)]  # near copies of document 5
    rows += [(300 + k, " ".join(prose(800 + k, 50) + prose(900, 40)), "s1") for k in range(3)]  # benchmark item 0
    rows += [(400, None, None), (401, "", "s2"), (None, " ".join(prose(7000, 30)), None)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(prose(900, 40)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def test_stages_and_result(spark, sf_dir):
    from tokenizers import Tokenizer

    path, rows = sf_dir
    columns = spark.read.parquet(f"{path}/documents.parquet").columns
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        if k < 4:
            assert docs.columns == columns
        docs.write.parquet(f"{path}/out-{k}")
        docs = spark.read.parquet(f"{path}/out-{k}")
        kept.append(docs.collect())
    good, distinct, clean, mixed, tokens = kept

    bad = {i for i, _, _ in rows if i is not None and i < 160 and i % 10 == 3}
    ids = {r.doc_id for r in good}
    assert not ids & bad and len(ids - bad) >= len(rows) - len(bad) - 5
    components = brute([(r.doc_id, r.text or "") for r in good if r.doc_id is not None])
    assert {r.doc_id for r in distinct} == {i for i, c in components.items() if i == c} | ({None} & ids)
    assert {r.doc_id for r in clean} == {r.doc_id for r in distinct} - {300, 301, 302}
    plan = mixing.plan(spark.read.parquet(f"{path}/out-2")).collect()
    assert sorted(r.doc_id for r in mixed if r.doc_id is not None) == sorted(r.doc_id for r in plan for _ in range(r.copies) if r.doc_id is not None)
    t = Tokenizer.from_file(token_files.default_tokenizer())
    text = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x, _ in rows}
    assert len(tokens) == len(mixed)
    at = 0
    for r in sorted(tokens, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(text[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(text[r.doc_id], "<u4").tobytes())
        at += r.n_tokens


def test_run_equals_the_stages(spark, sf_dir):
    path, _ = sf_dir
    got = corpus_pipeline.run(spark, path).collect()
    assert got and sorted(r.start for r in got)[0] == 0
    model = quality.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    rejected = {r.doc_id for r in quality.score(spark.read.parquet(f"{path}/documents.parquet"), model).collect() if r.score < 0.5}
    assert not rejected & {r.doc_id for r in got}


def test_empty_tables(spark, docs, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_repeated_ids_lose_no_document(spark, docs, prose, tmp_path):
    """A doc_id with two texts, of which one is a near copy of another document: the other text reaches the token files."""
    from tokenizers import Tokenizer

    a, b = prose(1, 80), prose(2, 80)
    base = [(3, " ".join(a), "s"), (9, " ".join(edited(a, 1, 4)), "s"), (9, " ".join(b), "s")]
    t = Tokenizer.from_file(token_files.default_tokenizer())
    want = sorted((i, len(t.encode(x, add_special_tokens=False).ids) + 1) for i, x, _ in (base[0], base[2]))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (base, base[::-1]):
        docs(rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
