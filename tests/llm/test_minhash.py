from collections import Counter
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import common
from quillon.llm import minhash_dedup as mh


def brute(rows):
    """Smallest id of each group of texts with probability Jaccard >= 0.8, by all pairs."""
    bags = {}
    for i, t in rows:
        w = t.split()
        bags[i] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(bags), 2):
        keys = list(bags[a] | bags[b])
        if bags[a] and bags[b] and mh.probability_jaccard(np.array([bags[a][k] for k in keys]), np.array([bags[b][k] for k in keys])) >= 0.8:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in bags}


def edited(words, n, seed):
    r = np.random.default_rng(seed)
    out = list(words)
    for i in r.choice(len(out), n, replace=False):
        out[i] = f"edit{seed}x{i}"
    return out


def test_groups_equal_brute_force(docs, prose):
    rows, n = [], 0
    for g in range(6):
        base = prose(g, 300)
        for k in range(8):
            rows.append((n := n + 1, " ".join(edited(base, (0, 2, 4, 6, 9, 12, 15, 20)[k], 10 * g + k))))
    rows += [(100 + i, " ".join(prose(50 + i, 40) * (i % 3 + 1))) for i in range(12)]
    rows += [(200 + i, " ".join(prose(3, 4)[: i + 1])) for i in range(4)]
    got = {r.doc_id: r.component_id for r in mh.near_duplicates(docs(rows)).collect()}
    assert got == brute(rows)


def test_a_chain_of_edits_is_one_group_also_without_hubs(docs, prose):
    """Neighbours are similar, ends are not: links inside a family that no hub has."""
    base, rows = prose(9, 400), []
    for i in range(30):
        base = list(base)
        for j in range(4):
            base[(i * 13 + j * 90) % 400] = f"new{i}x{j}"
        rows.append((i, " ".join(base)))
    got = {r.doc_id: r.component_id for r in mh.near_duplicates(docs(rows)).collect()}
    assert got == brute(rows)


def test_odd_rows(docs, odd):
    got = [(r.doc_id, r.component_id, r.kept) for r in mh.near_duplicates(docs(odd)).collect()]
    assert len(got) == len(odd)
    by = dict((i, (c, k)) for i, c, k in got if i is not None)
    assert by[1] == (1, True) and by[2] == (1, False) and by[10] == (6, False) and all(by[i] == (i, True) for i in (3, 4, 5, 7, 8, 9))
    assert [(c, k) for i, c, k in got if i is None] == [(None, True)] * 2
    kept = mh.dedup(docs(odd))
    assert kept.columns == docs([]).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 8, 9, 9]


def test_empty(docs):
    assert mh.near_duplicates(docs([])).collect() == [] and mh.dedup(docs([])).collect() == []


def test_register_agreement_estimates_probability_jaccard():
    r = np.random.default_rng(0)
    h = r.integers(1, 1 << 63, 300, dtype=np.uint64)
    wa, wb = r.integers(1, 4, 300), r.integers(1, 4, 300)
    wa[:60], wb[240:] = 0, 0
    a, b = np.flatnonzero(wa), np.flatnonzero(wb)
    z = mh.prob_min_hash(np.concatenate([h[a], h[b]]), np.repeat([0, 1], [len(a), len(b)]), np.concatenate([wa[a], wb[b]]), 2, m=6000)
    assert abs((z[0] == z[1]).mean() - mh.probability_jaccard(wa, wb)) < 0.03


@pytest.mark.parametrize("local", [0, 150, 10**6])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(common, "LOCAL_EDGES", local)
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5000), (None, 3)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1300)}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_word_hashes_do_not_depend_on_the_chunk():
    import pyarrow as pa

    texts = ["Ünï one two", None, "", "two one", "one"] * 3
    whole = common.Words(*common.text_buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        one = common.Words(*common.text_buffers(pa.array([t], pa.string())))
        assert (whole.hash[whole.first[i] : whole.first[i + 1]] == one.hash).all()
    assert whole.count.tolist() == [3, 0, 0, 2, 1] * 3


def test_null_ids_of_equal_texts_are_kept_beside_a_repeated_id(docs, prose):
    a, b = " ".join(prose(1, 40)), " ".join(prose(2, 40))
    rows = [(1, a), (1, a), (2, a), (None, b), (None, b), (None, None), (None, None), (None, ""), (None, "")]
    got = [(r.doc_id, r.text) for r in mh.dedup(docs(rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, a), *rows[3:]], key=str)


def test_a_repeated_id_keeps_its_unique_text(docs, prose):
    a, b = " ".join(prose(1, 40)), " ".join(prose(2, 40))
    rows = [(3, a), (9, a), (9, b), (9, b)]
    assert sorted((r.doc_id, r.text) for r in mh.dedup(docs(rows)).collect()) == sorted([(3, a), (9, b)])
    assert sorted((r.doc_id, r.component_id, r.kept) for r in mh.near_duplicates(docs(rows)).collect()) == [(3, 3, True), (9, 3, False), (9, 9, True), (9, 9, True)]


def brute_rows(rows):
    """(doc_id, component, kept) of rows, each a text of its own whatever its id; the kept one of a doc_id's texts is any."""
    comp = brute([(k, t) for k, (_, t) in enumerate(rows)])
    least = {}
    for k, c in comp.items():
        least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    return sorted((rows[k][0], least[c]) for k, c in comp.items())


def test_repeated_ids_with_different_texts_in_every_order(docs, prose):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    base = [(3, " ".join(a)), (9, " ".join(edited(a, 1, 4))), (9, " ".join(b)), (12, " ".join(edited(b, 1, 5))), (9, " ".join(c)), (9, " ".join(edited(c, 1, 6)))]
    for order in list(permutations(range(6)))[::77]:
        rows = [base[i] for i in order]
        got = mh.near_duplicates(docs(rows)).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == brute_rows(rows) == [(3, 3), (9, 3), (9, 9), (9, 9), (9, 9), (12, 9)]
        kept = sorted((r.doc_id, r.text) for r in mh.dedup(docs(rows)).collect())
        assert len(kept) == 3 and kept[0] == base[0] and (9, " ".join(b)) in kept and kept[1][0] == kept[2][0] == 9
        assert {t for _, t in kept} & {base[4][1], base[5][1]}  # one of two near copies of one id stays


def test_groups_of_many_rows_with_few_ids(docs, prose):
    """Ids that recur over groups: nothing is taken from one text of an id to another."""
    rows = []
    for g in range(5):
        base = prose(40 + g, 120)
        rows += [((7 * g + 3 * k) % 6, " ".join(edited(base, k % 4, 10 * g + k))) for k in range(9)]
    rows += [(i % 6, " ".join(prose(300 + i, 50))) for i in range(12)]
    got = [(r.doc_id, r.component_id) for r in mh.near_duplicates(docs(rows)).collect()]
    assert sorted(got) == brute_rows(rows)
    assert mh.dedup(docs(rows)).count() == len(set(brute([(k, t) for k, (_, t) in enumerate(rows)]).values()))


def test_columns_of_any_name_pass(spark, prose):
    a = " ".join(prose(1, 40))
    df = spark.createDataFrame([(1, a, 1, 2, "x"), (2, a, 1, 2, "y"), (None, a, 1, 2, "z")], "doc_id long, text string, `a.b` int, row int, t string")
    got = mh.dedup(df)
    assert got.columns == df.columns and sorted((r.doc_id or 0, r.t) for r in got.collect()) == [(0, "z"), (1, "x")]


def test_pairs_near_the_threshold_are_found_in_blocks(spark, prose):
    """Pairs of J_P just above 0.8 whose documents are in components of their own: the registers may not drop them."""
    import pyarrow as pa

    rows, want = [], set()
    for g in range(40):
        base = prose(100 + g, 520)
        other = edited(base, 1, g)[:466]  # 461 of 516 + 1 shingles are shared at most
        n = 0
        while True:
            bags = [Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for w in (base, other)]
            keys = list(bags[0] | bags[1])
            sim = mh.probability_jaccard(np.array([bags[0][k] for k in keys]), np.array([bags[1][k] for k in keys]))
            if sim < 0.815 or n > 80:
                break
            n += 1
            other = other[:-2]
        if sim >= 0.8:
            want.add((2 * g, 2 * g + 1))
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    table = lambda part: pa.table({"rep": [i for i, _ in part], "component": [i for i, _ in part], "text": pa.chunked_array([[t for _, t in part]])})
    got = {(a, b) for a, b, _ in mh._block_links(table(rows[::2]), table(rows[1::2]), 0.8)}
    assert got == want and len(want) > 30


@pytest.mark.parametrize("given", [False, True])
def test_spread_join_of_hot_keys(spark, given):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(7)).otherwise(F.col("id")).alias("key"), "id")
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    side = counts.where("n > 1 or key % 2 = 0").select("key", (F.col("key") * 2).alias("twice"))
    got = common.spread_join(rows, "key", side, per=100, counts=counts if given else None, grows=given)
    want = [(7, i, 14) for i in range(1000)] + [(i, i, 2 * i) for i in range(1000, 3000, 2)]
    assert sorted(tuple(r) for r in got.select("key", "id", "twice").collect()) == want
    if not given:
        return  # rows as few as these are broadcast
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        most = got.select("key", F.spark_partition_id().alias("p")).where("key = 7").groupBy("p").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert most < 1000  # the hot key is not in one task
