import math

import numpy as np
import pytest

from quillon.llm import hard_negatives

ROW = "vec_id long, label int, embedding array<float>, key int, score double, r int, side string"


def brute(rows, every=100):
    ok = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in ok if i % every == 0}:
        met = [(-max(min(sum(x * y for x, y in zip(v, w, strict=True)), 2**63 - 1), -(2**63)), j, m == label) for j, m, w in ok if j != i and len(w) == len(v)]
        for s, p, _ in sorted(x for x in met if x[2])[:5]:
            fits = sorted((n, j) for n, j, same in met if not same and 80 * -s <= 100 * -n <= 100 * -s)[:5]
            out += [(i, p, k + 1, j, -s, -n) for k, (n, j) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, every=100):
    df = spark.createDataFrame([(*r, 1, 0.5, 2, "x") for r in rows], ROW)
    return sorted(tuple(r) for r in hard_negatives.mine(df, every).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("seed,dim,n", [(1, 8, 600), (2, 3, 400), (3, 33, 500)])
def test_equals_brute_force(spark, seed, dim, n, monkeypatch):
    r = np.random.default_rng(seed)
    base = r.standard_normal((12, dim))
    v = (base[r.integers(0, 12, n)] + 0.4 * r.standard_normal((n, dim))) / 3
    if dim == 3:
        v = np.round(v * 4) / 256  # many equal scores
    rows = [(int(i), int(r.integers(0, 3)), x.tolist()) for i, x in enumerate(v)]
    monkeypatch.setattr(hard_negatives, "TILE", 500)  # many tiles, so that bounds are at work
    assert mined(spark, rows, 20) == brute(rows, 20)
    assert len(brute(rows, 20)) > 100


def test_bounds_keep_all(monkeypatch):
    """A block finds what brute force does and scores few pairs exactly."""
    r = np.random.default_rng(5)
    n, dim = 3000, 64
    v = np.floor(256 * (r.standard_normal((n, 6)) @ r.standard_normal((6, dim)) + 0.05 * r.standard_normal((n, dim))))
    turn = np.linalg.eigh(v.T @ v)[1][:, ::-1]
    ids, labels = np.arange(n), r.integers(0, 4, n)
    scored = []
    real = hard_negatives.exact
    monkeypatch.setattr(hard_negatives, "exact", lambda a, b: scored.append(len(a)) or real(a, b))
    block = hard_negatives.Block(ids[:30], labels[:30], v[:30], turn)
    for at in range(0, n, 100):
        block.meet(ids[at : at + 100], labels[at : at + 100], v[at : at + 100])
    want = []
    for a in range(30):
        s = v[a].astype(int) @ v.astype(int).T
        want += [(a, int(s[j]), int(j)) for j in sorted((j for j in range(n) if j != a and labels[j] == labels[a]), key=lambda j: (-s[j], j))[:5]]
    assert list(zip(block.key.tolist(), block.score.tolist(), block.found.tolist(), strict=True)) == want
    assert sum(scored) < 30 * n / 4 / 4  # a quarter of what has the label


def test_defined_cases(spark):
    rows = [(0, 1, [0.5, 0.5]), (0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.5]), (1, 1, [0.5, 0.5]), (2, 2, [0.5, 0.45]), (3, 2, [0.5, 0.45]), (3, 2, [0.5, 0.45])]
    rows += [(None, 1, [0.5, 0.5]), (4, None, [0.5, 0.5]), (5, 1, None), (6, 2, [0.5, None]), (8, 2, [0.5, float("nan")]), (9, 2, [float("inf"), 0.5])]
    rows += [(10, 1, [0.5, 0.5, 0.5]), (100, 1, [0.1, 0.2, 0.3]), (11, 2, [0.4, 0.5, 0.5]), (200, 7, []), (12, 7, []), (13, 8, []), (300, 3, [1e30, 1e30]), (14, 3, [1e30, 1e30]), (15, 4, [1e30, 9e29]), (-100, 1, [-0.5, 0.5]), (400, 9, [1.0])]
    assert mined(spark, rows) == brute(rows)
    assert {r[0] for r in brute(rows)} >= {0, 200, 300}
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, None)]) == []


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 4)
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 11)
    r = np.random.default_rng(9)
    rows = [(int(i), int(i % 3), x.tolist()) for i, x in enumerate(r.random((200, 5)))]
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_query_equals_sql(spark, sf, duck):
    got = hard_negatives.query(spark, sf)
    want = duck.execute(hard_negatives.SQL).fetchall()
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == sorted(want)
    assert want
