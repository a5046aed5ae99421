import datetime as dt
import math
import random
import zlib

import numpy as np
import pytest

from quillon.llm import point_in_time
from quillon.llm.common import table

DAY = dt.timedelta(days=1)
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, kind string, d int"
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, open boolean"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, amount double, shipped_at timestamp_ntz, lo int, client string"
COLUMNS = ["sale_id", "d", "t_us", "label", "n_clicks", "n_purchases", "click_cents", "last_click_id", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents"]


def cents(x):
    return math.floor(100 * x + 0.5) if x is not None and abs(x) < 9e16 else 0


def brute(sales, clicks, lines, windows=(2, 14)):
    out = []
    late = dt.timedelta(minutes=240)
    clicks = set(clicks)
    for sale_id, client, _, _, sold, *_ in sales:
        if client is None or sold is None:
            continue
        t = sold + dt.timedelta(seconds=zlib.crc32(str(sale_id).encode()) % 259_200 if sale_id is not None else 0)
        own = [s for s in sales if s[1] == client and s[4] is not None]
        label = any(t < s[4] <= t + 7 * DAY for s in own)
        for d in windows:
            def inside(at, arrived):
                return at is not None and arrived is not None and t - d * DAY < at <= t and arrived + late <= t  # noqa: B023
            cs = [c for c in clicks if c[3] == client and inside(c[1], c[2])]
            ss = [s for s in own if inside(s[4], s[5])]
            ls = [x for s in ss if s[0] is not None for x in lines if x[0] == s[0] and x[5] is not None and x[5] <= t]
            last = max(cs, key=lambda c: (c[1], c[0] is not None, c[0] or 0))[0] if cs else None
            us = (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
            out.append((sale_id, d, us, label, len(cs), sum(c[4] == "purchase" for c in cs), sum(cents(c[5]) for c in cs), last, len(ss), sum(cents(s[3]) for s in ss), len(ls), len({x[2] for x in ls} - {None}), sum(cents(x[4]) for x in ls)))
    return sorted(out, key=repr)


def made(seed, n_clients, n):
    """A shop with late, early, repeated, tied and broken rows."""
    r = random.Random(seed)
    start = dt.datetime(2024, 1, 31, 22)
    when = lambda: start + dt.timedelta(hours=r.choice([r.randint(0, 200), r.random() * 800]))
    maybe = lambda x, p=0.06: None if r.random() < p else x
    arrived = lambda t: maybe(t + dt.timedelta(minutes=r.choice([-500, 0, 1, 60, 3000, 9000, 30000])) if t else when())
    client = lambda: maybe(0 if r.random() < 0.5 else r.randrange(n_clients))
    money = lambda: maybe(r.choice([r.random() * 100, 0.005, -1.255, float("nan"), float("inf"), 1e300]))
    sales = []
    for i in range(n):
        t = maybe(when())
        sales.append((maybe(i if r.random() < 0.9 else r.randrange(n)), client(), "x", money(), t, arrived(t), 1))
    sales += r.choices(sales, k=n // 8)
    clicks = []
    for i in range(2 * n):
        t = maybe(when())
        clicks.append((maybe(i), t, arrived(t), client(), r.choice(["purchase", "view", None]), maybe(r.randint(-500, 500) / 8), "{}"))
    clicks += r.choices(clicks, k=n // 3)
    lines = [(maybe(7 if r.random() < 0.3 else r.randrange(n)), 1, maybe(r.randrange(6)), 1, money(), maybe(when())) for _ in range(3 * n)]
    return sales, clicks, lines


def run(spark, sales, clicks, lines, **options):
    frames = (spark.createDataFrame([(*r, *more) for r in rows], kind) for rows, kind, more in ((sales, SALES, ("k", 3)), (clicks, CLICKS, (True,)), (lines, LINES, (1, "c"))))
    return sorted((tuple(r) for r in point_in_time.features(*frames, **options).select(COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("hot_rows", [10**6, 25, 0])
def test_equals_brute_force(spark, hot_rows):
    shop = made(hot_rows, 9, 90)
    want = brute(*shop)
    assert run(spark, *shop, hot_rows=hot_rows) == want
    assert sum(r[4] for r in want) > 300 and sum(r[11] for r in want) > 100 and any(r[3] for r in want)


def test_other_windows_and_small_chunks(spark, monkeypatch):
    shop = made(4, 5, 60)
    monkeypatch.setattr(point_in_time, "CHUNK_ROWS", 20)
    want = brute(*shop, windows=(1, 3, 30))
    assert run(spark, *shop, windows=(1, 3, 30), hot_rows=40) == want


def test_one_client_over_many_partitions(spark):
    """Rows of one client at few times, dealt over more partitions than there are times."""
    at = dt.datetime(2024, 3, 1)
    sales = [(i, 1, "x", 1.0, at + (i % 3) * DAY, at, 1) for i in range(60)]
    clicks = [(i, at + (i % 2) * DAY, at, 1, "purchase", 2.0, "{}") for i in range(200)]
    lines = [(i % 60, 1, 5, 1, 1.0, at) for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        assert run(spark, sales, clicks, lines, hot_rows=0) == brute(sales, clicks, lines)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_tables(spark):
    sales, clicks, lines = made(2, 3, 20)
    for hot_rows in (10**6, 0):
        assert run(spark, [], clicks, lines, hot_rows=hot_rows) == []
        assert run(spark, sales, [], [], hot_rows=hot_rows) == brute(sales, [], [])


def test_time_zone_of_the_session_plays_no_part(spark):
    shop = made(6, 3, 30)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert run(spark, *shop) == brute(*shop)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_greatest_earlier_ts():
    order, before = point_in_time._beyond(np.array([0, 0, 0, 1, 1]), np.array([5, 3, 9, 2, 2]), np.array([5, 8, 1, 4, 3]), 6)
    none = np.iinfo(np.int64).min
    assert order.tolist() == [1, 0, 2, 4, 3] and before.tolist() == [6, 8, 8, none, 3]


def test_query_equals_sql(spark, sf, duck):
    want = duck.execute(point_in_time.SQL).df()[COLUMNS]
    got = point_in_time.query(spark, sf).toPandas()[COLUMNS]
    same = lambda f: sorted(map(tuple, f.astype(object).where(f.notna(), -1).astype("int64").to_numpy().tolist()))
    assert same(got) == same(want) and len(want)
    cut = point_in_time.features(*(table(spark, sf, n) for n in ("sales", "clicks", "sale_lines")), hot_rows=100).toPandas()[COLUMNS]
    assert same(cut) == same(want)
