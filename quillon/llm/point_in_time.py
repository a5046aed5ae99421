"""Point-in-time feature table by difference arrays.

Each sale is a probe: at its time t its client's clicks, sales and lines are summed over windows that
end at t, counting only what had arrived ``delay`` minutes before. A row is pushed to the probes that
it affects: in a window of d days, all of its client from ``lo`` (when it has happened and arrived)
to ``ts + d``. The probes of a chunk of clients are ranked by (client, time); searchsorted gives the
affected range of ranks, np.add.at puts the row's value at its begin and takes it off at its end, and
a cumulative sum gives every probe its total. An item counts once however many lines have it: of an
item's lines in the order of ``lo`` each adds only the time beyond what the latest earlier one covers,
so the pushed ranges are disjoint. The last click of a window is the greatest (ts, click_id) that has
arrived, a running maximum, if it is still in the window: any other click is older.

Clients of up to HOT_ROWS rows are hashed to tasks whole. The rows of larger ones, of which one may
hold a third of everything, are cut in time: both ends of each range go, as rows of their own, through
range partitioning by (client, time), so any client is dealt over as many tasks as it takes. A task
runs through its chunks; rows that cover all of a chunk enter it as a constant, the totals at the end
of the chunk before. What a client's earlier partitions amount to is a row of each partition, summed
before it is added. Items of such clients are ordered by range partitioning down to (client, item, lo),
of which each has one row.

Times are microseconds since 1970 without a zone, days have 24 hours. Defined cases. Sales without
client or time are no probe and count nowhere; without arrival they count only for labels. Sales
without id: t is the time of sale; they have no lines. Rows of an equal sale_id are each a probe and
a sale with all lines of that id. Clicks that are equal in all seven columns are one; those without
client, time or arrival, and lines without sale or shipping time, count nowhere. Lines without item
are lines, but no item. Null amounts, and those that are not finite or of 9e16 and more, are 0 cents.
The last click is null if its id is. Rows without sales give an empty result. Extra columns, whatever
their names, play no part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import clean_columns, in_arrow, materialize, partitions, spread_join, table, tidy

WINDOWS, DELAY_MINUTES, HORIZON_DAYS, SPREAD_SECONDS = (2, 14), 240, 7, 259_200
HOT_ROWS, MAX_BROADCAST, CHUNK_ROWS = 5_000, 100_000, 200_000
DAY = 86_400_000_000
CLICK, SALE, LINE, LABEL, PURCHASE, ITEM, PROBE = range(7)
COUNTERS = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")
#: Of each kind of row: the counter of rows, the one of cents.
_COUNTS = {CLICK: ("n_clicks", "click_cents"), SALE: ("n_sales", "sale_cents"), LINE: ("n_lines", "line_cents")}
_LEAST = np.iinfo(np.int64).min
RESULT = "sale_id long, t_us long, label long, last_ts long, last_click_id long, counts array<long>"  # counts: the counters of each window
PIECE = "client long, part int, open boolean, " + RESULT


def _micros(name: str) -> Column:
    c = F.col(name).cast("timestamp_ntz")
    seconds = F.unix_date(c.cast("date")) * F.lit(86_400).cast("long") + F.hour(c) * 3_600 + F.minute(c) * 60
    return seconds * F.lit(1_000_000).cast("long") + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def _cents(name: str) -> Column:
    x = F.col(name).cast("double")
    return F.coalesce(F.when(F.abs(x) < 9e16, F.floor(F.lit(100) * F.when(F.abs(x) < 9e16, x) + F.lit(0.5))), F.lit(0)).cast("long")


def records(sales: DataFrame, clicks: DataFrame, lines: DataFrame, longest: int = max(WINDOWS), delay: int = DELAY_MINUTES) -> DataFrame:
    """A row (client, kind, lo, ts, cents, id, t) for each sale, and each click and line that a window can hold; it counts from lo on, until d days after ts."""
    late = F.lit(delay * 60_000_000).cast("long")
    known = lambda arrived: F.when(arrived.isNotNull(), F.greatest(F.col("ts"), arrived + late))
    sold = (
        clean_columns(sales, "sale_id", "client_id", "sold_at", "arrived_at", "total")
        .select(F.col("sale_id").cast("long").alias("id"), F.col("client_id").cast("long").alias("client"), _micros("sold_at").alias("ts"), _micros("arrived_at").alias("arrived"), _cents("total").alias("cents"))
        .where("client is not null and ts is not null")
        .withColumn("lo", known(F.col("arrived")))
    )
    spread = F.pmod(F.coalesce(F.crc32(F.col("id").cast("string")), F.lit(0)), F.lit(SPREAD_SECONDS)) * F.lit(1_000_000).cast("long")
    sale_rows = sold.select("client", F.lit(SALE).alias("kind"), "lo", "ts", "cents", "id", (F.col("ts") + spread).alias("t"))
    click_rows = (
        clean_columns(clicks, "click_id", "ts", "arrived_at", "client_id", "kind", "value", "props")
        .where("client_id is not null and ts is not null and arrived_at is not null")
        .distinct()
        .select(F.col("click_id").cast("long").alias("id"), F.col("client_id").cast("long").alias("client"), _micros("ts").alias("ts"), _micros("arrived_at").alias("arrived"), F.when(F.col("kind") == "purchase", PURCHASE).otherwise(CLICK).alias("kind"), _cents("value").alias("cents"))
        .select("client", "kind", known(F.col("arrived")).alias("lo"), "ts", "cents", "id", F.lit(None).cast("long").alias("t"))
    )
    shipped = (
        clean_columns(lines, "sale_id", "item_id", "amount", "shipped_at")
        .select(F.col("sale_id").cast("long").alias("sale"), F.col("item_id").cast("long").alias("item"), _micros("shipped_at").alias("shipped"), _cents("amount").alias("cents"))
        .where("sale is not null and shipped is not null")
    )
    side = sold.where("lo is not null and id is not null").select(F.col("id").alias("sale"), "client", "lo", "ts")
    line_rows = spread_join(shipped, "sale", side, grows=True).select("client", F.lit(LINE).alias("kind"), F.greatest("lo", "shipped").alias("lo"), "ts", "cents", F.col("item").alias("id"), F.lit(None).cast("long").alias("t"))
    return sale_rows.unionByName(click_rows.unionByName(line_rows).where(F.col("lo") < F.col("ts") + longest * DAY))


# -- the arrays of a chunk ----------------------------------------------------------------------------


class Probes:
    """Probe times ranked by (client, time)."""

    def __init__(self, client: np.ndarray, t: np.ndarray, clients: np.ndarray):
        """clients: sorted, all that rows may come from; each has its probes and one more place, for what comes after them."""
        self.order = np.lexsort((t, client))
        self.clients, self.times = clients, np.unique(t)
        of = np.searchsorted(clients, client[self.order])
        self.key = self._key(of, t[self.order])
        self.place = np.arange(len(of)) + of  # of each ranked probe
        self.begin = np.searchsorted(of, np.arange(len(clients) + 1)) + np.arange(len(clients) + 1)

    def _key(self, of: np.ndarray, time: np.ndarray) -> np.ndarray:
        return of * np.int64(len(self.times) + 1) + np.searchsorted(self.times, time)

    def of(self, client: np.ndarray) -> np.ndarray:
        """Number of the client of each row."""
        return np.searchsorted(self.clients, client)

    def at(self, of: np.ndarray, time: np.ndarray) -> np.ndarray:
        """Place of the client's first probe at ``time`` or later, of what comes after its probes if there is none."""
        return np.searchsorted(self.key, self._key(of, time)) + of

    def sums(self, ends: list[tuple[np.ndarray, np.ndarray | int]]) -> np.ndarray:
        """At every place, the sum of what ``ends`` (places, values) add at or before it, within the client."""
        diff = np.zeros(int(self.begin[-1]), np.int64)
        for place, value in ends:
            np.add.at(diff, place, value)
        total = np.cumsum(diff)
        before = np.concatenate([[0], total])[self.begin[:-1]]
        return total - np.repeat(before, np.diff(self.begin))

    def latest(self, place: np.ndarray, ts: np.ndarray, id_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At every place, the greatest (ts, id) that comes at or before it, within the client; _LEAST where none does."""
        order = np.lexsort((id_, ts))
        n = len(order) + 1
        seat = np.repeat(np.arange(len(self.clients)), np.diff(self.begin)) * n
        top = seat.copy()
        np.maximum.at(top, place[order], seat[place[order]] + np.arange(1, n))
        best = np.maximum.accumulate(top) - seat if len(top) else top
        return np.append(_LEAST, ts[order])[best], np.append(_LEAST, id_[order])[best]


def _columns(batch: pa.RecordBatch | pa.Table, *names: str) -> list[np.ndarray]:
    """Long columns; nulls are _LEAST."""
    return [pc.fill_null(batch.column(n).cast(pa.int64()), int(_LEAST)).to_numpy() for n in names]


def _beyond(group: np.ndarray, lo: np.ndarray, ts: np.ndarray, so_far: int = _LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(order by group and lo, greatest ts of the rows of the group that come before each, _LEAST for none); so_far: of the first group."""
    order = np.lexsort((ts, lo, group))
    kinds, rank = np.unique(np.append(ts[order], so_far), return_inverse=True)
    number = np.unique(group[order], return_inverse=True)[1]
    n = len(kinds) + 1
    key = np.append(number * n, 0)
    own = number * n + rank[:-1] + 1
    before = np.concatenate([[rank[-1] + 1], own[:-1]])  # the row before, or what the first group has so far
    seen = np.maximum.accumulate(np.maximum(before, key[:-1])) - key[:-1]
    return order, np.append(_LEAST, kinds)[np.where(seen > 0, seen, 0)]


def _result(label: np.ndarray, counts: list[np.ndarray], last: tuple[np.ndarray, np.ndarray], sale: np.ndarray, t: np.ndarray | pa.Array, more: tuple = ()) -> pa.RecordBatch:
    null = lambda x: pc.if_else(pa.array(x == _LEAST), None, pa.array(x))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sale) + 1, dtype=np.int32) * len(counts)), pa.array(np.stack(counts, 1).ravel()))
    names = [x.split()[0] for x in (PIECE if len(more) else RESULT).split(", ")]
    return pa.RecordBatch.from_arrays([*more, null(sale), pa.array(t), pa.array(label), pa.array(last[0]), null(last[1]), lists], names=names)


def whole_clients(rows: pa.Table, windows: tuple[int, ...] = WINDOWS, horizon: int = HORIZON_DAYS) -> Iterator[pa.RecordBatch]:
    """RESULT of each probe among the records of some clients, of each of which all are here."""
    client, kind, lo, ts, cents, id_, t = _columns(rows, "client", "kind", "lo", "ts", "cents", "id", "t")
    probe = np.flatnonzero(kind == SALE)
    if not len(probe):
        return
    p = Probes(client[probe], t[probe], np.unique(client[probe]))
    number = np.minimum(p.of(client), len(p.clients) - 1)
    some = p.clients[number] == client  # rows of clients without probes affect none
    ranked = probe[p.order]
    soon = p.sums([(p.at(number[probe], ts[probe] - horizon * DAY), 1), (p.at(number[probe], ts[probe]), -1)])
    arrived = some & (lo != _LEAST)
    clicks = np.flatnonzero(arrived & ((kind == CLICK) | (kind == PURCHASE)))
    last_ts, last_id = (x[p.place] for x in p.latest(p.at(number[clicks], lo[clicks]), ts[clicks], id_[clicks]))
    items = np.flatnonzero(arrived & (kind == LINE) & (id_ != _LEAST))
    order, before = _beyond(_group(number[items], id_[items]), lo[items], ts[items])
    items = items[order]
    counts = []
    for d in windows:
        out = {}
        for k, (n, money) in _COUNTS.items():
            own = np.flatnonzero(arrived & ((kind == k) | (k == CLICK) & (kind == PURCHASE)) & (lo < ts + d * DAY))
            begin, end = p.at(number[own], lo[own]), p.at(number[own], ts[own] + d * DAY)
            out[n] = p.sums([(begin, 1), (end, -1)])[p.place]
            out[money] = p.sums([(begin, cents[own]), (end, -cents[own])])[p.place]
            if k == CLICK:
                bought = kind[own] == PURCHASE
                out["n_purchases"] = p.sums([(begin[bought], 1), (end[bought], -1)])[p.place]
        end = ts[items] + d * DAY
        begin = np.maximum(lo[items], np.where(before == _LEAST, _LEAST, before + d * DAY))
        new = np.flatnonzero(begin < end)
        of = number[items[new]]
        out["n_items"] = p.sums([(p.at(of, begin[new]), 1), (p.at(of, end[new]), -1)])[p.place]
        counts += [out[c] for c in COUNTERS]
    yield _result(soon[p.place], counts, (last_ts, last_id), id_[ranked], t[ranked])


def _group(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the distinct pairs, in their order."""
    _, a = np.unique(a, return_inverse=True)
    kinds, b = np.unique(b, return_inverse=True)
    return np.unique(a * np.int64(len(kinds)) + b, return_inverse=True)[1]


def _cold(batches: Iterator[pa.RecordBatch], windows: tuple[int, ...], horizon: int) -> Iterator[pa.RecordBatch]:
    """whole_clients of records sorted by client, some clients at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < CHUNK_ROWS:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        client = rows.column("client").to_numpy()
        cut = int(np.searchsorted(client, client[-1]))  # the last client may go on
        yield from whole_clients(rows.slice(0, cut), windows, horizon)
        held, n = rows.slice(cut).combine_chunks().to_batches(), len(client) - cut
    if held:
        yield from whole_clients(pa.Table.from_batches(held).combine_chunks(), windows, horizon)


# -- clients that are cut in time --------------------------------------------------------------------


def _before(sorted_rows: DataFrame) -> DataFrame:
    """Lines sorted by (client, id, lo) with ``before``: the greatest ts of the item's earlier lines of this partition; a row of part and last ts at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = ["client", "id", "lo", "ts", "before", "part", "open", "kind"]
        first = now = None
        so_far = int(_LEAST)

        def out(client, id_, lo, ts, before, open_, kind):
            n = len(client)
            null = lambda x: pc.if_else(pa.array(x == _LEAST), None, pa.array(x))
            return pa.RecordBatch.from_arrays([pa.array(client), pa.array(id_), pa.array(lo), pa.array(ts), null(before), pa.array(np.full(n, part, np.int32)), pa.array(open_), pa.array(np.full(n, kind, np.int32))], names=names)

        for batch in batches:
            client, id_, lo, ts = _columns(batch, "client", "id", "lo", "ts")
            if not len(client):
                continue
            first = first or (client[0], id_[0])
            order, before = _beyond(_group(client, id_), lo, ts, so_far if now == (client[0], id_[0]) else int(_LEAST))
            client, id_, lo, ts = client[order], id_[order], lo[order], ts[order]
            yield out(client, id_, lo, ts, before, (client == first[0]) & (id_ == first[1]), ITEM)
            same = (client == client[-1]) & (id_ == id_[-1])
            so_far = int(max(ts[same].max(), so_far if now == (client[-1], id_[-1]) else _LEAST))
            now = client[-1], id_[-1]
        if now is not None:
            one = lambda *x: [np.array([v]) for v in x]
            yield out(*one(*first, 0, 0, _LEAST), np.array([True]), 0)  # where the partition begins
            yield out(*one(*now, 0, so_far, _LEAST), np.array([False]), 1)  # and what it ends with

    return sorted_rows.transform(in_arrow, run, "client long, id long, lo long, ts long, before long, part int, open boolean, kind int")


def _item_ends(lines: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """Events of the disjoint ranges of the items of clients that are cut in time."""
    order = ["client", "id", "lo"]
    latest = lines.where("id is not null").groupBy(*order).agg(F.max("ts").alias("ts"))  # of lines that count from one time on the last one covers all
    found = materialize(_before(latest.repartitionByRange(partitions(lines.sparkSession), *order).sortWithinPartitions(*order)), "features-items")
    at_end = Window.partitionBy("client", "id").orderBy("part", "kind").rowsBetween(Window.unboundedPreceding, -1)  # one or two rows of each partition
    carried = found.where(F.col("kind") < ITEM).select("client", "id", "part", "kind", F.max(F.when(F.col("kind") == 1, F.col("ts"))).over(at_end).alias("carry")).where("kind = 0 and carry is not null").select("part", F.lit(True).alias("open"), "carry")
    rows = found.where(F.col("kind") == ITEM).drop("kind")
    opened = rows.where("open").join(F.broadcast(carried), ["part", "open"], "left").withColumn("before", F.greatest("before", "carry")).drop("carry")
    rows = opened.unionByName(rows.where("not open"))
    begins = [F.greatest("lo", F.col("before") + d * DAY) for d in windows]
    new = [b < F.col("ts") + d * DAY for b, d in zip(begins, windows, strict=True)]
    bit = lambda test, i: F.when(test, F.lit(1 << i)).otherwise(0)
    ends = []
    for i, d in enumerate(windows):
        alike = [n & (b == begins[i]) for n, b in zip(new, begins, strict=True)]  # windows that begin together
        first = functools.reduce(lambda a, b: a & ~b, alike[:i], new[i])
        ends.append(F.when(first, F.struct(begins[i].alias("at"), F.lit(1).alias("sign"), sum((bit(x, k) for k, x in enumerate(alike)), F.lit(0)).alias("mask"))))
        ends.append(F.when(new[i], F.struct((F.col("ts") + d * DAY).alias("at"), F.lit(-1).alias("sign"), F.lit(1 << i).alias("mask"))))
    return rows.select("client", "id", F.explode(F.array_compact(F.array(*ends))).alias("e")).select("client", "e.at", F.lit(ITEM).alias("kind"), "e.sign", "e.mask", F.lit(1).alias("n"), F.lit(0).cast("long").alias("cents"), F.lit(None).cast("long").alias("ts"), "id")


def _ends(rows: DataFrame, windows: tuple[int, ...], horizon: int) -> DataFrame:
    """(client, at, kind, sign, mask, n, cents, ts, id): both ends of each record's ranges, and the probes; mask has a bit for each window.

    Records that begin and end together are one first, with their number, sum of cents and greatest id.
    """
    rows = rows.groupBy("client", "kind", "lo", "ts", "t", F.when(F.col("kind") == SALE, F.col("id")).alias("sale")).agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("cents").alias("cents"), F.max("id").alias("id"))
    all_ = F.lit((1 << len(windows)) - 1)
    covers = [F.col("lo") < F.col("ts") + d * DAY for d in windows]
    end = lambda at, sign, mask, kind="kind": F.struct(at.alias("at"), (F.col(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(sign).alias("sign"), mask.cast("int").alias("mask"))
    some = sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(covers)), F.lit(0))
    ends = [F.when(some > 0, end(F.col("lo"), 1, some))] + [F.when(c, end(F.col("ts") + d * DAY, -1, F.lit(1 << i))) for i, (c, d) in enumerate(zip(covers, windows, strict=True))]
    sale = F.col("kind") == SALE
    ends += [F.when(sale, end(F.col("ts") - horizon * DAY, 1, all_, F.lit(LABEL))), F.when(sale, end(F.col("ts"), -1, all_, F.lit(LABEL)))]
    probes = F.array_repeat(end(F.col("t"), 0, all_, F.lit(PROBE)), F.when(sale, F.col("n")).otherwise(0))
    return rows.select("client", "n", "cents", "ts", "id", F.explode(F.concat(F.array_compact(F.array(*ends)), probes)).alias("e")).select("client", "e.at", "e.kind", "e.sign", "e.mask", "n", "cents", "ts", "id")


class _Run:
    """Totals of the client that a partition has come to."""

    def __init__(self, windows: tuple[int, ...]):
        self.windows, self.client = windows, None
        self.clear()

    def clear(self) -> None:
        self.total = [0] * (len(self.windows) * len(COUNTERS))
        self.label, self.last = 0, (int(_LEAST), int(_LEAST))

    def chunk(self, batch: pa.RecordBatch, part: int, first: int) -> Iterator[pa.RecordBatch]:
        """Results of the probes of sorted events; rows that cover the chunk are the totals so far, added as constants."""
        client, at, kind, sign, mask, n_rows, cents, ts, id_ = _columns(batch, "client", "at", "kind", "sign", "mask", "n", "cents", "ts", "id")
        if client[0] != self.client:
            self.clear()
        probe = kind == PROBE
        p = Probes(client[probe], at[probe], np.unique(client))
        sale, t = id_[probe][p.order], at[probe][p.order]
        of = p.of(client)
        place = p.at(of, at)
        end = p.begin[1:] - 1  # each client's place after its probes
        lead = np.arange(int(p.begin[-1])) < p.begin[1]  # places of the first client
        mine = kind == LABEL
        soon = p.sums([(place[mine], sign[mine])]) + np.where(lead, self.label, 0)
        clicks = np.flatnonzero(((kind == CLICK) | (kind == PURCHASE)) & (sign > 0))
        seen = p.latest(np.append(place[clicks], 0), np.append(ts[clicks], self.last[0]), np.append(id_[clicks], self.last[1]))
        last = seen[0][p.place], seen[1][p.place]
        owner = client[probe][p.order]
        more = [pa.array(owner), pa.array(np.full(len(owner), part, np.int32)), pa.array(owner == first)]
        counts = []
        for i in range(len(self.windows)):
            here = (mask >> i & 1).astype(bool)
            full = {}
            for k, (n, money) in _COUNTS.items():
                mine = np.flatnonzero(here & ((kind == k) | (k == CLICK) & (kind == PURCHASE)))
                full[n] = [(place[mine], sign[mine] * n_rows[mine])]
                full[money] = [(place[mine], sign[mine] * cents[mine])]
            for k, n in ((PURCHASE, "n_purchases"), (ITEM, "n_items")):
                mine = np.flatnonzero(here & (kind == k))
                full[n] = [(place[mine], sign[mine] * n_rows[mine])]
            counts += [p.sums(full[c]) + np.where(lead, self.total[i * len(COUNTERS) + at], 0) for at, c in enumerate(COUNTERS)]
        if len(owner):
            yield _result(soon[p.place], [x[p.place] for x in counts], last, sale, t, more)
        self.total = [int(x[end[-1]]) for x in counts]
        self.label, self.last, self.client = int(soon[end[-1]]), (int(seen[0][end[-1]]), int(seen[1][end[-1]])), client[-1]

    def rest(self, part: int, first: int) -> Iterator[pa.RecordBatch]:
        """What the partition ends with, and where it begins, as rows without t."""
        none, no_time = np.array([_LEAST]), pa.nulls(1, pa.int64())
        totals = [np.array([x]) for x in self.total]
        yield _result(np.array([self.label]), totals, tuple(np.array([x]) for x in self.last), none, no_time, [pa.array([self.client]), pa.array([part], pa.int32()), pa.array([False])])
        yield _result(np.array([0]), [x * 0 for x in totals], (none, none), none, no_time, [pa.array([first]), pa.array([part], pa.int32()), pa.array([True])])


def _hot(rows: DataFrame, windows: tuple[int, ...], horizon: int) -> DataFrame:
    """RESULT of the probes of clients whose rows are cut in time."""
    n = partitions(rows.sparkSession)
    events = materialize(_ends(rows, windows, horizon).unionByName(_item_ends(rows.where(F.col("kind") == LINE), windows)), "features-ends")
    later = (F.col("kind") == PROBE).cast("int")  # what begins or ends at a probe's time comes before it
    order = [F.col("client"), F.col("at"), later, F.col("kind"), F.col("id"), F.col("cents")]
    dealt = events.repartitionByRange(n, *order).sortWithinPartitions("client", "at", later)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state, first = TaskContext.get().partitionId(), _Run(windows), None
        for batch in batches:
            if batch.num_rows:
                first = batch.column("client")[0].as_py() if first is None else first
                yield from state.chunk(batch, part, first)
        if first is not None:
            yield from state.rest(part, first)

    found = materialize(dealt.transform(in_arrow, run, PIECE), "features-hot")
    earlier = Window.partitionBy("client").orderBy("part", F.col("open").desc()).rowsBetween(Window.unboundedPreceding, -1)  # two rows of each partition
    last, size = F.struct("last_ts", "last_click_id"), len(windows) * len(COUNTERS)
    carried = F.array(*[F.sum(F.col("counts")[i]).over(earlier) for i in range(size)])
    ends = found.where("t_us is null").select("open", "part", F.sum("label").over(earlier).alias("c_label"), F.max(last).over(earlier).alias("c_last"), carried.alias("c_counts")).where("open and c_label is not null")
    rows = found.where("t_us is not null").join(F.broadcast(ends), ["open", "part"], "left")
    latest = F.greatest(last, F.col("c_last"))
    full = F.when(F.col("c_counts").isNull(), F.col("counts")).otherwise(F.zip_with("counts", "c_counts", lambda a, b: a + b))
    return rows.select("sale_id", "t_us", (F.col("label") + F.coalesce("c_label", F.lit(0))).alias("label"), latest["last_ts"].alias("last_ts"), latest["last_click_id"].alias("last_click_id"), full.alias("counts"))


@tidy("features")
def features(sales: DataFrame, clicks: DataFrame, lines: DataFrame, windows: tuple[int, ...] = WINDOWS, delay: int = DELAY_MINUTES, horizon: int = HORIZON_DAYS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """For each sale and window of d days: (sale_id, d, t_us, label, counters, last_click_id)."""
    spark = sales.sparkSession
    rows = materialize(records(sales, clicks, lines, max(windows), delay), "features-records")
    big = materialize(rows.groupBy("client").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("client", F.lit(True).alias("hot")), "features-hot-clients")
    n_hot = big.count()
    if n_hot:
        marked = rows.join(F.broadcast(big) if n_hot <= MAX_BROADCAST else big.hint("merge"), "client", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        rows = materialize(marked, "features-marked")
    cold = rows.where("not hot").drop("hot") if n_hot else rows
    cold = cold.repartition(partitions(spark), "client").sortWithinPartitions("client")
    found = cold.transform(in_arrow, lambda batches: _cold(batches, windows, horizon), RESULT)
    if n_hot:
        found = found.unionByName(_hot(rows.where("hot").drop("hot"), windows, horizon))
    each = [F.struct(F.lit(d).alias("d"), *[F.col("counts")[i * len(COUNTERS) + j].alias(c) for j, c in enumerate(COUNTERS)]) for i, d in enumerate(windows)]
    found = found.select("sale_id", "t_us", "label", "last_ts", "last_click_id", F.explode(F.array(*each)).alias("w")).select("*", "w.*")
    still = F.col("last_ts") > F.col("t_us") - F.col("d") * F.lit(DAY)
    return found.select("sale_id", "d", "t_us", (F.col("label") > 0).alias("label"), *COUNTERS[:3], F.when(still, F.col("last_click_id")).alias("last_click_id"), *COUNTERS[3:])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(*(table(spark, sf_dir, n) for n in ("sales", "clicks", "sale_lines")))


SQL = f"""
with recursive bits as (select i as b, i as c, 0 as k from range(256) as r(i) union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
tab as (select list(c order by b) as t from bits where k = 8),
s as (
  select sale_id, client_id as c, sold_at, arrived_at + interval 240 minutes as known, coalesce(case when abs(total) < 9e16 then floor(100 * total + 0.5)::bigint end, 0) as cents,
    epoch_us(sold_at) + coalesce(xor(list_reduce(list_transform(string_split(sale_id::varchar, ''), lambda x: ascii(x)::bigint), lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1]), 4294967295::bigint), 4294967295) % {SPREAD_SECONDS}, 0) * 1000000 as t_us
  from sales, tab where client_id is not null and sold_at is not null),
p as (select s.*, make_timestamp(t_us) as t, d from s, (values {", ".join(f"({d})" for d in WINDOWS)}) as w(d)),
ck as (select click_id, ts, arrived_at + interval 240 minutes as known, client_id as c, kind, coalesce(case when abs(value) < 9e16 then floor(100 * value + 0.5)::bigint end, 0) as cents from (select distinct * from clicks)),
clicked as (
  select p.sale_id, p.t_us, d, count(*) as n_clicks, count(*) filter (kind = 'purchase') as n_purchases, sum(ck.cents)::bigint as click_cents, arg_max(click_id, (ts, click_id)) as last_click_id
  from p join ck on p.c = ck.c and ts <= t and ts > t - to_days(d) and ck.known <= t group by all),
sold as (
  select p.sale_id, p.t_us, d, count(*) as n_sales, sum(s.cents)::bigint as sale_cents
  from p join s on p.c = s.c and s.sold_at <= t and s.sold_at > t - to_days(d) and s.known <= t group by all),
ln as (select s.c, s.sold_at, greatest(s.known, shipped_at) as known, item_id, coalesce(case when abs(amount) < 9e16 then floor(100 * amount + 0.5)::bigint end, 0) as cents from s join sale_lines l on s.sale_id = l.sale_id where s.known is not null and shipped_at is not null),
lines as (
  select p.sale_id, p.t_us, d, count(*) as n_lines, count(distinct item_id) as n_items, sum(ln.cents)::bigint as line_cents
  from p join ln on p.c = ln.c and ln.sold_at <= t and ln.sold_at > t - to_days(d) and ln.known <= t group by all),
labels_ as (select p.sale_id, p.t_us, d from p semi join s on p.c = s.c and s.sold_at > p.t and s.sold_at <= p.t + to_days({HORIZON_DAYS}))
select p.sale_id, p.d::integer as d, p.t_us, labels_.t_us is not null as label, coalesce(n_clicks, 0) as n_clicks, coalesce(n_purchases, 0) as n_purchases, coalesce(click_cents, 0) as click_cents, last_click_id,
  coalesce(n_sales, 0) as n_sales, coalesce(sale_cents, 0) as sale_cents, coalesce(n_lines, 0) as n_lines, coalesce(n_items, 0) as n_items, coalesce(line_cents, 0) as line_cents
from p left join clicked using (sale_id, t_us, d) left join sold using (sale_id, t_us, d) left join lines using (sale_id, t_us, d) left join labels_ using (sale_id, t_us, d)
"""
