"""Exact rolling median and median absolute deviation over a time window of each series.

Rows become points (series, ts, cents, count), pre-aggregated before anything is dealt by series. Points go to chunks of
CHUNK microseconds with a halo: a chunk also gets what lies up to one window before it. A chunk in which more than DENSE
points lie is cut into up to PARTS parts, each with a halo of its own, so a series and an hour may be as full as
they like. In a chunk the points stand in order of ts, in a binary trie over the bits of their cents, less the least
cents (so the bits are unsigned). Every level of the trie keeps running counts of its zero bits; the count of a subtree in
any window is the difference of its running counts at the window's two ends, so the trie slides with the window by moving
two positions. Going down the bits with these counts selects the two middle values. The deviation is the least radius
whose prefix counts, right end less left end, reach half of the window; it is found by bisection between the distances
of two quartiles.

Windows hold ts in (own - WINDOW, own]; points of equal ts are all in it. All windows of a portion (PORTION points or
more) are answered at once, in arrays. A task holds one window's points and a portion, whatever the chunk holds.

Nulls: a null ts drops the row; a null value, NaN, an infinity and cents of 2^58 or more count as no cents (such rows get
a result, but are in no window); a null kind is a series; a null click_id is an id like any other and is taken once.
Of rows with one click_id that differ, the one with the least (ts, kind, cents), nulls last, is taken. Ties of ts and of
cents count with their number. Columns beside the five that are named are not read, so no name clashes; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import dropped, small, staged, table

SECOND = 1_000_000
WINDOW = 900 * SECOND
CHUNK = 3600 * SECOND
#: Points of a chunk above which it is cut, and the most parts it is cut into.
DENSE = 2_000_000
PARTS = 15
#: Points answered together.
PORTION = 1 << 17
#: Cents are below this, so that sums of four of them fit 64 bits.
MOST = 1 << 58


class WindowTrie:
    """Values in order of time in a counted binary trie; a window is a pair of positions."""

    def __init__(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.least = int(values.min()) if len(values) else 0
        v = values - self.least
        self.bits = int(v.max()).bit_length() if len(v) else 0
        self.single = bool((counts == 1).all())
        #: Per level: running number of zero bits, their running counts, and how many there are in all.
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.total = np.concatenate([[0], np.cumsum(counts)])
        for b in range(self.bits - 1, -1, -1):
            zero = (v >> b) & 1 == 0
            at = np.concatenate([[0], np.cumsum(zero)])
            held = at if self.single else np.concatenate([[0], np.cumsum(np.where(zero, counts, 0))])
            self.levels.append((at, held, int(at[-1])))
            v = np.concatenate([v[zero], v[~zero]])
            counts = np.concatenate([counts[zero], counts[~zero]])

    def size(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.total[hi] - self.total[lo]

    def select(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th least value (from 0) of each window, above self.least."""
        x = np.zeros(len(lo), np.int64)
        for at, held, zeros in self.levels:
            a, b = at[lo], at[hi]
            n = b - a if self.single else held[hi] - held[lo]
            one = k >= n
            k = np.where(one, k - n, k)
            lo, hi = np.where(one, zeros + lo - a, a), np.where(one, zeros + hi - b, b)
            x = 2 * x + one
        return x

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each window are less than x: the trie's counts left of the path of x."""
        over = x >= 1 << self.bits
        whole = self.size(lo, hi)
        path = np.where(over, 0, np.maximum(x, 0))
        out = np.zeros(len(lo), np.int64)
        for i, (at, held, zeros) in enumerate(self.levels):
            a, b = at[lo], at[hi]
            one = (path >> (self.bits - 1 - i)) & 1 == 1
            out += np.where(one, b - a if self.single else held[hi] - held[lo], 0)
            lo, hi = np.where(one, zeros + lo - a, a), np.where(one, zeros + hi - b, b)
        return np.where(over, whole, out)

    def medians(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Doubled median, and doubled median of its doubled distances, of windows that hold something."""
        n = self.size(lo, hi)
        half = (n - 1) // 2
        m = self.select(lo, hi, half) + self.select(lo, hi, n // 2)
        odd = m & 1
        # Ranks side..side + half lie within the greater of their ends' distances, and no lesser radius than the nearer has so many.
        side = (n - 1 - half) // 2
        left, right = m - 2 * self.select(lo, hi, side), 2 * self.select(lo, hi, side + half) - m
        # Distances are odd + 2j; bisect j.
        near, far = np.maximum(np.minimum(left, right) - odd, 0) // 2, (np.maximum(left, right) - odd) // 2
        first, last = (m - odd) // 2, (m + odd) // 2
        open_ = np.flatnonzero(near < far)
        while len(open_):
            j = (near[open_] + far[open_]) // 2
            a, b = lo[open_], hi[open_]
            enough = self.below(a, b, last[open_] + j + 1) - self.below(a, b, first[open_] - j) > half[open_]
            far[open_[enough]] = j[enough]
            near[open_[~enough]] = j[~enough] + 1
            open_ = open_[near[open_] < far[open_]]
        d = odd + 2 * near
        mad = 2 * d
        even = np.flatnonzero(n % 2 == 0)
        if len(even):  # the next distance: the same, or that of the nearest value outside the radius
            a, b, j, c = lo[even], hi[even], near[even], m[even]
            under, upto = self.below(a, b, first[even] - j), self.below(a, b, last[even] + j + 1)
            more = np.full(len(even), np.iinfo(np.int64).max)
            k = np.flatnonzero(under > 0)
            more[k] = c[k] - 2 * self.select(a[k], b[k], under[k] - 1)
            k = np.flatnonzero(upto < n[even])
            more[k] = np.minimum(more[k], 2 * self.select(a[k], b[k], upto[k]) - c[k])
            mad[even] = d[even] + np.where(upto - under > n[even] // 2, d[even], more)
        return m + 2 * self.least, mad


def _answers(rows: pa.Table, start: int, stop: int, window: int) -> pa.RecordBatch:
    """Windows of the own points start..stop of rows, in order of series, chunk, part and us; one row for each (series, us)."""
    us, group = rows["us"].to_numpy(), _groups(rows)
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    # One clock for all groups, more than a window apart.
    span = np.append(us[starts[1:] - 1], us[-1]) - us[starts]
    clock = us - us[starts][group] + np.concatenate([[0], np.cumsum(span[:-1] + window + 1)])[group]
    with_cents = rows["cents"].is_valid().to_numpy()
    values, counts, at = rows["cents"].drop_null().to_numpy(), rows["n"].to_numpy()[with_cents], clock[with_cents]
    asked = start + np.flatnonzero(rows["own"].to_numpy()[start:stop])
    asked = asked[np.diff(clock[asked], prepend=-1) != 0]
    lo, hi = np.searchsorted(at, clock[asked] - window, "right"), np.searchsorted(at, clock[asked], "right")
    trie = WindowTrie(values, counts)
    n = trie.size(lo, hi)
    some = n > 0
    median, mad = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    median[some], mad[some] = trie.medians(lo[some], hi[some])
    out = [rows["series"].take(pa.array(asked)).combine_chunks(), pa.array(us[asked]), pa.array(n), pa.array(median, mask=~some), pa.array(mad, mask=~some)]
    return pa.RecordBatch.from_arrays(out, ["series", "us", "n", "median2", "mad4"])


def _groups(rows: pa.Table) -> np.ndarray:
    """Running number of the group of each row."""
    series = rows["series"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
    new = np.zeros(len(series), bool)
    for k in (series, rows["chunk"].to_numpy(), rows["part"].to_numpy()):
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _slide(batches: Iterator[pa.RecordBatch], window: int, portion: int) -> Iterator[pa.RecordBatch]:
    """Batches in order of series, chunk, part and us to answers. Of what is answered only the last window stays."""
    held: list[pa.RecordBatch] = []
    done = rows = 0

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, done, rows
        t = pa.Table.from_batches(held).combine_chunks()
        us, group = t["us"].to_numpy(), _groups(t)
        before = np.flatnonzero((us != us[-1]) | (group != group[-1]))  # points of the last ts may not all be here
        cut = len(t) if last else int(before[-1]) + 1 if len(before) else 0
        if cut > done:
            yield _answers(t, done, cut, window)
        if not last:
            keep = int(np.flatnonzero((group == group[-1]) & (us > us[-1] - window))[0])
            held, done, rows = t.slice(keep).to_batches(), max(cut, done) - keep, len(t) - keep

    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
            if rows - done >= max(portion, done):
                yield from flush(False)
    if held:
        yield from flush(True)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a time as it stands on the clock, without any zone."""
    t = F.col(ts) if isinstance(ts, str) else ts
    day = F.unix_date(F.to_date(t)).cast("long")
    minutes = (day * 24 + F.hour(t)) * 60 + F.minute(t)
    return minutes * F.lit(60 * SECOND).cast("long") + (F.extract(F.lit("SECOND"), t) * SECOND).cast("long")


def cents(value: Column | str) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    c = F.floor(F.when(~F.isnan(v) & (F.abs(v) < MOST / 200), v) * 100 + 0.5)
    return c.cast("long")


def chunks(points: DataFrame, window: int = WINDOW, chunk: int = CHUNK, dense: int = DENSE, parts: int = PARTS) -> DataFrame:
    """points (series, us, ...) to rows with chunk, part and own: each point in its own part, and in those it is in the halo of."""
    own = F.expr(f"(us - pmod(us, {chunk}L)) div {chunk}L")
    full = points.groupBy("series", own.alias("chunk")).agg(F.count("*").alias("rows")).filter(F.col("rows") > dense)
    full = staged(full.select(F.col("series").alias("f_series"), F.col("chunk").alias("f_chunk"), F.least(F.lit(parts), F.ceil(F.col("rows") / dense)).cast("long").alias("f_parts")), "median_dense")
    last = F.expr(f"(us + {window - 1}L - pmod(us + {window - 1}L, {chunk}L)) div {chunk}L")
    dealt = points.select("*", F.explode(F.sequence(own, last)).alias("chunk"))
    cut = small(full)
    dealt = dealt.join(cut, dealt["series"].eqNullSafe(cut["f_series"]) & (dealt["chunk"] == cut["f_chunk"]), "left").withColumn("_parts", F.coalesce("f_parts", F.lit(1).cast("long")))
    dealt = dealt.withColumn("_rel", F.col("us") - F.col("chunk") * F.lit(chunk))
    first, final = F.expr(f"greatest(0L, _rel) * _parts div {chunk}L"), F.expr(f"least(_parts - 1, (_rel + {window - 1}L) * _parts div {chunk}L)")
    dealt = dealt.select("*", F.explode(F.sequence(first, final)).alias("part"))
    return dealt.select(*points.columns, "chunk", "part", ((F.col("_rel") >= 0) & (F.col("part") == first)).alias("own"))


def rolling(points: DataFrame, window: int = WINDOW, chunk: int = CHUNK, dense: int = DENSE, parts: int = PARTS, portion: int = PORTION) -> DataFrame:
    """points (series, us, cents, n: how many there are) to series, us, n, median2 and mad4, one row for each (series, us)."""
    key = next(f.dataType.simpleString() for f in points.schema.fields if f.name == "series")
    dealt = chunks(points.select("series", "us", "cents", "n"), window, chunk, dense, parts)
    dealt = dealt.repartition("series", "chunk", "part").sortWithinPartitions("series", "chunk", "part", "us")
    return dealt.mapInArrow(lambda it: _slide(it, window, portion), f"series {key}, us long, n long, median2 long, mad4 long")


def clicks_once(clicks: DataFrame) -> DataFrame:
    """One (click_id, kind, us, cents) for each click_id that has a ts; staged."""
    rows = clicks.filter(F.col("ts").isNotNull()).select("click_id", F.col("kind"), micros("ts").alias("us"), cents("value").alias("cents"))
    rows = rows.distinct()  # hash aggregation of repeated rows; only ids with different rows are left to the next
    once = rows.groupBy("click_id").agg(F.min(F.struct("us", F.col("kind").isNull().alias("a"), "kind", F.col("cents").isNull().alias("b"), "cents")).alias("r"))
    return staged(once.select("click_id", "r.kind", "r.us", "r.cents"), "clicks_once")


def with_medians(once: DataFrame, **how) -> DataFrame:
    """once (click_id, kind, us, cents) with n, median2, mad4 and far."""
    points = staged(once.groupBy(F.col("kind").alias("series"), "us", "cents").agg(F.count("*").alias("n")), "median_points")
    found = staged(rolling(points, **how), "medians")
    dropped(points)
    out = once.join(found, once["kind"].eqNullSafe(found["series"]) & (once["us"] == found["us"]), "left")
    far = (2 * F.abs(2 * F.col("cents") - F.col("median2")) > 2 * F.col("mad4")).alias("far")
    return out.select("click_id", "kind", F.coalesce(found["n"], F.lit(0).cast("long")).alias("n"), "median2", "mad4", far)


def op12_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_medians(clicks_once(table(spark, sf_dir, "clicks").select("click_id", "ts", "kind", "value")))


OP12_SQL = """
WITH once AS (
  SELECT click_id, min((epoch_us(ts), kind IS NULL, kind, value IS NULL, CAST(floor(100 * value + 0.5) AS BIGINT))) AS r
  FROM clicks WHERE ts IS NOT NULL GROUP BY click_id),
c AS (SELECT click_id, r[1] AS us, r[3] AS kind, r[5] AS cents FROM once),
w AS (
  SELECT click_id, kind, cents, list_sort(coalesce(list(cents) FILTER (WHERE cents IS NOT NULL) OVER (
    PARTITION BY kind ORDER BY us RANGE BETWEEN 899999999 PRECEDING AND CURRENT ROW), [])) AS x
  FROM c),
m AS (SELECT *, len(x) AS n, x[(len(x) + 1) // 2] + x[len(x) // 2 + 1] AS median2 FROM w),
d AS (SELECT *, list_sort(list_transform(x, lambda v: abs(2 * v - median2))) AS y FROM m),
e AS (SELECT *, y[(n + 1) // 2] + y[n // 2 + 1] AS mad4 FROM d)
SELECT click_id, kind, CAST(n AS BIGINT) AS n, CAST(median2 AS BIGINT) AS median2, CAST(mad4 AS BIGINT) AS mad4, 2 * abs(2 * cents - median2) > 2 * mad4 AS far
FROM e
"""
