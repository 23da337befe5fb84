"""Intervals of positions: runs, merging, bounded segments. Ends are inclusive, positions count from 0."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import micro
from ..functions.params import MICRO, Params
from ..sources.scratch import written

#: Positions of a sequence that one task looks at for runs; runs over a border are joined afterwards.
SPAN = 1 << 18


#: Positions of a run's piece that one task searches for the densest segment.
DENSE = 1 << 16

#: Positions of a bucket of the range joins.
BUCKET = 1024


def buckets(start: Column, end: Column) -> Column:
    """The buckets that [start, end] touches."""
    return F.sequence(F.floor(start / BUCKET), F.floor(end / BUCKET))


def near(signals: DataFrame, bounds: DataFrame, reach: int = 0) -> DataFrame:
    """Rows of ``signals`` with each region whose bounds, widened by ``reach``, hold them.

    An equality join on sequence and bucket, so a long sequence with many regions stays linear.
    """
    wide = bounds.withColumn("bucket", F.explode(buckets(F.col("start") - reach, F.col("end") + reach)))
    rows = signals.withColumn("bucket", F.floor(F.col("pos") / BUCKET))
    return rows.join(wide, ["seq_idx", "bucket"]).where((F.col("pos") >= F.col("start") - reach) & (F.col("pos") <= F.col("end") + reach)).drop("bucket")


def runs(rows: DataFrame, keys: tuple[str, ...] = ("seq_idx",)) -> DataFrame:
    """(keys, start, end) of maximal runs of consecutive ``pos`` among ``rows``."""
    part = rows.withColumn("_span", F.floor(F.col("pos") / SPAN))
    order = Window.partitionBy(*keys, "_span").orderBy("pos")
    island = part.select(*keys, "_span", "pos", (F.col("pos") - F.row_number().over(order)).alias("_island"))
    found = island.groupBy(*keys, "_span", "_island").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    return merge_intervals(found.select(*keys, "start", "end"), 1, keys)


def merge_intervals(intervals: DataFrame, gap: int, keys: tuple[str, ...] = ("seq_idx",)) -> DataFrame:
    """Union of intervals whose start is at most ``gap`` beyond the furthest end before it."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("_new", F.when(F.col("start") <= before + gap, 0).otherwise(1))
    grouped = marked.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_group")


def positive_runs(signals: DataFrame) -> DataFrame:
    """(seq_idx, start, end, length) of runs of positive pds."""
    return runs(signals.where("pds > 0").select("seq_idx", "pos")).withColumn("length", F.col("end") - F.col("start") + 1)


def long_runs(signals: DataFrame, p: Params = Params()) -> DataFrame:
    """Positive runs of at least the smallest region's length."""
    return positive_runs(signals).where(F.col("length") >= p.min_region)


def bounded_segments(signals: DataFrame, p: Params = Params()) -> DataFrame:
    """(seq_idx, run_start, start, end): a core for each long run.

    A run of at most ``max_region`` is its own core. In a longer one each end takes the start, within the
    bounds, with the least running sum before it (the latest of equals), and the first end with the
    greatest mean wins. Sums are of whole millionths, so ties are exact.
    """
    found = long_runs(signals, p)
    whole = found.where(F.col("length") <= p.max_region).select("seq_idx", F.col("start").alias("run_start"), "start", "end")
    over = written(found.where(F.col("length") > p.max_region).select("seq_idx", "start", "end"))
    inside = near(signals.select("seq_idx", "pos", "pds"), over).withColumnRenamed("start", "run_start")
    keys = ("seq_idx", "run_start")
    order = Window.partitionBy(*keys).orderBy("pos")
    sums = inside.select(*keys, "pos", F.sum(micro(F.col("pds"))).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    # The sum before a start s is upto at s - 1, and 0 at the run's own start.
    sums = sums.withColumn("before", F.coalesce(F.lag("upto").over(order), F.lit(0)))
    starts = order.rowsBetween(-(p.max_region - 1), -(p.min_region - 1))
    least = F.min(F.struct("before", (-F.col("pos")).alias("neg"))).over(starts)
    ends = sums.withColumn("s", least).where(F.col("s").isNotNull())
    start = -F.col("s.neg")
    mean = (F.col("upto") - F.col("s.before")).cast("double") / (F.col("pos") - start + 1).cast("double")
    best = ends.select(*keys, "pos", start.alias("start"), mean.alias("mean")).groupBy(*keys).agg(F.min(F.struct((-F.col("mean")).alias("m"), F.col("pos").alias("end"), "start")).alias("b"))
    return whole.unionByName(best.select(*keys, "b.start", "b.end"))


def least_before(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each value and the ``width`` - 1 before it, from running minima of blocks of ``width`` in both directions."""
    n = len(values)
    padded = np.concatenate([values, np.full(-n % width, values.max(), values.dtype)]).reshape(-1, width)
    onward, back = np.minimum.accumulate(padded, axis=1).ravel()[:n], np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    first = np.maximum(np.arange(n) - width + 1, 0)
    return np.where(np.arange(n) < width, np.minimum.accumulate(values), np.minimum(onward, back[first]))


def densest(values: np.ndarray, least: int, most: int) -> tuple[int, int, int] | None:
    """(start, end, sum) of the stretch of ``least`` to ``most`` values with the greatest mean; of equals the first end, then the latest start. None if there are too few.

    For a guessed mean p/q the gain of a stretch is q * sum - p * length, a difference of two points of one walk, so the best start for every end is the least point of a
    sliding window. The best stretch's own mean is the next guess; it grows until nothing gains, after a few linear rounds. Whole numbers, so ties are exact.
    """
    n = len(values)
    if n < least or most < least:
        return None
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    if int(np.abs(sums).max()) * min(most, n) + int(np.abs(values).max()) * min(most, n) * n >= 1 << 62:
        sums = sums.astype(object)  # longer than 64 bits
    at = np.arange(n + 1).astype(sums.dtype)
    p, q = sums[least], least
    while True:
        walk = q * sums - p * at
        low = least_before(walk[: n - least + 1], most - least + 1)  # for ends least, least + 1, ... the least start
        gain = walk[least:] - low
        best = int(np.argmax(gain))
        starts = walk[max(0, best - (most - least)) : best + 1]
        start = best - int(np.argmax(starts[::-1] == low[best]))
        if gain[best] <= 0:
            return start, best + least - 1, int(sums[best + least] - sums[start])
        p, q = sums[best + least] - sums[start], best + least - start


def densest_segments(signals: DataFrame, p: Params = Params()) -> DataFrame:
    """(seq_idx, run_start, start, end, mean): in each long run the segment of ``min_region`` to ``max_region`` positions with the greatest mean score.

    Unlike ``bounded_segments`` this is the segment of the greatest mean. A segment of twice the least length or more has a half that is no worse, so none of
    that length needs a look, and a run is dealt out in pieces that overlap by twice the least length: a run of any length is many tasks' work.
    """
    least, most = p.min_region, min(p.max_region, 2 * p.min_region - 1)
    kind, step = dict(signals.dtypes)["seq_idx"], max(4 * least, DENSE)
    inside = near(signals.select("seq_idx", "pos", "pds"), long_runs(signals, p).select("seq_idx", "start", "end"))
    at = F.col("pos") - F.col("start")
    piece = F.floor(at / step)
    both = F.when((piece > 0) & (at < piece * step + most - 1), F.array(piece - 1, piece)).otherwise(F.array(piece))
    rows = inside.select("seq_idx", F.col("start").cast("long").alias("run_start"), F.explode(both).alias("piece"), F.col("pos").cast("long").alias("pos"), micro(F.col("pds")).alias("v"))

    def of(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        found = densest(rows["v"].to_numpy(), least, most)
        first = rows["pos"][0].as_py()
        columns = [(first + found[0],), (first + found[1],), (found[2],)] if found else [()] * 3
        keys = [rows[c].slice(0, len(columns[0])).combine_chunks() for c in ("seq_idx", "run_start")]
        return pa.table([*keys, *(pa.array(c, pa.int64()) for c in columns)], ["seq_idx", "run_start", "start", "end", "total"])

    best = rows.groupBy("seq_idx", "run_start", "piece").applyInArrow(of, f"seq_idx {kind}, run_start long, start long, end long, total long")
    mean = F.col("total").cast("double") / (F.col("end") - F.col("start") + 1).cast("double")
    first = F.min(F.struct((-mean).alias("m"), F.col("end").alias("end"), (-F.col("start")).alias("s"))).alias("b")
    return best.groupBy("seq_idx", "run_start").agg(first).select("seq_idx", "run_start", (-F.col("b.s")).alias("start"), F.col("b.end").alias("end"), (-F.col("b.m") / float(MICRO)).alias("mean"))


def expanded(cores: DataFrame, signals: DataFrame) -> DataFrame:
    """(seq_idx, start, end): the positive run around each core, which is what expansion restores."""
    points = cores.select("seq_idx", F.col("start").alias("pos"), F.col("end").alias("last"))
    return near(points, positive_runs(signals).select("seq_idx", "start", "end")).where(F.col("last") <= F.col("end")).select("seq_idx", "start", "end").distinct()


def region_bounds(signals: DataFrame, p: Params = Params()) -> DataFrame:
    """(seq_idx, start, end) of the regions: long runs, merged. With a smallest region above the largest there are none."""
    if p.max_region < p.min_region:
        return signals.select("seq_idx", F.col("pos").alias("start"), F.col("pos").alias("end")).limit(0)
    return merge_intervals(long_runs(signals, p), p.merge_gap)


def clamped(start: Column, end: Column, size: Column) -> tuple[Column, Column]:
    """Bounds within a signal of ``size``."""
    s = F.greatest(F.lit(0), F.least(start, size - 1))
    return s, F.greatest(s, F.least(end, size - 1))
