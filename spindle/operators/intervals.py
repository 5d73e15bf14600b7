"""Keep rows whose time lies in any closed interval [lo, hi].

A row inside several (overlapping) intervals is kept once: this is a LEFT
SEMI join, never an inner join. An empty interval list keeps nothing.

Intervals are clipped to the time range of the data (so an open-ended one costs no more than the data's
own range), cut at the edges of time bins, and merged inside each bin: overlapping, touching and repeated
ones become one. The rows then meet the few merged pieces of their bin in an equi-join plus the range test; the
join strategy is left to AQE. Cost grows with rows + bins covered, not rows x intervals.

Before the join the rows are filtered by a short list of coarse ranges that cover all intervals (:func:`coarse_ranges`). As plain
comparisons on the time column they reach the scan of a table: row groups and pages whose times lie outside are not read. This
pays where rows are stored in time order (``average_reference`` leaves them so, and the power table's files hold runs of blocks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_range(df: DataFrame, time: str = "time") -> tuple[int, int] | None:
    """(smallest, largest) time of the rows, None if there is none."""
    r = df.agg(F.min(time).alias("lo"), F.max(time).alias("hi")).first()
    return None if r["lo"] is None else (int(r["lo"]), int(r["hi"]))


def clip_intervals(intervals: DataFrame, bounds: tuple[int, int]) -> DataFrame:
    """The non-empty intervals that meet the bounds, cut to them."""
    lo, hi = (F.lit(x).cast("bigint") for x in bounds)
    return (intervals.filter((F.col("lo") <= F.col("hi")) & (F.col("hi") >= lo) & (F.col("lo") <= hi))
            .select(F.greatest(F.col("lo"), lo).alias("lo"), F.least(F.col("hi"), hi).alias("hi")))


def mean_length(intervals: DataFrame) -> int:
    """Mean length of clipped intervals, 1 at least (summed in DOUBLE: lengths may not fit a BIGINT sum)."""
    r = intervals.agg(F.avg(F.col("hi").cast("double") - F.col("lo").cast("double") + 1).alias("m")).first()
    return max(1, int(r["m"])) if r["m"] is not None else 1


RANGES = 64  # coarse ranges that filter a scan


def coarse_ranges(intervals: DataFrame, bounds: tuple[int, int], most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` disjoint ranges, in order, that cover the clipped intervals: the data's range is cut into ``most`` equal
    cells, and each range runs from the first to the last covered time of neighbouring cells. One row per cell reaches the driver."""
    base, width = bounds[0], -(-(bounds[1] - bounds[0] + 1) // most)
    cell = lambda c: F.floor((F.col(c) - F.lit(base).cast("bigint")) / F.lit(width).cast("bigint"))
    first = F.lit(base).cast("bigint") + F.col("_cell") * width
    cells = (intervals.select("lo", "hi", F.explode(F.sequence(cell("lo"), cell("hi"))).alias("_cell")).groupBy("_cell")
             .agg(F.min(F.greatest("lo", first)).alias("lo"), F.max(F.least("hi", first + (width - 1))).alias("hi")))
    out: list[tuple[int, int]] = []
    for r in sorted(cells.select("lo", "hi").collect()):
        if out and r["lo"] <= out[-1][1] + 1:
            out[-1] = (out[-1][0], r["hi"])
        else:
            out.append((r["lo"], r["hi"]))
    return out


def in_ranges(time: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a time lies in one of the ranges, as comparisons that a scan can use."""
    cond = F.lit(False)
    for k, (lo, hi) in enumerate(ranges):
        one = (time >= F.lit(lo).cast("bigint")) & (time <= F.lit(hi).cast("bigint"))
        cond = one if k == 0 else cond | one
    return cond


def merged_bins(intervals: DataFrame, bin_width: int) -> DataFrame:
    """Rows (_bin, _lo, _hi): the clipped intervals cut at bin edges and merged inside each bin.

    Pieces that begin alike are reduced to the longest first (a partial aggregate), so a bin never holds more
    than ``bin_width`` of them, however many intervals there are."""
    w = F.lit(bin_width).cast("bigint")
    cut = intervals.select("lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / w), F.floor(F.col("hi") / w))).alias("_bin"))
    first = F.col("_bin") * w
    pieces = (cut.select("_bin", F.greatest("lo", first).alias("_lo"), F.least("hi", first + (w - 1)).alias("_hi"))
              .groupBy("_bin", "_lo").agg(F.max("_hi").alias("_hi")))
    order = Window.partitionBy("_bin").orderBy("_lo")
    reach = F.max("_hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("_new", F.when(reach.isNull() | (F.col("_lo") - 1 > reach), 1).otherwise(0))
    runs = marked.withColumn("_run", F.sum("_new").over(order))
    return runs.groupBy("_bin", "_run").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).drop("_run")


def within_intervals(df: DataFrame, intervals: DataFrame, time: str = "time", bin_width: int | None = None,
                     bounds: tuple[int, int] | None = None, ranges: int = RANGES) -> DataFrame:
    """Rows of ``df`` inside any interval. ``ranges``: coarse ranges that filter the scan (0: none). ``bounds`` (default: from the rows, one small aggregate) is the time
    range of the data; ``bin_width`` defaults to the mean length of the clipped intervals. NULL times are in no interval."""
    bounds = bounds or time_range(df, time)
    if bounds is None:
        return df.filter(F.lit(False))
    clipped = clip_intervals(intervals, bounds)
    if ranges and (covered := coarse_ranges(clipped, bounds, ranges)):
        df = df.where(in_ranges(F.col(time), covered))
    width = bin_width or mean_length(clipped)
    bins = merged_bins(clipped, width)
    keyed = df.withColumn("_bin", F.floor(F.col(time) / F.lit(width)))
    cond = (keyed["_bin"] == bins["_bin"]) & (F.col(time) >= F.col("_lo")) & (F.col(time) <= F.col("_hi"))
    return keyed.join(bins, cond, "left_semi").drop("_bin")
