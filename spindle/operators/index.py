"""Position operators over long series without putting a series in one task.

Both operators split a series into coarse bins (a column that never decreases
along the series order, e.g. ``floor(time / width)``). Work inside a bin is a
window over (series, bin); only one row per bin crosses bins, through a small
per-bin table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.session import materialize


def _cols(xs: Sequence[Column | str]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def count_bins(df: DataFrame, series: Sequence[str], position: Column, target: int = 10_000) -> Column:
    """A bin column for ``dense_index`` from counts: ``floor(position / width)`` with the width at which the densest
    series has about ``target`` rows a bin. One small aggregate (a row per series) is read on the way."""
    per = df.select(*series, position.cast("bigint").alias("_p")).groupBy(*series).agg(
        F.min("_p").alias("lo"), F.max("_p").alias("hi"), F.count("_p").alias("n"))
    width = per.agg(F.min((F.col("hi").cast("double") - F.col("lo") + 1) * target / F.col("n"))).first()[0]
    return F.floor(position / F.lit(max(1, int(width or 1))))


def dense_index(df: DataFrame, series: Sequence[str], order: Sequence[Column | str],
                bin_col: Column, index_col: str = "i") -> DataFrame:
    """Add ``index_col`` = 0-based position of the row inside its series.

    ``order`` must be a total order inside a series (add a tie-break column),
    and ``bin_col`` must not decrease along it. The index is
    ``rows in earlier bins + row_number inside the bin - 1``.

    The bin width trades the two windows: each (series, bin) is sorted by one
    task, and the per-bin count table (n / bin rows per series) is summed by
    one task per series. Bins of ~1e3-1e4 expected rows keep both small even
    for 1e9-sample series and split clustered timestamps; only many rows with
    (nearly) the same time can make one bin large. Counts are exact, so a
    re-run task rebuilds the same bins (no sampled boundaries).
    """
    series = list(series)
    binned = df.withColumn("_bin", bin_col)
    local = binned.withColumn(
        "_r", F.row_number().over(Window.partitionBy(*series, "_bin").orderBy(*_cols(order))) - 1)
    counts = binned.groupBy(*series, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*series).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*series, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # the rows lie by (series, bin) already, so the merge moves and sorts only the counts, and the driver gets none of them
    return (local.join(offsets.hint("merge"), [*series, "_bin"])
            .withColumn(index_col, (F.col("_off") + F.col("_r")).cast("bigint"))
            .drop("_bin", "_r", "_off"))


def split_index(df: DataFrame, series: Sequence[str], order: Sequence[str], index_col: str = "i", partitions: int | None = None) -> DataFrame:
    """``dense_index`` over ranges of the whole order: rows with equal times, in any number, are spread like others.

    The rows are dealt to ``partitions`` (default: the shuffle partitions) ranges of (series, order), sorted there and written once
    with their place. A series' rows of one range lie side by side, so the index is the place in the range plus the
    exact counts of the series' earlier ranges, a table of at most one row per range and series in it. ``order`` names columns that are a
    total order inside a series. NULLs come first, a NULL series is a series.
    """
    series, order = list(series), list(order)
    p = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(p, *series, *order).sortWithinPartitions(*series, *order)
    placed = materialize(ranges.withColumn("_place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_place", 33).alias("_part")  # the id holds the partition above its lower 33 bits
    heads = placed.groupBy(*series, part).agg(F.min("_place").alias("_head"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*series).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*[F.col(s).alias(f"_s{k}") for k, s in enumerate(series)], F.col("_part").alias("_p"), "_head",
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    same = F.col("_part") == F.col("_p")
    for k, s in enumerate(series):
        same = same & F.col(s).eqNullSafe(F.col(f"_s{k}"))
    return (placed.withColumn("_part", part).join(heads, same)
            .withColumn(index_col, (F.col("_off") + F.col("_place") - F.col("_head")).cast("bigint")).select(*df.columns, index_col))


def order_violations(df: DataFrame, series: Sequence[str], position: Sequence[Column | str],
                     time: str, bin_col: Column) -> DataFrame:
    """Rows whose ``time`` is smaller than the previous row's ``time`` in
    ``position`` order (equal times are allowed).

    Returns the series keys, the position columns, ``prev_time`` and ``time``.
    """
    series = list(series)
    pos = _cols(position)
    pos_names = [p for p in position if isinstance(p, str)]
    binned = df.select(*series, *pos, time, bin_col.alias("_bin"))
    inner = binned.withColumn(
        "prev_time", F.lag(time).over(Window.partitionBy(*series, "_bin").orderBy(*pos)))
    # Per bin: first and last time in position order; the last of the previous
    # bin is the predecessor of each bin's first row.
    key = F.struct(*pos)
    ends = binned.groupBy(*series, "_bin").agg(F.max_by(time, key).alias("_last"))
    ends = ends.withColumn(
        "_prev_last", F.lag("_last").over(Window.partitionBy(*series).orderBy("_bin")))
    firsts = (inner.filter(F.col("prev_time").isNull()).drop("prev_time")
              .join(ends.select(*series, "_bin", F.col("_prev_last").alias("prev_time")), [*series, "_bin"]))
    rows = inner.filter(F.col("prev_time").isNotNull()).unionByName(firsts)
    out = rows.filter(F.col(time) < F.col("prev_time"))
    return out.select(*series, *pos_names, "prev_time", time)
