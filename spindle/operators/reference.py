"""Common-average reference across channels.

Every (time, frequency) gets the mean power over *all* rows of the table with
that (time, frequency) - every rat, session and channel - and each channel
row keeps only that mean: ``DISTINCT (rat, frequency, channel, dt, mean, time)``.
``within`` adds grouping keys (e.g. rat and dt for a per-session reference).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUT = ("rat", "frequency", "channel", "dt", "convolution", "time")


def average_by_time_frequency(power: DataFrame, within: Sequence[str] = (), value: str = "convolution") -> DataFrame:
    grp = ["time", "frequency", *within]
    return power.groupBy(*grp).agg(F.avg(value).alias(value))


def average_reference(power: DataFrame, within: Sequence[str] = (), value: str = "convolution") -> DataFrame:
    """Pre-aggregate, then a window mean; reads ``power`` once.

    Power is reduced to one row per (rat, dt, channel, time, frequency)
    holding (sum, count) - a partial, map-side aggregate - and the mean per
    (time, frequency) is a window over those rows. A window group holds one
    row per series recorded at that time, so its size is bounded by the
    number of simultaneous channels, not by the series length. The rows are dealt to the window by ranges of time,
    so those written from it are in time order and a filter on time skips most of them.
    """
    grp = ["time", "frequency", *within]
    per_key = power.groupBy("rat", "dt", "channel", "time", "frequency").agg(
        F.sum(value).alias("_s"), F.count(value).alias("_c")).repartitionByRange("time")
    w = Window.partitionBy(*grp)
    mean = F.try_divide(F.sum("_s").over(w), F.sum("_c").over(w))
    return per_key.select("rat", "frequency", "channel", "dt", mean.alias(value), "time")


def average_reference_join(power: DataFrame, within: Sequence[str] = (), value: str = "convolution",
                           only: Column | None = None) -> DataFrame:
    """Aggregate-then-join plan: means per (time, frequency) joined back to
    the distinct channel rows. Both sides are partial aggregates; a skewed
    key is split by AQE's skew join. Reads ``power`` twice. ``only`` restricts the channel rows (not the means)."""
    grp = ["time", "frequency", *within]
    rows = power if only is None else power.where(only)
    keys = rows.select("rat", "dt", "channel", "time", "frequency").distinct()
    means = power.groupBy(*grp).agg(F.avg(value).alias(value))
    return keys.join(means, grp).select(*OUT)


def average_reference_window(power: DataFrame, within: Sequence[str] = (), value: str = "convolution") -> DataFrame:
    """The window plan under its own name: as ``average_reference``, which reduces the rows before the window."""
    return average_reference(power, within, value)
