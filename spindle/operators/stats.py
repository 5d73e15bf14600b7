"""Per-group mean / population standard deviation and z-scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.functions.columns import safe_zscore

GROUP = ("rat", "dt", "channel", "frequency")


def group_stats(df: DataFrame, keys: Sequence[str] = GROUP, value: str = "convolution") -> DataFrame:
    """``mean``, ``sd`` (population) per group, both cast to FLOAT."""
    return df.groupBy(*keys).agg(F.avg(value).cast("float").alias("mean"),
                                 F.stddev_pop(value).cast("float").alias("sd"))


def zscore(df: DataFrame, keys: Sequence[str] = GROUP, value: str = "convolution",
           stats: DataFrame | None = None) -> DataFrame:
    """Replace ``value`` by ``CAST((value - mean) / sd AS FLOAT)`` of its group.

    The stats are a partial aggregate (one row per group) joined back on the
    group keys; AQE broadcasts them when the measured size is small. ``sd = 0``
    gives NULL.
    """
    st = group_stats(df, keys, value) if stats is None else stats
    cols = [c for c in df.columns if c != value]
    return (df.join(st, list(keys))
            .select(*cols, safe_zscore(value, "mean", "sd").alias(value)))
