"""Phase binning and the phase-locked mean of z-scored power."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.config import DEFAULT
from spindle.functions.columns import phase_bucket


def phase_buckets(phase: DataFrame, lo: int = DEFAULT.phase_min, hi: int = DEFAULT.phase_max,
                  n: int = DEFAULT.phase_buckets) -> DataFrame:
    """(time, phaserange) from (time, phase)."""
    return phase.select("time", phase_bucket("phase", lo, hi, n).alias("phaserange"))


def phase_profile(z: DataFrame, buckets: DataFrame, value: str = "convolution") -> DataFrame:
    """``CAST(AVG(z) AS FLOAT)`` per (rat, dt, channel, frequency, phaserange).

    Inner join on time: a time with several phase rows counts once per row.
    """
    return (z.join(buckets, "time")
            .groupBy("rat", "dt", "channel", "frequency", "phaserange")
            .agg(F.avg(value).cast("float").alias(value)))


def select_result(profile: DataFrame, rat: str = DEFAULT.result_rat, dt: str = DEFAULT.result_dt) -> DataFrame:
    """Rows of one rat and session as (frequency, phaserange, convolution)."""
    return (profile.filter((F.col("rat") == rat) & (F.col("dt") == dt))
            .select("frequency", "phaserange", "convolution"))
