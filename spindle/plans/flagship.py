"""The whole analysis: recordings -> power -> phase-locked z-scored power.

    power      band power per (rat, dt, channel, time, frequency)
    reference  common-average reference per (time, frequency)
    z          z-score per (rat, dt, channel, frequency)
    passes     keep times inside any pass interval
    profile    mean z per (rat, dt, channel, frequency, phase bucket)
    result     one rat and session: (frequency, phaserange, convolution)

One lazy plan, one action by the caller; no collect on the data path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from spindle.operators.convolution import band_power_blocks
from spindle.operators.intervals import clip_intervals, coarse_ranges, in_ranges, time_range, within_intervals
from spindle.operators.phase import phase_buckets, phase_profile, select_result
from spindle.operators.reference import average_reference, average_reference_join
from spindle.operators.stats import zscore
from spindle.session import materialize, scratch_path
from spindle.sinks import write_power
from spindle.sources.tables import read_power
from spindle.store import Snapshot


def power_table(signal: DataFrame, bank: DataFrame, keys: Sequence[str] = ("rat", "dt", "channel"),
                path: str | None = None, observation: Observation | None = None, mode: str = "errorifexists",
                **block_args) -> DataFrame:
    """Band power written once as the partitioned power table and read back.

    The statistics read power several times (means and channel keys, stats
    and z rows); reading Parquet is cheaper than re-running the transforms,
    and the written table survives executor loss. ``path`` defaults to a new
    folder under the session's checkpoint directory. With ``observation``
    the number of rows written is collected during the write (no extra pass). ``mode="add"`` adds the
    series to an existing table or replaces them there; the whole table is read back.
    """
    spark = signal.sparkSession
    out = path or scratch_path(spark, "power")
    power = band_power_blocks(signal, bank, list(keys), **block_args)
    if observation is not None:
        power = power.observe(observation, F.count(F.lit(1)).alias("power_rows"))
    write_power(power, out, mode=mode)
    return read_power(spark, out)


def _profile(rows: DataFrame, passes: DataFrame, phase: DataFrame, bin_width: int | None) -> DataFrame:
    """Profile of average-referenced rows. They are written once: the statistics per group and the rows these are
    joined to both read them."""
    ref = materialize(rows, "referenced", sort=["time"])
    bounds = time_range(ref)
    z = zscore(ref)
    kept = within_intervals(z, passes, bin_width=bin_width, bounds=bounds) if bounds else z.where("false")
    return phase_profile(kept, phase_buckets(phase))


def profile(power: DataFrame, passes: DataFrame, phase: DataFrame, reference: str = "aggregate",
            bin_width: int | None = None) -> DataFrame:
    rows = average_reference_join(power) if reference == "join" else average_reference(power)
    return _profile(rows, passes, phase, bin_width)


def result(power: DataFrame, passes: DataFrame, phase: DataFrame, rat: str, dt: str,
           reference: str = "join", bin_width: int | None = None) -> DataFrame:
    """One rat and session. The means read every rat and session, but only the rows of this one are
    referenced and kept: the join form lets the filter prune the channel-key side to its partition folders."""
    if reference == "join":
        rows = average_reference_join(power, only=(F.col("rat") == rat) & (F.col("dt") == dt))
        return select_result(_profile(rows, passes, phase, bin_width), rat, dt)
    return select_result(profile(power, passes, phase, reference, bin_width), rat, dt)


def result_from_store(snapshot: Snapshot, passes: DataFrame, phase: DataFrame, rat: str, dt: str, bin_width: int | None = None) -> DataFrame:
    """One rat and session from a store's kept-up reference and statistics: of the power only the rows of this session inside the passes
    are read, of the sums only those times."""
    only = (F.col("rat") == rat) & (F.col("dt") == dt)
    bounds = snapshot.bounds()
    if bounds is None:
        rows = snapshot.referenced(only)
    else:
        rows = snapshot.referenced(only, in_ranges(F.col("time"), coarse_ranges(clip_intervals(passes, bounds), bounds)))
    z = zscore(rows, stats=snapshot.group_stats().where(only))
    kept = within_intervals(z, passes, bin_width=bin_width, bounds=bounds, ranges=0) if bounds else z
    return select_result(phase_profile(kept, phase_buckets(phase)), rat, dt)
