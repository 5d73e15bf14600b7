"""The whole recording job as one call (and a command line).

    recordings (CSV files, keys in the file names)  --+
    kernel bank (text, one line per frequency)        +-> power table (Parquet, rat=/dt=/channel=)
                                                           |
    passes (lo,hi text) + phase (time,phase text) ---------+-> result text: [frequency,phaserange,convolution]

python -m spindle.plans.job --recordings DIR --bank FILE --passes FILE --phase FILE \\
    --power-table DIR --result DIR --rat R192 --dt 2009-11-19 [--mode add]

``--mode add`` adds the recordings to an existing power table (a series it already has is replaced, so adding
twice changes nothing); without ``--recordings`` only the statistics over the existing table are made.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.config import DEFAULT, SERIES_KEYS, JobConfig
from spindle.plans import flagship
from spindle.session import materialize
from spindle.sinks import write_text_result
from spindle.sources import index_recordings, read_kernel_bank, read_passes, read_phase, read_power, read_recordings
from spindle.sources.recordings import unsorted_samples
from spindle.store import PowerStore
from spindle.streaming.ingest import add_recordings


def load_recordings(spark: SparkSession, recordings: str, bank: str, power_table: str, bin_width: int | None = None,
                    config: JobConfig = DEFAULT, integer_samples: bool = False, mode: str = "errorifexists",
                    on_disorder: str = "fail") -> DataFrame:
    """Filter the recordings and write their power; returns the whole power table.

    ``on_disorder``: what to do with a file whose timestamps go back: ``"fail"`` raises and names it,
    ``"sort"`` indexes by time. ``bin_width`` is the time width of the index bins (default: from counts).
    """
    kernels = read_kernel_bank(spark, bank, config.first_frequency, config.last_frequency, config.kernel_width)
    # Parsed samples are staged as Parquet in the shared folder: the check and the index
    # read them (numbering and bin counts), and text is parsed once.
    rec = materialize(read_recordings(spark, recordings), "samples")
    if on_disorder not in ("fail", "sort"):
        raise ValueError(f"on_disorder: {on_disorder}")
    if on_disorder == "fail":
        bad = unsorted_samples(rec).first()
        if bad is not None:
            raise ValueError(f"{bad['file_path']}: time {bad['time']} follows {bad['prev_time']}")
    rec = rec.withColumn("v", F.col("voltage").cast("bigint" if integer_samples else "double"))
    signal = index_recordings(rec, bin_width, SERIES_KEYS)
    return flagship.power_table(signal, kernels, SERIES_KEYS, path=power_table, mode=mode)


def load_into_store(spark: SparkSession, recordings: str | list[str], kernels: DataFrame, store: PowerStore, how: str = "replace",
                    integer_samples: bool = False, bin_width: int | None = None) -> int:
    """Filter the recordings and add their power to a store, as one version: series that it has are replaced, or with
    ``how="extend"`` continued by these later parts. Returns the version."""
    rec = materialize(read_recordings(spark, recordings), "samples")
    bad = unsorted_samples(rec).first()
    if bad is not None:
        raise ValueError(f"{bad['file_path']}: time {bad['time']} follows {bad['prev_time']}")
    rec = rec.withColumn("v", F.col("voltage").cast("bigint" if integer_samples else "double"))
    return add_recordings(store, rec, materialize(kernels, "kernels"), how, integer_samples, bin_width)


def run_statistics(spark: SparkSession, power_table: str, passes: str, phase: str, rat: str, dt: str,
                   result: str | None = None) -> DataFrame:
    """The statistics over an existing power table, of all the recordings it has accumulated; the result text is
    written only when ``result`` is given."""
    out = flagship.result(read_power(spark, power_table), read_passes(spark, passes), read_phase(spark, phase), rat, dt)
    if result:
        write_text_result(out, result)
    return out


def run_job(spark: SparkSession, recordings: str, bank: str, passes: str, phase: str, power_table: str,
            result: str | None = None, rat: str | None = None, dt: str | None = None,
            bin_width: int | None = None, config: JobConfig = DEFAULT, integer_samples: bool = False,
            mode: str = "errorifexists", on_disorder: str = "fail") -> DataFrame:
    """Load the recordings, then the statistics; returns the result rows (frequency, phaserange, convolution)."""
    load_recordings(spark, recordings, bank, power_table, bin_width, config, integer_samples, mode, on_disorder)
    return run_statistics(spark, power_table, passes, phase, rat or config.result_rat, dt or config.result_dt, result)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description="Phase-locked z-scored band power of recordings.")
    for a in ("passes", "phase", "power-table", "result", "rat", "dt"):
        ap.add_argument(f"--{a}", required=True)
    ap.add_argument("--recordings")
    ap.add_argument("--bank")
    ap.add_argument("--mode", choices=["errorifexists", "add"], default="errorifexists")
    ap.add_argument("--on-disorder", choices=["fail", "sort"], default="fail")
    ap.add_argument("--bin-width", type=int)
    args = ap.parse_args(argv)
    if bool(args.recordings) != bool(args.bank):
        ap.error("--recordings and --bank go together")
    spark = SparkSession.builder.appName("spindle-job").getOrCreate()
    if args.recordings:
        load_recordings(spark, args.recordings, args.bank, args.power_table, args.bin_width, mode=args.mode,
                        on_disorder=args.on_disorder)
    run_statistics(spark, args.power_table, args.passes, args.phase, args.rat, args.dt, args.result)


if __name__ == "__main__":
    main()
