"""Structured Streaming ingest: recording files arriving in a folder become
rows of the power table.

A series may arrive over many batches, in time order. Between batches the last samples of each series (as many
as a filter window reaches back) and their index are kept as a small Parquet table beside the power table, so the
outputs at the seam are made and the index goes on. Each batch writes folders of its own
(``rat=/dt=/channel=/batch=``, and ``batch=`` of the state): a batch replayed
after a failure reads the state from before it and replaces just what it wrote. Samples older than what their
series already has stop the query with an error.

With ``store`` the batches go to a :class:`~spindle.store.PowerStore`, the same table that the job adds to: one version a batch, with the
series' last samples in it, so no batch reads what earlier ones left and a replayed batch adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from spindle.config import DEFAULT, SERIES_KEYS
from spindle.operators.convolution import band_power_blocks
from spindle.session import materialize
from spindle.sources.kernels import kernel_width
from spindle.sources.recordings import filename_keys, index_recordings, parse_signal, path_keys
from spindle.store import PowerStore, Snapshot

KEYS = list(SERIES_KEYS)


def recording_lines(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(source_dir).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_block"))


def parse_batch(lines: DataFrame, strict: bool = True, keys_from: str = "name", integer_samples: bool = False) -> DataFrame:
    """Samples (keys, time, v, file_path, _block, _pos) of one batch of recording lines.

    Series keys come from the file name (``R192-2009-11-19-CSC10a.csv``) or,
    with ``keys_from="path"``, from ``rat=/dt=/channel=`` directories.
    ``integer_samples`` treats the voltages as integer counts (exact sums).
    """
    with_pos = lines.withColumn("_pos", F.monotonically_increasing_id())
    keys = filename_keys("file_name") if keys_from == "name" else path_keys("file_path")
    v = F.col("voltage").cast("bigint" if integer_samples else "double")
    return parse_signal(with_pos, strict=strict).select(*keys, "time", v.alias("v"), "file_path", "_block", "_pos")


def state_schema(integer_samples: bool) -> T.StructType:
    return T.StructType([T.StructField(k, T.StringType()) for k in KEYS] + [
        T.StructField("time", T.LongType()), T.StructField("i", T.LongType()),
        T.StructField("v", T.LongType() if integer_samples else T.DoubleType()), T.StructField("batch", T.LongType())])


def sample_schema(integer_samples: bool) -> T.StructType:
    return T.StructType([f for f in state_schema(integer_samples).fields if f.name != "batch"])


def last_state(spark: SparkSession, path: str, before: int, integer_samples: bool) -> DataFrame:
    """The samples kept for each series by the latest batch before ``before`` that had it."""
    rows = spark.read.schema(state_schema(integer_samples)).parquet(path).where(F.col("batch") < before)
    latest = rows.groupBy(*KEYS).agg(F.max("batch").alias("batch"))
    return rows.join(latest, [*KEYS, "batch"]).select(*KEYS, "time", "i", "v")


def continue_series(rec: DataFrame, old: DataFrame, bin_width: int | None) -> DataFrame:
    """Old samples (``emit`` false) and the batch's, indexed on from them: (keys, time, i, v, emit)."""
    start = old.groupBy(*KEYS).agg((F.max("i") + 1).alias("_next"))
    new = index_recordings(rec, bin_width).join(start, KEYS, "left").select(
        *KEYS, "time", (F.col("i") + F.coalesce("_next", F.lit(0))).alias("i"), "v", F.lit(True).alias("emit"))
    seen = rec.select(*KEYS).distinct()
    return old.join(seen, KEYS, "left_semi").withColumn("emit", F.lit(False)).unionByName(new)


def add_recordings(store: PowerStore, rec: DataFrame, bank: DataFrame, how: str, integer_samples: bool, bin_width: int | None = None,
                   token: tuple[str, int] | None = None) -> int:
    """Filter samples (keys, time, v, file_path, _block, _pos) and add their power to the store, whose state keeps the last samples of
    each series: ``"extend"`` goes on where a series stands (late samples raise), ``"replace"`` begins it anew."""
    snap = store.snapshot()
    if how == "extend":
        # the state is small - a filter window for each series - but is read by several jobs
        old = materialize(snap.state(sample_schema(integer_samples)), "store-state")
        _refuse_late(rec, old)
        sig = continue_series(rec, old, bin_width)
    else:
        sig = index_recordings(rec, bin_width).select(*KEYS, "time", "i", "v", F.lit(True).alias("emit"))
    sig = materialize(sig, "store-signal")
    keep = last_samples(sig, max(1, kernel_width(bank) - 1))
    seen = sig.select(*KEYS).distinct()

    def state(before: Snapshot) -> DataFrame:
        return before.state(sample_schema(integer_samples)).join(seen, KEYS, "left_anti").unionByName(keep)

    return store.add(band_power_blocks(sig, bank, KEYS, emit="emit"), how, token, state, based_on=snap)


def _refuse_late(rec: DataFrame, old: DataFrame) -> None:
    late = (rec.groupBy(*KEYS).agg(F.min("time").alias("first"))
            .join(old.groupBy(*KEYS).agg(F.max("time").alias("last")), KEYS).where("first < last").first())
    if late is not None:
        raise ValueError(f"series {tuple(late[k] for k in KEYS)}: time {late['first']} arrived after {late['last']}")


def last_samples(sig: DataFrame, reach: int) -> DataFrame:
    """The samples of each series that a filter window reaches back to."""
    end = sig.groupBy(*KEYS).agg(F.max("i").alias("_end"))
    return sig.join(end, KEYS).where(F.col("i") > F.col("_end") - reach).select(*KEYS, "time", "i", "v")


def ingest_recordings(spark: SparkSession, source_dir: str, power_path: str, bank: DataFrame,
                      bin_width: int | None = None, checkpoint: str | None = None, available_now: bool = True,
                      max_files_per_trigger: int | None = None,
                      records_per_file: int = DEFAULT.records_per_file, keys_from: str = "name",
                      integer_samples: bool = False, strict: bool = True, store: bool = False) -> StreamingQuery:
    """Start the ingest; ``available_now`` processes what is there and stops. The checkpoint defaults to a fixed
    folder beside the power table, so a restart goes on where the last run stopped. ``store``: ``power_path`` is a
    :class:`~spindle.store.PowerStore`."""
    power_path = power_path.rstrip("/")
    state_path = f"{power_path}_state"
    checkpoint = checkpoint or f"{power_path}_checkpoint"
    bank = materialize(bank, "ingest-bank")  # small; read by every batch
    if store:
        table = PowerStore(spark, power_path, records_per_file=records_per_file)

        def add_batch(batch: DataFrame, epoch_id: int) -> None:
            token = (checkpoint, epoch_id)
            if table.snapshot().has(token):
                return
            rec = materialize(parse_batch(batch, strict, keys_from, integer_samples), "ingest-samples")
            if not rec.isEmpty():
                add_recordings(table, rec, bank, "extend", integer_samples, bin_width, token)

        return _start(recording_lines(spark, source_dir, max_files_per_trigger), add_batch, checkpoint, available_now)
    reach = max(1, kernel_width(bank) - 1)
    spark.createDataFrame([], state_schema(integer_samples)).write.mode("append").partitionBy("batch").parquet(state_path)

    def replace(df: DataFrame, path: str, *folders: str) -> None:
        (df.write.option("maxRecordsPerFile", records_per_file).partitionBy(*folders)
         .mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path))

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        # staged as Parquet in the shared folder: the index reads it twice, the text is parsed once
        rec = materialize(parse_batch(batch, strict, keys_from, integer_samples), "ingest-samples")
        if rec.isEmpty():
            return
        old = last_state(spark, state_path, epoch_id, integer_samples)
        _refuse_late(rec, old)
        sig = materialize(continue_series(rec, old, bin_width), "ingest-signal")
        power = band_power_blocks(sig, bank, KEYS, emit="emit")
        replace(power.withColumn("batch", F.lit(epoch_id).cast("bigint")), power_path, *KEYS, "batch")
        keep = last_samples(sig, reach)
        replace(keep.withColumn("batch", F.lit(epoch_id).cast("bigint")), state_path, "batch")

    return _start(recording_lines(spark, source_dir, max_files_per_trigger), write_batch, checkpoint, available_now)


def _start(lines: DataFrame, write_batch, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = lines.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
