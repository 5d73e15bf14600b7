"""Registered queries: name -> (spark, sf_dir) -> DataFrame, with DuckDB twins.

Every query reads whole driver tables (through ``fixtures``). Floating
results that two engines may sum in different orders are compared after a
FLOAT cast (power averages) or rounding (transforms).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spindle.operators import (
    average_by_time_frequency,
    average_reference,
    average_reference_join,
    average_reference_window,
    band_power_blocks,
    band_power_partitioned,
    band_power_relational,
    count_bins,
    dense_index,
    fir_blocks,
    fir_partitioned,
    fir_relational,
    group_stats,
    order_violations,
    phase_buckets,
    split_index,
    within_intervals,
    zscore,
)
from spindle.config import JobConfig
from spindle.operators import spectral as X
from spindle.operators.intervals import time_range
from spindle.plans import fixtures as fx
from spindle.plans import flagship
from spindle.plans.job import load_into_store, load_recordings, run_job, run_statistics
from spindle.plans.sql_chain import sql_result
from spindle.plans.oracle import SERIES64, USER_SEGMENTS, dft_sql, with_ctes
from spindle.session import materialize, scratch_path
from spindle.sinks import result_lines, write_csv, write_power
from spindle.sources import (
    bank_frequencies,
    index_recordings,
    kernel_width,
    parse_records,
    parse_signal,
    read_kernel_bank,
    read_passes,
    read_phase,
    read_power,
    read_recordings,
)
from spindle.sources.recordings import filename_keys
from spindle.store import PowerStore
from spindle.streaming import ingest_recordings

Query = Callable[[SparkSession, str], DataFrame]


def _power(spark: SparkSession, sf: str) -> DataFrame:
    return band_power_blocks(fx.signal(spark, sf), fx.bank(spark, sf), fx.SERIES)


def _stored_power(spark: SparkSession, sf: str) -> DataFrame:
    """Power written to the power table and read back: the statistics read
    it more than once, and Parquet is cheaper than re-running transforms."""
    return flagship.power_table(fx.signal(spark, sf), fx.bank(spark, sf), fx.SERIES)


def _f(c: str) -> Column:
    return F.col(c).cast("float").alias(c)


def _r(c: str, digits: int = 4) -> Column:
    return (F.round(F.col(c), digits) + F.lit(0.0)).alias(c)


# --- sources ----------------------------------------------------------------

def kernel_bank_long(spark, sf):
    return fx.bank(spark, sf)


def kernel_bank_text(spark, sf):
    """Bank written as a text file (one line of taps per frequency) and parsed back."""
    bank = fx.bank(spark, sf)
    lines = (bank.groupBy("frequency")
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("u", "h"))),
                                           lambda s: s["h"].cast("string")), ",").alias("value"))
             .orderBy("frequency"))
    path = scratch_path(spark, "bank")
    lines.repartition(1).sortWithinPartitions("frequency").select("value").write.text(path)
    shape = bank.agg(F.min("frequency").alias("f0"), F.max("frequency").alias("f1"), F.max("u").alias("u")).first()
    return read_kernel_bank(spark, path, first_frequency=shape["f0"], last_frequency=shape["f1"],
                            width=shape["u"] + 1)


def _signal_lines(spark, sf):
    ev = fx.table(spark, sf, "events")
    suffix = (F.when(F.col("event_type") == "click", F.lit(","))
              .when(F.col("event_type") == "signup", F.lit(",,"))
              .when(F.col("event_type") == "error", F.lit(",7"))
              .otherwise(F.lit("")))
    return ev.select(F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(" , "),
                              F.round(F.col("value") * 100).cast("bigint").cast("string"), suffix).alias("line"))


def signal_parse_csv(spark, sf):
    return parse_signal(_signal_lines(spark, sf)).select("time", "voltage")


def signal_parse_records(spark, sf):
    """Typed records (SMALLINT voltage) with NULL records for wrong arity."""
    ev = fx.table(spark, sf, "events")
    suffix = (F.when(F.col("event_type") == "click", F.lit(",")).when(F.col("event_type") == "error", F.lit(",1,2"))
              .otherwise(F.lit("")))
    lines = ev.select(F.concat(F.col("event_id").cast("string"), F.lit(", "),
                               F.round("value").cast("bigint").cast("string"), suffix).alias("line"))
    return parse_records(lines)


def filename_keys_query(spark, sf):
    ev = fx.table(spark, sf, "events")
    name = F.concat(F.lit("R"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd"),
                    F.lit("-CSC"), F.col("event_type"), F.lit(".csv"))
    return ev.select("event_id", *filename_keys(name))


def sortedness_violations(spark, sf):
    """Events read in reverse id order: rows whose hour is below the previous row's."""
    ev = fx.table(spark, sf, "events").select(
        "user_id", (-F.col("event_id")).alias("pos"), fx.hours_since("ts").alias("time"))
    return order_violations(ev, ["user_id"], ["pos"], "time", F.floor(F.col("pos") / 1024))


# --- series -----------------------------------------------------------------

def dense_index_query(spark, sf):
    return fx.signal(spark, sf).select(*fx.SERIES, "event_id", "i")


def tied_index(spark, sf):
    """Index over months: thousands of samples of a series share a time and are ordered by their ids."""
    s = fx.samples(spark, sf).select(*fx.SERIES, F.floor(F.col("time") / 720).alias("month"), "event_id")
    return split_index(s, fx.SERIES, ["month", "event_id"])


def fir_valid(spark, sf):
    return fir_relational(fx.signal(spark, sf), fx.bank(spark, sf), fx.SERIES)


def fir_blocks_query(spark, sf):
    return fir_blocks(fx.signal(spark, sf), fx.bank(spark, sf), fx.SERIES)


def _with_missing(spark, sf):
    """The signal with the samples of the largest values missing."""
    return fx.signal(spark, sf).withColumn("v", F.when(F.col("v") < 25_000, F.col("v")))


def fir_missing(spark, sf):
    return fir_relational(_with_missing(spark, sf), fx.bank(spark, sf), fx.SERIES)


def fir_missing_blocks(spark, sf):
    return fir_blocks(_with_missing(spark, sf), fx.bank(spark, sf), fx.SERIES)


def fir_long(spark, sf):
    """Kernels of 256 taps by transforms of 128 entries: four parts in two tiles, summed in the frequency domain."""
    return fir_partitioned(fx.signal(spark, sf), fx.long_bank(spark, sf), fx.SERIES, entries=128, run=4, tile=2, band=4)


def band_power_long(spark, sf):
    """Band power with kernels in two parts."""
    return band_power_partitioned(fx.signal(spark, sf), fx.bank(spark, sf), fx.SERIES, entries=64, tile=2)


def fir_exact(spark, sf):
    """31-bit samples and 16-bit taps by transforms, in limbs."""
    return fir_blocks(*fx.wide(fx.signal(spark, sf), fx.bank(spark, sf)), fx.SERIES)


def fir_exact_long(spark, sf):
    """The same by partitioned kernels."""
    return fir_partitioned(*fx.wide(fx.signal(spark, sf), fx.long_bank(spark, sf)), fx.SERIES, entries=256)


def band_power(spark, sf):
    return band_power_relational(fx.signal(spark, sf), fx.bank(spark, sf), fx.SERIES)


def band_power_blocks_query(spark, sf):
    return _power(spark, sf)


# --- statistics -------------------------------------------------------------

def avg_by_time_freq(spark, sf):
    return average_by_time_frequency(_stored_power(spark, sf)).select("time", "frequency", _f("convolution"))


_RA = ["rat", "frequency", "channel", "dt", "time"]


def average_reference_query(spark, sf):
    return average_reference(_stored_power(spark, sf)).select(*_RA, _f("convolution"))


def average_reference_window_query(spark, sf):
    return average_reference_window(_stored_power(spark, sf)).select(*_RA, _f("convolution"))


def average_reference_join_query(spark, sf):
    return average_reference_join(_stored_power(spark, sf)).select(*_RA, _f("convolution"))


def average_reference_within(spark, sf):
    return average_reference(_stored_power(spark, sf), within=["rat", "dt"]).select(*_RA, _f("convolution"))


def _referenced(spark, sf):
    """Average-referenced rows, written once: the statistics and the rows they are joined to read them."""
    return materialize(average_reference(_stored_power(spark, sf)), "referenced", sort=["time"])


def group_stats_query(spark, sf):
    return group_stats(average_reference(_stored_power(spark, sf)))


def zscore_query(spark, sf):
    return zscore(_referenced(spark, sf))


def _within(spark, sf, bin_width=None):
    ref = _referenced(spark, sf)
    return within_intervals(zscore(ref), fx.passes(spark, sf), bin_width=bin_width, bounds=time_range(ref))


def within_passes(spark, sf):
    return _within(spark, sf)


def within_passes_binned(spark, sf):
    """Day bins: many passes to a bin, merged there."""
    return _within(spark, sf, 24)


def within_passes_nested(spark, sf):
    """Hour bins: every pass is cut at the bin edges."""
    return _within(spark, sf, 1)


def phase_bucket_query(spark, sf):
    return phase_buckets(fx.phase(spark, sf))


def phase_profile_query(spark, sf):
    return flagship.profile(_stored_power(spark, sf), fx.passes(spark, sf), fx.phase(spark, sf))


def final_result(spark, sf):
    """The whole analysis; power is written to the power table and read back."""
    return flagship.result(_stored_power(spark, sf), fx.passes(spark, sf), fx.phase(spark, sf),
                           fx.RESULT_RAT, fx.RESULT_DT)


def final_result_window(spark, sf):
    """Same, with the aggregate-and-window plan for the reference and day bins for the passes."""
    return flagship.result(_stored_power(spark, sf), fx.passes(spark, sf), fx.phase(spark, sf),
                           fx.RESULT_RAT, fx.RESULT_DT, reference="aggregate", bin_width=24)


def final_result_streamed(spark, sf):
    """Same, with power as a plain staged table instead of the partitioned power table."""
    return flagship.result(materialize(_power(spark, sf), "power-rows"), fx.passes(spark, sf), fx.phase(spark, sf),
                           fx.RESULT_RAT, fx.RESULT_DT)


def final_result_sql(spark, sf):
    """Same result through SQL text over temp views."""
    return sql_result(spark, _stored_power(spark, sf), fx.passes(spark, sf), fx.phase(spark, sf),
                      fx.RESULT_RAT, fx.RESULT_DT)


STREAM_SLICES = 2  # arrivals of each series


def stream_ingest_power(spark, sf):
    """Recordings arriving as text files in rat=/dt=/channel= folders, each series in time slices, ingested by the
    streaming job a few files a batch, read back from the power table it wrote."""
    base = scratch_path(spark, "recordings")
    sig = fx.samples(spark, sf)
    lo, hi = time_range(sig)
    width = (hi - lo) // STREAM_SLICES + 1
    bank = fx.bank(spark, sf)
    for k in range(STREAM_SLICES):
        # Sorting by the partition columns first satisfies the writer's ordering, so no second
        # sort can disturb the time order of the lines.
        (sig.where(F.floor((F.col("time") - lo) / width) == k).repartition(*fx.SERIES)
         .sortWithinPartitions(*fx.SERIES, "ts", "event_id")
         .select(*fx.SERIES, F.concat_ws(",", F.col("time").cast("string"), F.col("v").cast("string")).alias("value"))
         .write.mode("append").partitionBy(*fx.SERIES).text(base + "/in"))
        q = ingest_recordings(spark, base + "/in", base + "/power", bank, keys_from="path", integer_samples=True,
                              max_files_per_trigger=8)
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return read_power(spark, base + "/power").select(*fx.SERIES, "time", "frequency", "convolution")


def _store(spark, sf) -> PowerStore:
    """A store after three adds of whole series: R0's, R1's, and R0's again in place of the first."""
    store = PowerStore(spark, scratch_path(spark, "store"), bin_width=240)
    power = _stored_power(spark, sf)
    for rat in ("R0", "R1", "R0"):
        store.add(power.where(F.col("rat") == rat))
    return store


def store_means(spark, sf):
    """The reference per (time, frequency) from the store's sums."""
    return _store(spark, sf).snapshot().means().select("time", "frequency", _f("convolution"))


def store_group_stats(spark, sf):
    """Mean and standard deviation per series and frequency from the store's moments."""
    return _store(spark, sf).snapshot().group_stats()


def store_result(spark, sf):
    """The whole analysis of one session from the kept-up reference and statistics."""
    return flagship.result_from_store(_store(spark, sf).snapshot(), fx.passes(spark, sf), fx.phase(spark, sf), fx.RESULT_RAT, fx.RESULT_DT)


def store_compacted(spark, sf):
    """The power rows of a store after its adds were put together."""
    store = _store(spark, sf)
    store.compact()
    return store.snapshot().power().select(*fx.SERIES, "time", "frequency", "convolution")


# --- the job from text ------------------------------------------------------

JOB_DT = "2024-01-01"  # session part of the file names, which need year, month and day


def _text_inputs(spark, sf) -> tuple[str, JobConfig]:
    """The driver tables written as the job's text inputs: named recording files (each series over several folders), bank,
    passes and phase. Returns the folder and the bank's shape."""
    base = scratch_path(spark, "job")
    name = F.concat(F.col("rat"), F.lit(f"-{JOB_DT}-CSC"), F.col("channel"), F.lit(".csv"))
    (fx.samples(spark, sf).select(F.floor(F.col("time") / 240).alias("part"), name.alias("name"), "ts", "event_id",
                                  F.concat_ws(",", F.col("time").cast("string"), F.col("v").cast("string")).alias("value"))
     .repartition("part", "name").sortWithinPartitions("part", "name", "ts", "event_id")
     .select("part", "name", "value").write.partitionBy("part", "name").text(base + "/staged"))
    # Spark names its files itself; the recordings are moved to the names the keys are read from
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(conf)
    for f in fs.globStatus(path(base + "/staged/part=*/name=*/part-*")):
        folder = f.getPath().getParent()
        to = path(f"{base}/rec/{folder.getParent().getName()}")
        fs.mkdirs(to)
        if not fs.rename(f.getPath(), path(to, folder.getName()[len("name="):])):
            raise RuntimeError(f"could not move {f.getPath()}")
    bank = fx.bank(spark, sf)
    (bank.groupBy("frequency").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("u", "h"))),
                                                            lambda s: s["h"].cast("string")), ",").alias("value"))
     .repartition(1).sortWithinPartitions("frequency").select("value").write.text(base + "/bank"))
    fx.passes(spark, sf).select(F.concat_ws(",", "lo", "hi", F.lit("pass")).alias("value")).write.text(base + "/passes")
    fx.phase(spark, sf).select(F.concat_ws(", ", "time", "phase").alias("value")).write.text(base + "/phase")
    f = bank_frequencies(bank)
    return base, JobConfig(first_frequency=f[0], last_frequency=f[-1], kernel_width=kernel_width(bank))


def _read_result(spark, path):
    """The result text back as columns; ``null`` is NULL."""
    parts = F.split(F.regexp_extract("value", r"^\[(.*)\]$", 1), ",")
    field = lambda k, kind: F.nullif(parts[k], F.lit("null")).cast(kind)
    return spark.read.text(path).select(field(0, "int").alias("frequency"), field(1, "int").alias("phaserange"),
                                        field(2, "float").alias("convolution"))


def job_from_text(spark, sf):
    """The whole job: text inputs, power table, statistics, result text."""
    base, config = _text_inputs(spark, sf)
    run_job(spark, base + "/rec/*", base + "/bank", base + "/passes", base + "/phase", base + "/power", base + "/result",
            fx.RESULT_RAT, JOB_DT, config=config, integer_samples=True)
    return _read_result(spark, base + "/result")


def job_append(spark, sf):
    """Recordings added to the power table in two calls (one of them twice), then the statistics over all of it."""
    base, config = _text_inputs(spark, sf)
    for files in ("R0-*", "R1-*", "R0-*"):
        load_recordings(spark, f"{base}/rec/*/{files}", base + "/bank", base + "/power", config=config, integer_samples=True, mode="add")
    run_statistics(spark, base + "/power", base + "/passes", base + "/phase", fx.RESULT_RAT, JOB_DT, base + "/result")
    return _read_result(spark, base + "/result")


def store_job_and_stream(spark, sf):
    """One store fed by both: the job adds the first files of each series, a stream goes on with the later ones; then the statistics."""
    base, config = _text_inputs(spark, sf)
    bank = read_kernel_bank(spark, base + "/bank", config.first_frequency, config.last_frequency, config.kernel_width)
    store = PowerStore(spark, base + "/store", bin_width=240)
    names = sorted((n for n, _ in store.files.names(base + "/rec")), key=lambda n: int(n.split("=")[1]))
    first = names[:len(names) // 2]
    load_into_store(spark, [f"{base}/rec/{n}" for n in first], bank, store, integer_samples=True)
    for n in names[len(first):]:  # one folder of arrivals after the other, in time order
        q = ingest_recordings(spark, f"{base}/rec/{n}", store.path, bank, checkpoint=f"{base}/checkpoint-{n}", integer_samples=True, store=True)
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    passes, phase = read_passes(spark, base + "/passes"), read_phase(spark, base + "/phase")
    return flagship.result_from_store(store.snapshot(), passes, phase, fx.RESULT_RAT, JOB_DT)


def passes_phase_text(spark, sf):
    """Passes and phase scanned from text, joined: each pass with the phase at its begin."""
    base, _ = _text_inputs(spark, sf)
    passes, phase = read_passes(spark, base + "/passes"), read_phase(spark, base + "/phase")
    return passes.join(phase, passes.lo == phase.time).select("lo", "hi", "phase")


def recordings_scan(spark, sf):
    """Recording files scanned in batch: samples with the keys of their file names."""
    base, _ = _text_inputs(spark, sf)
    return read_recordings(spark, base + "/rec/*").select("rat", "dt", "channel", "time", "voltage")


def load_counts(spark, sf):
    """Lines read, samples kept and power rows written, counted on the way."""
    base, config = _text_inputs(spark, sf)
    seen, power = Observation("load"), Observation("power")
    rec = materialize(read_recordings(spark, base + "/rec/*", observation=seen), "samples")
    sig = index_recordings(rec.withColumn("v", F.col("voltage").cast("bigint")), None, fx.SERIES)
    bank = read_kernel_bank(spark, base + "/bank", config.first_frequency, config.last_frequency, config.kernel_width)
    flagship.power_table(sig, bank, fx.SERIES, observation=power)
    got = {**seen.get, **power.get}
    return spark.range(1).select(*(F.lit(got[c]).cast("bigint").alias(c) for c in ("lines", "samples", "power_rows")))


def csv_dump(spark, sf):
    """Filtered values dumped as CSV text and read back."""
    path = scratch_path(spark, "csv")
    df = fir_blocks(fx.signal(spark, sf), fx.bank(spark, sf), fx.SERIES)
    write_csv(df, path)
    return spark.read.schema(df.schema).csv(path)


# --- sinks ------------------------------------------------------------------

def parquet_roundtrip(spark, sf):
    path = scratch_path(spark, "power")
    write_power(_power(spark, sf), path, mode="errorifexists", records_per_file=5000)
    return read_power(spark, path).select(*fx.SERIES, "time", "frequency", "convolution")


def text_result(spark, sf):
    res = final_result(spark, sf).select("frequency", "phaserange",
                                         F.col("convolution").cast("decimal(12,4)").alias("convolution"))
    return result_lines(res)


# --- transforms -------------------------------------------------------------

def _series64(spark, sf):
    emb = fx.table(spark, sf, "embeddings")
    return emb.select("vec_id", "embedding", F.posexplode("embedding").alias("j", "_e")).select(
        "vec_id", "j", F.col("_e").cast("double").alias("re"),
        F.element_at("embedding", F.size("embedding") - F.col("j")).cast("double").alias("im"))


def _user_segments(spark, sf):
    ev = fx.table(spark, sf, "events").select("user_id", "event_id", "value")
    idx = dense_index(ev, ["user_id"], ["event_id"], count_bins(ev, ["user_id"], F.col("event_id")), "jj")
    seg = X.segments(idx.withColumnRenamed("jj", "j"), "j", 128)
    return seg.select("user_id", "segment", "j", F.col("value").alias("re"), F.lit(0.0).alias("im"))


def _rounded(df: DataFrame, keys: list[str], idx: str, digits: int = 4, im: bool = True) -> DataFrame:
    return df.select(*keys, idx, _r("re", digits), *([_r("im", digits)] if im else []))


def dft_complex_forward(spark, sf):
    return _rounded(X.complex_forward(_series64(spark, sf), ["vec_id"]), ["vec_id"], "k")


def dft_complex_inverse(spark, sf):
    s = _series64(spark, sf).withColumnRenamed("j", "k")
    return _rounded(X.complex_inverse(s, ["vec_id"]), ["vec_id"], "j", 6)


def idft_unscaled(spark, sf):
    s = _series64(spark, sf).withColumnRenamed("j", "k")
    return _rounded(X.complex_inverse(s, ["vec_id"], scale=False), ["vec_id"], "j")


def dft_real_half(spark, sf):
    return _rounded(X.real_forward(_series64(spark, sf), ["vec_id"]), ["vec_id"], "k")


def dft_real_full(spark, sf):
    return _rounded(X.real_forward_full(_series64(spark, sf), ["vec_id"]), ["vec_id"], "k")


def idft_real_half(spark, sf):
    """Half spectrum of each embedding, transformed back (round trip)."""
    s = _series64(spark, sf)
    n = s.groupBy("vec_id").agg((F.max("j") + 1).alias("n"))
    spec = X.real_forward(s, ["vec_id"]).join(n, "vec_id")
    return _rounded(X.real_inverse(spec, ["vec_id"], "n"), ["vec_id"], "j", 6, im=False)


def idft_real_full(spark, sf):
    s = _series64(spark, sf).withColumnRenamed("j", "k")
    return _rounded(X.real_inverse_full(s, ["vec_id"]), ["vec_id"], "j", 6)


def dft_slice(spark, sf):
    return _rounded(X.complex_forward(X.slice_series(_series64(spark, sf), "j", 8, 48), ["vec_id"]), ["vec_id"], "k")


def dft_prime_length(spark, sf):
    keys = ["user_id", "segment"]
    return _rounded(X.complex_forward(_user_segments(spark, sf), keys), keys, "k")


def dft_distributed(spark, sf):
    """Whole channel series transformed in two rounds of ~sqrt(n)-sized groups."""
    s = fx.signal(spark, sf).select(*fx.SERIES, F.col("i").alias("j"), F.col("v").cast("double").alias("re"),
                                    F.lit(0.0).alias("im"))
    return _rounded(X.complex_forward_distributed(s, fx.SERIES), fx.SERIES, "k", 2)


def idft_distributed(spark, sf):
    """Whole channel series taken as spectra and transformed back, alone (no forward transform before)."""
    s = fx.signal(spark, sf).select(*fx.SERIES, F.col("i").alias("k"), F.col("v").cast("double").alias("re"),
                                    F.lit(0.0).alias("im"))
    return _rounded(X.complex_inverse_distributed(s, fx.SERIES, scale=False), fx.SERIES, "j", 2)


def dft_chirp(spark, sf):
    """Whole channel series with calls so small that those of a large prime factor take the chirp plan."""
    s = fx.signal(spark, sf).select(*fx.SERIES, F.col("i").alias("j"), F.col("v").cast("double").alias("re"),
                                    F.lit(0.0).alias("im"))
    return _rounded(X.complex_forward_distributed(s, fx.SERIES, entries_per_call=512), fx.SERIES, "k", 2)


def spectral_product_conj(spark, sf):
    s = _series64(spark, sf)
    a = X.real_forward_full(s, ["vec_id"])
    b = X.real_forward_full(s.select("vec_id", "j", F.col("im").alias("re")), ["vec_id"])
    return _rounded(X.product_conj(a, b, ["vec_id"]), ["vec_id"], "k")


QUERIES: dict[str, Query] = {
    "kernel_bank_long": kernel_bank_long,
    "kernel_bank_text": kernel_bank_text,
    "signal_parse_csv": signal_parse_csv,
    "signal_parse_records": signal_parse_records,
    "filename_keys": filename_keys_query,
    "sortedness_violations": sortedness_violations,
    "dense_index": dense_index_query,
    "tied_index": tied_index,
    "fir_valid": fir_valid,
    "band_power": band_power,
    "band_power_blocks": band_power_blocks_query,
    "avg_by_time_freq": avg_by_time_freq,
    "average_reference": average_reference_query,
    "average_reference_window": average_reference_window_query,
    "average_reference_join": average_reference_join_query,
    "average_reference_within": average_reference_within,
    "group_stats": group_stats_query,
    "zscore": zscore_query,
    "within_passes": within_passes,
    "within_passes_binned": within_passes_binned,
    "within_passes_nested": within_passes_nested,
    "phase_bucket": phase_bucket_query,
    "phase_profile": phase_profile_query,
    "final_result": final_result,
    "final_result_window": final_result_window,
    "final_result_streamed": final_result_streamed,
    "final_result_sql": final_result_sql,
    "parquet_roundtrip": parquet_roundtrip,
    "stream_ingest_power": stream_ingest_power,
    "text_result": text_result,
    "dft_complex_forward": dft_complex_forward,
    "dft_complex_inverse": dft_complex_inverse,
    "idft_unscaled": idft_unscaled,
    "dft_real_half": dft_real_half,
    "dft_real_full": dft_real_full,
    "idft_real_half": idft_real_half,
    "idft_real_full": idft_real_full,
    "dft_slice": dft_slice,
    "dft_prime_length": dft_prime_length,
    "spectral_product_conj": spectral_product_conj,
    "dft_distributed": dft_distributed,
    "idft_distributed": idft_distributed,
    "dft_chirp": dft_chirp,
    "fir_blocks": fir_blocks_query,
    "fir_missing": fir_missing,
    "fir_missing_blocks": fir_missing_blocks,
    "fir_long": fir_long,
    "fir_exact": fir_exact,
    "band_power_long": band_power_long,
    "fir_exact_long": fir_exact_long,
    "job_from_text": job_from_text,
    "job_append": job_append,
    "passes_phase_text": passes_phase_text,
    "recordings_scan": recordings_scan,
    "load_counts": load_counts,
    "csv_dump": csv_dump,
    "store_means": store_means,
    "store_group_stats": store_group_stats,
    "store_result": store_result,
    "store_compacted": store_compacted,
    "store_job_and_stream": store_job_and_stream,
}

def _series_dft(inverse: bool = False, scale: bool = False, index: str = "k") -> str:
    return with_ctes("sig", body="") + dft_sql(
        "SELECT rat, dt, channel, i AS j, CAST(v AS DOUBLE) AS x, 0.0 AS y FROM sig", ["rat", "dt", "channel"], index,
        inverse=inverse, scale=scale, digits=2).replace("WITH s AS (", ", s AS (", 1)


_LINES = """SELECT ' ' || CAST(event_id AS VARCHAR) || ' , ' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)
       || CASE event_type WHEN 'click' THEN ',' WHEN 'signup' THEN ',,' WHEN 'error' THEN ',7' ELSE '' END AS line
FROM events"""

_FINAL = "SELECT frequency, phaserange, convolution FROM prof WHERE rat = 'R0' AND dt = '2024-01'"

_RA_SQL = "SELECT rat, frequency, channel, dt, time, CAST(convolution AS FLOAT) AS convolution FROM ra"

_H = "CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000.0) AS BIGINT)"

_REAL64 = "SELECT vec_id, j, CAST(embedding[j + 1] AS DOUBLE) AS x, 0.0 AS y FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS j FROM embeddings)"

_IM64 = "SELECT vec_id, j, CAST(embedding[len(embedding) - j] AS DOUBLE) AS x, 0.0 AS y FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS j FROM embeddings)"

_PRODUCT = f"""WITH a AS ({dft_sql(_REAL64, ['vec_id'], 'k', digits=None)}),
b AS ({dft_sql(_IM64, ['vec_id'], 'k', digits=None)})
SELECT a.vec_id, a.k, round(a.re * b.re - a.im * b.im, 4) + 0.0 AS re, round(-(a.re * b.im + a.im * b.re), 4) + 0.0 AS im
FROM a JOIN b ON a.vec_id = b.vec_id AND a.k = b.k"""

_IDFT_HALF = f"""WITH hs AS ({dft_sql(_REAL64, ['vec_id'], 'k', half=True, digits=None)}),
nn AS (SELECT vec_id, len(embedding) AS n FROM embeddings),
jj AS (SELECT vec_id, n, unnest(range(n)) AS j FROM nn)
SELECT jj.vec_id, jj.j,
       round(sum(CASE WHEN hs.k = 0 OR 2 * hs.k = jj.n THEN 1 ELSE 2 END
                 * (hs.re * cos(2 * pi() * ((jj.j * hs.k) % jj.n) / jj.n)
                    - CASE WHEN hs.k = 0 OR 2 * hs.k = jj.n THEN 0 ELSE hs.im END
                      * sin(2 * pi() * ((jj.j * hs.k) % jj.n) / jj.n))) / jj.n, 6) + 0.0 AS re
FROM jj JOIN hs ON jj.vec_id = hs.vec_id
GROUP BY jj.vec_id, jj.j, jj.n"""



# an output is NULL if its window holds a missing sample
_MISSING = with_ctes("sig", "taps", body="") + """, w AS (SELECT max(u) + 1 AS w FROM taps)
SELECT t.rat, t.dt, t.channel, t.time, k.frequency, t.i,
       CAST(CASE WHEN count(CASE WHEN s.v < 25000 THEN 1 END) = (SELECT w FROM w)
            THEN sum(CASE WHEN s.v < 25000 THEN CAST(k.h AS BIGINT) * s.v END) END AS BIGINT) AS y
FROM sig t JOIN sig s ON s.rat = t.rat AND s.dt = t.dt AND s.channel = t.channel AND s.i BETWEEN t.i - (SELECT max(u) FROM taps) AND t.i
JOIN taps k ON k.u = t.i - s.i
WHERE t.i >= (SELECT max(u) FROM taps)
GROUP BY t.rat, t.dt, t.channel, t.time, t.i, k.frequency"""

_LONG_TAPS = """ltaps AS (
  SELECT CAST(label + 5 AS INTEGER) AS frequency, CAST(g * 64 + u AS INTEGER) AS u, CAST(round(avg(e) * 1000) AS SMALLINT) AS h
  FROM (SELECT label, vec_id % 4 AS g, unnest(range(len(embedding))) AS u, unnest(embedding) AS e FROM embeddings)
  GROUP BY label, g, u)"""


def _fir_sql(taps: str, ctes: str, wide: bool = False) -> str:
    v, h = ("(s.v * 30011 + s.event_id % 30011)", "(CAST(k.h AS BIGINT) * 61 + k.u % 61)") if wide else ("s.v", "CAST(k.h AS BIGINT)")
    return ctes + f"""
SELECT t.rat, t.dt, t.channel, t.time, k.frequency, t.i, CAST(sum(CAST({h} AS HUGEINT) * {v}) AS BIGINT) AS y
FROM sig t JOIN sig s ON s.rat = t.rat AND s.dt = t.dt AND s.channel = t.channel AND s.i BETWEEN t.i - (SELECT max(u) FROM {taps}) AND t.i
JOIN {taps} k ON k.u = t.i - s.i
WHERE t.i >= (SELECT max(u) FROM {taps})
GROUP BY t.rat, t.dt, t.channel, t.time, t.i, k.frequency"""


SQL: dict[str, str] = {
    "fir_long": _fir_sql("ltaps", with_ctes("sig", body=", " + _LONG_TAPS)),
    "band_power_long": with_ctes("pw", body="SELECT * FROM pw"),
    "fir_exact": _fir_sql("taps", with_ctes("sig", "taps", body=""), wide=True),
    "fir_exact_long": _fir_sql("ltaps", with_ctes("sig", body=", " + _LONG_TAPS), wide=True),
    "kernel_bank_long": with_ctes("taps", body="SELECT frequency, u, h FROM taps"),
    "kernel_bank_text": with_ctes("taps", body="SELECT frequency, u, h FROM taps"),
    "signal_parse_csv": f"""SELECT CAST(trim(p[1]) AS BIGINT) AS time, CAST(trim(p[2]) AS FLOAT) AS voltage
FROM (SELECT string_split(rtrim(line, ','), ',') AS p FROM ({_LINES})) WHERE len(p) = 2""",
    "signal_parse_records": """SELECT CASE WHEN len(p) = 2 THEN CAST(trim(p[1]) AS BIGINT) END AS time,
       CASE WHEN len(p) = 2 THEN CAST(trim(p[2]) AS SMALLINT) END AS voltage
FROM (SELECT string_split(rtrim(CAST(event_id AS VARCHAR) || ', ' || CAST(CAST(round(value) AS BIGINT) AS VARCHAR)
      || CASE event_type WHEN 'click' THEN ',' WHEN 'error' THEN ',1,2' ELSE '' END, ','), ',') AS p FROM events)""",
    "filename_keys": """SELECT event_id, regexp_extract(name, '^([^-]*)-([^-]*-[^-]*-[^-]*)-...([^.]*)\\.', 1) AS rat,
       regexp_extract(name, '^([^-]*)-([^-]*-[^-]*-[^-]*)-...([^.]*)\\.', 2) AS dt,
       regexp_extract(name, '^([^-]*)-([^-]*-[^-]*-[^-]*)-...([^.]*)\\.', 3) AS channel
FROM (SELECT event_id, 'R' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') || '-CSC' || event_type || '.csv' AS name
      FROM events)""",
    "sortedness_violations": f"""SELECT user_id, pos, prev_time, time FROM (
  SELECT user_id, -event_id AS pos, {_H} AS time,
         lag({_H}) OVER (PARTITION BY user_id ORDER BY -event_id) AS prev_time FROM events)
WHERE time < prev_time""",
    "dense_index": with_ctes("sig", body="SELECT rat, dt, channel, event_id, i FROM sig"),
    "tied_index": with_ctes("sig", body="""SELECT rat, dt, channel, time // 720 AS month, event_id,
       row_number() OVER (PARTITION BY rat, dt, channel ORDER BY time // 720, event_id) - 1 AS i FROM sig"""),
    "fir_valid": with_ctes("conv", body="SELECT rat, dt, channel, time, frequency, i, y FROM conv"),
    "band_power": with_ctes("pw", body="SELECT * FROM pw"),
    "band_power_blocks": with_ctes("pw", body="SELECT * FROM pw"),
    "avg_by_time_freq": with_ctes("av", body="SELECT time, frequency, CAST(convolution AS FLOAT) AS convolution FROM av"),
    "average_reference": with_ctes("ra", body=_RA_SQL),
    "average_reference_window": with_ctes("ra", body=_RA_SQL),
    "average_reference_join": with_ctes("ra", body=_RA_SQL),
    "average_reference_within": with_ctes("pw", body="""SELECT DISTINCT p.rat, p.frequency, p.channel, p.dt, p.time,
       CAST(a.convolution AS FLOAT) AS convolution
FROM pw p JOIN (SELECT rat, dt, time, frequency, avg(convolution) AS convolution FROM pw GROUP BY rat, dt, time, frequency) a
  ON p.rat = a.rat AND p.dt = a.dt AND p.time = a.time AND p.frequency = a.frequency"""),
    "group_stats": with_ctes("st", body="SELECT * FROM st"),
    "zscore": with_ctes("z", body="SELECT * FROM z"),
    "within_passes": with_ctes("zp", body="SELECT * FROM zp"),
    "within_passes_binned": with_ctes("zp", body="SELECT * FROM zp"),
    "within_passes_nested": with_ctes("zp", body="SELECT * FROM zp"),
    "phase_bucket": with_ctes("pb", body="SELECT * FROM pb"),
    "phase_profile": with_ctes("prof", body="SELECT * FROM prof"),
    "final_result": with_ctes("prof", body=_FINAL),
    "final_result_window": with_ctes("prof", body=_FINAL),
    "final_result_streamed": with_ctes("prof", body=_FINAL),
    "final_result_sql": with_ctes("prof", body=_FINAL),
    "parquet_roundtrip": with_ctes("pw", body="SELECT * FROM pw"),
    "stream_ingest_power": with_ctes("pw", body="SELECT * FROM pw"),
    "text_result": with_ctes("prof", body=f"""SELECT '[' || CAST(frequency AS VARCHAR) || ',' || CAST(phaserange AS VARCHAR) || ','
       || CAST(CAST(convolution AS DECIMAL(12, 4)) AS VARCHAR) || ']' AS value FROM ({_FINAL})"""),
    "dft_complex_forward": dft_sql(SERIES64, ["vec_id"], "k"),
    "dft_complex_inverse": dft_sql(SERIES64, ["vec_id"], "j", inverse=True, scale=True, digits=6),
    "idft_unscaled": dft_sql(SERIES64, ["vec_id"], "j", inverse=True),
    "dft_real_half": dft_sql(_REAL64, ["vec_id"], "k", half=True),
    "dft_real_full": dft_sql(_REAL64, ["vec_id"], "k"),
    "idft_real_half": _IDFT_HALF,
    "idft_real_full": dft_sql(_REAL64, ["vec_id"], "j", inverse=True, scale=True, digits=6),
    "dft_slice": dft_sql(SERIES64.replace("FROM embeddings)", "FROM embeddings) WHERE j >= 8 AND j < 56")
                         .replace("SELECT vec_id, j,", "SELECT vec_id, j - 8 AS j,"), ["vec_id"], "k"),
    "dft_prime_length": dft_sql(USER_SEGMENTS, ["user_id", "segment"], "k"),
    "spectral_product_conj": _PRODUCT,
    "dft_distributed": with_ctes("sig", body="") + dft_sql(
        "SELECT rat, dt, channel, i AS j, CAST(v AS DOUBLE) AS x, 0.0 AS y FROM sig", ["rat", "dt", "channel"], "k",
        digits=2).replace("WITH s AS (", ", s AS (", 1),
    "idft_distributed": _series_dft(inverse=True, index="j"),
    "dft_chirp": _series_dft(index="k"),
    "fir_blocks": with_ctes("conv", body="SELECT rat, dt, channel, time, frequency, i, y FROM conv"),
    "fir_missing": _MISSING,
    "fir_missing_blocks": _MISSING,
    "job_from_text": with_ctes("prof", body=_FINAL),
    "job_append": with_ctes("prof", body=_FINAL),
    "passes_phase_text": with_ctes("passes", "phase", body="SELECT lo, hi, phase FROM passes JOIN phase ON lo = time"),
    "recordings_scan": with_ctes("sig", body="""SELECT rat, '2024-01-01' AS dt, channel, time, CAST(v AS FLOAT) AS voltage FROM sig"""),
    "load_counts": with_ctes("pw", body="""SELECT (SELECT count(*) FROM sig) AS lines, (SELECT count(*) FROM sig) AS samples,
       (SELECT count(*) FROM pw) AS power_rows"""),
    "store_means": with_ctes("av", body="SELECT time, frequency, CAST(convolution AS FLOAT) AS convolution FROM av"),
    "store_group_stats": with_ctes("st", body="SELECT * FROM st"),
    "store_result": with_ctes("prof", body=_FINAL),
    "store_compacted": with_ctes("pw", body="SELECT * FROM pw"),
    "store_job_and_stream": with_ctes("prof", body=_FINAL),
    "csv_dump": with_ctes("conv", body="SELECT rat, dt, channel, time, frequency, i, y FROM conv"),
}
