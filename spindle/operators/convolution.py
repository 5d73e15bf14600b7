"""Band power: each series filtered by every kernel of a bank, squared.

For series ``x`` (dense index ``i``) and kernel ``h_f`` of width ``W``::

    y_f[t] = sum_{u=0}^{W-1} h_f[u] * x[t-u]     for t = W-1 .. n-1
    power  = CAST(y_f[t]^2 AS FLOAT), stamped with the time of sample t

i.e. a causal FIR filter in "valid" mode: no edge rows, ``n-W+1`` rows per
kernel and series, the time of the *last* sample under the kernel.

Two plans with the same contract:

* ``fir_relational`` - each sample fans out to the W outputs it feeds, joined
  to the taps on the offset, summed per output. Exact for integer inputs,
  expressible in plain SQL, O(n*W*K) rows before aggregation.
* ``fir_blocks`` / ``band_power_blocks`` - overlap-save: the series is cut into
  blocks of B samples plus a halo of W-1 samples from the previous block; each
  (series, block) group is transformed once and multiplied with every kernel's
  spectrum in NumPy, one band of kernels at a time. Groups have a fixed size, so
  one long series spreads over many tasks.

Rules both forms share: a sample that is NULL or NaN, or absent from the index, is
missing, and an output whose window holds a missing sample is NULL. ``y`` is squared in
DOUBLE and rounded to FLOAT once. A bank of any size is taken in slices.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.operators import exact
from spindle.sources.kernels import bank_matrix, bank_slices, kernel_width

PIVOT = 256  # kernels summed side by side in the relational form
CELLS = 1 << 22  # taps of a bank slice that is broadcast or shipped


def _integral(signal: DataFrame, value: str, bank: DataFrame) -> bool:
    return isinstance(signal.schema[value].dataType, T.IntegralType) and isinstance(bank.schema["h"].dataType, T.IntegralType)


def _sample(signal: DataFrame, value: str, rtype: str) -> Column:
    """The sample as ``rtype``; NaN is missing like NULL."""
    v = F.col(value).cast(rtype)
    return v if rtype == "bigint" or isinstance(signal.schema[value].dataType, T.IntegralType) else F.when(~F.isnan(v), v)


def fir_relational(signal: DataFrame, bank: DataFrame, keys: Sequence[str], width: int | None = None,
                   index: str = "i", value: str = "v", time: str = "time") -> DataFrame:
    """Filtered value ``y`` per (keys, time, frequency, i) by join + sum.

    ``bank`` is the long form (frequency, u, h). Every sample j fans out to
    the W outputs t = j + u it feeds and meets the taps of offset u as one
    row with a column per kernel (a slice of the bank pivoted, broadcast up to CELLS
    taps), so the aggregate per (keys, t) carries K
    sums instead of K rows. The time of output t is that of the u = 0 row;
    outputs past the series end have none and are dropped. ``y`` is BIGINT
    when sample and tap types are integral (exact), else DOUBLE.
    """
    keys = list(keys)
    out = None
    for freqs in bank_slices(bank, CELLS, PIVOT):
        part = _fir_slice(signal, bank.where(F.col("frequency").between(freqs[0], freqs[-1])), freqs, keys,
                          width or kernel_width(bank), index, value, time, _integral(signal, value, bank))
        out = part if out is None else out.unionByName(part)
    return out


def _fir_slice(signal, bank, freqs, keys, w, index, value, time, integral) -> DataFrame:
    rtype = "bigint" if integral else "double"
    wide = (bank.select(F.col("u").cast("int").alias("u"), "frequency", F.col("h").cast(rtype).alias("h"))
            .groupBy("u").pivot("frequency", freqs).agg(F.first("h"))
            .select("u", *[F.coalesce(F.col(str(f)), F.lit(0).cast(rtype)).alias(f"_h{k}")
                           for k, f in enumerate(freqs)]))
    if w * len(freqs) <= CELLS:  # at most W rows of the slice's kernels: 32 MB
        wide = F.broadcast(wide)
    fan = (signal.select(*keys, F.col(index).alias("_j"), _sample(signal, value, rtype).alias("_v"),
                         F.col(time).alias("_time"))
           .withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
           .withColumn("_t", F.col("_j") + F.col("u")))
    sums = (fan.join(wide, "u", "left")  # an offset without taps still counts its sample
            .groupBy(*keys, "_t")
            .agg(F.max(F.when(F.col("u") == 0, F.col("_time"))).alias("time"),
                 F.max(F.col("u") == 0).alias("_own"), F.count("_v").alias("_c"),
                 *[F.sum(F.col(f"_h{k}") * F.col("_v")).alias(f"_y{k}") for k in range(len(freqs))]))
    rows = F.inline(F.array(*[F.struct(F.lit(f).cast("int").alias("frequency"),
                                       F.when(F.col("_c") == w, F.coalesce(F.col(f"_y{k}"), F.lit(0).cast(rtype))).alias("y"))
                              for k, f in enumerate(freqs)]))
    return (sums.filter(F.col("_own") & (F.col("_t") >= w - 1))
            .select(*keys, "time", F.col("_t").alias(index), rows)
            .select(*keys, "time", "frequency", index, "y"))


def _power(y: Column) -> Column:
    """``CAST(y^2 AS FLOAT)``, squared in DOUBLE (a BIGINT square overflows beyond 3e9). "+ 0f" keeps the FLOAT
    rounding real: Catalyst would otherwise fold a later cast to DOUBLE - e.g. inside AVG - over it."""
    d = y.cast("double")
    return (d * d).cast("float") + F.lit(0.0).cast("float")


def band_power_relational(signal: DataFrame, bank: DataFrame, keys: Sequence[str], width: int | None = None,
                          index: str = "i", value: str = "v", time: str = "time") -> DataFrame:
    y = fir_relational(signal, bank, keys, width, index, value, time)
    return y.select(*keys, "time", "frequency", _power(F.col("y")).alias("convolution"))


def _fft_length(width: int, floor: int = 1024) -> int:
    """Power-of-two FFT length with the halo at most 1/8 of it."""
    n = floor
    while n < 8 * (width - 1):
        n *= 2
    return n


def band_power_blocks(signal: DataFrame, bank: DataFrame, keys: Sequence[str], **block_args) -> DataFrame:
    """Band power by overlap-save FFT blocks (same rows as the relational form); arguments as ``fir_blocks``."""
    return _blocks(signal, bank, list(keys), power=True, **block_args)


def fir_blocks(signal: DataFrame, bank: DataFrame, keys: Sequence[str], **block_args) -> DataFrame:
    """Filtered value ``y`` per (keys, time, frequency, i) by overlap-save FFT blocks.

    ``block`` is the number of output samples per group (default: a
    power-of-two FFT length, at least 1024 and 8 halos, minus the halo). With
    integral samples and taps the filtered value is the exact integer - each block is cut into as many limbs as
    its magnitudes need (:mod:`spindle.operators.exact`); what does not fit a BIGINT raises -, so the result equals the relational form
    whatever the block size. ``emit`` names a boolean column: only its rows get outputs (the others feed them).

    The groups are range-partitioned explicitly into ``partitions`` (default
    ``spark.sql.shuffle.partitions``) on (keys, block): the shuffle is
    small in bytes but the work per group is heavy, and a user-set
    partitioning is not coalesced by AQE. A task holds a run of consecutive
    blocks of about one series, so writing the partitioned power table makes
    about one file per task (hashing would scatter every series over every
    task: a file per series per task). The grouped map reuses that
    partitioning (no second exchange); the range bounds are fixed once per
    exchange, so a retried task sees the same ones.
    """
    return _blocks(signal, bank, list(keys), power=False, **block_args)


def _blocks(signal: DataFrame, bank: DataFrame, keys: list[str], power: bool, block: int | None = None,
            kernels_per_call: int = 16, index: str = "i", value: str = "v", time: str = "time", emit: str | None = None,
            partitions: int | None = None, partitioning: str = "range", max_cells: int = CELLS) -> DataFrame:
    w = kernel_width(bank)
    n_fft = _fft_length(w) if block is None else block + w - 1
    b = n_fft - (w - 1)
    if b < w - 1:
        raise ValueError(f"block {b} must be at least the halo {w - 1}")
    integral = _integral(signal, value, bank)
    halo = w - 1

    blk = F.floor(F.col("_i") / F.lit(b))
    in_halo = (F.col("_i") - blk * F.lit(b)) >= F.lit(b - halo)
    rows = signal.select(*keys, F.col(index).cast("bigint").alias("_i"), F.col(time).alias("_time"),
                         _sample(signal, value, "bigint" if integral else "double").alias("_v"),
                         (F.col(emit) if emit else F.lit(True)).alias("_emit"))
    rows = rows.withColumn(
        "_blk", F.explode(F.when(in_halo & F.lit(halo > 0), F.array(blk, blk + 1)).otherwise(F.array(blk))))
    spark = signal.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if partitioning == "hash":  # spreads groups evenly, but every task touches every series
        rows = rows.repartition(p, *keys, "_blk")
    else:
        rows = rows.repartitionByRange(p, *keys, "_blk")

    fields = [T.StructField(k, signal.schema[k].dataType, True) for k in keys]
    fields += [T.StructField("time", signal.schema[time].dataType, True), T.StructField("frequency", T.IntegerType(), False)]
    if power:
        fields.append(T.StructField("convolution", T.FloatType(), True))
    else:
        fields += [T.StructField(index, T.LongType(), False),
                   T.StructField("y", T.LongType() if integral else T.DoubleType(), True)]
    out = None
    for freqs in bank_slices(bank, max_cells):
        fn = _block_kernel(keys, *bank_matrix(bank, freqs), b, n_fft, kernels_per_call, integral, power, index)
        part = rows.groupBy(*keys, "_blk").applyInArrow(fn, T.StructType(fields))
        out = part if out is None else out.unionByName(part)
    return out


def _block_kernel(keys, freqs, taps, b, n_fft, per_call, integral, power, index):
    """Grouped map over Arrow batches: one forward transform of a block, then one
    output batch for each band of kernels. Inputs are read as NumPy views and outputs built as
    Arrow arrays (constant key columns by ``pa.repeat``), so no pandas
    conversion sits on the hot path, and memory stays at one band."""
    w = taps.shape[1]
    halo = w - 1
    spectra: dict[tuple, np.ndarray] = {}
    tap_max = int(np.abs(taps).max()) if integral and taps.size else 0

    def spectrum(band: int, limbs: exact.Limbs | None = None, limb: int = 0) -> np.ndarray:
        key = (band, limbs and (limbs.h_bits, limbs.h_count), limb)
        if key not in spectra:
            part = taps[band * per_call:(band + 1) * per_call]
            if limbs is not None:
                part = exact.split(part.astype(np.int64), limbs.h_bits, limbs.h_count)[limb]
            spectra[key] = np.fft.rfft(part, n=n_fft, axis=1)
        return spectra[key]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tbl = pa.Table.from_batches(list(batches)).combine_chunks()  # one block and its halo
        base = tbl.column("_blk")[0].as_py() * b - halo  # series index of array position 0
        pos = tbl.column("_i").to_numpy() - base
        v = tbl.column("_v")
        known = v.is_valid().to_numpy()
        if integral:
            x = np.zeros(n_fft, np.int64)
            x[pos] = v.fill_null(0).to_numpy(zero_copy_only=False)
            limbs = exact.plan(int(np.abs(x).max()), tap_max, n_fft, w)
            fx = [np.fft.rfft(part) for part in exact.split(x, limbs.x_bits, limbs.x_count)]
        else:
            x = np.zeros(n_fft)
            x[pos] = np.nan_to_num(v.to_numpy(zero_copy_only=False).astype(np.float64))
            fx = np.fft.rfft(x)
        missing = np.ones(n_fft, dtype=bool)
        missing[pos[known]] = False
        behind = np.cumsum(missing)
        tcol = tbl.column("_time").combine_chunks()
        slot = np.full(n_fft, -1, dtype=np.int64)
        slot[pos] = np.arange(len(pos))
        wanted = np.zeros(n_fft, dtype=bool)
        wanted[pos] = tbl.column("_emit").to_numpy(zero_copy_only=False)
        owned = np.arange(halo, n_fft)
        owned = owned[wanted[owned] & (base + owned >= halo)]
        if not len(owned):
            return
        spoilt = behind[owned] - np.where(owned >= w, behind[owned - w], 0) > 0
        times = tcol.take(pa.array(slot[owned]))
        consts = [tbl.column(k)[0] for k in keys]
        for band in range(-(-len(freqs) // per_call)):
            fr = freqs[band * per_call:(band + 1) * per_call]
            if integral:
                total = exact.Sum((len(fr), len(owned)))
                for i, part in enumerate(fx):
                    for j in range(limbs.h_count):
                        total.add(np.fft.irfft(spectrum(band, limbs, j) * part, n=n_fft, axis=1)[:, owned], limbs.shift(i, j))
                y = total.values()
            else:
                y = np.fft.irfft(spectrum(band) * fx, n=n_fft, axis=1)[:, owned]
            m, kk = len(owned), len(fr)
            nulls = np.tile(spoilt, kk)
            flat = y.reshape(-1)
            cols = [pa.repeat(c, m * kk) for c in consts]
            cols.append(pa.concat_arrays([times] * kk))
            cols.append(pa.array(np.repeat(np.asarray(fr, dtype=np.int32), m)))
            names = [*keys, "time", "frequency"]
            if power:
                d = flat.astype(np.float64)
                cols.append(pa.array((d * d).astype(np.float32), mask=nulls))
                names.append("convolution")
            else:
                cols.append(pa.array(np.tile(base + owned, kk)))
                cols.append(pa.array(flat, mask=nulls))
                names += [index, "y"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return fn
