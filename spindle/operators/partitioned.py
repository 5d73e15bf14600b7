"""Filtering with kernels longer than a call: kernel and signal cut into equal parts, products summed in the frequency domain.

With parts of L entries, kernel part p holds the taps pL .. pL + L - 1 and signal block m the samples of two neighbouring
parts (the second one its own). The spectra of both, of length 2L, are tables. Output block m is the inverse transform of
``sum_p H[p] * X[m - p]`` (its second half), so the sum over the parts is taken on spectra and every transform has 2L entries, whatever
the kernel's width.

The products are a blocked matrix product: a task joins a run of output blocks with a band of kernels over a tile of parts, and
hands on the sum over its parts; a second shuffle adds the tiles. Bank and signal reach the tasks by equi-joins on
(run, band, tile); neither passes through the driver, and no task holds a whole kernel or a whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.operators import exact
from spindle.operators.convolution import _integral, _power, _sample
from spindle.session import materialize
from spindle.sources.kernels import bank_frequencies, kernel_width

CALL = 1 << 14  # samples of one call, about: short blocks come many to a call

_SPECTRUM = [T.StructField("re", T.ArrayType(T.DoubleType())), T.StructField("im", T.ArrayType(T.DoubleType()))]


def _lists(spectra: np.ndarray) -> list[pa.Array]:
    """The lines of a matrix as lists of real and of imaginary parts."""
    ends = pa.array(np.arange(len(spectra) + 1, dtype=np.int32) * np.int32(spectra.shape[1]))
    return [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(part).reshape(-1))) for part in (spectra.real, spectra.imag)]


def _spectra(tbl: pa.Table, size: int) -> np.ndarray:
    """The rows' spectra, one a line."""
    if not tbl.num_rows:
        return np.empty((0, size), complex)
    re, im = (tbl.column(c).combine_chunks().flatten().to_numpy() for c in ("re", "im"))
    return (re + 1j * im).reshape(-1, size)


def kernel_spectra(bank: DataFrame, half: int, limbs: exact.Limbs | None = None) -> DataFrame:
    """Rows (frequency, part, h_limb, re, im): the spectrum of each part of ``half`` taps, per limb."""
    schema = T.StructType([T.StructField("frequency", T.IntegerType()), T.StructField("part", T.LongType()),
                           T.StructField("h_limb", T.IntegerType()), *_SPECTRUM])

    def run(tbl: pa.Table) -> pa.Table:
        part = tbl.column("part")[0].as_py()
        h = np.zeros(half, np.int64 if limbs else np.float64)
        h[tbl.column("u").to_numpy() - part * half] = tbl.column("h").to_numpy()
        pieces = exact.split(h, limbs.h_bits, limbs.h_count) if limbs else [h]
        spectra = np.fft.rfft(np.array(pieces), n=2 * half, axis=1)
        m = len(spectra)
        return pa.table([pa.repeat(tbl.column("frequency")[0], m), pa.array(np.full(m, part)), pa.array(np.arange(m, dtype=np.int32)),
                         *_lists(spectra)], names=schema.names)

    rows = bank.select(F.col("frequency").cast("int"), F.col("u").cast("bigint").alias("u"),
                       F.col("h").cast("bigint" if limbs else "double").alias("h"), F.floor(F.col("u") / half).alias("part"))
    return rows.groupBy("frequency", "part").applyInArrow(run, schema)


def signal_spectra(rows: DataFrame, keys: list[str], half: int, limbs: exact.Limbs | None = None) -> DataFrame:
    """Rows (keys, block, x_limb, re, im, place, known, at): the spectrum of each block of own samples and those of the part before, and
    on limb 0 the places, presence and times of its own samples; ``gap`` is the last missing index of the block (NULL: none).
    ``rows``: (keys, _i, _v, _time)."""
    time = rows.schema["_time"].dataType
    schema = T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in keys), T.StructField("block", T.LongType()),
                           T.StructField("x_limb", T.IntegerType()), *_SPECTRUM, T.StructField("place", T.ArrayType(T.LongType())),
                           T.StructField("known", T.ArrayType(T.BooleanType())), T.StructField("at", T.ArrayType(time)),
                           T.StructField("gap", T.LongType())])

    per_call = max(1, CALL // half)

    def run(tbl: pa.Table) -> pa.Table:
        first = tbl.column("_call")[0].as_py() * per_call
        at = tbl.column("_i").to_numpy() - (first - 1) * half  # line 0 is the part before the first block
        order = np.argsort(at)
        at, v = at[order], tbl.column("_v").combine_chunks().take(pa.array(order))
        x = np.zeros((per_call + 1, half), np.int64 if limbs else np.float64)
        x.reshape(-1)[at] = v.fill_null(0).to_numpy()
        held = np.zeros(per_call + 1, bool)
        held[at // half] = True
        lines = np.flatnonzero(held[1:] | held[:-1])  # blocks with a sample of their own or of the part before
        both = np.concatenate([x[lines], x[lines + 1]], axis=1)
        pieces = exact.split(both, limbs.x_bits, limbs.x_count) if limbs else [both]
        m, n = len(pieces), len(lines)
        spectra = np.concatenate([np.fft.rfft(p, axis=1) for p in pieces])
        own = np.flatnonzero(at >= half)
        counts = np.bincount(at[own] // half - 1, minlength=per_call)[lines]
        ends = pa.array(np.concatenate([[0], np.cumsum(counts), np.full(n * (m - 1), counts.sum())]), pa.int32())  # lists on limb 0 only
        known = v.is_valid().take(pa.array(own))
        lists = [pa.array(at[own] % half), known, tbl.column("_time").combine_chunks().take(pa.array(order[own]))]
        missing = np.ones((per_call, half), bool)
        missing.reshape(-1)[at[own] - half] = ~known.to_numpy(zero_copy_only=False)
        missing = missing[lines]
        last = (first + lines) * half + half - 1 - np.argmax(missing[:, ::-1], axis=1)
        gap = pa.array(np.tile(last, m), pa.int64(), mask=np.tile(~missing.any(axis=1), m))
        return pa.table([*(pa.repeat(tbl.column(k)[0], m * n) for k in keys), pa.array(np.tile(first + lines, m)),
                         pa.array(np.repeat(np.arange(m, dtype=np.int32), n)), *_lists(spectra),
                         *(pa.ListArray.from_arrays(ends, x) for x in lists), gap], names=schema.names)

    own = F.floor(F.col("_i") / half)
    call = lambda block: F.floor(block / per_call)
    fan = rows.withColumn("_call", F.explode(F.array_distinct(F.array(call(own), call(own + 1)))))
    return fan.groupBy(*keys, "_call").applyInArrow(run, schema)


def fir_partitioned(signal: DataFrame, bank: DataFrame, keys: Sequence[str], entries: int = 1 << 14, index: str = "i",
                    value: str = "v", time: str = "time", run: int = 16, tile: int = 16, band: int = 8) -> DataFrame:
    """Filtered value ``y`` per (keys, time, frequency, i), as ``fir_blocks``, with no transform above ``entries`` entries.

    ``run`` output blocks (more where these have less than ``CALL`` samples), ``tile`` kernel parts and ``band`` kernels meet in one
    call: its memory is about ``(run + tile + run * band + tile * band) * entries * 8`` bytes (times the limbs of integers too large for one),
    for every kernel width. Missing samples make NULL outputs in the windows they touch. Integers are exact. Rows with a NULL key are left out.
    """
    keys, half = list(keys), entries // 2
    run = max(run, CALL // half)
    integral = _integral(signal, value, bank)
    width = kernel_width(bank)
    limbs = None
    if integral:
        facts = [df.agg(F.max(F.abs(F.col(c).cast("decimal(20,0)")))).first()[0] for df, c in ((signal, value), (bank, "h"))]
        limbs = exact.plan(int(facts[0] or 0), int(facts[1] or 0), 2 * half, width)
    rows = signal.select(*keys, F.col(index).cast("bigint").alias("_i"), F.col(time).alias("_time"),
                         _sample(signal, value, "bigint" if integral else "double").alias("_v"))
    kernels = materialize(kernel_spectra(bank, half, limbs), "kernel-spectra")
    blocks = materialize(signal_spectra(rows, keys, half, limbs), "signal-spectra")
    parts = -(-width // half)
    freqs = bank_frequencies(bank)
    bands = signal.sparkSession.createDataFrame([(f, k // band) for k, f in enumerate(freqs)], "frequency int, band long")
    sums = _products(blocks, kernels, bands, keys, half, parts, run, tile, -(-len(freqs) // band))
    return _outputs(blocks, sums, keys, half, width, limbs, -(-len(freqs) // band), index, time, signal.schema[time].dataType)


def band_power_partitioned(signal: DataFrame, bank: DataFrame, keys: Sequence[str], **args) -> DataFrame:
    """Band power by partitioned kernels (same rows as ``band_power_blocks``); arguments as ``fir_partitioned``."""
    y = fir_partitioned(signal, bank, keys, **args)
    return y.select(*keys, args.get("time", "time"), "frequency", _power(F.col("y")).alias("convolution"))


def _key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [T.StructField(k, df.schema[k].dataType) for k in keys]


def _products(blocks, kernels, bands, keys, half, parts, run, tile, n_bands) -> DataFrame:
    """Rows (keys, block, band, frequency, x_limb, h_limb, re, im): sums over the parts of a tile."""
    size = half + 1
    by = [*keys, "_run", "band", "_tile"]
    last = blocks.where(F.size("place") > 0).groupBy(*keys).agg(F.max("block").alias("_last"))
    tiles = -(-parts // tile)
    first_part = F.col("_tile") * tile
    spread = (blocks.select(*keys, "block", "x_limb", "re", "im").join(last, keys)
              .withColumn("_tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tiles - 1).cast("bigint"))))
              .withColumn("_to", F.least(F.col("block") + F.least(first_part + tile, F.lit(parts)) - 1, F.col("_last")))
              .where(F.col("block") + first_part <= F.col("_to"))
              .withColumn("_run", F.explode(F.sequence(F.floor((F.col("block") + first_part) / run), F.floor(F.col("_to") / run))))
              .withColumn("band", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_bands - 1).cast("bigint")))))
    tiled = kernels.join(F.broadcast(bands), "frequency").withColumn("_tile", F.floor(F.col("part") / tile))
    to = [f"_to_{c}" for c in by]  # names of their own: both sides come from the blocks
    asked = spread.select(*(F.col(c).alias(t) for c, t in zip(by, to))).distinct()
    meets = (F.col("_to_band") == F.col("band")) & (F.col("_to__tile") == F.col("_tile"))
    taps = asked.join(tiled, meets).select(*to, "frequency", "part", "h_limb", "re", "im")
    schema = T.StructType([*_key_fields(blocks, keys), *(T.StructField(c, t) for c, t in (
        ("block", T.LongType()), ("band", T.LongType()), ("frequency", T.IntegerType()), ("x_limb", T.IntegerType()),
        ("h_limb", T.IntegerType()))), *_SPECTRUM])

    def product(x: pa.Table, h: pa.Table) -> pa.Table:
        none = schema_arrow(x, keys, schema)
        if not x.num_rows or not h.num_rows:
            return none
        n_run, t = x.column("_run")[0].as_py(), x.column("_tile")[0].as_py()
        lo, end = n_run * run, min(x.column("_last")[0].as_py(), n_run * run + run - 1)
        xs, hs = _spectra(x, size), _spectra(h, size)
        h_at: dict[tuple, list] = {}
        for k, (f, p, j) in enumerate(zip(*(h.column(c).to_pylist() for c in ("frequency", "part", "h_limb")))):
            h_at.setdefault((f, j), []).append((p, k))
        blocks, limbs_x = x.column("block").to_numpy(), x.column("x_limb").to_numpy()
        base = min(int(blocks.min()), lo - max(p for held in h_at.values() for p, _ in held))
        head, out = [], []
        for i in np.unique(limbs_x):
            mine = limbs_x == i
            lines, there = np.zeros((end + 1 - base, size), complex), np.zeros(end + 1 - base, bool)
            mine &= blocks <= end
            lines[blocks[mine] - base], there[blocks[mine] - base] = xs[mine], True
            for (f, j), held in h_at.items():
                total, some = np.zeros((end + 1 - lo, size), complex), np.zeros(end + 1 - lo, bool)
                for p, k in held:
                    at = slice(lo - p - base, end + 1 - p - base)
                    total += lines[at] * hs[k]
                    some |= there[at]
                m = np.flatnonzero(some)
                head.append((m + lo, np.full(len(m), f), np.full(len(m), i), np.full(len(m), j)))
                out.append(total if len(m) == len(total) else total[m])
        block, f, i, j = (np.concatenate(c) for c in zip(*head))
        n = len(block)
        if not n:
            return none
        return pa.table([*(pa.repeat(x.column(k)[0], n) for k in keys), pa.array(block, pa.int64()), pa.repeat(x.column("band")[0], n),
                         pa.array(f, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), *_lists(np.concatenate(out))],
                        names=schema.names)

    return spread.groupBy(*by).cogroup(taps.groupBy(*to)).applyInArrow(product, schema)


def schema_arrow(tbl: pa.Table, keys: list[str], schema: T.StructType) -> pa.Table:
    """An empty table of the schema; key columns as in ``tbl``."""
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.ArrayType(T.DoubleType()): pa.list_(pa.float64())}
    return pa.table([pa.array([], tbl.column(f.name).type if f.name in keys else kinds[f.dataType]) for f in schema.fields], names=schema.names)


def _outputs(blocks, sums, keys, half, width, limbs, n_bands, index, time, time_type) -> DataFrame:
    """The tiles' sums added, transformed back and set on the own samples of each block."""
    own = blocks.where((F.col("x_limb") == 0) & (F.size("place") > 0)).select(*keys, "block", "place", "known", "at", "gap")
    # the last missing sample of the blocks before (an absent block is missing): a window over one row per block
    marks = own.select(*keys, "block", F.col("gap").alias("_gap"))
    order = Window.partitionBy(*keys).orderBy("block")
    absent = F.when(F.coalesce(F.lag("block").over(order), F.lit(-1)) < F.col("block") - 1, F.col("block") * half - 1)
    marks = marks.withColumn("_absent", absent).withColumn("_before", F.greatest(
        F.max(F.greatest(F.col("_gap"), F.col("_absent"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_absent")))
    own = own.join(marks.select(*keys, "block", F.coalesce("_before", F.lit(-1).cast("bigint")).alias("_before")), [*keys, "block"])
    own = own.withColumn("band", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_bands - 1).cast("bigint"))))
    size, per_call = half + 1, max(1, CALL // half)
    y_type = T.LongType() if limbs else T.DoubleType()
    schema = T.StructType([*_key_fields(blocks, keys), T.StructField(time, time_type), T.StructField("frequency", T.IntegerType()),
                           T.StructField(index, T.LongType()), T.StructField("y", y_type)])

    def finish(info: pa.Table, parts: pa.Table) -> pa.Table:
        names, y_arrow = schema.names, pa.int64() if limbs else pa.float64()
        if not info.num_rows or not parts.num_rows:
            key_types = [(info if info.num_rows else parts).column(k).type for k in keys]
            kinds = [*key_types, info.column("at").type.value_type, pa.int32(), pa.int64(), y_arrow]
            return pa.table([pa.array([], t) for t in kinds], names=names)
        blocks, n_place = info.column("block").to_numpy(), pc.list_value_length(info.column("place")).to_numpy()
        line = np.repeat(np.arange(len(blocks)), n_place)  # the line of each own sample
        place = info.column("place").combine_chunks().flatten().to_numpy()
        known = info.column("known").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        times = info.column("at").combine_chunks().flatten()
        missing = np.ones((len(blocks), half), bool)
        missing[line[known], place[known]] = False
        before = info.column("_before").to_numpy()[:, None]
        last = np.maximum.accumulate(np.where(missing, blocks[:, None] * half + np.arange(half), before), axis=1)
        last = np.maximum(last, before)[line, place]
        t = blocks[line] * half + place
        spectra, sets = _spectra(parts, size), {}
        line_of = np.full(per_call, -1)
        line_of[blocks % per_call] = np.arange(len(blocks))
        of = line_of[parts.column("block").to_numpy() % per_call]
        for k, key in enumerate(zip(*(parts.column(c).to_pylist() for c in ("frequency", "x_limb", "h_limb")))):
            if of[k] >= 0:  # else the block has no samples of its own
                sets.setdefault(key, []).append(k)
        total: dict[int, exact.Sum | np.ndarray] = {}
        keeps: dict[int, np.ndarray] = {}  # the samples of the blocks that a kernel's products reach
        for (f, i, j), rows in sets.items():
            if f not in keeps:
                some = np.zeros(len(blocks), bool)
                some[of[[k for key, ks in sets.items() if key[0] == f for k in ks]]] = True
                keeps[f] = np.flatnonzero((t >= width - 1) & some[line])
            keep = keeps[f]
            summed = np.zeros((len(blocks), size), complex)
            np.add.at(summed, of[rows], spectra[rows])
            y = np.fft.irfft(summed, n=2 * half, axis=1)[:, half:][line[keep], place[keep]]
            if limbs:
                total.setdefault(f, exact.Sum(len(keep))).add(y, limbs.shift(i, j))
            else:
                total[f] = y
        ys = np.concatenate([v.values() if limbs else v for v in total.values()]) if total else np.empty(0)
        keep = np.concatenate([keeps[f] for f in total]) if total else np.empty(0, np.int64)
        n = len(keep)
        return pa.table([*(pa.repeat(info.column(k)[0], n) for k in keys), times.take(pa.array(keep)),
                         pa.array(np.repeat(np.array(list(total), np.int32), [len(keeps[f]) for f in total])), pa.array(t[keep]),
                         pa.array(ys, y_arrow, mask=last[keep] > t[keep] - width)], names=names)

    by = [*keys, "_call", "band"]
    call = F.floor(F.col("block") / per_call)
    own, sums = own.withColumn("_call", call), sums.withColumn("_call", call)
    return own.groupBy(*by).cogroup(sums.groupBy(*by)).applyInArrow(finish, schema)
