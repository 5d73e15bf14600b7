"""Discrete Fourier transforms over long tables, one transform per key group.

Input is a long table ``(keys..., index, re[, im])`` - one row per entry of
a series or of a segment of one. The length of a group's series
is ``max(index) + 1``; missing entries are zeros. Forward uses the exponent
``-2*pi*i*j*k/n``, inverse ``+``; a scaled inverse divides by ``n``. NULL keys are a group like any other.

A series of at most ``ENTRIES`` entries is transformed in one call, many series to a call. Longer ones run in two rounds
of bounded calls. With ``n = n1 * n2`` and ``j = j1 + n1 * j2``,
``X[k2 + n2 * k1] = sum_j1 w_n1^(j1 k1) * w_n^(j1 k2) * sum_j2 x[j] w_n2^(j2 k2)``:
round 1 transforms the ``n1`` rows j1 (length ``n2``) and applies the
twiddle; round 2 transforms the ``n2`` columns k2 (length ``n1``). Between the rounds a row is a piece: the entries that one
call of round 1 has for one call of round 2.
``n1`` is the largest divisor of ``n`` not above sqrt(n) (2^23 splits
2048 x 4096). Where that leaves rows longer than a call may be (a large prime factor), the transform is
a chirp product around a convolution whose length is a power of two, made of the same two rounds.

Real series cost half: round 1 has real rows, of whose spectra (conjugate-symmetric) only k2 <= n2 / 2 cross to round 2,
whose columns give both halves of the spectrum. The inverse of a half spectrum puts the rows r and n1 - r into one call, which
completes each from the other; only the rows r <= n1 / 2 cross, and round 2 gives real columns. This holds for odd and even n.
Inverse and sliced transforms are column operations around these.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.session import materialize

ENTRIES = 1 << 16  # entries of one call, about

#: What is transformed: complex entries; real ones to the half or the full spectrum; a half spectrum (sign +) to real entries.
COMPLEX, REAL, REAL_FULL, HALF = "complex", "real", "real_full", "half"


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys where NULL equals NULL; the keys of ``left`` stay."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(r, cond).drop(*[f"_r_{k}" for k in keys])


def _sizes(df: DataFrame, keys: Sequence[str], index: str, n: str | None) -> DataFrame:
    """(keys, _n, _n1): length of each series and the row count of its split."""
    length = F.max(n) if n else F.max(index) + 1
    sizes = df.groupBy(*keys).agg(length.cast("bigint").alias("_n"))
    divisors = F.filter(F.sequence(F.lit(1).cast("bigint"), F.floor(F.sqrt("_n")).cast("bigint")),
                        lambda d: F.col("_n") % d == 0)
    return sizes.withColumn("_n1", F.array_max(divisors))


def _long(entries: int) -> Column:
    """Rows too long for a call and much longer than they are many; a power of two always splits evenly."""
    return (F.col("_n") > F.col("_n1") * entries) & (F.col("_n") > F.col("_n1") * F.col("_n1") * 2)


def _dft(df: DataFrame, keys: Sequence[str], index: str, re: Column, im: Column | None, entries: int = ENTRIES,
         n: str | None = None, kind: str = COMPLEX) -> DataFrame:
    """Rows (keys, k, re[, im], _n) of the transform ``kind``. ``n`` names a column with the length (default: max index + 1).

    The lengths are read once before (one aggregate): where all series fit a call nothing else is needed; else they are
    written, one row per series, and joined to the entries."""
    keys = list(keys)
    x = df.select(*keys, F.col(index).cast("bigint").alias("_j"), re.cast("double").alias("re"),
                  *([im.cast("double").alias("im")] if im is not None else []),
                  *([F.col(n).cast("bigint").alias("_n")] if n else []))
    sizes = _sizes(df, keys, index, n)
    facts = sizes.agg(F.max("_n").alias("most"), F.sum(F.when(F.col("_n") <= entries, F.col("_n"))).alias("short"),
                      F.max(_long(entries)).alias("long"), F.max((F.col("_n") > entries) & ~_long(entries)).alias("split")).first()
    calls = int((facts["short"] or 0) // entries) + 1
    if facts["most"] is None or facts["most"] <= entries:
        return _one_call(x, keys, calls, kind)
    sizes = materialize(sizes, "lengths")
    rows = _null_safe(x.drop("_n"), sizes, keys)
    out = _four_step(rows.where((F.col("_n") > entries) & ~_long(entries)), keys, entries, kind) if facts["split"] else None
    if facts["short"]:
        short = _one_call(rows.where(F.col("_n") <= entries).drop("_n1"), keys, calls, kind)
        out = short if out is None else out.unionByName(short)
    if facts["long"]:
        long = _chirp_of(kind, rows.where(_long(entries)), sizes.where(_long(entries)), keys, entries)
        out = long if out is None else out.unionByName(long)
    return out


def _out_schema(rows: DataFrame, keys: list[str], kind: str) -> T.StructType:
    return T.StructType([T.StructField(k, rows.schema[k].dataType, True) for k in keys] + [T.StructField("k", T.LongType(), False)]
                        + [T.StructField(c, T.DoubleType(), False) for c in (("re",) if kind == HALF else ("re", "im"))]
                        + [T.StructField("_n", T.LongType(), False)])


def _values(tbl: pa.Table) -> np.ndarray:
    re = tbl.column("re").to_numpy()
    return re + 1j * tbl.column("im").to_numpy() if "im" in tbl.column_names else re


def _series(tbl: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of each series and the series number of each row; NULL keys are keys."""
    code = np.zeros(tbl.num_rows, np.int64)
    for k in keys:
        col = tbl.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        code = code * (len(col.dictionary) + 1) + col.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    _, first, of = np.unique(code, return_index=True, return_inverse=True)
    return first, of


def _full(y: np.ndarray, n: int) -> np.ndarray:
    """Full spectra from half ones."""
    return np.concatenate([y, np.conj(y[:, 1:(n + 1) // 2][:, ::-1])], axis=1)


def _one_call(x: DataFrame, keys: list[str], calls: int, kind: str) -> DataFrame:
    """Series dealt to ``calls`` groups by their keys, each group transformed at once, length by length."""
    schema = _out_schema(x, keys, kind)

    def run(tbl: pa.Table) -> pa.Table:
        first, of = _series(tbl, keys)
        j, v = tbl.column("_j").to_numpy(), _values(tbl)
        if "_n" in tbl.column_names:
            length = tbl.column("_n").to_numpy()[first]
        else:
            length = np.zeros(len(first), np.int64)
            np.maximum.at(length, of, j + 1)
        source, index, out, sizes = [], [], [], []
        for n in np.unique(length):
            mine = np.flatnonzero(length == n)
            place = np.full(len(first), -1)
            place[mine] = np.arange(len(mine))
            take = place[of] >= 0
            a = np.zeros((len(mine), n // 2 + 1 if kind == HALF else n), v.dtype)
            a[place[of[take]], j[take]] = v[take]
            if kind == COMPLEX:
                y = np.fft.fft(a, axis=1)
            elif kind == HALF:
                y = np.fft.irfft(a, n=n, axis=1, norm="forward")
            else:
                y = np.fft.rfft(a, axis=1)
                y = _full(y, n) if kind == REAL_FULL else y
            source.append(np.repeat(first[mine], y.shape[1]))
            index.append(np.tile(np.arange(y.shape[1], dtype=np.int64), len(mine)))
            out.append(y.reshape(-1))
            sizes.append(np.full(y.size, n, np.int64))
        source, out = pa.array(np.concatenate(source)), np.concatenate(out)
        values = [out] if kind == HALF else [np.ascontiguousarray(out.real), np.ascontiguousarray(out.imag)]
        return pa.Table.from_arrays([*(tbl.column(k).take(source) for k in keys), pa.array(np.concatenate(index)),
                                     *map(pa.array, values), pa.array(np.concatenate(sizes))], names=[f.name for f in schema.fields])

    call = F.pmod(F.xxhash64(*keys) if keys else F.lit(0).cast("bigint"), F.lit(calls)).alias("_call")
    return x.withColumn("_call", call).groupBy("_call").applyInArrow(run, schema)


def _four_step(rows: DataFrame, keys: list[str], entries: int, kind: str = COMPLEX) -> DataFrame:
    """The two rounds over rows (keys, _j, re[, im], _n, _n1). Each call takes a block of rows - about
    ``entries`` entries, one 2-D NumPy transform - so neither long rows
    nor many short ones make a group large or a call tiny."""
    p = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n2 = (F.col("_n") / F.col("_n1")).cast("bigint")
    row = F.col("_j") % F.col("_n1")
    if kind == HALF:
        row = F.least(row, F.col("_n1") - row)
    x = (rows.withColumn("_c1", F.greatest(F.lit(1), F.floor(F.lit(entries) / n2)).cast("bigint"))
         .withColumn("_b", F.floor(row / F.col("_c1"))))
    key_fields = [T.StructField(k, rows.schema[k].dataType, True) for k in keys]
    mid = T.StructType(key_fields + [T.StructField(c, T.LongType(), False) for c in ("_b", "_row", "_n", "_n1")]
                       + [T.StructField(c, T.ArrayType(T.DoubleType()), False) for c in ("re", "im")])
    final = _out_schema(rows, keys, kind)

    def head(tbl, c):
        return int(tbl.column(c)[0].as_py())

    def width(n1: int) -> int:
        return max(1, entries // n1)  # columns of a call of round 2

    def round1(tbl: pa.Table) -> pa.Table:
        n, n1, c1, b = (head(tbl, c) for c in ("_n", "_n1", "_c1", "_b"))
        n2 = n // n1
        j, v = tbl.column("_j").to_numpy(), _values(tbl)
        rows_of = np.arange(b * c1, min((b + 1) * c1, n1 // 2 + 1 if kind == HALF else n1), dtype=np.int64)
        a = np.zeros((len(rows_of), n2), v.dtype)
        if kind == HALF:
            own = np.flatnonzero(j % n1 // c1 == b)
            own = own[j[own] % n1 <= n1 // 2]
            a[j[own] % n1 - b * c1, j[own] // n1] = v[own]
            inner = (j > 0) & (2 * j < n)  # those with a mirror image of their own
            other = np.flatnonzero(inner & (-j % n1 // c1 == b) & (-j % n1 <= n1 // 2))
            m = n - j[other]
            a[m % n1 - b * c1, m // n1] = np.conj(v[other])
            edge = np.flatnonzero((j == 0) | (2 * j == n))  # imaginary parts of these bins do not count
            edge = edge[np.isin(edge, own)]
            a[j[edge] % n1 - b * c1, j[edge] // n1] = v[edge].real
            y = np.fft.ifft(a, axis=1, norm="forward")
        else:
            a[j % n1 - b * c1, j // n1] = v
            y = np.fft.fft(a, axis=1) if kind == COMPLEX else np.fft.rfft(a, axis=1)
        columns = np.arange(y.shape[1], dtype=np.int64)
        y = y * np.exp((2j if kind == HALF else -2j) * np.pi * (np.outer(rows_of, columns) % n) / n)
        w = width(n1)
        pieces = [y[:, c:c + w].reshape(-1) for c in range(0, y.shape[1], w)]
        if not y.size:
            pieces = []
        flat = np.concatenate(pieces) if pieces else np.empty(0, complex)
        ends = pa.array(np.append(0, np.cumsum([len(x) for x in pieces])), pa.int32())
        m = len(pieces)
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(part))) for part in (flat.real, flat.imag)]
        return pa.Table.from_arrays([*(pa.repeat(tbl.column(k)[0], m) for k in keys), pa.array(np.arange(m, dtype=np.int64)),
                                     *(pa.array(np.full(m, c, np.int64)) for c in (b * c1, n, n1)), *lists],
                                    names=[f.name for f in mid.fields])

    def round2(tbl: pa.Table) -> pa.Table:
        n, n1, b = (head(tbl, c) for c in ("_n", "_n1", "_b"))
        n2, w = n // n1, width(n1)
        last = n2 // 2 + 1 if kind in (REAL, REAL_FULL) else n2
        columns = np.arange(b * w, min((b + 1) * w, last), dtype=np.int64)
        a = np.zeros((len(columns), n1 // 2 + 1 if kind == HALF else n1), complex)
        tbl = tbl.combine_chunks()
        first = tbl.column("_row").to_numpy()
        re, im = (tbl.column(c).combine_chunks() for c in ("re", "im"))
        for r0, x, y in zip(first, re, im):
            piece = (x.values.to_numpy() + 1j * y.values.to_numpy()).reshape(-1, len(columns))
            a[:, r0:r0 + len(piece)] = piece.T
        k = columns[:, None] + n2 * np.arange(n1, dtype=np.int64)[None, :]
        if kind == HALF:
            k, values = k.reshape(-1), [np.fft.irfft(a, n=n1, axis=1, norm="forward").reshape(-1)]
        else:
            y = np.fft.fft(a, axis=1)  # [k2, k1]
            if kind != COMPLEX:
                alone = (columns == 0) | (2 * columns == n2)  # columns that are their own mirror image
                k, y, alone = k.reshape(-1), y.reshape(-1), np.repeat(alone, n1)
                low = 2 * k <= n
                if kind == REAL:
                    high = ~low & ~alone
                    k, y = np.concatenate([k[low], n - k[high]]), np.concatenate([y[low], np.conj(y[high])])
                else:
                    k, y = np.concatenate([k, n - k[~alone]]), np.concatenate([y, np.conj(y[~alone])])
            k, y = k.reshape(-1), y.reshape(-1)
            values = [np.ascontiguousarray(y.real), np.ascontiguousarray(y.imag)]
        return pa.Table.from_arrays([*(pa.repeat(tbl.column(c)[0], len(k)) for c in keys), pa.array(k), *map(pa.array, values),
                                     pa.array(np.full(len(k), n, np.int64))], names=[f.name for f in final.fields])

    values = [c for c in ("re", "im") if c in rows.columns]
    step1 = (x.select(*keys, "_b", "_j", "_n", "_n1", "_c1", *values)
             .repartition(p, *keys, "_b").groupBy(*keys, "_b").applyInArrow(round1, mid))
    return step1.repartition(p, *keys, "_b").groupBy(*keys, "_b").applyInArrow(round2, final)


def _times(ar: Column, ai: Column, br: Column, bi: Column) -> tuple[Column, Column]:
    return ar * br - ai * bi, ar * bi + ai * br


def _wave(j: Column, n: Column, sign: int) -> tuple[Column, Column]:
    """cos and sin of sign * pi * j^2 / n, the square reduced modulo 2n first."""
    angle = F.lit(float(np.pi)) * ((j * j) % (n * 2)).cast("double") / n.cast("double")
    return F.cos(angle), (F.sin(angle) if sign > 0 else -F.sin(angle))


PIECE = 1 << 16  # entries of the chirp that one row makes


def _chirp_numbers(lengths: DataFrame) -> DataFrame:
    """Rows (_len, _m, _d), d = 1 - _len .. _len - 1: ranges of ``PIECE`` numbers first, dealt over the tasks, then the numbers of
    each, so that no row and no task holds the whole chirp."""
    first, last = F.lit(1).cast("bigint") - F.col("_len"), F.col("_len") - 1
    p = int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = lengths.select("_len", "_m", F.explode(F.sequence(first, last, F.lit(PIECE).cast("bigint"))).alias("_from"))
    ranges = ranges.repartition(p, "_len", "_from")
    return ranges.select("_len", "_m", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (PIECE - 1), last))).alias("_d"))


def _padded(df: DataFrame) -> DataFrame:
    """``_m``, the power of two from 2 * _len - 1 on, and the split of transforms of that length: no lengths are read or joined for it."""
    bits = F.ceil(F.log2(F.col("_len") * 2 - 1))
    m = F.pow(F.lit(2.0), bits).cast("bigint")
    return df.withColumns({"_m": m, "_n": m, "_n1": F.pow(F.lit(2.0), F.floor(bits / 2)).cast("bigint")})


def _chirp(rows: DataFrame, sizes: DataFrame, keys: list[str], entries: int) -> DataFrame:
    """Transform of any length: with ``jk = (j^2 + k^2 - (k-j)^2) / 2``, ``X[k] = w[k] * sum_j (x[j] w[j]) conj(w[k-j])``,
    ``w[j] = exp(-i pi j^2 / n)``. The sum is a cyclic convolution of length m, the power of two from 2n - 1 on (what is not
    there counts as zero, so the padding has no rows); the spectrum of
    the chirp is made once for each length that occurs. It is as long as a series, so it meets the spectra by a shuffle: the size that
    Spark expects of it is that of the lengths it is made from, and would have it broadcast."""
    c, s = _wave(F.col("_j"), F.col("_n"), -1)
    re, im = _times(F.col("re"), F.col("im"), c, s)
    a = rows.select(*keys, "_j", re.alias("re"), im.alias("im"), F.col("_n").alias("_len"))
    fa = _four_step(_padded(a), [*keys, "_len"], entries)
    lengths = _padded(sizes.select(F.col("_n").alias("_len")).distinct())
    c, s = _wave(F.col("_d"), F.col("_len"), +1)
    b = _chirp_numbers(lengths).select("_len", F.pmod(F.col("_d"), F.col("_m")).alias("_j"), c.alias("re"), s.alias("im"))
    fb = _four_step(_padded(b), ["_len"], entries).select("_len", "k", F.col("re").alias("_br"), F.col("im").alias("_bi"))
    re, im = _times(F.col("re"), F.col("im"), F.col("_br"), F.col("_bi"))
    prod = fa.join(fb.hint("merge"), ["_len", "k"]).select(*keys, "_len", F.col("k").alias("_j"), re.alias("re"), (-im).alias("im"))
    conv = _four_step(_padded(prod), [*keys, "_len"], entries).where(F.col("k") < F.col("_len"))
    c, s = _wave(F.col("k"), F.col("_len"), -1)
    re, im = _times(F.col("re") / F.col("_n"), -F.col("im") / F.col("_n"), c, s)
    return conv.select(*keys, "k", re.alias("re"), im.alias("im"), F.col("_len").alias("_n"))


def _chirp_of(kind: str, rows: DataFrame, sizes: DataFrame, keys: list[str], entries: int) -> DataFrame:
    """The chirp transform of ``kind``; the real ones are cut from the complex one."""
    if kind == HALF:
        edge = (F.col("_j") == 0) | (F.col("_j") * 2 == F.col("_n"))
        half = rows.withColumn("im", F.when(edge, 0.0).otherwise(F.col("im")))
        mirror = half.where(~edge).withColumns({"_j": F.col("_n") - F.col("_j"), "im": -F.col("im")})
        whole = half.unionByName(mirror).withColumn("im", -F.col("im"))  # the sign + by conjugation; the result is real
        return _chirp(whole, sizes, keys, entries).drop("im")
    if kind in (REAL, REAL_FULL):
        rows = rows.withColumn("im", F.lit(0.0))
    out = _chirp(rows, sizes, keys, entries)
    return out.where(F.col("k") * 2 <= F.col("_n")) if kind == REAL else out


def complex_forward(df: DataFrame, keys: Sequence[str], index: str = "j", re: str = "re", im: str = "im",
                    entries_per_call: int = ENTRIES) -> DataFrame:
    """X[k] = sum_j x[j] e^{-2 pi i j k / n}, k = 0..n-1."""
    return _dft(df, keys, index, F.col(re), F.col(im), entries_per_call).drop("_n")


def _inverse(df: DataFrame, keys: Sequence[str], index: str, re: Column, im: Column, scale: bool, n: str | None = None,
             entries: int = ENTRIES) -> DataFrame:
    """``ifft(X) = conj(fft(conj(X))) / n``: rows (keys, j, re, im)."""
    out = _dft(df, keys, index, re, -im, entries, n)
    by = F.col("_n") if scale else F.lit(1)
    return out.select(*keys, F.col("k").alias("j"), (F.col("re") / by).alias("re"), (-F.col("im") / by).alias("im"))


def complex_inverse(df: DataFrame, keys: Sequence[str], index: str = "k", re: str = "re", im: str = "im",
                    scale: bool = True, entries_per_call: int = ENTRIES) -> DataFrame:
    """x[j] = (1/n if scale) * sum_k X[k] e^{+2 pi i j k / n}."""
    return _inverse(df, keys, index, F.col(re), F.col(im), scale, entries=entries_per_call)


def real_forward(df: DataFrame, keys: Sequence[str], index: str = "j", re: str = "re", entries_per_call: int = ENTRIES) -> DataFrame:
    """Half spectrum of a real series: k = 0..n//2."""
    return _dft(df, keys, index, F.col(re), None, entries_per_call, kind=REAL).drop("_n")


def real_forward_full(df: DataFrame, keys: Sequence[str], index: str = "j", re: str = "re", entries_per_call: int = ENTRIES) -> DataFrame:
    """Full spectrum of a real series: k = 0..n-1 (upper half is the conjugate mirror)."""
    return _dft(df, keys, index, F.col(re), None, entries_per_call, kind=REAL_FULL).drop("_n")


def real_inverse(df: DataFrame, keys: Sequence[str], n: int | str, index: str = "k", re: str = "re",
                 im: str = "im", scale: bool = True, entries_per_call: int = ENTRIES) -> DataFrame:
    """Real series of length ``n`` from its half spectrum (k = 0..n//2).

    The imaginary parts of the k = 0 bin (and of k = n/2 for even n) are
    ignored. ``n`` is a length or the name of a column holding it. The other half is never made as rows.
    """
    length = (F.col(n) if isinstance(n, str) else F.lit(n)).cast("bigint")
    half = df.select(*keys, F.col(index).cast("bigint").alias("_k"), F.col(re).alias("_re"), F.col(im).alias("_im"), length.alias("_len"))
    out = _dft(half.where(F.col("_k") * 2 <= F.col("_len")), keys, "_k", F.col("_re"), F.col("_im"), entries_per_call, "_len", HALF)
    by = F.col("_n") if scale else F.lit(1)
    return out.select(*keys, F.col("k").alias("j"), (F.col("re") / by).alias("re"))


def real_inverse_full(df: DataFrame, keys: Sequence[str], index: str = "k", re: str = "re",
                      scale: bool = True, entries_per_call: int = ENTRIES) -> DataFrame:
    """Complex inverse transform of a real sequence: all n outputs (the conjugate of its spectrum over n)."""
    out = _dft(df, keys, index, F.col(re), None, entries_per_call, kind=REAL_FULL)
    by = F.col("_n") if scale else F.lit(1)
    return out.select(*keys, F.col("k").alias("j"), (F.col("re") / by).alias("re"), (-F.col("im") / by).alias("im"))


def slice_series(df: DataFrame, index: str, offset: int, length: int) -> DataFrame:
    """Entries ``offset .. offset+length-1`` re-indexed from 0."""
    return (df.filter((F.col(index) >= offset) & (F.col(index) < offset + length))
            .withColumn(index, F.col(index) - F.lit(offset)))


def segments(df: DataFrame, index: str, length: int, segment: str = "segment") -> DataFrame:
    """Cut series into consecutive segments of ``length`` entries (new key ``segment``)."""
    return (df.withColumn(segment, F.floor(F.col(index) / F.lit(length)))
            .withColumn(index, F.col(index) - F.col(segment) * F.lit(length)))


def scaled(df: DataFrame, cols: Sequence[str], m: float | Column) -> DataFrame:
    """Multiply ``cols`` by ``1/m``."""
    f = F.lit(1.0 / m) if not isinstance(m, Column) else (F.lit(1.0) / m)
    return df.select(*[(F.col(c) * f).alias(c) if c in cols else F.col(c) for c in df.columns])


def product_conj(a: DataFrame, b: DataFrame, keys: Sequence[str], index: str = "k") -> DataFrame:
    """conj(A * B) per (keys, k): re = ar*br - ai*bi, im = -(ar*bi + ai*br)."""
    keys = list(keys)
    x = a.select(*keys, index, F.col("re").alias("_ar"), F.col("im").alias("_ai"))
    y = b.select(*keys, index, F.col("re").alias("_br"), F.col("im").alias("_bi"))
    j = x.join(y, [*keys, index])
    return j.select(*keys, index,
                    (F.col("_ar") * F.col("_br") - F.col("_ai") * F.col("_bi")).alias("re"),
                    (-(F.col("_ar") * F.col("_bi") + F.col("_ai") * F.col("_br"))).alias("im"))


def complex_forward_distributed(df: DataFrame, keys: Sequence[str], index: str = "j", re: str = "re",
                                im: str = "im", entries_per_call: int = ENTRIES) -> DataFrame:
    """``complex_forward`` under the name it has for whole long series."""
    return complex_forward(df, keys, index, re, im, entries_per_call)


def complex_inverse_distributed(df: DataFrame, keys: Sequence[str], index: str = "k", re: str = "re",
                                im: str = "im", scale: bool = True) -> DataFrame:
    """``complex_inverse`` under the name it has for whole long series."""
    return complex_inverse(df, keys, index, re, im, scale)
