"""Partitioned kernels and exact integers against direct sums."""

import uuid

import numpy as np
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from spindle.operators import exact, fir_blocks, fir_partitioned, fir_relational
from spindle.operators import partitioned


def signal_df(spark, series, kind="bigint"):
    rows = [(c, i, 10 * i, None if v is None else (int(v) if kind == "bigint" else float(v)))
            for c, xs in series.items() for i, v in enumerate(xs) if v != "absent"]
    return spark.createDataFrame(rows, f"c string, i bigint, time bigint, v {kind}")


def bank_df(spark, kernels, kind="int"):
    rows = [(f, u, int(h) if kind != "double" else float(h)) for f, taps in kernels.items() for u, h in enumerate(taps)]
    return spark.createDataFrame(rows, f"frequency int, u int, h {kind}")


def direct(series, kernels):
    out = {}
    for c, xs in series.items():
        for f, taps in kernels.items():
            w = len(taps)
            for t in range(w - 1, len(xs)):
                if xs[t] == "absent":
                    continue
                window = xs[t - w + 1:t + 1][::-1]
                out[(c, f, t)] = None if any(v is None or v == "absent" for v in window) else sum(int(h) * int(v) for h, v in zip(taps, window))
    return out


def got(df):
    rows = df.collect()
    out = {(r["c"], r["frequency"], r["i"]): r["y"] for r in rows}
    assert len(out) == len(rows)
    assert all(r["time"] == 10 * r["i"] for r in rows)
    return out


@pytest.mark.parametrize("entries,run,tile,band", [(16, 3, 2, 2), (32, 16, 16, 8), (8, 1, 1, 1)])
def test_equals_direct_sums(spark, entries, run, tile, band):
    rng = np.random.default_rng(entries)
    series = {"a": list(rng.integers(-500, 500, 150)), "b": list(rng.integers(-500, 500, 61)), "short": [1, 2, 3],
              "gaps": [None if i in (40, 41, 90) else "absent" if i in (7, 120, *range(130, 170)) else int(x)
                       for i, x in enumerate(rng.integers(-500, 500, 260))]}
    kernels = {f: list(rng.integers(-90, 90, 37)) for f in (5, 6, 9, 11, 12)}
    df = fir_partitioned(signal_df(spark, series), bank_df(spark, kernels), ["c"], entries=entries, run=run, tile=tile, band=band)
    assert got(df) == direct(series, kernels)


def test_real_values(spark):
    rng = np.random.default_rng(2)
    x, h = rng.normal(size=300), rng.normal(size=70)
    df = fir_partitioned(signal_df(spark, {"a": x}, "double"), bank_df(spark, {5: h}, "double"), ["c"], entries=32)
    found = got(df)
    want = np.convolve(x, h)[69:300]
    assert np.allclose([found[("a", 5, t)] for t in range(69, 300)], want)


def test_long_kernel_in_small_calls(spark, monkeypatch):
    """100,000 taps, no transform above 8192 entries (checked in the tasks), equal to the sum by one long transform."""
    rng = np.random.default_rng(5)
    x, h = rng.integers(-1000, 1000, 130_000), rng.integers(-1000, 1000, 100_000)
    sig = spark.createDataFrame([("a", i, 10 * i, int(v)) for i, v in enumerate(x)], "c string, i bigint, time bigint, v bigint")
    bank = spark.createDataFrame([(5, u, int(v)) for u, v in enumerate(h)], "frequency int, u int, h int")
    spectra = partitioned.kernel_spectra(bank, 4096, exact.plan(1000, 1000, 8192, len(h)))
    assert spectra.agg(F.max(F.size("re"))).first()[0] == 4097 and spectra.count() == 25
    df = fir_partitioned(sig, bank, ["c"], entries=8192)
    found = np.array([r["y"] for r in df.orderBy("i").select("y").collect()])
    n = 1 << 18
    parts = [np.rint(np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(p, n), n)) for p in exact.split(h.astype(np.int64), 6, 2)]
    want = (parts[0] + 64 * parts[1])[len(h) - 1:len(x)].astype(np.int64)
    assert len(found) == 30_001 and (found == want).all()


def test_limbs_give_the_number_back():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-2**62, 2**62, 500), [0, 1, -1, 2**31, -2**31, 2**62, -2**62]]).astype(np.int64)
    for bits, count in ((16, 4), (21, 3), (32, 2), (9, 8)):
        parts = exact.split(x, bits, count)
        assert sum(int(p[0]) << (bits * i) for i, p in enumerate(parts)) == int(x[0])
        assert [sum(int(p[k]) << (bits * i) for i, p in enumerate(parts)) for k in range(len(x))] == x.tolist()
        assert all(np.abs(p).max() <= 2 ** (bits - 1) for p in parts[:-1])


def test_plan_is_one_limb_where_that_is_exact_and_never_too_few():
    assert exact.plan(1 << 15, 1 << 9, 1024, 64) == exact.Limbs(0, 1, 0, 1)
    rng = np.random.default_rng(7)
    for x_bits, h_bits, w in ((31, 16, 64), (38, 12, 501), (31, 30, 3), (54, 4, 20)):
        n = 2048
        limbs = exact.plan(2 ** x_bits - 1, 2 ** h_bits - 1, n, w)
        x = rng.choice([-1, 1], n) * (2 ** x_bits - 1)
        x[:w], h = 2 ** x_bits - 1, np.full(w, 2 ** h_bits - 1)
        total = exact.Sum(n)
        for i, a in enumerate(exact.split(x.astype(np.int64), limbs.x_bits, limbs.x_count)):
            for j, b in enumerate(exact.split(h.astype(np.int64), limbs.h_bits, limbs.h_count)):
                total.add(np.fft.irfft(np.fft.rfft(a) * np.fft.rfft(b, n), n), limbs.shift(i, j))
        want = [sum(int(h[u]) * int(x[t - u]) for u in range(w)) for t in range(w - 1, w + 200)]
        assert total.values()[w - 1:w + 200].tolist() == want


@pytest.mark.parametrize("x_bits,h_bits", [(31, 16), (45, 12)])
def test_block_forms_equal_relational_form_bit_for_bit(spark, x_bits, h_bits):
    rng = np.random.default_rng(x_bits)
    series = {"a": list(rng.integers(-2**x_bits, 2**x_bits, 400)), "b": [2**x_bits - 1] * 90, "c": [None if i == 30 else 3 for i in range(90)]}
    kernels = {f: list(rng.integers(-2**(h_bits - 1), 2**(h_bits - 1), 24)) for f in (5, 7)}
    sig, bank = signal_df(spark, series), bank_df(spark, kernels)
    want = got(fir_relational(sig, bank, ["c"]))
    assert want == direct(series, kernels)
    assert got(fir_blocks(sig, bank, ["c"], block=100)) == want
    assert got(fir_partitioned(sig, bank, ["c"], entries=32)) == want


def test_values_beyond_a_bigint_raise(spark):
    sig, bank = signal_df(spark, {"a": [2**61] * 20}), bank_df(spark, {5: [7] * 4})
    for df in (fir_blocks(sig, bank, ["c"], block=16), fir_partitioned(sig, bank, ["c"], entries=16)):
        with pytest.raises(Exception, match="does not fit a BIGINT"):
            df.collect()


def test_short_blocks_come_many_to_a_call(spark, monkeypatch, tmp_path):
    """5000 samples in blocks of 8 are a few calls of Python, not one for each block and band; small calls give the same."""
    def counted(real):
        def apply(self, fn, schema):
            def run(*tables):
                (tmp_path / uuid.uuid4().hex).touch()
                return fn(*tables[-2:])
            # the number of arguments tells a grouped map from a cogrouped one
            return real(self, (lambda x: run(x)) if isinstance(self, GroupedData) else (lambda x, y: run(x, y)), schema)
        return apply

    rng = np.random.default_rng(8)
    series = {"a": list(rng.integers(-500, 500, 5000)), "b": [None if i == 9 else "absent" if 30 < i < 60 else 3 for i in range(100)]}
    kernels = {f: list(rng.integers(-90, 90, 21)) for f in (5, 6, 7)}
    sig, bank = signal_df(spark, series), bank_df(spark, kernels)
    for kind in (GroupedData, PandasCogroupedOps):
        monkeypatch.setattr(kind, "applyInArrow", counted(kind.applyInArrow))
    want = direct(series, kernels)
    assert got(fir_partitioned(sig, bank, ["c"], entries=16, run=2, tile=2, band=2)) == want
    assert len(list(tmp_path.iterdir())) < 100
    monkeypatch.undo()
    monkeypatch.setattr(partitioned, "CALL", 24)
    few = {c: xs[:90] for c, xs in series.items()}
    assert got(fir_partitioned(signal_df(spark, few), bank, ["c"], entries=16, run=2, tile=2, band=2)) == direct(few, kernels)
