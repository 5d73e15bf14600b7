"""Band power: closed form, twin plans, boundaries and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators import band_power_blocks, band_power_relational, fir_blocks, fir_relational

KEYS = ["rat", "dt", "channel"]


def signal_df(spark, series):
    """series: {(rat, dt, channel): [values]} -> (keys, time, i, v) with time = 10*i + 3."""
    data = [(r, d, c, 10 * i + 3, i, int(v)) for (r, d, c), vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(data, "rat string, dt string, channel string, time bigint, i bigint, v bigint")


def bank_df(spark, taps):
    data = [(f, u, int(h)) for f, hs in taps.items() for u, h in enumerate(hs)]
    return spark.createDataFrame(data, "frequency int, u int, h smallint")


def expected(series, taps):
    out = []
    for key, vs in series.items():
        x = np.array(vs, dtype=np.int64)
        for f, hs in taps.items():
            h = np.array(hs, dtype=np.int64)
            if len(x) < len(h):
                continue
            y = np.convolve(x, h, "valid")
            for t, yy in zip(range(len(h) - 1, len(x)), y):
                out.append((*key, 10 * t + 3, f, float(np.float32(yy * yy))))
    return sorted(out)


def collect(df):
    return sorted(tuple(r) for r in df.select(*KEYS, "time", "frequency", F.col("convolution").cast("double")).collect())


@pytest.fixture(scope="module")
def case():
    rng = np.random.default_rng(7)
    series = {("R1", "2024-01-01", "a"): rng.integers(-500, 500, 300).tolist(),
              ("R1", "2024-01-01", "b"): rng.integers(-500, 500, 9).tolist(),    # n = W: one row
              ("R2", "2024-01-02", "a"): rng.integers(-500, 500, 5).tolist()}    # n < W: none
    taps = {5: rng.integers(-30, 30, 9).tolist(), 6: rng.integers(-30, 30, 9).tolist(),
            7: rng.integers(-30, 30, 9).tolist()}
    return series, taps


def test_relational_matches_closed_form(spark, case):
    series, taps = case
    got = collect(band_power_relational(signal_df(spark, series), bank_df(spark, taps), KEYS))
    assert got == expected(series, taps)


@pytest.mark.parametrize("block,per_call", [(8, 16), (13, 2), (100, 1), (None, 16)])
def test_blocks_match_closed_form(spark, case, block, per_call):
    series, taps = case
    got = collect(band_power_blocks(signal_df(spark, series), bank_df(spark, taps), KEYS,
                                    block=block, kernels_per_call=per_call))
    assert got == expected(series, taps)


def test_boundary_counts(spark, case):
    series, taps = case
    df = band_power_relational(signal_df(spark, series), bank_df(spark, taps), KEYS)
    counts = {r["channel"] + r["rat"]: r["count"] for r in df.groupBy("rat", "channel").count().collect()}
    assert counts == {"aR1": (300 - 8) * 3, "bR1": 3}  # n - W + 1 rows per kernel; none when n < W


def test_time_is_last_sample_under_kernel(spark, case):
    series, taps = case
    df = fir_relational(signal_df(spark, series), bank_df(spark, taps), KEYS)
    assert df.filter(F.col("time") != F.col("i") * 10 + 3).count() == 0
    assert df.agg(F.min("i")).first()[0] == 8


def test_impulse_returns_taps(spark):
    taps = {5: [3, -1, 4, 1, -5]}
    x = [0] * 4 + [1] + [0] * 10
    df = fir_relational(signal_df(spark, {("R", "d", "c"): x}), bank_df(spark, taps), KEYS)
    y = [r["y"] for r in df.orderBy("i").collect()]
    assert y[:5] == taps[5] and set(y[5:]) == {0}


def test_linearity_and_shift(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(-50, 50, 40), rng.integers(-50, 50, 40)
    taps = {5: rng.integers(-9, 9, 6).tolist()}
    bank = bank_df(spark, taps)

    def ys(x):
        df = fir_relational(signal_df(spark, {("R", "d", "c"): list(x)}), bank, KEYS)
        return np.array([r["y"] for r in df.orderBy("i").collect()])

    assert (ys(2 * a + 3 * b) == 2 * ys(a) + 3 * ys(b)).all()
    shifted = ys(np.concatenate([[0, 0, 0], a]))
    assert (shifted[3:] == ys(a)).all()


def test_float_samples_use_double(spark):
    data = [("R", "d", "c", i, i, float(v)) for i, v in enumerate([0.5, -1.25, 2.0, 3.5])]
    sig = spark.createDataFrame(data, "rat string, dt string, channel string, time bigint, i bigint, v double")
    bank = spark.createDataFrame([(5, 0, 1.5), (5, 1, -0.5)], "frequency int, u int, h double")
    rel = collect(band_power_relational(sig, bank, KEYS))
    blk = collect(band_power_blocks(sig, bank, KEYS, block=2))
    assert [r[-1] for r in rel] == pytest.approx([r[-1] for r in blk], rel=1e-6)
    assert len(rel) == 3


def test_partition_count_independent(spark, case):
    series, taps = case
    a = collect(band_power_blocks(signal_df(spark, series).repartition(1), bank_df(spark, taps), KEYS, partitions=3))
    b = collect(band_power_blocks(signal_df(spark, series).repartition(7), bank_df(spark, taps), KEYS, partitions=11))
    assert a == b


def test_bank_is_taken_in_slices(spark, case, monkeypatch):
    from spindle.operators import convolution
    from spindle.sources import bank_matrix, bank_slices

    bank = spark.createDataFrame([(f, u, 1) for f in range(5, 9) for u in range(10)], "frequency int, u int, h smallint")
    freqs, taps = bank_matrix(bank)
    assert taps.shape == (4, 10) and list(freqs) == [5, 6, 7, 8]
    assert bank_slices(bank, max_cells=39) == [[5, 6, 7], [8]] and bank_slices(bank, max_cells=3) == [[5], [6], [7], [8]]
    with pytest.raises(ValueError, match="given twice"):
        bank_slices(bank.union(bank.limit(1)))
    series, taps = case
    want = expected(series, taps)
    assert collect(band_power_blocks(signal_df(spark, series), bank_df(spark, taps), KEYS, max_cells=10)) == want
    monkeypatch.setattr(convolution, "PIVOT", 2)
    monkeypatch.setattr(convolution, "CELLS", 10)
    assert collect(band_power_relational(signal_df(spark, series), bank_df(spark, taps), KEYS)) == want


@pytest.mark.parametrize("block", [40, 97, None])
def test_full_int16_samples_and_taps_agree(spark, block):
    """|y| far beyond 3e9, where a BIGINT square overflows."""
    rng = np.random.default_rng(8)
    series = {("R", "d", "c"): rng.choice([-32768, 32767, -32767, 30000], 300).tolist()}
    taps = {5: rng.choice([-32768, 32767], 40).tolist(), 6: [32767] * 40}
    rel = fir_relational(signal_df(spark, series), bank_df(spark, taps), KEYS)
    blk = fir_blocks(signal_df(spark, series), bank_df(spark, taps), KEYS, block=block)
    cols = ["rat", "dt", "channel", "time", "frequency", "i", "y"]
    a, b = (sorted(tuple(r) for r in d.select(*cols).collect()) for d in (rel, blk))
    assert a == b and max(abs(r[-1]) for r in a) > 4e9 and blk.schema["y"].dataType == rel.schema["y"].dataType
    p, q = (collect(f(signal_df(spark, series), bank_df(spark, taps), KEYS)) for f in (band_power_relational, band_power_blocks))
    assert p == q


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_missing_sample_spoils_its_window_only(spark, bad):
    rng = np.random.default_rng(2)
    x = [float(v) for v in rng.integers(-9, 9, 120)]
    x[50] = bad
    rows = [("R", "d", "c", 10 * i, i, v) for i, v in enumerate(x) if i != 90]  # 90: not there at all
    sig = spark.createDataFrame(rows, "rat string, dt string, channel string, time bigint, i bigint, v double")
    bank = bank_df(spark, {5: [1, 2, -1, 3]})
    a, b = ({r["i"]: r["y"] for r in f(sig, bank, KEYS).collect()} for f in (fir_relational, lambda *x: fir_blocks(*x, block=40)))
    assert a.keys() == b.keys() == set(range(3, 120)) - {90}
    assert {i for i, y in a.items() if y is None} == {i for i, y in b.items() if y is None} == {50, 51, 52, 53, 91, 92, 93}
    assert all(y is None or abs(y - b[i]) < 1e-9 for i, y in a.items())
