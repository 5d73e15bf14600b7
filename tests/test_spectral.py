"""Transforms: NumPy-backed grouped transforms vs direct sums, round trips, Parseval."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators import dense_index
from spindle.operators import spectral as X


def long_df(spark, series, complex_=True):
    data = [(g, j, float(np.real(v)), float(np.imag(v))) for g, xs in series.items() for j, v in enumerate(xs)]
    return spark.createDataFrame(data, "g bigint, j bigint, re double, im double")


def as_arrays(df, idx, cols=("re", "im")):
    out = {}
    for r in df.collect():
        out.setdefault(r["g"], {})[r[idx]] = complex(r["re"], r["im"] if "im" in cols else 0.0)
    return {g: np.array([d[k] for k in sorted(d)]) for g, d in out.items()}


def direct(x, sign):
    n = len(x)
    jk = np.outer(np.arange(n), np.arange(n)) % n
    return (x[None, :] * np.exp(sign * 2j * np.pi * jk / n)).sum(axis=1)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(11)
    return {g: rng.normal(size=n) + 1j * rng.normal(size=n) for g, n in [(1, 1), (2, 16), (3, 61), (4, 211), (5, 100)]}


def test_complex_forward_any_length(spark, series):
    got = as_arrays(X.complex_forward(long_df(spark, series), ["g"]), "k")
    for g, x in series.items():
        assert np.allclose(got[g], direct(x, -1), atol=1e-8)


def test_round_trip_complex(spark, series):
    fwd = X.complex_forward(long_df(spark, series), ["g"])
    back = as_arrays(X.complex_inverse(fwd, ["g"]), "j")
    for g, x in series.items():
        assert np.allclose(back[g], x, atol=1e-9)
    unscaled = as_arrays(X.complex_inverse(fwd, ["g"], scale=False), "j")
    assert np.allclose(unscaled[3], 61 * series[3], atol=1e-7)


def test_real_half_round_trip_and_parseval(spark, series):
    real = {g: np.real(x) for g, x in series.items()}
    df = long_df(spark, real)
    half = X.real_forward(df, ["g"])
    n = df.groupBy("g").agg((F.max("j") + 1).alias("n"))
    back = X.real_inverse(half.join(n, "g"), ["g"], "n")
    got = {r["g"]: {} for r in back.collect()}
    for r in back.collect():
        got[r["g"]][r["j"]] = r["re"]
    for g, x in real.items():
        assert np.allclose([got[g][j] for j in range(len(x))], x, atol=1e-9)
    full = as_arrays(X.real_forward_full(df, ["g"]), "k")
    for g, x in real.items():
        assert np.isclose((np.abs(full[g]) ** 2).sum() / len(x), (x ** 2).sum())
        assert np.allclose(full[g][1:], np.conj(full[g][1:][::-1]))


def test_real_inverse_full(spark, series):
    real = {g: np.real(x) for g, x in series.items()}
    got = as_arrays(X.real_inverse_full(long_df(spark, real).withColumnRenamed("j", "k"), ["g"]), "j")
    for g, x in real.items():
        assert np.allclose(got[g], direct(x, +1) / len(x), atol=1e-9)


def test_slice_and_segments(spark, series):
    df = long_df(spark, series)
    sl = as_arrays(X.complex_forward(X.slice_series(df.filter("g = 5"), "j", 10, 30), ["g"]), "k")
    assert np.allclose(sl[5], direct(series[5][10:40], -1), atol=1e-8)
    seg = X.complex_forward(X.segments(df.filter("g = 4"), "j", 64), ["g", "segment"])
    r = {(a["segment"], a["k"]): complex(a["re"], a["im"]) for a in seg.collect()}
    last = np.array([r[(3, k)] for k in range(211 - 192)])
    assert np.allclose(last, direct(series[4][192:], -1), atol=1e-8)


def test_product_conj(spark, series):
    df = long_df(spark, series)
    a = X.complex_forward(df, ["g"])
    p = as_arrays(X.product_conj(a, a, ["g"]), "k")
    for g, x in series.items():
        s = direct(x, -1)
        assert np.allclose(p[g], np.conj(s * s), atol=1e-6)


def test_scaled(spark):
    df = spark.createDataFrame([(1, 4.0, 2.0)], "g int, re double, im double")
    assert tuple(X.scaled(df, ["re", "im"], 4).first()) == (1, 1.0, 0.5)


def test_distributed_forward_matches_direct(spark, series):
    rng = np.random.default_rng(5)
    more = dict(series)
    more[6] = rng.normal(size=360) + 1j * rng.normal(size=360)   # 18 x 20
    more[7] = rng.normal(size=64) + 1j * rng.normal(size=64)     # 8 x 8
    for per_call in (1 << 16, 7, 1):
        got = as_arrays(X.complex_forward_distributed(long_df(spark, more), ["g"], entries_per_call=per_call), "k")
        for g, x in more.items():
            assert np.allclose(got[g], direct(x, -1), atol=1e-8), (g, per_call)


def test_groups_straddling_arrow_batches(spark, series):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = as_arrays(X.complex_forward(long_df(spark, series).repartition(3), ["g"]), "k")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(got) == sorted(series)
    for g, x in series.items():
        assert np.allclose(got[g], direct(x, -1), atol=1e-8), g


def test_distributed_inverse_round_trip(spark, series):
    df = long_df(spark, series)
    spec = X.complex_forward_distributed(df, ["g"], entries_per_call=50)
    back = as_arrays(X.complex_inverse_distributed(spec, ["g"]), "j")
    for g, x in series.items():
        assert np.allclose(back[g], x, atol=1e-9), g
    unscaled = as_arrays(X.complex_inverse_distributed(spec, ["g"], scale=False), "j")
    assert np.allclose(unscaled[2], 16 * series[2], atol=1e-8)


def test_large_prime_factors_take_the_chirp_plan(spark):
    rng = np.random.default_rng(9)
    more = {g: rng.normal(size=n) + 1j * rng.normal(size=n) for g, n in [(1, 61), (2, 2 * 53), (3, 97), (4, 64), (5, 3)]}
    df = X.complex_forward(long_df(spark, more), ["g"], entries_per_call=20)
    got = as_arrays(df, "k")
    for g, x in more.items():
        assert np.allclose(got[g], direct(x, -1), atol=1e-7), g
    back = as_arrays(X.complex_inverse(df, ["g"], entries_per_call=20), "j")
    assert all(np.allclose(back[g], x, atol=1e-7) for g, x in more.items())
    # lengths whose own split would leave rows of more than 20 entries
    sizes = X._sizes(long_df(spark, more), ["g"], "j", None).collect()
    assert {r["g"] for r in sizes if r["_n"] > 20 * r["_n1"]} == {1, 2, 3}


def test_null_and_large_keys_are_groups(spark):
    rows = [(None, j, float(j), 0.0) for j in range(4)] + [(2**53, j, 1.0, 0.0) for j in range(3)] + [(2**53 + 1, j, 2.0, 0.0) for j in range(3)]
    got = X.complex_forward(spark.createDataFrame(rows, "g bigint, j bigint, re double, im double"), ["g"]).collect()
    assert sorted((str(r["g"]), round(r["re"], 6)) for r in got if r["k"] == 0) == [(str(2**53), 3.0), (str(2**53 + 1), 6.0), ("None", 6.0)]
    assert len(got) == 10


REAL_LENGTHS = [(1, 1), (2, 2), (3, 3), (4, 64), (5, 61), (6, 210), (7, 225), (8, 360), (9, 5 * 53), (10, 2 * 97)]


@pytest.mark.parametrize("entries", [1 << 16, 50, 7])
def test_real_kinds_by_one_call_two_rounds_and_chirp(spark, entries):
    rng = np.random.default_rng(3)
    real = {g: rng.normal(size=n) for g, n in REAL_LENGTHS}
    df = long_df(spark, real)
    half = X.real_forward(df, ["g"], entries_per_call=entries)
    got, full = as_arrays(half, "k"), as_arrays(X.real_forward_full(df, ["g"], entries_per_call=entries), "k")
    n = df.groupBy("g").agg((F.max("j") + 1).alias("n"))
    # the imaginary parts of the two edge bins do not count
    odd = half.join(n, "g").withColumn("im", F.when((F.col("k") == 0) | (F.col("k") * 2 == F.col("n")), 7.0).otherwise(F.col("im")))
    back = as_arrays(X.real_inverse(odd, ["g"], "n", entries_per_call=entries), "j", cols=("re",))
    raw = as_arrays(X.real_inverse(odd, ["g"], "n", scale=False, entries_per_call=entries), "j", cols=("re",))
    inverse = as_arrays(X.real_inverse_full(df.withColumnRenamed("j", "k"), ["g"], entries_per_call=entries), "j")
    for g, x in real.items():
        want = direct(x, -1)
        assert len(got[g]) == len(x) // 2 + 1 and np.allclose(got[g], want[:len(x) // 2 + 1], atol=1e-8), g
        assert len(full[g]) == len(x) and np.allclose(full[g], want, atol=1e-8), g
        assert np.allclose(back[g], x, atol=1e-9) and np.allclose(raw[g], x * len(x), atol=1e-7), g
        assert np.allclose(inverse[g], direct(x, +1) / len(x), atol=1e-9), g


def test_missing_bins_and_entries_count_as_zero(spark):
    x = np.zeros(60)
    x[[3, 59]] = [2.0, 1.0]
    df = spark.createDataFrame([(1, 3, 2.0, 0.0), (1, 59, 1.0, 0.0)], "g bigint, j bigint, re double, im double")
    bins = spark.createDataFrame([(1, 7, 1.0, -2.0, 60)], "g bigint, k bigint, re double, im double, n bigint")
    for entries in (1 << 16, 30):
        got = as_arrays(X.real_forward(df, ["g"], entries_per_call=entries), "k")[1]
        assert np.allclose(got, np.fft.rfft(x))
        spec = np.zeros(31, complex)
        spec[7] = 1 - 2j
        back = as_arrays(X.real_inverse(bins, ["g"], "n", entries_per_call=entries), "j", cols=("re",))[1]
        assert np.allclose(back, np.fft.irfft(spec, 60))


def test_half_of_the_entries_cross_to_round_two(spark, monkeypatch):
    """Of a real series round 1 has no imaginary column and hands half of a spectrum on; of a half spectrum only its own
    bins enter round 1 and half of the rows leave it."""
    rng = np.random.default_rng(4)
    n = 4096
    df = long_df(spark, {1: rng.normal(size=n)})
    seen = {}
    plan = X._four_step

    def spy(rows, keys, entries, kind=X.COMPLEX):
        mid = {}
        group = type(rows.groupBy("_n"))
        real = group.applyInArrow

        def apply(self, fn, schema):
            out = real(self, fn, schema)
            if "_row" in [f.name for f in schema.fields]:
                mid["df"] = out
            return out

        monkeypatch.setattr(group, "applyInArrow", apply)
        out = plan(rows, keys, entries, kind)
        monkeypatch.setattr(group, "applyInArrow", real)
        seen[kind] = (rows.count(), [c for c in rows.columns if c in ("re", "im")],
                      mid["df"].agg(F.sum(F.size("re"))).first()[0], mid["df"].count())
        return out

    monkeypatch.setattr(X, "_four_step", spy)
    X.complex_forward(df, ["g"], entries_per_call=512)
    X.real_forward(df, ["g"], entries_per_call=512)
    X.real_inverse(df.where(f"j <= {n // 2}").withColumnRenamed("j", "k"), ["g"], n, entries_per_call=512)
    assert seen[X.COMPLEX][:3] == (n, ["re", "im"], n)
    assert seen[X.REAL][:3] == (n, ["re"], n // 2 + 64)
    assert seen[X.HALF][:3] == (n // 2 + 1, ["re", "im"], n // 2 + 64)
    assert all(pieces <= 64 for *_, pieces in seen.values())  # not a row per entry


def test_chirp_is_made_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(X, "PIECE", 100)
    lengths = spark.createDataFrame([(1031, 4096), (7, 16)], "_len bigint, _m bigint")
    got = X._chirp_numbers(lengths)
    assert sorted(r["_d"] for r in got.where("_len = 1031").collect()) == list(range(-1030, 1031))
    assert sorted(r["_d"] for r in got.where("_len = 7").collect()) == list(range(-6, 7))
    rng = np.random.default_rng(2)
    x = rng.normal(size=1031) + 1j * rng.normal(size=1031)
    out = as_arrays(X.complex_forward(long_df(spark, {1: x}), ["g"], entries_per_call=128), "k")
    assert np.allclose(out[1], direct(x, -1), atol=1e-7)


def broadcasts(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]


def test_chirp_spectra_and_places_of_samples_pass_no_driver(spark):
    """A chirp's spectrum is as long as a series: it is not broadcast, though it is made from a table of a few lengths."""
    rng = np.random.default_rng(6)
    x = {1: rng.normal(size=1031) + 1j * rng.normal(size=1031), 2: rng.normal(size=360)}
    for kind in (X.complex_forward_distributed, X.real_forward):
        out = kind(long_df(spark, x), ["g"], entries_per_call=64)
        assert len(broadcasts(out)) <= 2  # only the lengths, a row per series, for each of the two plans
        assert not any("_len" in line for line in broadcasts(out))
    got = as_arrays(X.complex_forward_distributed(long_df(spark, x), ["g"], entries_per_call=64), "k")
    assert all(np.allclose(got[g], direct(v, -1), atol=1e-7) for g, v in x.items())
    rows = spark.range(300).selectExpr("id % 3 AS g", "id")
    placed = dense_index(rows, ["g"], ["id"], F.floor(F.col("id") / 50))
    assert not broadcasts(placed) and all(r["i"] == r["id"] // 3 for r in placed.collect())
