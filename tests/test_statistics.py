"""Average reference, z-score, passes, phase buckets and the profile."""

import pytest
from pyspark.sql import functions as F

from spindle.functions import phase_bucket
from spindle.operators import (
    average_reference,
    average_reference_join,
    average_reference_window,
    group_stats,
    phase_buckets,
    phase_profile,
    select_result,
    within_intervals,
    zscore,
)

POWER = "rat string, dt string, channel string, time bigint, frequency int, convolution float"


@pytest.fixture(scope="module")
def power(spark):
    data = [
        ("R1", "s1", "a", 1, 5, 2.0), ("R1", "s1", "b", 1, 5, 4.0), ("R2", "s2", "a", 1, 5, 6.0),
        ("R1", "s1", "a", 2, 5, 1.0), ("R1", "s1", "b", 2, 5, 3.0),
        ("R1", "s1", "a", 2, 5, 5.0),  # same time twice in one channel
        ("R1", "s1", "a", 3, 5, 7.0), ("R1", "s1", "a", 1, 6, 9.0),
    ]
    return spark.createDataFrame(data, POWER)


def test_average_reference_semantics(spark, power):
    got = sorted(tuple(r) for r in average_reference(power).collect())
    assert got == sorted([
        ("R1", 5, "a", "s1", 4.0, 1), ("R1", 5, "b", "s1", 4.0, 1), ("R2", 5, "a", "s2", 4.0, 1),
        ("R1", 5, "a", "s1", 3.0, 2), ("R1", 5, "b", "s1", 3.0, 2),
        ("R1", 5, "a", "s1", 7.0, 3), ("R1", 6, "a", "s1", 9.0, 1)])


def test_join_and_window_plans_agree(spark, power):
    a = sorted(tuple(r) for r in average_reference(power).collect())
    b = sorted(tuple(r) for r in average_reference_window(power).collect())
    c = sorted(tuple(r) for r in average_reference_join(power).collect())
    assert a == b == c


def test_append_twice_changes_nothing(spark, power):
    a = sorted(tuple(r) for r in average_reference(power).collect())
    b = sorted(tuple(r) for r in average_reference(power.unionAll(power)).collect())
    assert a == b


def test_within_session(spark, power):
    got = {(r["rat"], r["time"], r["frequency"]): r["convolution"]
           for r in average_reference(power, within=["rat", "dt"]).collect()}
    assert got[("R2", 1, 5)] == 6.0 and got[("R1", 1, 5)] == 3.0


def test_stats_are_population_and_float(spark, power):
    st = group_stats(average_reference(power))
    assert dict(st.dtypes)["mean"] == "float" and dict(st.dtypes)["sd"] == "float"
    r = st.filter((F.col("rat") == "R1") & (F.col("channel") == "a") & (F.col("frequency") == 5)).first()
    assert r["mean"] == pytest.approx(14 / 3) and r["sd"] == pytest.approx(((4 - 14 / 3) ** 2 + (3 - 14 / 3) ** 2 + (7 - 14 / 3) ** 2) ** .5 / 3 ** .5, rel=1e-6)


def test_zero_sd_gives_null_and_avg_skips_it(spark):
    df = spark.createDataFrame([("R", "s", "c", t, 5, 2.0) for t in range(4)], POWER)
    z = zscore(average_reference(df))
    assert [r["convolution"] for r in z.collect()] == [None] * 4
    ph = spark.createDataFrame([(t, 0) for t in range(4)], "time bigint, phase int")
    prof = phase_profile(z, phase_buckets(ph)).collect()
    assert len(prof) == 1 and prof[0]["convolution"] is None


def intervals(spark, pairs):
    return spark.createDataFrame(pairs, "lo bigint, hi bigint")


@pytest.mark.parametrize("width", [None, 1, 24])
def test_overlapping_passes_keep_rows_once(spark, width):
    df = spark.createDataFrame([(t,) for t in range(20)], "time bigint")
    iv = intervals(spark, [(2, 5), (4, 8), (4, 8), (6, 6), (10, 10), (11, 10), (15, 16)])  # overlap, dup, nested, empty
    got = sorted(r[0] for r in within_intervals(df, iv, bin_width=width).collect())
    assert got == [2, 3, 4, 5, 6, 7, 8, 10, 15, 16]


@pytest.mark.parametrize("width", [None, 1, 24])
def test_empty_pass_list(spark, width):
    df = spark.createDataFrame([(t,) for t in range(5)], "time bigint")
    assert within_intervals(df, intervals(spark, []), bin_width=width).count() == 0
    assert within_intervals(df.where('time < 0'), intervals(spark, [(0, 9)]), bin_width=width).count() == 0


def test_binned_any_width(spark):
    df = spark.createDataFrame([(t,) for t in range(-30, 60)], "time bigint")
    iv = intervals(spark, [(-7, 3), (20, 41), (45, 45)])
    want = sorted(list(range(-7, 4)) + list(range(20, 42)) + [45])
    for w in (1, 2, 7, 100):
        assert sorted(r[0] for r in within_intervals(df, iv, bin_width=w).collect()) == want


def test_phase_bucket_edges(spark):
    df = spark.createDataFrame([(-3141593,), (0,), (3141593,), (3141594,), (-3141594,)], "p int")
    got = [r[0] for r in df.select(phase_bucket("p")).collect()]
    assert got == [1, 38, 75, 76, 0]


def test_duplicate_phase_rows_multiply(spark):
    z = spark.createDataFrame([("R", "s", "c", 1, 5, 1.0), ("R", "s", "c", 2, 5, 3.0)], POWER)
    ph = spark.createDataFrame([(1, 0), (2, 0), (2, 0)], "time bigint, phase int")
    r = phase_profile(z, phase_buckets(ph)).first()
    assert r["convolution"] == pytest.approx((1 + 3 + 3) / 3)


def test_select_result_filters_rat_and_session(spark):
    prof = spark.createDataFrame([("R192", "2009-11-19", "c", 5, 1, 0.5), ("R1", "2009-11-19", "c", 5, 1, 0.7)],
                                 "rat string, dt string, channel string, frequency int, phaserange int, convolution float")
    assert [tuple(r) for r in select_result(prof).collect()] == [(5, 1, 0.5)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_open_ended_passes(spark):
    df = spark.createDataFrame([(t,) for t in range(100)] + [(None,)], "time bigint")
    for iv, want in (([(90, 2**63 - 1)], range(90, 100)), ([(-(2**63), 4)], range(5)), ([(-(2**63), 2**63 - 1)] * 3, range(100)),
                     ([(2**62, 2**63 - 1)], [])):
        got = within_intervals(df, intervals(spark, iv))
        assert sorted(r[0] for r in got.collect()) == list(want)
        assert "BroadcastNestedLoopJoin" not in _plan(got) and "LeftSemi" in _plan(got)


def test_passes_are_merged_inside_bins(spark):
    from spindle.operators import merged_bins

    iv = intervals(spark, [(1, 4), (3, 6), (7, 7), (9, 12), (9, 11)] * 5)
    got = sorted((r["_bin"], r["_lo"], r["_hi"]) for r in merged_bins(iv, 10).collect())
    assert got == [(0, 1, 7), (0, 9, 9), (1, 10, 12)]
