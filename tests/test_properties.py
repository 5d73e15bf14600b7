"""Randomised properties against brute force (few examples: each runs Spark jobs)."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindle.operators import (
    band_power_blocks,
    band_power_relational,
    within_intervals,
)

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

interval = st.tuples(st.integers(-50, 150), st.integers(0, 40)).map(lambda t: (t[0], t[0] + t[1] - 5))


@SETTINGS
@given(ivs=st.lists(interval, max_size=12), width=st.one_of(st.none(), st.integers(1, 60)))
def test_semi_joins_equal_brute_force(spark, ivs, width):
    times = list(range(-60, 200, 3))
    df = spark.createDataFrame([(t,) for t in times], "time bigint")
    iv = spark.createDataFrame(ivs, "lo bigint, hi bigint")
    want = sorted(t for t in times if any(lo <= t <= hi for lo, hi in ivs))
    assert sorted(r[0] for r in within_intervals(df, iv, bin_width=width).collect()) == want
    assert sorted(r[0] for r in within_intervals(df, iv, bounds=(-100, 300)).collect()) == want


@SETTINGS
@given(n=st.integers(1, 120), w=st.integers(1, 12), k=st.integers(1, 3), block=st.integers(0, 40), seed=st.integers(0, 99))
def test_band_power_forms_equal_numpy(spark, n, w, k, block, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-300, 300, n)
    taps = rng.integers(-20, 20, (k, w))
    sig = spark.createDataFrame([("R", "d", "c", 7 * i, i, int(v)) for i, v in enumerate(x)],
                                "rat string, dt string, channel string, time bigint, i bigint, v bigint")
    bank = spark.createDataFrame([(5 + f, u, int(taps[f, u])) for f in range(k) for u in range(w)],
                                 "frequency int, u int, h smallint")
    want = sorted((7 * t, 5 + f, float(np.float32(int(y) ** 2)))
                  for f in range(k) if n >= w
                  for t, y in zip(range(w - 1, n), np.convolve(x, taps[f], "valid")))
    cols = ["time", "frequency", F.col("convolution").cast("double")]
    rel = sorted(tuple(r) for r in band_power_relational(sig, bank, ["rat", "dt", "channel"]).select(*cols).collect())
    b = max(block, w - 1, 1)
    blk = sorted(tuple(r) for r in band_power_blocks(sig, bank, ["rat", "dt", "channel"], block=b,
                                                      kernels_per_call=2).select(*cols).collect())
    assert rel == want and blk == want
