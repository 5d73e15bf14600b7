"""Dense index, order checks, plan properties of the flagship."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindle.operators import average_reference, dense_index, order_violations, split_index, within_intervals, zscore
from spindle.operators import index as index_module
from spindle.operators.intervals import clip_intervals, coarse_ranges, in_ranges
from spindle.plans import fixtures as fx
from spindle.plans import flagship
from spindle.schemas import POWER_TABLE
from spindle.session import materialize

from conftest import SMOKE


def test_dense_index_equals_row_number(spark):
    ev = fx.table(spark, SMOKE, "events")
    a = dense_index(ev, ["event_type"], ["ts", "event_id"], F.floor(F.col("event_id") / 37), "i")
    b = ev.withColumn("i", F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")) - 1)
    key = ["event_type", "event_id", "i"]
    assert sorted(tuple(r) for r in a.select(*key).collect()) == sorted(tuple(r) for r in b.select(*key).collect())


def test_order_violations_across_bins(spark):
    df = spark.createDataFrame([("a", p, t) for p, t in enumerate([1, 2, 2, 5, 4, 6, 3, 9])], "s string, p bigint, t bigint")
    for width in (1, 2, 3, 100):
        bad = order_violations(df, ["s"], ["p"], "t", F.floor(F.col("p") / width)).collect()
        assert sorted((r["p"], r["prev_time"], r["t"]) for r in bad) == [(4, 5, 4), (6, 6, 3)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _final(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_statistics_plans_read_the_referenced_rows_once_written(spark):
    from spindle.plans import queries

    for name in ("within_passes", "phase_profile", "zscore", "final_result_window"):
        plan = _final(queries.QUERIES[name](spark, SMOKE))
        assert "Python" not in plan and "InArrow" not in plan, name
        assert "/power-" not in plan and "referenced-" in plan, name
        # no window over the power rows: only the small one that merges passes in their bins
        assert all("_bin" in x for x in plan.split("\n") if "Window [" in x), name


def test_result_filter_reaches_power_scan(spark, tmp_path):
    from spindle.operators import average_reference_join

    power = flagship.power_table(fx.signal(spark, SMOKE), fx.bank(spark, SMOKE), fx.SERIES, path=str(tmp_path / "p"))
    plan = _plan(average_reference_join(power, only=(F.col("rat") == "R0") & (F.col("dt") == "2024-01")))
    assert "PartitionFilters: [isnotnull(rat" in plan and "(rat#" in plan


def test_bins_follow_counts(spark):
    from spindle.operators import count_bins

    df = spark.range(100_000).select(F.lit("a").alias("s"), (F.col("id") * 7).alias("t"))
    per = df.groupBy(count_bins(df, ["s"], F.col("t"), target=1000).alias("b")).count()
    assert 900 <= per.agg(F.max("count")).first()[0] <= 1100


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["frequency", "phaserange", "convolution"] and df.count() > 0


def test_power_table_observes_rows(spark, tmp_path):
    from pyspark.sql import Observation
    obs = Observation("power")
    t = flagship.power_table(fx.signal(spark, SMOKE), fx.bank(spark, SMOKE), fx.SERIES,
                             path=str(tmp_path / "pt"), observation=obs)
    assert obs.get == {"power_rows": t.count()}


def test_hours_independent_of_session_time_zone(spark):
    from spindle.functions import hours_since
    ev = fx.table(spark, SMOKE, "events")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        got = {}
        for tz in ("UTC", "America/Los_Angeles", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got[tz] = ev.select(F.sum(hours_since("ts"))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert len(set(got.values())) == 1


def test_entry_schema_is_stable(spark):
    import __spark_entry__ as e
    assert e.entry(spark).dtypes == [("frequency", "int"), ("phaserange", "int"), ("convolution", "float")]


def test_flagship_ignores_appending_the_same_power_twice(spark, tmp_path):
    power = flagship.power_table(fx.signal(spark, SMOKE), fx.bank(spark, SMOKE), fx.SERIES, path=str(tmp_path / "p1"))
    passes, phase = fx.passes(spark, SMOKE), fx.phase(spark, SMOKE)
    once = sorted(tuple(r) for r in flagship.result(power, passes, phase, "R0", "2024-01").collect())
    twice = sorted(tuple(r) for r in flagship.result(power.unionAll(power), passes, phase, "R0", "2024-01").collect())
    assert once == twice and len(once) > 0


def test_millions_of_equal_times_are_spread(spark):
    """Ten million samples of one series with one time, among others: no range above one hundredth of them."""
    n, p = 10_000_000, 256
    ties = spark.range(n).select(F.lit("a").alias("s"), F.lit(7).alias("time"), F.col("id").alias("pos"))
    rest = spark.range(50_000).select(F.lit("b").alias("s"), (F.col("id") % 100).alias("time"), F.col("id").alias("pos"))
    early = spark.range(1000).select(F.lit("a").alias("s"), F.lit(3).alias("time"), F.col("id").alias("pos"))
    df = ties.unionByName(early).unionByName(rest)
    seen = []
    placed = index_module.materialize

    def spy(d, name):
        out = placed(d, name)
        seen.append(out.groupBy(F.shiftright("_place", 33)).count().agg(F.max("count")).first()[0])
        return out

    index_module.materialize = spy
    try:
        out = split_index(df, ["s"], ["time", "pos"], partitions=p)
    finally:
        index_module.materialize = placed
    assert seen[0] <= n // 100
    a = out.where("s = 'a'")
    assert a.where("i != pos + CASE WHEN time = 7 THEN 1000 ELSE 0 END").count() == 0 and a.count() == n + 1000
    b = out.where("s = 'b'").orderBy("time", "pos").select("i").collect()
    assert [r["i"] for r in b] == list(range(50_000))


def test_split_index_takes_nulls_ties_and_empty_tables(spark):
    rows = [(None, 2, 1), (None, 1, 5), ("x", None, 3), ("x", 1, 1), ("x", 1, 2), ("y", 0, 0)]
    df = spark.createDataFrame(rows, "s string, time int, pos int")
    got = {(r["s"], r["time"], r["pos"]): r["i"] for r in split_index(df, ["s"], ["time", "pos"]).collect()}
    assert got == {(None, 1, 5): 0, (None, 2, 1): 1, ("x", None, 3): 0, ("x", 1, 1): 1, ("x", 1, 2): 2, ("y", 0, 0): 0}
    assert split_index(df.where("false"), ["s"], ["time", "pos"]).collect() == []


def _scanned(df):
    """(description, rows read) of each scan of the finished plan."""
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
            continue
        if p.nodeName().startswith("Scan parquet"):
            out.append((str(p.simpleString(4000)), p.metrics().get("numOutputRows").get().value()))
        for i in range(p.children().size()):
            todo.append(p.children().apply(i))
    return out


def test_coarse_ranges_cover_and_are_few(spark):
    rows = [(5, 9), (8, 12), (100, 100), (104, 104), (300, 10**15), (-10**15, 2), (700, 600)]
    df = spark.createDataFrame(rows, "lo bigint, hi bigint")
    clipped = clip_intervals(df, (0, 1000))
    for most in (1, 7, 64, 5000):
        got = coarse_ranges(clipped, (0, 1000), most)
        assert len(got) <= most and all(a[1] < b[0] for a, b in zip(got, got[1:]))
        covered = {t for lo, hi in got for t in range(lo, hi + 1)}
        assert covered >= {t for lo, hi in rows for t in range(max(lo, 0), min(hi, 1000) + 1)}
    assert coarse_ranges(clipped, (0, 1000), 5000) == [(0, 2), (5, 12), (100, 100), (104, 104), (300, 1000)]
    assert coarse_ranges(clipped.where("false"), (0, 1000)) == []
    assert spark.range(3).where(in_ranges(F.col("id"), [])).count() == 0


def test_pass_restriction_skips_pages_of_the_scan(spark):
    """Referenced rows are written in time order; a few passes read few of them, the statistics read all."""
    rows = spark.range(400_000).select(F.lit("R").alias("rat"), F.lit("d").alias("dt"), (F.col("id") % 2).cast("string").alias("channel"),
                                       F.floor(F.col("id") / 2).alias("time"), F.lit(5).alias("frequency"),
                                       (F.col("id") % 97).cast("float").alias("convolution"))
    ref = materialize(average_reference(rows), "referenced", sort=["time"])
    n = ref.count()
    assert n == 400_000
    passes = spark.createDataFrame([(150, 260), (150_000, 150_200)], "lo bigint, hi bigint")
    out = within_intervals(zscore(ref), passes)
    assert out.count() == 2 * (111 + 201)
    scans = _scanned(out)
    read = [c for s, c in scans if "time" in s and "GreaterThanOrEqual(time" in s]
    assert len(read) == 1 and read[0] <= n // 5, scans
    assert max(c for _, c in scans) >= n  # the statistics
    everything = within_intervals(zscore(ref), passes, ranges=0)
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, out.collect()))
