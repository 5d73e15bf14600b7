"""Snapshots of the power table: adds, replacements, later parts, killed and concurrent adds, and what is kept up under them."""

import os
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators import average_by_time_frequency, average_reference, band_power_relational, group_stats
from spindle.plans import flagship
from spindle.plans.job import load_into_store
from spindle.schemas import POWER_TABLE
from spindle.sources import index_recordings, read_recordings
from spindle.store import Conflict, PowerStore
from spindle.streaming import ingest_recordings

COLS = ["rat", "dt", "channel", "time", "frequency", "convolution"]


def power_df(spark, series, times, seed):
    rng = np.random.default_rng(seed)
    rows = [(float(rng.integers(0, 5000)), int(t), f, *s) for s in series for t in times for f in (5, 6)]
    return spark.createDataFrame([dict(zip(("convolution", "time", "frequency", "rat", "dt", "channel"), r)) for r in rows],
                                 POWER_TABLE)


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def check(snap, power):
    """Everything a store keeps up equals a full pass over the rows it should have."""
    assert rows(snap.power()) == rows(power)
    mean = {(r["time"], r["frequency"]): r["convolution"] for r in snap.means().collect()}
    want = {(r["time"], r["frequency"]): r["convolution"] for r in average_by_time_frequency(power).collect()}
    assert mean == pytest.approx(want)
    ref = average_reference(power)
    assert rows(snap.referenced()) == pytest.approx(rows(ref)) if not want else [r[:5] for r in rows(snap.referenced())] == [r[:5] for r in rows(ref)]
    key = lambda r: (r["rat"], r["dt"], r["channel"], r["frequency"])
    stats = {key(r): (r["mean"], r["sd"]) for r in snap.group_stats().collect()}
    full = {key(r): (r["mean"], r["sd"]) for r in group_stats(ref).collect()}
    assert stats.keys() == full.keys()
    for k in full:
        assert stats[k] == pytest.approx(full[k], rel=1e-6, abs=1e-5)


A, B, C = ("R1", "2024", "a"), ("R1", "2024", "b"), ("R2", "2024", "a")


def test_adds_and_a_replacement(spark, tmp_path):
    store = PowerStore(spark, str(tmp_path / "s"), bin_width=7)
    assert store.versions() == [] and store.snapshot().power().count() == 0 and store.snapshot().bounds() is None
    ab, c = power_df(spark, [A, B], range(30), 1), power_df(spark, [C], range(20, 50), 2)
    assert store.add(ab) == 1
    old = store.snapshot()
    check(old, ab)
    assert store.add(c) == 2
    check(store.snapshot(), ab.unionByName(c))
    again = power_df(spark, [B], range(5, 25), 3)  # shorter than what it replaces
    assert store.add(again) == 3
    now = ab.where("channel != 'b'").unionByName(c).unionByName(again)
    check(store.snapshot(), now)
    check(old, ab)  # a reader of version 1 still has it
    check(store.snapshot(2), ab.unionByName(c))
    assert store.snapshot().power(F.col("rat") == "R2").count() == 60
    assert store.compact() == 4
    check(store.snapshot(), now)
    assert store.add(power_df(spark, [A], [], 4)) == 5  # nothing to add
    check(store.snapshot(), now)
    assert store.vacuum(keep=1, older_than_s=-5) > 0
    assert store.versions() == [5]
    check(store.snapshot(), now)


def test_an_add_writes_only_the_times_it_has(spark, tmp_path):
    store = PowerStore(spark, str(tmp_path / "s"), bin_width=10)
    store.add(power_df(spark, [A, B], range(200), 1))
    store.add(power_df(spark, [C], range(43, 58), 2))
    name = store.snapshot().manifest["sums"][-1]
    last = spark.read.parquet(f"{store.path}/sums/add={name}").agg(F.min("time"), F.max("time")).first()
    assert tuple(last) == (43, 57)
    moments = spark.read.parquet(f"{store.path}/moments/add={name}")
    assert sorted(r["bin"] for r in moments.select("bin").distinct().collect()) == [4, 5]
    assert moments.select("rat", "channel").distinct().count() == 3


def test_later_parts_extend_a_series(spark, tmp_path):
    store = PowerStore(spark, str(tmp_path / "s"), bin_width=9)
    parts = [power_df(spark, [A], r, i) for i, r in enumerate((range(10), range(10, 25), range(25, 31)))]
    for p in parts:
        store.add(p, how="extend")
    check(store.snapshot(), parts[0].unionByName(parts[1]).unionByName(parts[2]))
    whole = power_df(spark, [A], range(4), 9)
    store.add(whole)  # replaces all parts
    check(store.snapshot(), whole)
    with pytest.raises(ValueError):
        store.add(whole, how="append")


def test_a_killed_add_leaves_no_trace(spark, tmp_path, monkeypatch):
    store = PowerStore(spark, str(tmp_path / "s"))
    store.add(power_df(spark, [A], range(5), 1))
    before = rows(store.snapshot().power())
    for stage in ("_sums", "_bins", "_commit"):
        with monkeypatch.context() as m:
            m.setattr(PowerStore, stage, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
            with pytest.raises(KeyboardInterrupt):
                store.add(power_df(spark, [A, B], range(9), 2))
        assert store.versions() == [1] and rows(store.snapshot().power()) == before
    assert store.vacuum(older_than_s=3600) == 0  # young folders may be somebody's add
    assert store.vacuum(older_than_s=-5) >= 3
    assert rows(store.snapshot().power()) == before


def test_a_reader_during_an_add_sees_before_or_after(spark, tmp_path, monkeypatch):
    store = PowerStore(spark, str(tmp_path / "s"))
    store.add(power_df(spark, [A], range(5), 1))
    before, seen = rows(store.snapshot().power()), []
    commit = PowerStore._commit

    def slow(self, manifest):
        seen.append(rows(PowerStore(spark, self.path).snapshot().power()))  # all folders written, nothing committed
        commit(self, manifest)
        seen.append(rows(PowerStore(spark, self.path).snapshot().power()))

    monkeypatch.setattr(PowerStore, "_commit", slow)
    store.add(power_df(spark, [A, C], range(7), 2))
    assert seen[0] == before and len(seen[1]) == 28 and not set(before) & set(seen[1])


def test_two_writers_at_once_are_both_added(spark, tmp_path, monkeypatch):
    store = PowerStore(spark, str(tmp_path / "s"))
    store.add(power_df(spark, [A], range(5), 1))
    derive, waited = PowerStore._derive, []

    def after_the_other(self, snap, *args):
        if not waited:
            waited.append(1)
            PowerStore(spark, self.path).add(power_df(spark, [C], range(3, 9), 3))  # takes the version this one wants
        return derive(self, snap, *args)

    monkeypatch.setattr(PowerStore, "_derive", after_the_other)
    assert store.add(power_df(spark, [B], range(4, 8), 2)) == 3
    check(store.snapshot(), power_df(spark, [A], range(5), 1).unionByName(power_df(spark, [B], range(4, 8), 2))
          .unionByName(power_df(spark, [C], range(3, 9), 3)))
    monkeypatch.undo()
    with ThreadPoolExecutor(3) as pool:  # each its own series
        list(pool.map(lambda i: PowerStore(spark, store.path).add(power_df(spark, [(f"T{i}", "2024", "x")], range(4), i)), range(3)))
    assert store.snapshot().version == 6 and store.snapshot().power().count() == 10 + 8 + 12 + 24


def test_a_version_is_made_once(spark, tmp_path):
    store = PowerStore(spark, str(tmp_path / "s"))
    store._commit({"version": 1, "who": "first"})
    with pytest.raises(Conflict):
        store._commit({"version": 1, "who": "second"})
    assert "first" in store.files.read(store._file(1))
    assert [n for n, _ in store.files.names(f"{store.path}/_versions") if "draft" in n and not n.endswith(".crc")] == []


def test_tokens_and_stale_bases(spark, tmp_path):
    store = PowerStore(spark, str(tmp_path / "s"))
    base = store.snapshot()
    assert store.add(power_df(spark, [A], range(5), 1), "extend", token=("stream", 0)) == 1
    assert store.add(power_df(spark, [A], range(5), 1), "extend", token=("stream", 0)) == 1
    assert store.add(power_df(spark, [A], range(5, 9), 1), "extend", token=("stream", 1), based_on=store.snapshot()) == 2
    assert store.snapshot().power().count() == 18
    with pytest.raises(Conflict, match="changed since version 0"):
        store.add(power_df(spark, [A], range(9, 12), 1), "extend", based_on=base)
    store.add(power_df(spark, [B], range(9, 12), 1), "extend", based_on=base)  # another series


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_job_and_stream_feed_one_store(spark, tmp_path):
    x = [(t * 37) % 23 - 11 for t in range(60)]
    src, store = tmp_path / "in", PowerStore(spark, str(tmp_path / "store"), bin_width=8)
    bank = spark.createDataFrame([(5, u, h) for u, h in enumerate([1, -2, 3, 2])], "frequency int, u int, h smallint")
    write(str(tmp_path / "rec" / "R1-2024-01-01-CSCa.csv"), [f"{t},{x[t]}" for t in range(20)])
    write(str(tmp_path / "rec" / "R2-2024-01-01-CSCa.csv"), [f"{t},{t % 5}" for t in range(30)])
    load_into_store(spark, str(tmp_path / "rec"), bank, store, integer_samples=True)
    write(str(src / "R1-2024-01-01-CSCa.csv"), [f"{t},{x[t]}" for t in range(20, 40)])
    ck = str(tmp_path / "ck")

    def run():
        q = ingest_recordings(spark, str(src), store.path, bank, checkpoint=ck, max_files_per_trigger=1, integer_samples=True, store=True)
        q.awaitTermination(120)
        if q.exception():
            raise q.exception()

    run()
    os.remove(os.path.join(ck, "commits", "0"))  # as if the batch had failed after its add
    if os.path.exists(os.path.join(ck, "commits", ".0.crc")):
        os.remove(os.path.join(ck, "commits", ".0.crc"))
    run()
    assert store.snapshot().version == 2
    write(str(tmp_path / "later" / "R1-2024-01-01-CSCa.csv"), [f"{t},{x[t]}" for t in range(40, 60)])
    load_into_store(spark, str(tmp_path / "later"), bank, store, how="extend", integer_samples=True)
    got = sorted((r["time"], r["convolution"]) for r in store.snapshot().power(F.col("rat") == "R1").collect())
    assert got == [(t, float(y) ** 2) for t, y in zip(range(3, 60), np.convolve(x, [1, -2, 3, 2], "valid"))]
    with pytest.raises(ValueError, match="arrived after"):
        load_into_store(spark, str(tmp_path / "later" / ".." / "rec"), bank, store, how="extend", integer_samples=True)


def test_result_from_the_store_equals_the_full_pass(spark, tmp_path):
    rng = np.random.default_rng(5)
    for ch in ("10a", "10b"):
        write(str(tmp_path / "rec" / f"R192-2009-11-19-CSC{ch}.csv"), [f"{1000 + 5 * t},{v}" for t, v in enumerate(rng.integers(-900, 900, 300))])
    write(str(tmp_path / "rec" / "R7-2010-01-02-CSC3.csv"), [f"{1000 + 5 * t},{t % 17}" for t in range(250)])
    bank = spark.createDataFrame([(f, u, int(h)) for f in (5, 6) for u, h in enumerate(rng.integers(-40, 40, 7))], "frequency int, u int, h int")
    passes = spark.createDataFrame([(1100, 1300), (1250, 1500), (2300, 2350)], "lo bigint, hi bigint")
    phase = spark.createDataFrame([(1000 + 5 * t, (t * 7919) % 6283187 - 3141593) for t in range(300)], "time bigint, phase int")
    store = PowerStore(spark, str(tmp_path / "store"), bin_width=100)
    load_into_store(spark, str(tmp_path / "rec"), bank, store, integer_samples=True)
    load_into_store(spark, str(tmp_path / "rec" / "R7*"), bank, store, integer_samples=True)
    rec = read_recordings(spark, str(tmp_path / "rec")).withColumn("v", F.col("voltage").cast("bigint"))
    power = band_power_relational(index_recordings(rec), bank, ["rat", "dt", "channel"])
    for who in (("R192", "2009-11-19"), ("R7", "2010-01-02"), ("R0", "none")):
        got = sorted(map(tuple, flagship.result_from_store(store.snapshot(), passes, phase, *who).collect()))
        want = sorted(map(tuple, flagship.result(power, passes, phase, *who).collect()))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-5, abs=1e-6)
