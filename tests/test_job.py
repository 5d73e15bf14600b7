"""The whole job from text files, against the same chain built by hand."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.config import JobConfig
from spindle.operators import band_power_relational
from spindle.plans import flagship
from spindle.plans.job import load_recordings, main, run_job, run_statistics
from spindle.sources import index_recordings, read_kernel_bank, read_passes, read_phase, read_recordings, unsorted_samples


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_job_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(1)
    d = tmp_path
    for ch in ("10a", "10b"):
        vals = rng.integers(-900, 900, 400)
        write(str(d / "rec" / f"R192-2009-11-19-CSC{ch}.csv"), [f"{1000 + 5 * t},{v}" for t, v in enumerate(vals)])
    write(str(d / "rec" / "R7-2010-01-02-CSC3.csv"), [f"{1000 + 5 * t},{t % 17}" for t in range(300)])
    cfg = JobConfig(first_frequency=5, last_frequency=8, kernel_width=7)
    write(str(d / "bank.dat"), [",".join(str(int(x)) for x in rng.integers(-40, 40, 9)) for _ in range(4)])
    write(str(d / "passes.csv"), ["1100,1500", "1400,1800,x", "2500,2600"])
    write(str(d / "phase.csv"), [f"{1000 + 5 * t},{(t * 7919) % 6283187 - 3141593}" for t in range(400)])
    res = run_job(spark, str(d / "rec"), str(d / "bank.dat"), str(d / "passes.csv"), str(d / "phase.csv"),
                  str(d / "rats"), str(d / "resultspark"), bin_width=50, config=cfg, integer_samples=True)
    got = sorted(tuple(r) for r in res.collect())
    # the same chain by hand, with the relational (exact) band power
    rec = read_recordings(spark, str(d / "rec")).withColumn("v", F.col("voltage").cast("bigint"))
    bank = read_kernel_bank(spark, str(d / "bank.dat"), 5, 8, 7)
    power = band_power_relational(index_recordings(rec, 50), bank, ["rat", "dt", "channel"])
    want = sorted(tuple(r) for r in flagship.result(power, read_passes(spark, str(d / "passes.csv")),
                                                    read_phase(spark, str(d / "phase.csv")), "R192", "2009-11-19").collect())
    assert got == want and len(got) > 0
    text = [f for f in os.listdir(d / "resultspark") if f.startswith("part-")]
    assert len(text) == 1 and len(open(d / "resultspark" / text[0]).read().split()) == len(got)
    assert sorted(x for x in os.listdir(d / "rats") if x.startswith("rat=")) == ["rat=R192", "rat=R7"]

    # the same recordings again, and another session added: the first result stays, the table grows
    again = run_job(spark, str(d / "rec"), str(d / "bank.dat"), str(d / "passes.csv"), str(d / "phase.csv"), str(d / "rats"),
                    config=cfg, integer_samples=True, mode="add")
    assert sorted(tuple(r) for r in again.collect()) == got
    with pytest.raises(Exception, match="already exists"):
        load_recordings(spark, str(d / "rec"), str(d / "bank.dat"), str(d / "rats"), config=cfg, integer_samples=True)
    write(str(d / "more" / "R8-2010-01-03-CSC1.csv"), [f"{1000 + 5 * t},{t % 13}" for t in range(300)])
    load_recordings(spark, str(d / "more"), str(d / "bank.dat"), str(d / "rats"), config=cfg, integer_samples=True, mode="add")
    both = run_statistics(spark, str(d / "rats"), str(d / "passes.csv"), str(d / "phase.csv"), "R192", "2009-11-19")
    rec = read_recordings(spark, [str(d / "rec"), str(d / "more")]).withColumn("v", F.col("voltage").cast("bigint"))
    power = band_power_relational(index_recordings(rec), bank, ["rat", "dt", "channel"])
    want = flagship.result(power, read_passes(spark, str(d / "passes.csv")), read_phase(spark, str(d / "phase.csv")), "R192", "2009-11-19")
    assert sorted(tuple(r) for r in both.collect()) == sorted(tuple(r) for r in want.collect()) != got


def test_job_refuses_disorder_and_strange_names(spark, tmp_path):
    cfg = JobConfig(first_frequency=5, last_frequency=5, kernel_width=2)
    write(str(tmp_path / "bank.dat"), ["1,2"])
    write(str(tmp_path / "rec" / "R1-2024-01-01-CSCa.csv"), ["1,5", "3,6", "2,7"])
    load = lambda **k: load_recordings(spark, str(tmp_path / "rec"), str(tmp_path / "bank.dat"), str(tmp_path / "p"), config=cfg, **k)
    with pytest.raises(ValueError, match="time 2 follows 3"):
        load()
    assert load(on_disorder="sort").count() == 2
    for name in ("session1.csv", "R1-2024-CSCa.csv"):
        write(str(tmp_path / name / name), ["1,2"])
        with pytest.raises(Exception, match=name):
            read_recordings(spark, str(tmp_path / name)).collect()


def test_equal_names_in_two_folders_are_one_series_in_time_order(spark, tmp_path):
    write(str(tmp_path / "rec" / "a" / "R1-2024-01-01-CSCa.csv"), ["1,1", "2,2", "2,3"])
    write(str(tmp_path / "rec" / "b" / "R1-2024-01-01-CSCa.csv"), ["2,4", "3,5"])
    rec = read_recordings(spark, str(tmp_path / "rec" / "*"))
    assert unsorted_samples(rec).count() == 0
    got = [r["voltage"] for r in index_recordings(rec).orderBy("i").collect()]
    assert got == [1, 2, 3, 4, 5]


def test_command_line_needs_rat_and_session():
    with pytest.raises(SystemExit):
        main(["--passes", "p", "--phase", "p", "--power-table", "t", "--result", "r"])
