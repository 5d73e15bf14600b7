"""Text sources written to temp folders, and the sinks."""

import os

import pytest
from pyspark.sql import functions as F

from spindle.operators import band_power_blocks, band_power_relational
from spindle.sinks import write_power, write_text_result
from spindle.sources import (
    index_recordings,
    read_kernel_bank,
    read_passes,
    read_phase,
    read_power,
    read_recordings,
    unsorted_samples,
)


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_kernel_bank_good_and_surplus(spark, tmp_path):
    p = str(tmp_path / "bank.dat")
    write(p, ["1,2,3,4", "-5,6,7,8,99", "9,10,11,12,", "0,0,0,1"])  # surplus taps ignored, trailing comma ok
    bank = read_kernel_bank(spark, p, first_frequency=5, last_frequency=7, width=4)
    got = sorted(tuple(r) for r in bank.collect())
    assert len(got) == 12 and (6, 0, -5) in got and (7, 3, 12) in got
    assert dict(bank.dtypes)["h"] == "smallint"


def test_kernel_bank_rejects_short(spark, tmp_path):
    p = str(tmp_path / "short.dat")
    write(p, ["1,2,3,4", "1,2,3"])
    with pytest.raises(ValueError, match="fewer than 4 taps"):
        read_kernel_bank(spark, p, first_frequency=5, last_frequency=6, width=4)
    with pytest.raises(ValueError, match="missing"):
        read_kernel_bank(spark, p, first_frequency=5, last_frequency=7, width=3)


def test_kernel_bank_strict_parse(spark, tmp_path):
    p = str(tmp_path / "bad.dat")
    write(p, ["1,2,x,4"])
    with pytest.raises(Exception):
        read_kernel_bank(spark, p, first_frequency=5, last_frequency=5, width=4).collect()


@pytest.fixture()
def recordings_dir(tmp_path):
    d = tmp_path / "rec"
    write(str(d / "R192-2009-11-19-CSC10a.csv"),
          [" 100 , 1.5", "101,2,", "102,", "103,4,5", "104,-2", "104,3", "106,7", "107,1", "108,0", "109,2"])
    write(str(d / "R7-2010-01-02-CSC3.csv"), ["5,1", "6,2", "4,3", "7,4"])  # decreasing timestamp
    return str(d)


def test_recordings_parse_and_keys(spark, recordings_dir):
    rec = read_recordings(spark, recordings_dir)
    a = rec.filter(F.col("rat") == "R192").orderBy("_block", "_pos").collect()
    assert {(r["dt"], r["channel"]) for r in a} == {("2009-11-19", "10a")}
    assert [r["time"] for r in a] == [100, 101, 104, 104, 106, 107, 108, 109]  # '102,' and '103,4,5' dropped
    assert a[0]["voltage"] == 1.5
    b = rec.filter(F.col("rat") == "R7").select("dt", "channel").distinct().collect()
    assert [tuple(r) for r in b] == [("2010-01-02", "3")]


def test_unsorted_samples(spark, recordings_dir):
    bad = unsorted_samples(read_recordings(spark, recordings_dir)).collect()
    assert [(r["prev_time"], r["time"]) for r in bad] == [(6, 4)]  # equal timestamps are allowed


def test_recordings_to_power(spark, recordings_dir):
    rec = read_recordings(spark, recordings_dir).withColumn("v", F.col("voltage").cast("double"))
    sig = index_recordings(rec, bin_width=3)
    idx = [(r["time"], r["i"]) for r in sig.filter(F.col("rat") == "R192").orderBy("i").collect()]
    assert [i for _, i in idx] == list(range(8)) and [t for t, _ in idx][:4] == [100, 101, 104, 104]
    bank = spark.createDataFrame([(5, 0, 1.0), (5, 1, 1.0), (5, 2, 1.0)], "frequency int, u int, h double")
    a = sorted(tuple(r) for r in band_power_relational(sig, bank, ["rat", "dt", "channel"]).collect())
    b = sorted(tuple(r) for r in band_power_blocks(sig, bank, ["rat", "dt", "channel"], block=3).collect())
    assert a == b and len(a) == 6 + 2
    assert a[0][3] == 104 and a[0][5] == pytest.approx((1.5 + 2 - 2) ** 2)


def test_passes_and_phase_files(spark, tmp_path):
    p = str(tmp_path / "passes.csv")
    write(p, ["1,5", " 3 , 9 ,extra", "20,20"])
    assert sorted(tuple(r) for r in read_passes(spark, p).collect()) == [(1, 5), (3, 9), (20, 20)]
    q = str(tmp_path / "phase.csv")
    write(q, ["1,-3141593", "2,0", "3,3141593", "3,3141594"])
    ph = read_phase(spark, q)
    assert dict(ph.dtypes) == {"time": "bigint", "phase": "int"} and ph.count() == 4


def test_passes_strict_short_line(spark, tmp_path):
    p = str(tmp_path / "p.csv")
    write(p, ["1"])
    with pytest.raises(Exception):
        read_passes(spark, p).collect()
    assert read_passes(spark, p, strict=False).count() == 0


def test_power_table_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(t, 5, float(t), "R192", "2009-11-19", "10a") for t in range(50)],
                               "time bigint, frequency int, convolution float, rat string, dt string, channel string")
    out = str(tmp_path / "rats")
    write_power(df, out, records_per_file=7)
    write_power(df, out, records_per_file=7)  # append, as the original per-chunk flush
    back = read_power(spark, out)
    assert dict(back.dtypes)["dt"] == "string" and back.count() == 100
    files = [f for f in back.inputFiles()]
    assert len(files) >= 100 // 7
    pruned = back.filter((F.col("rat") == "R192") & (F.col("dt") == "2009-11-19"))
    assert "PartitionFilters: [isnotnull(rat" in pruned._jdf.queryExecution().executedPlan().toString() or \
        "PartitionFilters" in pruned._jdf.queryExecution().executedPlan().toString()


def test_text_result_single_file(spark, tmp_path):
    df = spark.createDataFrame([(5, 1, 0.5), (6, 75, -1.25)], "frequency int, phaserange int, convolution float")
    out = str(tmp_path / "resultspark")
    write_text_result(df, out)
    parts = [f for f in os.listdir(out) if f.startswith("part-")]
    assert len(parts) == 1
    assert sorted(open(os.path.join(out, parts[0])).read().split()) == ["[5,1,0.5]", "[6,75,-1.25]"]


def test_parse_records_and_observed_counts(spark, recordings_dir, tmp_path):
    from pyspark.sql import Observation

    from spindle.sources import parse_records, read_lines, record_text
    p = str(tmp_path / "ints" / "R1-2024-01-01-CSCa.csv")
    write(p, ["1,2", "3,-4,", "5,", "6,7,8", " 9 , 10 "])
    recs = parse_records(read_lines(spark, p))
    assert dict(recs.dtypes)["voltage"] == "smallint"
    assert sorted(tuple(r) for r in recs.collect() if r["time"] is not None) == [(1, 2), (3, -4), (9, 10)]
    assert recs.filter("time IS NULL AND voltage IS NULL").count() == 2
    with pytest.raises(Exception):
        parse_records(read_lines(spark, recordings_dir)).collect()  # '1.5' is not a SMALLINT
    obs = Observation("load")
    df = read_recordings(spark, recordings_dir, observation=obs)
    n = df.count()
    assert obs.get == {"lines": 14, "samples": n}
    assert spark.range(1).select(record_text(F.lit(5), F.lit(7)).alias("t")).first()["t"] == "5--7"


def test_csv_dump_and_avro_gate(spark, tmp_path):
    from spindle.sinks import avro_available, write_avro, write_csv
    df = spark.createDataFrame([(1, 5, 0.5)], "time bigint, frequency int, convolution float")
    out = str(tmp_path / "ratrecordstext")
    write_csv(df, out)
    assert [tuple(r) for r in spark.read.csv(out, schema=df.schema).collect()] == [(1, 5, 0.5)]
    if not avro_available(df):
        with pytest.raises(RuntimeError, match="spark-avro"):
            write_avro(df, str(tmp_path / "avro"))


def test_scratch_paths_live_under_checkpoint_dir(spark):
    from spindle.session import checkpoint_dir, materialize, scratch_path
    base = checkpoint_dir(spark)
    p = scratch_path(spark, "x")
    assert p.startswith(base.rstrip("/")) and p != scratch_path(spark, "x")
    df = spark.range(10).withColumnRenamed("id", "n")
    m = materialize(df, "m")
    assert sorted(r[0] for r in m.collect()) == list(range(10))
    def norm(x):
        return "/" + x.replace("file:", "").lstrip("/")
    assert all(norm(f).startswith(norm(base).rstrip("/")) for f in m.inputFiles())
