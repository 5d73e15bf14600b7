"""Streaming ingest equals the batch path; replaying files changes nothing."""

import os
import shutil
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators import band_power_relational
from spindle.sources import index_recordings, read_power, read_recordings
from spindle.streaming import ingest_recordings


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_ingest_matches_batch(spark, tmp_path):
    src = tmp_path / "incoming"
    write(str(src / "R1-2024-01-01-CSCa.csv"), [f"{100 + t},{(t * 37) % 11 - 5}" for t in range(40)])
    write(str(src / "R2-2024-01-02-CSCb.csv"), [f"{t},{(t * 13) % 7}" for t in range(25)])
    bank = spark.createDataFrame([(5, u, h) for u, h in enumerate([1, -2, 3])] + [(6, u, h) for u, h in enumerate([2, 0, 1])],
                                 "frequency int, u int, h smallint")
    out, ck = str(tmp_path / "rats"), str(tmp_path / "ck")
    q = ingest_recordings(spark, str(src), out, bank, bin_width=8, checkpoint=ck)
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in read_power(spark, out)
                 .select("rat", "dt", "channel", "time", "frequency", "convolution").collect())
    rec = read_recordings(spark, str(src)).withColumn("v", F.col("voltage").cast("double"))
    want = sorted(tuple(r) for r in band_power_relational(index_recordings(rec, 8), bank, ["rat", "dt", "channel"])
                  .select("rat", "dt", "channel", "time", "frequency", "convolution").collect())
    assert [g[:5] for g in got] == [w[:5] for w in want] and len(got) == (38 + 23) * 2
    assert all(abs(g[5] - w[5]) <= 1e-4 * max(1.0, abs(w[5])) for g, w in zip(got, want))  # float samples: FFT round-off

    # A new series arrives: the others stay. A known file under a new name goes back in time: the query stops.
    write(str(src / "R3-2024-01-03-CSCc.csv"), [f"{t},{t % 3}" for t in range(10)])
    q = ingest_recordings(spark, str(src), out, bank, bin_width=8, checkpoint=ck)
    q.awaitTermination(120)
    again = read_power(spark, out)
    assert again.filter("rat = 'R1'").count() == 38 * 2 and again.filter("rat = 'R3'").count() == 8 * 2
    shutil.copy(str(src / "R1-2024-01-01-CSCa.csv"), str(src / "R1-2024-01-01-CSCa.csv.copy"))
    q = ingest_recordings(spark, str(src), out, bank, bin_width=8, checkpoint=ck)
    with pytest.raises(Exception, match="arrived after"):
        q.awaitTermination(120)


def test_series_over_several_batches(spark, tmp_path):
    """Two files of one series, one file a trigger, 4 taps: 37 outputs, also when the second batch is replayed."""
    src, out, ck = tmp_path / "in", str(tmp_path / "power"), str(tmp_path / "ck")
    x = [(t * 37) % 23 - 11 for t in range(40)]
    write(str(src / "R1-2024-01-01-CSCa.csv"), [f"{t},{x[t]}" for t in range(20)])
    time.sleep(1.1)  # the file source orders by modification time
    write(str(src / "late" / "R1-2024-01-01-CSCa.csv"), [f"{t},{x[t]}" for t in range(20, 40)])
    bank = spark.createDataFrame([(5, u, h) for u, h in enumerate([1, -2, 3, 2])], "frequency int, u int, h smallint")
    want = [(t, float(y) ** 2) for t, y in zip(range(3, 40), np.convolve(x, [1, -2, 3, 2], "valid"))]

    def rows():
        return sorted((r["time"], r["convolution"]) for r in read_power(spark, out).collect())

    def run():
        q = ingest_recordings(spark, str(src), out, bank, checkpoint=ck, max_files_per_trigger=1, integer_samples=True)
        q.awaitTermination(120)

    run()
    assert rows() == want
    os.remove(os.path.join(ck, "commits", "1"))  # as if the second batch had failed after writing
    crc = os.path.join(ck, "commits", ".1.crc")
    if os.path.exists(crc):
        os.remove(crc)
    run()
    assert rows() == want
