"""Recording-shaped inputs derived from the driver tables (whole tables).

* signal  - every ``events`` row is a sample: rat ``'R' || user_id % 2``,
            session ``'2024-01'``, channel = event type, time = whole hours
            since 2024-01-01, integer sample ``round(value * 100)``, index by
            (ts, event_id) inside the series. 10 series.
* bank    - one kernel per ``embeddings`` label: tap u is
            ``round(1000 * mean of embedding[u])`` over the label's vectors,
            frequency ``label + 5``. 10 kernels of 64 taps.
* passes  - ``[H, H + 2]`` for every event with ``value >= 200`` (overlaps
            and duplicates included).
* phase   - one phase per distinct hour H: ``(H * 1234567) % 6283187 - 3141593``.

Integer samples and taps keep every filter sum exact in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions.columns import hours_since
from spindle.operators.index import count_bins, dense_index

SERIES = ["rat", "dt", "channel"]
RESULT_RAT = "R0"
RESULT_DT = "2024-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("R"), (F.col("user_id") % 2).cast("string")).alias("rat"),
        F.lit(RESULT_DT).alias("dt"),
        F.col("event_type").alias("channel"),
        hours_since("ts").alias("time"),
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
        "ts", "event_id")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rat, dt, channel, time, i, v, event_id) - bins of about 10,000 samples for the index."""
    s = samples(spark, sf_dir)
    second = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    idx = dense_index(s, SERIES, ["ts", "event_id"], count_bins(s, SERIES, second), "i")
    return idx.select(*SERIES, "time", "i", "v", "event_id")


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frequency INT, u INT, h SMALLINT)."""
    emb = table(spark, sf_dir, "embeddings")
    taps = emb.select("label", F.posexplode("embedding").alias("u", "e"))
    return (taps.groupBy("label", "u").agg(F.avg("e").alias("m"))
            .select((F.col("label") + 5).cast("int").alias("frequency"), F.col("u").cast("int").alias("u"),
                    F.round(F.col("m") * 1000).cast("smallint").alias("h")))


def long_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernels four times as long: tap 64 g + u of a label is ``round(1000 * mean of embedding[u])`` over its vectors with
    ``vec_id % 4 = g``."""
    emb = table(spark, sf_dir, "embeddings")
    taps = emb.select("label", (F.col("vec_id") % 4).alias("g"), F.posexplode("embedding").alias("u", "e"))
    return (taps.groupBy("label", "g", "u").agg(F.avg("e").alias("m"))
            .select((F.col("label") + 5).cast("int").alias("frequency"), (F.col("g") * 64 + F.col("u")).cast("int").alias("u"),
                    F.round(F.col("m") * 1000).cast("smallint").alias("h")))


def wide(signal: DataFrame, bank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples of about 31 bits and taps of about 16, whose filtered values pass 2^53."""
    return (signal.withColumn("v", (F.col("v") * 30011 + F.col("event_id") % 30011).cast("bigint")),
            bank.withColumn("h", (F.col("h").cast("int") * 61 + F.col("u") % 61).cast("int")))


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    h = hours_since("ts")
    return ev.filter(F.col("value") >= 200).select(h.alias("lo"), (h + 2).alias("hi"))


def phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    hrs = ev.select(hours_since("ts").alias("time")).distinct()
    return hrs.select("time", ((F.col("time") * 1234567) % 6283187 - 3141593).cast("int").alias("phase"))
