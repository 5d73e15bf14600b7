"""Power table (partitioned Parquet) and the small text inputs: passes and phase."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions.columns import strip_trailing_commas
from spindle.schemas import POWER_TABLE


def read_power(spark: SparkSession, path: str) -> DataFrame:
    """Power table with rat/dt/channel discovered from directories, all STRING; further partition folders (a stream's batches) are read through."""
    return spark.read.schema(POWER_TABLE).parquet(path).select(*POWER_TABLE.fieldNames())


def _two_fields(spark: SparkSession, path: str, first: str, second: str, kind: str, strict: bool) -> DataFrame:
    p = F.split(strip_trailing_commas("value"), ",")
    df = spark.read.text(path).select(p.alias("p"))
    if strict:  # a short line or a non-number raises, as the original parse did
        return df.select(F.trim(F.col("p")[0]).cast(kind).alias(first),
                         F.trim(F.col("p")[1]).cast(kind).alias(second))
    return df.select(F.expr(f"try_cast(trim(p[0]) AS {kind})").alias(first),
                     F.expr(f"try_cast(trim(try_element_at(p, 2)) AS {kind})").alias(second)).dropna()


def read_passes(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Closed intervals ``lo, hi`` (columns 0 and 1 of each line, others ignored)."""
    return _two_fields(spark, path, "lo", "hi", "bigint", strict)


def read_phase(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Phase samples ``time, phase`` (micro-radians)."""
    df = _two_fields(spark, path, "time", "phase", "bigint", strict)
    return df.select("time", F.col("phase").cast("int").alias("phase"))
