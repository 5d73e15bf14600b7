"""Writers: partitioned power table, one-file text result, CSV dump, Avro when available."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from spindle.config import DEFAULT, SERIES_KEYS
from spindle.functions.columns import bracket_row


def write_power(df: DataFrame, path: str, mode: str = "append",
                records_per_file: int = DEFAULT.records_per_file) -> None:
    """Power rows into Parquet partitioned rat=/dt=/channel=, at most
    ``records_per_file`` rows per file. Each writing task holds one series
    block, so no repartition is needed before the write.

    ``mode="add"`` adds the series of ``df`` to an existing table and replaces
    those it already has (dynamic partition overwrite), so adding the same
    recording twice changes nothing."""
    w = df.write.partitionBy(*SERIES_KEYS).option("maxRecordsPerFile", records_per_file)
    if mode == "add":
        w.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        w.mode(mode).parquet(path)


def result_lines(df: DataFrame, cols=("frequency", "phaserange", "convolution")) -> DataFrame:
    """One ``[a,b,c]`` text line per row."""
    return df.select(bracket_row(*cols).alias("value"))


def write_text_result(df: DataFrame, path: str, cols=("frequency", "phaserange", "convolution")) -> None:
    """Single text file of ``[a,b,c]`` lines. Only for the small final result
    (one row per frequency and phase bucket): it is written by one task."""
    result_lines(df, cols).repartition(1).write.mode("errorifexists").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path)


def avro_available(df: DataFrame) -> bool:
    try:
        df.sparkSession._jvm.java.lang.Class.forName("org.apache.spark.sql.avro.AvroFileFormat")
        return True
    except Exception:
        return False


def write_avro(df: DataFrame, path: str) -> None:
    """Avro records (needs the external spark-avro package on the classpath)."""
    if not avro_available(df):
        raise RuntimeError("Avro sink needs the spark-avro package, which is not on the classpath")
    try:
        df.write.mode("errorifexists").format("avro").save(path)
    except AnalysisException as e:  # pragma: no cover - depends on deployment
        raise RuntimeError(f"Avro write failed: {e}") from e
