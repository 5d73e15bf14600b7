"""Raw recordings: text files of ``timestamp,voltage`` lines, one file per channel.

File names carry the series keys, e.g. ``R192-2009-11-19-CSC10a.csv`` is rat
``R192``, session ``2009-11-19``, channel ``10a`` (three characters after
the fourth dash are skipped).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spindle.functions.columns import strip_trailing_commas
from spindle.operators.index import dense_index, order_violations, split_index

# Fixed value: file-name layout <rat>-<yyyy>-<mm>-<dd>-<3 chars><channel>.<ext>
FILE_NAME_PATTERN = r"^([^-]*)-([^-]*-[^-]*-[^-]*)-...([^.]*)\."


def filename_keys(name: Column | str) -> list[Column]:
    c = F.col(name) if isinstance(name, str) else name
    known = F.when(c.rlike(FILE_NAME_PATTERN), c).otherwise(
        F.raise_error(F.concat(F.lit("no rat-yyyy-mm-dd-xxxchannel in the file name: "), F.coalesce(c, F.lit("NULL")))))
    return [F.regexp_extract(known, FILE_NAME_PATTERN, i).alias(k) for i, k in ((1, "rat"), (2, "dt"), (3, "channel"))]


def path_keys(path: Column | str) -> list[Column]:
    """rat/dt/channel from ``.../rat=R1/dt=2024-01-01/channel=a/...`` directories."""
    c = F.col(path) if isinstance(path, str) else path
    return [F.regexp_extract(c, f"/{k}=([^/]*)/", 1).alias(k) for k in ("rat", "dt", "channel")]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with the file name and a file-order position.

    Position is (start of the file split, running id inside the split): both
    are fixed by the file layout, so a re-run task sees the same values.
    """
    return spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"))


def parse_signal(lines: DataFrame, line: str = "line", strict: bool = True) -> DataFrame:
    """Keep lines with exactly two fields (trailing empty fields do not count)
    and parse ``time BIGINT, voltage FLOAT`` from the trimmed fields.

    ``strict`` raises on a field that is not a number (ANSI cast), otherwise
    such lines are dropped.
    """
    parts = F.split(strip_trailing_commas(line), ",")
    out = lines.withColumn("_parts", parts).filter(F.size("_parts") == 2)
    t, v = F.trim(F.col("_parts")[0]), F.trim(F.col("_parts")[1])
    if strict:
        out = out.withColumn("time", t.cast("bigint")).withColumn("voltage", v.cast("float"))
    else:
        out = (out.withColumn("time", F.expr("try_cast(trim(_parts[0]) AS BIGINT)"))
               .withColumn("voltage", F.expr("try_cast(trim(_parts[1]) AS FLOAT)"))
               .filter(F.col("time").isNotNull() & F.col("voltage").isNotNull()))
    return out.drop("_parts")


def parse_records(lines: DataFrame, line: str = "line") -> DataFrame:
    """Typed record per line: ``time BIGINT, voltage SMALLINT``, both NULL
    when the line does not have exactly two fields (kept as a NULL record,
    not dropped). A field that is not a number of that type raises."""
    parts = F.split(strip_trailing_commas(line), ",")
    ok = F.size(parts) == 2
    return lines.select(
        F.when(ok, F.trim(parts[0]).cast("bigint")).alias("time"),
        F.when(ok, F.trim(parts[1]).cast("smallint")).alias("voltage"))


def record_text(time: Column | str = "time", voltage: Column | str = "voltage") -> Column:
    """``time--voltage`` text of a record."""
    return F.concat_ws("--", F.col(time) if isinstance(time, str) else time,
                       F.col(voltage) if isinstance(voltage, str) else voltage)


def read_recordings(spark: SparkSession, path: str, strict: bool = True,
                    observation: Observation | None = None) -> DataFrame:
    """All recording files under ``path`` as (rat, dt, channel, time, voltage, file_path, _block, _pos).

    With ``observation``, the number of lines read and samples kept are
    collected as metrics of the first action (no extra pass).
    """
    lines = read_lines(spark, path)
    if observation is not None:
        lines = lines.observe(observation, F.count(F.lit(1)).alias("lines"),
                              F.sum((F.size(F.split(strip_trailing_commas("line"), ",")) == 2).cast("int"))
                              .alias("samples"))
    parsed = parse_signal(lines, strict=strict)
    return parsed.select(*filename_keys("file_name"), "time", "voltage", "file_path", "_block", "_pos")


def unsorted_samples(recordings: DataFrame) -> DataFrame:
    """Samples whose timestamp is below the previous line's in the same file.

    Checked per file split (bounded) plus one boundary row per split.
    """
    return order_violations(recordings, ["file_path"], ["_block", "_pos"], "time", F.col("_block"))


def index_recordings(recordings: DataFrame, bin_width: int | None = None, keys=("rat", "dt", "channel")) -> DataFrame:
    """Dense 0-based sample index ``i`` per series in (time, file, file position) order, over ranges of the whole order, so that
    equal times are spread too. With ``bin_width`` (in time) bins of that width are numbered instead, without writing the rows."""
    order = ["time", "file_path", "_block", "_pos"]
    if bin_width is None:
        return split_index(recordings, list(keys), order)
    return dense_index(recordings, list(keys), order, F.floor(F.col("time") / F.lit(bin_width)), "i")
