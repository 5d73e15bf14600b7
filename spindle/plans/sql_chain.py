"""The statistics as one SQL statement over temp views - the SQL entry point.

Inputs are registered as views with a per-call suffix (power table, pass
intervals, phase samples); the statement is a chain of CTEs equal to the
DataFrame chain in ``flagship`` (join-form reference, binned pass semi join,
z-score with NULL for sd = 0, phase buckets, mean per bucket). Passes are a
table of merged pieces joined on time bins, never text spliced into the statement.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spindle.config import DEFAULT
from spindle.operators.intervals import clip_intervals, mean_length, merged_bins, time_range

STATEMENT = """
WITH channel_keys AS (
  SELECT DISTINCT rat, dt, channel, time, frequency FROM {power}
), time_means AS (
  SELECT time, frequency, AVG(convolution) AS m FROM {power} GROUP BY time, frequency
), referenced AS (
  SELECT k.rat, k.dt, k.channel, k.time, k.frequency, t.m AS value
  FROM channel_keys k JOIN time_means t ON k.time = t.time AND k.frequency = t.frequency
), moments AS (
  SELECT rat, dt, channel, frequency,
         CAST(AVG(value) AS FLOAT) AS mu, CAST(STDDEV_POP(value) AS FLOAT) AS sigma
  FROM referenced GROUP BY rat, dt, channel, frequency
), scored AS (
  SELECT r.rat, r.dt, r.channel, r.time, r.frequency,
         CAST(try_divide(r.value - g.mu, g.sigma) AS FLOAT) AS z
  FROM referenced r
  JOIN moments g ON r.rat = g.rat AND r.dt = g.dt AND r.channel = g.channel AND r.frequency = g.frequency
  LEFT SEMI JOIN {passes} p ON CAST(FLOOR(r.time / :w) AS BIGINT) = p._bin AND r.time BETWEEN p._lo AND p._hi
), buckets AS (
  SELECT time, CAST(FLOOR((phase - :lo) / CAST(:span AS DOUBLE) * :n) + 1 AS INT) AS phaserange FROM {phase}
)
SELECT s.frequency, b.phaserange, CAST(AVG(s.z) AS FLOAT) AS convolution
FROM scored s JOIN buckets b ON s.time = b.time
WHERE s.rat = :rat AND s.dt = :dt
GROUP BY s.rat, s.dt, s.channel, s.frequency, b.phaserange
"""


def sql_result(spark: SparkSession, power: DataFrame, passes: DataFrame, phase: DataFrame,
               rat: str = DEFAULT.result_rat, dt: str = DEFAULT.result_dt) -> DataFrame:
    """(frequency, phaserange, convolution) of one rat and session, via SQL."""
    tag = uuid.uuid4().hex[:8]
    views = {"power": f"power_{tag}", "passes": f"passes_{tag}", "phase": f"phase_{tag}"}
    power.createOrReplaceTempView(views["power"])
    clipped = clip_intervals(passes, time_range(power) or (0, 0))
    width = mean_length(clipped)
    merged_bins(clipped, width).createOrReplaceTempView(views["passes"])
    phase.createOrReplaceTempView(views["phase"])
    args = {"w": width, "lo": DEFAULT.phase_min, "span": DEFAULT.phase_max - DEFAULT.phase_min,
            "n": DEFAULT.phase_buckets, "rat": rat, "dt": dt}
    return spark.sql(STATEMENT.format(**views), args=args)
