"""Column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindle.config import DEFAULT


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def phase_bucket(phase: Column | str, lo: int = DEFAULT.phase_min, hi: int = DEFAULT.phase_max,
                 n: int = DEFAULT.phase_buckets) -> Column:
    """Bucket number ``floor((p - lo) / (hi - lo) * n) + 1`` as INT.

    With the default bounds -pi (in micro-radians) lands in bucket 1 and +pi in
    bucket ``n``; values outside the range extrapolate (<= 0 or > n) instead of
    being clamped.
    """
    p = _col(phase).cast("double")
    return (F.floor(((p - F.lit(lo)) / F.lit(float(hi - lo))) * F.lit(n)) + F.lit(1)).cast("int")


def safe_zscore(value: Column | str, mean: Column | str, sd: Column | str) -> Column:
    """``(value - mean) / sd`` as FLOAT; NULL when sd is 0 (skipped by AVG)."""
    return F.try_divide(_col(value) - _col(mean), _col(sd)).cast("float")


def strip_trailing_commas(line: Column | str) -> Column:
    """Drop trailing empty fields so that ``split`` counts fields like Java's
    ``String.split``: ``'1,2,'`` has 2 fields, ``'1,'`` has 1."""
    return F.regexp_replace(_col(line), ",+$", "")


def bracket_row(*cols: Column | str) -> Column:
    """Text form ``[a,b,c]`` of a row; a NULL field is written ``null``, so every row keeps its fields."""
    fields = [F.coalesce(_col(c).cast("string"), F.lit("null")) for c in cols]
    return F.concat(F.lit("["), F.concat_ws(",", *fields), F.lit("]"))


def hours_since(ts: Column | str, origin_date: str = "2024-01-01") -> Column:
    """Whole hours from midnight of ``origin_date`` to a TIMESTAMP_NTZ.

    Built from the calendar fields (days * 24 + hour), so it does not depend
    on the session time zone or daylight saving.
    """
    t = _col(ts)
    return (F.date_diff(F.to_date(t), F.lit(origin_date).cast("date")).cast("bigint") * 24
            + F.hour(t)).cast("bigint")
