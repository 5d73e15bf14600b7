"""Kernel bank: text file, one line per frequency, comma-separated integer taps.

Line ``i`` (0-based, file order) holds the kernel of frequency
``first_frequency + i``. Only the first ``width`` taps of a line are used;
a line with fewer taps, or fewer lines than frequencies, is an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.config import DEFAULT
from spindle.functions.columns import strip_trailing_commas


def read_kernel_bank(spark: SparkSession, path: str, first_frequency: int = DEFAULT.first_frequency,
                     last_frequency: int = DEFAULT.last_frequency, width: int = DEFAULT.kernel_width,
                     strict: bool = True, validate: bool = True) -> DataFrame:
    """Long form (frequency INT, u INT, h SMALLINT) of a kernel bank file.

    The bank is a small file (K lines of W taps), so it is read whole to keep
    line numbers; ``validate`` checks its shape with one small aggregate.
    """
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n"))
                        .alias("line_no", "line"))
    lines = lines.select((F.col("line_no") + first_frequency).cast("int").alias("frequency"), "line") \
        .filter(F.col("frequency") <= last_frequency)
    taps = lines.select("frequency", F.posexplode(F.split(strip_trailing_commas("line"), ",")).alias("u", "tap"))
    cast = F.col("tap").cast("smallint") if strict else F.expr("try_cast(tap AS SMALLINT)")
    bank = taps.filter(F.col("u") < width).select("frequency", F.col("u").cast("int").alias("u"), cast.alias("h"))
    if validate:
        validate_bank(bank, first_frequency, last_frequency, width)
    return bank


def validate_bank(bank: DataFrame, first_frequency: int, last_frequency: int, width: int) -> None:
    """Raise if a frequency is missing or has fewer than ``width`` usable taps."""
    n = last_frequency - first_frequency + 1
    per = bank.groupBy("frequency").agg(F.count("h").alias("taps")).collect()  # <= n rows
    have = {r["frequency"]: r["taps"] for r in per}
    missing = [f for f in range(first_frequency, last_frequency + 1) if f not in have]
    if missing:
        raise ValueError(f"kernel bank has {len(have)} of {n} kernels; missing frequencies {missing[:5]}...")
    short = sorted(f for f, c in have.items() if c < width)
    if short:
        raise ValueError(f"kernels with fewer than {width} taps: frequencies {short[:5]}")


def kernel_width(bank: DataFrame) -> int:
    return int(bank.agg(F.max("u")).first()[0]) + 1


def bank_frequencies(bank: DataFrame) -> list[int]:
    """Frequencies of a bank in order (one integer per kernel); a (frequency, u) that occurs twice is an error."""
    per = bank.groupBy("frequency").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("d")).collect()
    if not per:
        raise ValueError("empty kernel bank")
    twice = sorted(r["frequency"] for r in per if r["n"] != r["d"])
    if twice:
        raise ValueError(f"kernels with a tap given twice: frequencies {twice[:5]}")
    return sorted(r["frequency"] for r in per)


def bank_slices(bank: DataFrame, max_cells: int = 1 << 22, max_kernels: int | None = None) -> list[list[int]]:
    """The frequencies of a bank cut into slices of at most ``max_cells`` taps (one kernel at least): a bank of any
    size is processed slice by slice. 4M taps are 32 MB, ten times the original 196 x 2001 bank."""
    freqs = bank_frequencies(bank)
    per = max(1, min(max_cells // kernel_width(bank), max_kernels or len(freqs)))
    return [freqs[k:k + per] for k in range(0, len(freqs), per)]


def bank_matrix(bank: DataFrame, frequencies: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, taps[K, W]) of a slice of a long-form bank, for shipping to tasks; W is the width of the whole bank."""
    freqs = bank_frequencies(bank) if frequencies is None else frequencies
    w = kernel_width(bank)
    rows = bank.where(F.col("frequency").between(freqs[0], freqs[-1])).select("frequency", "u", "h").collect()
    taps = np.zeros((len(freqs), w))
    at = {f: k for k, f in enumerate(freqs)}
    for r in rows:
        taps[at[r["frequency"]], r["u"]] = float(r["h"] or 0)
    return np.array(freqs, dtype=np.int32), taps
