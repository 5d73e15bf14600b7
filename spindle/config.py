"""Job parameters.

The defaults are the constants of the original recording job and must keep
these values for results to match it (fixed values, stated in natural order):

    first kernel frequency      5
    last kernel frequency       200
    kernel width (taps)         2001
    phase buckets               75
    phase lower bound           -3141593   (micro-radians)
    phase upper bound           3141594    (one above +pi, so +pi lands in bucket 75)
    records per output file     7000000
    result filter               rat 'R192', session '2009-11-19'
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class JobConfig:
    first_frequency: int = 5
    last_frequency: int = 200
    kernel_width: int = 2001
    phase_buckets: int = 75
    phase_min: int = -3141593
    phase_max: int = 3141594
    records_per_file: int = 7_000_000
    result_rat: str = "R192"
    result_dt: str = "2009-11-19"

    @property
    def n_kernels(self) -> int:
        return self.last_frequency - self.first_frequency + 1


DEFAULT = JobConfig()

# Series keys of a recording: animal, session date, electrode channel.
SERIES_KEYS = ("rat", "dt", "channel")
