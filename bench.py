"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3; the median is reported). Each query runs to
completion through the ``noop`` writer (full execution, nothing collected).
``queries`` has the whole time of each query; ``write`` and ``statistics`` split
it for those that write the power table first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spindle.plans import queries as Q  # noqa: E402
from spindle.session import local_session, remove_scratch  # noqa: E402

HEADLINE = [
    "band_power",
    "band_power_blocks",
    "average_reference",
    "average_reference_join",
    "average_reference_window",
    "within_passes",
    "within_passes_binned",
    "final_result",
    "final_result_window",
    "dft_prime_length",
    "dft_distributed",
]


written = [0.0]  # seconds spent writing power tables since the run began
_power_table = Q.flagship.power_table


def timed_power_table(*args, **kwargs):
    t = time.perf_counter()
    out = _power_table(*args, **kwargs)
    written[0] += time.perf_counter() - t
    return out


Q.flagship.power_table = timed_power_table


def run(spark, name, sf):
    """(seconds, of them writing the power table)"""
    written[0] = 0.0
    t = time.perf_counter()
    Q.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    t = time.perf_counter() - t
    remove_scratch(spark)
    return t, written[0]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16)
    # Warm-up: JIT of the JVM paths and the Python workers of the grouped maps.
    smoke = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    warm = smoke if os.path.isdir(smoke) else sf
    for name in ("final_result_streamed", "dft_prime_length", "band_power"):
        run(spark, name, warm)
    out, write, rest = {}, {}, {}
    for name in names:
        times = sorted(run(spark, name, sf) for _ in range(repeat))
        total, of_write = times[len(times) // 2]
        out[name] = round(total, 3)
        if of_write:
            write[name], rest[name] = round(of_write, 3), round(total - of_write, 3)
        print(f"# {name}: {times}", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf)
    print(json.dumps({"metric": "median_query_seconds_sum", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "write": write, "statistics": rest, "sf": float(m.group(1)) if m else sf, "cpus": cpus,
                      "repeat": repeat}))
    spark.stop()


if __name__ == "__main__":
    main()
