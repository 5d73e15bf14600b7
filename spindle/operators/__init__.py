from spindle.operators.convolution import (
    band_power_blocks,
    band_power_relational,
    fir_blocks,
    fir_relational,
)
from spindle.operators.index import count_bins, dense_index, order_violations, split_index
from spindle.operators.intervals import merged_bins, within_intervals
from spindle.operators.partitioned import band_power_partitioned, fir_partitioned
from spindle.operators.phase import phase_buckets, phase_profile, select_result
from spindle.operators.reference import (
    average_by_time_frequency,
    average_reference,
    average_reference_join,
    average_reference_window,
)
from spindle.operators.stats import group_stats, zscore

__all__ = [
    "band_power_blocks", "band_power_partitioned", "band_power_relational", "fir_blocks", "fir_partitioned", "fir_relational",
    "count_bins", "dense_index", "order_violations", "split_index",
    "merged_bins", "within_intervals",
    "phase_buckets", "phase_profile", "select_result",
    "average_by_time_frequency", "average_reference", "average_reference_join", "average_reference_window",
    "group_stats", "zscore",
]
