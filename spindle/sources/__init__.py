from spindle.sources.kernels import bank_frequencies, bank_matrix, bank_slices, kernel_width, read_kernel_bank, validate_bank
from spindle.sources.recordings import (
    filename_keys,
    index_recordings,
    parse_records,
    parse_signal,
    read_lines,
    record_text,
    read_recordings,
    unsorted_samples,
)
from spindle.sources.tables import read_passes, read_phase, read_power

__all__ = [
    "bank_frequencies", "bank_matrix", "bank_slices", "kernel_width", "read_kernel_bank", "validate_bank",
    "filename_keys", "index_recordings", "parse_records", "parse_signal", "record_text", "read_lines", "read_recordings", "unsorted_samples",
    "read_passes", "read_phase", "read_power",
]
