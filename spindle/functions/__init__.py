from spindle.functions.columns import (
    bracket_row,
    hours_since,
    phase_bucket,
    safe_zscore,
    strip_trailing_commas,
)

__all__ = ["bracket_row", "hours_since", "phase_bucket", "safe_zscore", "strip_trailing_commas"]
