from contactlift.functions.rowwise import (  # noqa: F401
    breakeven_cutoff,
    days_to_snapshot_end,
    finite_or_null,
    hash_key,
    hash_uniform,
    ieee_class,
    missing_to_null,
    row_max_narm,
    row_mean_narm,
    row_min_narm,
    row_sum_narm,
    safe_ratio,
)
