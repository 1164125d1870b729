from shoprank.functions.columns import (
    age_band,
    days_between,
    log2_bucket,
    log2_label,
    price_tier,
    recency_band,
    unit_hash,
    week_of,
    weeks_before,
)
from shoprank.functions.session import checkpointed, ensure_checkpoint_dir, tune, written

__all__ = [
    "age_band", "checkpointed", "days_between", "ensure_checkpoint_dir", "log2_bucket",
    "log2_label", "price_tier", "recency_band", "tune", "unit_hash", "week_of", "weeks_before", "written",
]
