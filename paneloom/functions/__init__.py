from paneloom.functions.columns import (
    hash_rank_key,
    ieee_divide,
    missing_level,
    nan_to_null,
    slot_in,
)

__all__ = ["hash_rank_key", "ieee_divide", "missing_level", "nan_to_null", "slot_in"]
