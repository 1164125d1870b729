from shoprank.sources.readers import apply_casts, load, load_transactions
from shoprank.sources.sinks import read_stage, write_once, write_stage

__all__ = ["apply_casts", "load", "load_transactions", "read_stage", "write_once", "write_stage"]
