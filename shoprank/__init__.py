"""Two-stage product recommendation and retail purchase analytics on Spark DataFrames."""

from shoprank.schema import Columns, FoldInputs, Settings

__all__ = ["Columns", "FoldInputs", "Settings"]
