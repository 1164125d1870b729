"""One row per candidate with every source's rank, and the label-blind cap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoprank.operators.shared import top_per_group
from shoprank.schema import Columns


def union_candidates(parts: Mapping[str, DataFrame], cols: Columns = Columns()) -> DataFrame:
    """`<source>_rank` per source, null where the source did not find the pair.

    The sources are known, so one aggregation with a conditional minimum each does the pivot. A source lists a pair
    once, so adding up before the shuffle would only hold a task's rows in memory: they are dealt out by user first,
    where a user has at most the summed depth of the sources. Caps and lists per user then need no other shuffle.
    """
    stacked = reduce(DataFrame.unionByName, [p.select(cols.user, cols.item, "rank", "source") for p in parts.values()])
    stacked = stacked.repartition(cols.user)
    ranks = [F.min(F.when(F.col("source") == name, F.col("rank"))).alias(f"{name}_rank") for name in parts]
    return stacked.groupBy(cols.user, cols.item).agg(*ranks)


def source_flags(df: DataFrame, names: Sequence[str]) -> DataFrame:
    flags = {f"src_{n}": F.col(f"{n}_rank").isNotNull().cast("int") for n in names}
    total = reduce(lambda a, b: a + b, flags.values())
    return df.withColumns({**flags, "n_sources": total})


def cap_order(cols: Columns):
    """Most corroborated first. Nothing from the held-out weeks takes part."""
    return [F.col("n_sources").desc(), F.col(cols.item)]


def cap_per_customer(df: DataFrame, max_candidates: int | None, cols: Columns = Columns()) -> DataFrame:
    if max_candidates is None:
        return df
    return top_per_group(df, [cols.user], cap_order(cols), max_candidates, "_at").drop("_at")
