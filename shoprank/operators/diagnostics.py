"""What the retrieval sources contribute and what a cap would cost.

Every report is one pass: candidates joined once with the held-out pairs, counted per user, then
counted over users. `keys` (a fold) may be carried through any of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoprank.operators.union import cap_order
from shoprank.schema import Columns


def rank_columns(candidates: DataFrame) -> list[str]:
    return [c for c in candidates.columns if c.endswith("_rank")]


def _with_hits(candidates: DataFrame, truth: DataFrame, cols: Columns, keys: Sequence[str]) -> DataFrame:
    pair = [*keys, cols.user, cols.item]
    # dealt out by user like the united candidates, which then stay where they are
    bought = truth.select(*pair).repartition(cols.user).distinct().withColumn("hit", F.lit(True))
    return candidates.join(bought, pair, "left").fillna({"hit": False})


def _truth_size(truth: DataFrame, cols: Columns, keys: Sequence[str]) -> DataFrame:
    pairs = truth.select(*keys, cols.user, cols.item).distinct()
    return pairs.groupBy(*keys).agg(F.count("*").alias("n_truth"))


def _attach_size(df: DataFrame, truth: DataFrame, cols: Columns, keys: Sequence[str]) -> DataFrame:
    size = _truth_size(truth, cols, keys)
    if keys:
        return df.join(size, list(keys), "left")
    return df.withColumn("n_truth", size.scalar())


def _percent(part, whole):
    return F.try_divide(F.lit(100.0) * part, whole)


def per_source_report(candidates: DataFrame, truth: DataFrame, cols: Columns = Columns(),
                      customers: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, users, hits and recall per source and for the union.

    Sources overlap, so their recalls do not add up. With `customers` the share of all customers
    who got any candidate from the source is added.
    """
    ranks = rank_columns(candidates)
    names = [c.removesuffix("_rank") for c in ranks] + ["UNION"]
    found = [F.col(c).isNotNull() for c in ranks] + [F.lit(True)]
    joined = _with_hits(candidates.select(*keys, cols.user, cols.item, *ranks), truth, cols, keys)
    per_user = joined.groupBy(*keys, cols.user).agg(
        *[F.count_if(f).alias(f"c{i}") for i, f in enumerate(found)],
        *[F.count_if(f & F.col("hit")).alias(f"h{i}") for i, f in enumerate(found)])
    entries = F.array(*[F.struct(F.lit(n).alias("source"), F.col(f"c{i}").alias("c"), F.col(f"h{i}").alias("h"))
                        for i, n in enumerate(names)])
    report = (per_user.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")
              .groupBy(*keys, "source").agg(F.sum("c").alias("candidates"), F.count_if(F.col("c") > 0).alias("customers"),
                                            F.sum("h").alias("hits")))
    report = _attach_size(report, truth, cols, keys).select(
        *keys, "source", "candidates", "customers",
        F.try_divide(F.col("candidates"), F.col("customers")).alias("cands_per_customer"), "hits",
        _percent(F.col("hits"), F.col("n_truth")).alias("recall_pct"))
    if customers is not None:
        total = customers.select(cols.user).distinct().agg(F.count("*")).scalar()
        report = report.withColumn("customer_coverage_pct", _percent(F.col("customers"), total))
    return report


def rank_sweep(candidates: DataFrame, truth: DataFrame, ks: Sequence[int] = (10, 25, 50, 100),
               cols: Columns = Columns(), keys: Sequence[str] = ()) -> DataFrame:
    """Recall of each source cut at rank <= K, for all sources and depths at once."""
    ranks = rank_columns(candidates)
    grid = [(c, k) for c in ranks for k in ks]
    joined = _with_hits(candidates.select(*keys, cols.user, cols.item, *ranks), truth, cols, keys)
    counts = joined.filter("hit").groupBy(*keys).agg(
        *[F.count_if((F.col(c) <= k) & F.col("hit")).alias(f"n{i}") for i, (c, k) in enumerate(grid)])
    entries = F.array(*[F.struct(F.lit(c.removesuffix("_rank")).alias("source"), F.lit(k).alias("k"),
                                 F.col(f"n{i}").alias("hits")) for i, (c, k) in enumerate(grid)])
    long = counts.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")
    return _attach_size(long, truth, cols, keys).select(
        *keys, "source", "k", "hits", _percent(F.col("hits"), F.col("n_truth")).alias("recall_pct"))


def cap_sweep(candidates: DataFrame, truth: DataFrame, caps: Sequence[int | None] = (60, 120, 180, None),
              cols: Columns = Columns(), keys: Sequence[str] = ()) -> DataFrame:
    """Volume and recall at several per-customer caps; None stands for no cap.

    A user's candidates number at most the summed depth of the sources, so the window is small.
    """
    window = Window.partitionBy(*keys, cols.user).orderBy(*cap_order(cols))
    joined = _with_hits(candidates.select(*keys, cols.user, cols.item, "n_sources"), truth, cols, keys)
    placed = joined.withColumn("_at", F.row_number().over(window))
    inside = [F.lit(True) if cap is None else F.col("_at") <= cap for cap in caps]
    counts = placed.groupBy(*keys).agg(
        F.count_if(F.col("_at") == 1).alias("customers"),
        *[F.count_if(i).alias(f"r{n}") for n, i in enumerate(inside)],
        *[F.count_if(i & F.col("hit")).alias(f"h{n}") for n, i in enumerate(inside)])
    entries = F.array(*[F.struct(F.lit("uncapped" if cap is None else str(cap)).alias("cap"), F.col(f"r{n}").alias("rows"),
                                 F.col(f"h{n}").alias("hits")) for n, cap in enumerate(caps)])
    long = counts.select(*keys, "customers", F.explode(entries).alias("e")).select(*keys, "customers", "e.*")
    return _attach_size(long, truth, cols, keys).select(
        *keys, "cap", "rows", F.try_divide(F.col("rows"), F.col("customers")).alias("cands_per_customer"), "hits",
        _percent(F.col("hits"), F.col("n_truth")).alias("recall_pct"))


def across_folds(per_fold: DataFrame, index: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over folds of a report that carries a `fold` column."""
    return per_fold.groupBy(*index).agg(
        F.count("*").alias("folds"),
        *[f(v).alias(f"{v}_{tag}") for v in values for f, tag in ((F.avg, "mean"), (F.stddev, "sd"))])
