"""Ranking metrics over long recommendation lists `(user, item, pos)` and truth `(user, item)`.

Lists are cut to the first k positions before repeated items are dropped. Whoever belongs to the
population without predictions or purchases counts as 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoprank.schema import Columns

METRICS = ("map", "ndcg", "hit_rate", "precision", "recall", "mrr")


def user_scores(recs: DataFrame, truth: DataFrame, k: int = 12, population: DataFrame | None = None,
                cols: Columns = Columns(), keys: Sequence[str] = ()) -> DataFrame:
    """One row per user: `ap, ndcg, hit, precision, recall, rr, n_pred, n_true`.

    Lists, truth and population are stacked and summed per pair, then per user: two aggregations
    that combine before the shuffle and no join. What is kept per user is at most k hit positions.
    `keys` (a fold, an arm) are carried along with the user.
    """
    group = [*keys, cols.user]
    none_int, none_item = F.lit(None).cast("int"), F.lit(None).cast(recs.schema[cols.item].dataType)
    shown = recs.filter(F.col("pos") <= k).select(
        *group, cols.item, F.col("pos").cast("int").alias("pos"), F.lit(0).alias("bought"), F.lit(0).alias("member"))
    bought = truth.select(*group, cols.item, none_int.alias("pos"), F.lit(1).alias("bought"), F.lit(0).alias("member"))
    rows = shown.unionByName(bought)
    if population is not None:
        rows = rows.unionByName(population.select(
            *group, none_item.alias(cols.item), none_int.alias("pos"), F.lit(0).alias("bought"), F.lit(1).alias("member")))
    pairs = rows.groupBy(*group, cols.item).agg(
        F.min("pos").alias("pos"), F.count("pos").alias("shown"), F.max("bought").alias("bought"),
        F.max("member").alias("member"))
    hit_at = F.when(F.col("bought") == 1, F.col("pos"))
    users = pairs.groupBy(*group).agg(
        F.sum("shown").alias("n_pred"), F.sum("bought").alias("n_true"), F.max("member").alias("member"),
        F.array_sort(F.collect_list(hit_at)).alias("hits"))
    users = users.filter(F.col("n_pred") > 0) if population is None else users.filter(F.col("member") == 1)

    ideal = [0.0]
    for i in range(1, k + 1):
        ideal.append(ideal[-1] + 1.0 / math.log2(i + 1))
    reachable = F.least(F.col("n_true"), F.lit(k))
    best = F.element_at(F.array(*[F.lit(v) for v in ideal]), (reachable + 1).cast("int"))

    def total(terms):
        return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)

    gained = total(F.transform("hits", lambda p, i: (i + 1) / p))
    discounted = total(F.transform("hits", lambda p: 1.0 / F.log2(p + 1)))
    n_hits = F.size("hits")

    def share(value, of):
        return F.when(of > 0, value / of).otherwise(F.lit(0.0))

    return users.select(
        *group, share(gained, reachable).alias("ap"), share(discounted, best).alias("ndcg"),
        (n_hits > 0).cast("double").alias("hit"), share(n_hits, F.col("n_pred")).alias("precision"),
        share(n_hits, F.col("n_true")).alias("recall"),
        F.when(n_hits > 0, 1.0 / F.get("hits", F.lit(0))).otherwise(F.lit(0.0)).alias("rr"),
        "n_pred", "n_true")


def mean_scores(scores: DataFrame, *keys: str) -> DataFrame:
    """Means of the per-user scores, overall or per key; an empty population gives 0."""
    source = dict(zip(METRICS, ("ap", "ndcg", "hit", "precision", "recall", "rr")))
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(m) for m, c in source.items()]
    sizes = [F.count("*").alias("customers"), F.count_if(F.col("n_true") > 0).alias("buyers")]
    return scores.groupBy(*keys).agg(*sizes, *means)


def _single(recs, truth, k, population, cols, column, name):
    return user_scores(recs, truth, k, population, cols).agg(F.coalesce(F.avg(column), F.lit(0.0)).alias(name))


def mapk(recs, truth, k=12, population=None, cols=Columns()) -> DataFrame:
    return _single(recs, truth, k, population, cols, "ap", "mapk")


def ndcg_at_k(recs, truth, k=12, population=None, cols=Columns()) -> DataFrame:
    return _single(recs, truth, k, population, cols, "ndcg", "ndcg")


def precision_at_k(recs, truth, k=12, population=None, cols=Columns()) -> DataFrame:
    return _single(recs, truth, k, population, cols, "precision", "precision")


def recall_at_k(recs, truth, k=12, population=None, cols=Columns()) -> DataFrame:
    """Averaged over the users who bought something, unless a population is given."""
    population = truth.select(cols.user).distinct() if population is None else population
    return _single(recs, truth, k, population, cols, "recall", "recall")


def mrr_at_k(recs, truth, k=12, population=None, cols=Columns()) -> DataFrame:
    return _single(recs, truth, k, population, cols, "rr", "mrr")


def hit_rate_at_k(recs, truth, k=12, population=None, cols=Columns()) -> DataFrame:
    return _single(recs, truth, k, population, cols, "hit", "hit_rate")


def hit_rate(candidates: DataFrame, truth: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Share of the true pairs among the candidates, before any list exists."""
    pair = [cols.user, cols.item]
    marked = (candidates.select(*pair, F.lit(1).alias("found"), F.lit(0).alias("bought"))
              .unionByName(truth.select(*pair, F.lit(0).alias("found"), F.lit(1).alias("bought"))))
    pairs = marked.groupBy(*pair).agg(F.max("found").alias("found"), F.max("bought").alias("bought"))
    share = F.try_divide(F.sum(F.col("found") * F.col("bought")), F.sum("bought"))
    return pairs.agg(F.coalesce(share, F.lit(0.0)).alias("hit_rate"))
