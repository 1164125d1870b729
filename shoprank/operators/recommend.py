"""From scores to lists, and lists against the held-out weeks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoprank.functions.columns import unit_hash, weeks_before
from shoprank.functions.session import written
from shoprank.operators.metrics import mean_scores, user_scores
from shoprank.operators.shared import as_list, bestsellers, top_per_group
from shoprank.schema import Columns, FoldInputs

# The five numbers of an accuracy table.
ACCURACY = ("map", "ndcg", "hit_rate", "precision", "recall")


def score_with(model, features: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """`(user, item, score)` from a fitted ranker, in the JVM."""
    return model.transform(features).select(cols.user, cols.item, F.col("score").cast("double").alias("score"))


def score_in_python(predict: Callable, features: DataFrame, columns: Sequence[str],
                    cols: Columns = Columns()) -> DataFrame:
    """The same for a ranker that only lives in Python: `predict(frame)` per Arrow batch."""
    user, item, names = cols.user, cols.item, list(columns)
    types = features.schema
    ddl = f"{user} {types[user].dataType.simpleString()}, {item} {types[item].dataType.simpleString()}, score double"

    def run(batches):
        for batch in batches:
            yield batch[[user, item]].assign(score=predict(batch[names]))

    return features.select(user, item, *names).mapInPandas(run, ddl)


def top_k(scored: DataFrame, k: int = 12, users: DataFrame | None = None, cols: Columns = Columns()) -> DataFrame:
    """The k best items per user as `(user, item, pos)`; equal scores are ordered by item."""
    if users is not None:
        scored = scored.join(users.select(cols.user).distinct(), cols.user, "left_semi")
    best = top_per_group(scored, [cols.user], [F.col("score").desc(), F.col(cols.item)], k, "pos")
    return best.select(cols.user, cols.item, "pos")


def to_lists(recs: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """One row per user with the ordered array `items`. For sinks; reports use the long form."""
    entries = F.array_sort(F.collect_list(F.struct("pos", cols.item)))
    return recs.groupBy(cols.user).agg(F.transform(entries, lambda e: e[cols.item]).alias("items"))


def sample_customers(features: DataFrame, n: int, seed: int = 42, cols: Columns = Columns(), buckets: int = 1024) -> DataFrame:
    """A fixed sample of exactly n users, everybody if there are no more than n.

    The n smallest hashes: counts per range of the hash (`buckets` numbers) give the range in which the n-th
    lies, and only that one is sorted.
    """
    drawn = features.select(cols.user).distinct().withColumn("_draw", unit_hash(cols.user, seed=seed))
    drawn = written(drawn.withColumn("_range", F.floor(F.col("_draw") * buckets).cast("int")))
    sizes = dict(drawn.groupBy("_range").agg(F.count("*")).collect())
    left, cut = n, 0
    while cut < buckets and sizes.get(cut, 0) <= left:
        left -= sizes.get(cut, 0)
        cut += 1
    whole = drawn.filter(F.col("_range") < cut).select(cols.user)
    return whole.unionByName(drawn.filter(F.col("_range") == cut).orderBy("_draw", cols.user).limit(left).select(cols.user))


def evaluation_users(features: DataFrame, n: int | None, seed: int = 42, cols: Columns = Columns()) -> DataFrame | None:
    return sample_customers(features, n, seed, cols) if n else None


def sampled_inputs(features: DataFrame, val: DataFrame, n: int | None, seed: int = 42,
                   cols: Columns = Columns()) -> tuple[DataFrame, DataFrame]:
    """A fold's features and held-out rows, cut to the same fixed sample of users if n is given."""
    users = evaluation_users(features, n, seed, cols)
    if users is None:
        return features, val
    users = written(users)
    return features.join(users, cols.user, "left_semi"), val.join(users, cols.user, "left_semi")


def backfill(recs: DataFrame, users: DataFrame, fallback: DataFrame, k: int = 12,
             cols: Columns = Columns()) -> DataFrame:
    """Pad lists shorter than k with unseen fallback items, and serve users without a list.

    The fallback `(rank, item)` has fixed length and arrives as one array. Each user's own list is
    an array of at most k items, so padding happens within the row.
    """
    items = as_list(fallback, cols)
    own = to_lists(recs.filter(F.col("pos") <= k), cols).withColumn("listed", F.lit(True))
    asked = users.select(cols.user).distinct().withColumn("asked", F.lit(True))
    both = asked.join(own, cols.user, "full")
    current = F.coalesce("items", F.expr("array()").cast(f"array<{recs.schema[cols.item].dataType.simpleString()}>"))
    padded = F.slice(F.concat(current, F.array_except(items, current)), 1, k)
    final = F.when(F.col("asked"), padded).otherwise(current)
    return (both.select(cols.user, F.posexplode(final).alias("at", cols.item))
                .select(cols.user, cols.item, (F.col("at") + 1).alias("pos")))


def same_for_all(users: DataFrame, best: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """The bestseller baseline: one `(rank, item)` list shown to every user."""
    return (users.select(cols.user).distinct().select(cols.user, F.posexplode(as_list(best, cols)).alias("at", cols.item))
                 .select(cols.user, cols.item, (F.col("at") + 1).alias("pos")))


def ground_truth(val: DataFrame, cols: Columns = Columns()) -> DataFrame:
    return val.select(cols.user, cols.item).distinct()


def buyers_of(recs: DataFrame, truth: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Scored users who bought in the held-out weeks."""
    return recs.select(cols.user).distinct().join(truth.select(cols.user), cols.user, "left_semi")


def popular_items(fold: FoldInputs, weeks: int, k: int = 12) -> DataFrame:
    recent = fold.train.filter(F.col(fold.columns.date) > weeks_before(fold.train_end, weeks))
    return bestsellers(recent, fold.columns, k)


def accuracy_metrics(recs: DataFrame, truth: DataFrame, k: int = 12, users: DataFrame | None = None,
                     cols: Columns = Columns()) -> DataFrame:
    """MAP, NDCG, hit rate, precision and recall over one population, as one row."""
    return mean_scores(user_scores(recs, truth, k, users, cols)).select(*ACCURACY)


def evaluate(recs: DataFrame, truth: DataFrame, k: int = 12, cols: Columns = Columns(),
             keys: Sequence[str] = ()) -> DataFrame:
    """Population sizes, the accuracy numbers over all scored users and MAP over the buyers."""
    scores = user_scores(recs, truth, k, None, cols, keys)
    parts = zip(ACCURACY, ("ap", "ndcg", "hit", "precision", "recall"))
    return scores.groupBy(*keys).agg(
        F.count("*").alias("customers"), F.count_if(F.col("n_true") > 0).alias("buyers"),
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(m) for m, c in parts],
        F.coalesce(F.avg(F.when(F.col("n_true") > 0, F.col("ap"))), F.lit(0.0)).alias("map_buyers"))


def compare_to_baseline(recs: DataFrame, truth: DataFrame, best: DataFrame, k: int = 12,
                        users: DataFrame | None = None, cols: Columns = Columns()) -> DataFrame:
    """`(metric, baseline, model, lift)`: the lists against the same bestsellers for everybody."""
    users = recs.select(cols.user).distinct() if users is None else users
    arms = (recs.select(cols.user, cols.item, "pos").withColumn("arm", F.lit("model"))
            .unionByName(same_for_all(users, best, cols).withColumn("arm", F.lit("baseline"))))

    def for_both(df):
        return df.withColumn("arm", F.explode(F.array(F.lit("baseline"), F.lit("model"))))

    scores = user_scores(arms, for_both(truth.select(cols.user, cols.item)), k,
                         for_both(users.select(cols.user)), cols, ["arm"])
    means = mean_scores(scores, "arm")
    long = means.select("arm", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ACCURACY])).alias("e"))
    wide = long.select("arm", "e.metric", "e.value").groupBy("metric").agg(
        F.max(F.when(F.col("arm") == "baseline", F.col("value"))).alias("baseline"),
        F.max(F.when(F.col("arm") == "model", F.col("value"))).alias("model"))
    return wide.withColumn("lift", F.try_divide(F.col("model"), F.col("baseline")))


@dataclass(frozen=True)
class ScoredFold:
    """A fold's lists with everything needed to judge them; frames, not collections."""

    fold: str
    recs: DataFrame
    truth: DataFrame
    best: DataFrame
    columns: Columns = Columns()

    @property
    def customers(self) -> DataFrame:
        return self.recs.select(self.columns.user).distinct()

    @property
    def buyers(self) -> DataFrame:
        return buyers_of(self.recs, self.truth, self.columns)


def score_fold(fold: FoldInputs, scored: DataFrame, k: int = 12, popularity_weeks: int = 4,
               users: DataFrame | None = None) -> ScoredFold:
    """Top-k lists of a fold, written out once: every report of the fold starts from them."""
    recs = written(top_k(scored, k, users, fold.columns))
    return ScoredFold(fold.name, recs, ground_truth(fold.val, fold.columns),
                      popular_items(fold, popularity_weeks, k), fold.columns)
