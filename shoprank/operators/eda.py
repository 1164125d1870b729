"""Exploration of the interaction log.

The reports end in frames bounded by the calendar or by the number of distinct counts; windows
without a partition appear only there.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoprank.functions.columns import (
    EXPLORE_RECENCY,
    EXPLORE_RECENCY_REST,
    log2_bucket,
    log2_label,
    recency_band,
    week_of,
)
from shoprank.operators.folds import fold_specs, time_split
from shoprank.operators.shared import top_per_group
from shoprank.schema import Columns

def _all():
    """Window over every row; for frames bounded by the calendar or by distinct counts only."""
    return Window.partitionBy()


# --- volume over time ----------------------------------------------------------------------

def transaction_patterns(tx: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Weekly rows, users, items and mean price; weeks beyond two deviations are flagged."""
    weekly = tx.groupBy(week_of(cols.date).alias("week")).agg(
        F.count("*").alias("n_transactions"), F.count_distinct(cols.user).alias("n_active_users"),
        F.count_distinct(cols.item).alias("n_distinct_items"), F.avg("price").alias("avg_price"))
    mean, spread = F.avg("n_transactions").over(_all()), F.stddev("n_transactions").over(_all())
    return weekly.withColumn("is_outlier", F.abs(F.col("n_transactions") - mean) > 2 * spread)


def transaction_facts(weekly: DataFrame) -> DataFrame:
    """Range, peak and lowest week of the weekly table; the earlier week wins a tie."""
    n, week = F.col("n_transactions"), F.col("week")
    best = F.max(F.struct(n, (-F.datediff(week, F.lit("1970-01-01").cast("date"))).alias("neg"), week))
    worst = F.min(F.struct(n, week))
    return weekly.agg(
        F.min(week).alias("first_week"), F.max(week).alias("last_week"), F.count("*").alias("n_weeks"),
        best["week"].alias("peak_week"), best["n_transactions"].alias("peak_transactions"),
        worst["week"].alias("lowest_week"), worst["n_transactions"].alias("lowest_transactions"),
        F.count_if("is_outlier").alias("n_outliers"))


# --- sparsity ------------------------------------------------------------------------------

def interaction_summary(tx: DataFrame, cols: Columns = Columns()) -> DataFrame:
    sizes = tx.agg(F.count("*").alias("n_transactions"), F.count_distinct(cols.user).alias("n_users"),
                   F.count_distinct(cols.item).alias("n_items"))
    cells = F.col("n_users").cast("double") * F.col("n_items")
    return sizes.withColumn("sparsity", 1.0 - F.try_divide(F.col("n_transactions"), cells))


def interaction_buckets(tx: DataFrame, key: str, out: str) -> DataFrame:
    """How many users (or items) have 1, 2-3, 4-7, ... interactions."""
    counts = tx.groupBy(key).agg(F.count("*").alias("n")).select(log2_bucket(F.col("n")).alias("log_bucket"))
    return (counts.groupBy("log_bucket").agg(F.count("*").alias(out))
                  .withColumn("bucket_label", log2_label(F.col("log_bucket"))))


def cold_shares(user_buckets: DataFrame, item_buckets: DataFrame) -> DataFrame:
    """Percent of users and of items seen exactly once."""
    def once(column: str) -> Column:
        single = F.sum(F.when(F.col("log_bucket") == 0, F.col(column)).otherwise(0))
        return F.try_divide(100.0 * single, F.sum(column))

    return (user_buckets.agg(once("n_users").alias("cold_user_pct"))
            .withColumn("cold_item_pct", item_buckets.agg(once("n_items")).scalar()))


# --- item life -----------------------------------------------------------------------------

def _item_weeks(tx: DataFrame, cols: Columns) -> DataFrame:
    """(item, week, n, first_week): after the first sum an item has one row per week at most."""
    weekly = tx.groupBy(cols.item, week_of(cols.date).alias("week")).agg(F.count("*").alias("n"))
    return weekly.withColumn("first_week", F.min("week").over(Window.partitionBy(cols.item)))


def item_lifespan(tx: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Items by whole weeks between first and last active week."""
    week = week_of(cols.date)
    spans = tx.groupBy(cols.item).agg(F.min(week).alias("a"), F.max(week).alias("b"))
    weeks = F.expr("datediff(b, a) div 7").cast("int").alias("lifespan_weeks")
    return spans.groupBy(weeks).agg(F.count("*").alias("n_items"))


def item_decay(tx: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Items still sold and volume by week since launch, with the cumulative share of volume."""
    offset = F.expr("datediff(week, first_week) div 7").cast("int").alias("week_offset")
    by_offset = _item_weeks(tx, cols).groupBy(offset).agg(
        F.count("*").alias("n_active_items"), F.sum("n").alias("n_purchases"))
    # every item is active in its launch week, so offset 0 counts all items
    n_items, total = F.max(F.when(F.col("week_offset") == 0, F.col("n_active_items"))).over(_all()), F.sum("n_purchases").over(_all())
    running = F.sum("n_purchases").over(Window.orderBy("week_offset").rowsBetween(Window.unboundedPreceding, 0))
    return by_offset.select(
        "week_offset", "n_active_items", (F.col("n_active_items") / n_items * 100).alias("pct_surviving"),
        "n_purchases", (F.col("n_purchases") / total * 100).alias("pct_volume"),
        (running / total * 100).alias("cum_pct_volume"))


def survival_curve(tx: DataFrame, max_weeks: int | None = None, cols: Columns = Columns()) -> DataFrame:
    curve = item_decay(tx, cols).select("week_offset", "n_active_items", "pct_surviving")
    return curve if max_weeks is None else curve.filter(F.col("week_offset") <= max_weeks)


def volume_by_week_offset(tx: DataFrame, max_weeks: int | None = None, cols: Columns = Columns()) -> DataFrame:
    curve = item_decay(tx, cols).select("week_offset", "n_purchases", "pct_volume", "cum_pct_volume")
    return curve if max_weeks is None else curve.filter(F.col("week_offset") <= max_weeks)


def decay_thresholds(tx: DataFrame, volume: Sequence[int] = (50, 80, 95), survival: Sequence[int] = (50, 20),
                     cols: Columns = Columns()) -> DataFrame:
    """First week by which a share of the volume is in, and in which survival has fallen to a share."""
    week = F.col("week_offset")
    marks = [("volume", p, F.min(F.when(F.col("cum_pct_volume") >= p, week))) for p in volume]
    marks += [("survival", p, F.min(F.when(F.col("pct_surviving") <= p, week))) for p in survival]
    row = item_decay(tx, cols).agg(*[m.alias(f"m{i}") for i, (_, _, m) in enumerate(marks)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(kind).alias("measure"), F.lit(p).alias("pct"), F.col(f"m{i}").alias("week_offset"))
        for i, (kind, p, _) in enumerate(marks)])).alias("e")).select("e.*").filter(F.col("week_offset").isNotNull())


# --- concentration -------------------------------------------------------------------------

def _count_steps(tx: DataFrame, cols: Columns) -> DataFrame:
    """Items per purchase count with the items and purchases ahead of each step.

    N rows have at most sqrt(2N) different counts, so the running sums stay small however many
    items there are.
    """
    counts = tx.groupBy(cols.item).agg(F.count("*").alias("c"))
    steps = counts.groupBy("c").agg(F.count("*").alias("m"))
    ahead = Window.orderBy(F.col("c").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return steps.select(
        "c", "m", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("items_before"),
        F.coalesce(F.sum(F.col("c") * F.col("m")).over(ahead), F.lit(0)).alias("bought_before"),
        F.sum("m").over(_all()).alias("n_items"), F.sum(F.col("c") * F.col("m")).over(_all()).alias("n_bought"))


def lorenz(tx: DataFrame, cols: Columns = Columns(), run: int = 4096) -> DataFrame:
    """One point per item, best seller first: share of items against share of purchases.

    Items of equal count lie on a straight piece of the curve, so a step unfolds into its points
    without sorting the items; long steps unfold in runs spread over the tasks.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1, F.lit(run).cast("bigint"))).alias("start")
    runs = _count_steps(tx, cols).select("*", starts).repartition("c", "start")
    points = runs.select("*", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + run, F.col("m")))).alias("j"))
    return points.select(
        ((F.col("items_before") + F.col("j")) / F.col("n_items") * 100).alias("item_pct"),
        ((F.col("bought_before") + F.col("j") * F.col("c")) / F.col("n_bought") * 100).alias("cum_purchase_pct"))


def top_share(tx: DataFrame, percents: Sequence[int] = (1, 10), cols: Columns = Columns()) -> DataFrame:
    """Share of purchases that goes to the best-selling p % of items, one column per p."""
    steps = _count_steps(tx, cols)
    shares = []
    for p in percents:
        allowed = F.expr(f"n_items * {p} div 100")
        taken = F.greatest(F.lit(0), F.least(F.col("m"), allowed - F.col("items_before")))
        share = F.sum(taken * F.col("c")) / F.max("n_bought") * 100
        shares.append(F.when(F.max(allowed) > 0, share).alias(f"top{p}_pct"))
    return steps.agg(*shares)


def weekly_rank_stability(tx: DataFrame, top_n: int = 1000, min_shared: int = 10, cols: Columns = Columns()) -> DataFrame:
    """Spearman correlation of a week's top items with the same items' sales one present week on."""
    weekly = tx.groupBy(week_of(cols.date).alias("week"), cols.item).agg(F.count("*").alias("n"))
    following = (weekly.select("week").distinct()
                 .withColumn("next_week", F.lead("week").over(Window.orderBy("week"))).filter("next_week is not null"))
    leaders = top_per_group(weekly, ["week"], [F.col("n").desc(), F.col(cols.item)], top_n)
    before = leaders.join(following, "week").select(F.col("next_week").alias("week"), cols.item, F.col("n").alias("n_before"))
    shared = before.join(weekly, ["week", cols.item])

    def average_rank(column: str) -> Column:
        ties = F.count("*").over(Window.partitionBy("week", column))
        return F.rank().over(Window.partitionBy("week").orderBy(column)) + (ties - 1) / 2

    ranked = shared.select("week", average_rank("n_before").alias("x"), average_rank("n").alias("y"))
    return (ranked.groupBy("week").agg(F.count("*").alias("shared"), F.corr("x", "y").alias("spearman_r"))
                  .filter(F.col("shared") > min_shared).select("week", "spearman_r"))


def concentration_summary(tx: DataFrame, top_n: int = 1000, min_shared: int = 10, cols: Columns = Columns()) -> DataFrame:
    mean = weekly_rank_stability(tx, top_n, min_shared, cols).agg(F.avg("spearman_r")).scalar()
    return top_share(tx, (1, 10), cols).withColumn("mean_rank_corr", mean)


# --- repurchase ----------------------------------------------------------------------------

def _first_two_days(tx: DataFrame, cols: Columns) -> DataFrame:
    """(user, item, d1, n1, d2, n2): rows on the first and second day of each pair."""
    days = tx.groupBy(cols.user, cols.item, cols.date).agg(F.count("*").alias("n"))
    two = top_per_group(days, [cols.user, cols.item], [F.col(cols.date)], 2, "nth")
    first, second = F.col("nth") == 1, F.col("nth") == 2
    return two.groupBy(cols.user, cols.item).agg(
        F.max(F.when(first, F.col(cols.date))).alias("d1"), F.max(F.when(first, F.col("n"))).alias("n1"),
        F.max(F.when(second, F.col(cols.date))).alias("d2"), F.max(F.when(second, F.col("n"))).alias("n2"))


# Purchases of a pair are ranked by day with gaps, so a second purchase is rank 2 only where the
# first day holds a single row.
_HAS_SECOND = "d2 is not null and n1 = 1"


def repurchase_rates(tx: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Percent of users with a second purchase, percent of rows that are repeat purchases."""
    total = tx.agg(F.count("*")).scalar()
    per_user = _first_two_days(tx, cols).groupBy(cols.user).agg(
        F.max(F.expr(_HAS_SECOND)).alias("again"), F.sum("n1").alias("first_rows"))
    return per_user.agg(
        F.try_divide(100.0 * F.count_if("again"), F.count("*")).alias("repurchase_rate"),
        F.try_divide(100.0 * (total - F.sum("first_rows")), total).alias("repurchase_share"))


def time_to_repurchase(tx: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Days between first and second purchase, with the cumulative percent of pairs."""
    gaps = _first_two_days(tx, cols).filter(_HAS_SECOND)
    table = gaps.groupBy(F.datediff("d2", "d1").alias("days_to_repurchase")).agg(F.sum("n2").alias("n_pairs"))
    running = F.sum("n_pairs").over(Window.orderBy("days_to_repurchase").rowsBetween(Window.unboundedPreceding, 0))
    return table.withColumn("cum_pct", running / F.sum("n_pairs").over(_all()) * 100)


def repurchase_summary(tx: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Rates with the mean, lower median and the 80 % point of the waiting time."""
    days, pairs = F.col("days_to_repurchase"), F.col("n_pairs")

    def reached(pct: int) -> Column:
        return F.min(F.when(F.col("cum_pct") >= pct, days))

    waits = time_to_repurchase(tx, cols).agg(
        reached(50).alias("median_days_to_repurchase"),
        F.round(F.try_divide(F.sum(days * pairs), F.sum(pairs)), 1).alias("mean_days_to_repurchase"),
        reached(80).alias("days_to_80_pct"))
    rates = repurchase_rates(tx, cols).select(
        F.struct(F.round("repurchase_rate", 2).alias("rate"), F.round("repurchase_share", 2).alias("share")).alias("r"))
    return waits.withColumn("_r", rates.scalar()).select(
        F.col("_r.rate").alias("repurchase_rate_pct"), F.col("_r.share").alias("repurchase_share_pct"),
        "median_days_to_repurchase", "mean_days_to_repurchase", "days_to_80_pct")


# --- recency -------------------------------------------------------------------------------

def _days_since_last(tx: DataFrame, reference: date | Column, cols: Columns) -> DataFrame:
    until = reference if isinstance(reference, Column) else F.lit(reference).cast("date")
    return tx.groupBy(cols.user).agg(F.datediff(until, F.max(cols.date)).alias("days"))


def user_activity_segments(tx: DataFrame, reference: date | Column, cols: Columns = Columns()) -> DataFrame:
    """Users per activity segment at the reference date."""
    segment = recency_band(F.col("days"), EXPLORE_RECENCY, EXPLORE_RECENCY_REST).alias("segment")
    counts = _days_since_last(tx, reference, cols).groupBy(segment).agg(F.count("*").alias("n_users"))
    return counts.withColumn("pct_users", F.col("n_users") / F.sum("n_users").over(_all()) * 100)


def recency_histogram(tx: DataFrame, reference: date | Column, cols: Columns = Columns(), width: int = 14) -> DataFrame:
    bucket = (F.floor(F.col("days") / width) * width).cast("bigint").alias("bucket")
    return _days_since_last(tx, reference, cols).groupBy(bucket).agg(F.count("*").alias("n_users"))


# --- signal helpers ------------------------------------------------------------------------

def make_fold(tx: DataFrame, week_end: date, train_weeks: int | None = None,
              cols: Columns = Columns()) -> tuple[DataFrame, DataFrame]:
    """History before the week and the distinct pairs bought in it."""
    fold = time_split(tx, fold_specs(week_end, train_weeks, 1, 1, False), cols)[0]
    return fold.train, fold.val.select(cols.user, cols.item).distinct()


def evaluate_source(name: str, candidates: DataFrame, bought: DataFrame, n_customers: Column | int | None = None,
                    k_global: int | None = None, cols: Columns = Columns()) -> DataFrame:
    """Recall, precision and hit rate of pairs, or of one item list shown to `n_customers` people."""
    sizes = bought.agg(F.count("*").alias("n_next"), F.count_distinct(cols.user).alias("n_buyers"))
    if k_global is None:
        pairs = candidates.select(cols.user, cols.item).distinct()
        hits = bought.join(pairs, [cols.user, cols.item], "left_semi")
        n_candidates = pairs.agg(F.count("*")).scalar()
    else:
        hits = bought.join(candidates.select(cols.item).distinct(), cols.item, "left_semi")
        n_candidates = F.lit(k_global) * (F.lit(n_customers) if isinstance(n_customers, int) else n_customers)
    found = hits.groupBy(cols.user).agg(F.count("*").alias("h")).agg(
        F.struct(F.coalesce(F.sum("h"), F.lit(0)).alias("hits"), F.count("*").alias("buyers")).alias("f"))
    return sizes.withColumn("f", found.scalar()).select(
        F.lit(name).alias("source"), F.try_divide(100.0 * F.col("f.hits"), F.col("n_next")).alias("recall_pct"),
        F.coalesce(F.try_divide(100.0 * F.col("f.hits"), n_candidates), F.lit(0.0)).alias("precision_pct"),
        F.try_divide(100.0 * F.col("f.buyers"), F.col("n_buyers")).alias("hit_rate_pct"))


def consistency(usual: DataFrame, following: DataFrame, cols: Columns = Columns(), keys: Sequence[str] = ()) -> DataFrame:
    """How often the next value equals the usual one, against the match rate of independent draws."""
    joined = usual.select(*keys, cols.user, "usual").join(following.select(*keys, cols.user, "next_val"), [*keys, cols.user])
    # counts per (usual, next) combination hold everything needed and are few
    return agreement(joined.groupBy(*keys, "usual", "next_val").agg(F.count("*").alias("n")), keys)


def agreement(combos: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Observed and chance match rate from the counts `n` of every (usual, next) combination."""
    same = F.col("usual") == F.col("next_val")
    observed = combos.groupBy(*keys).agg(
        F.try_divide(F.sum(F.when(same, F.col("n")).otherwise(F.lit(0))), F.sum(F.when(same.isNotNull(), F.col("n")))).alias("observed"),
        F.sum("n").alias("n"))
    sides = combos.select(*keys, F.explode(F.array(
        F.struct(F.col("usual").alias("value"), F.col("n").alias("u"), F.lit(0).cast("bigint").alias("x")),
        F.struct(F.col("next_val").alias("value"), F.lit(0).cast("bigint").alias("u"), F.col("n").alias("x")))).alias("e"))
    shares = sides.groupBy(*keys, "e.value").agg(F.sum("e.u").alias("u"), F.sum("e.x").alias("x"))
    chance = shares.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("u").cast("double") * F.col("x")), F.sum("u").cast("double") * F.sum("x")).alias("chance"))
    if keys:
        return observed.join(chance, list(keys)).select(*keys, "observed", "chance")
    return observed.withColumn("chance", chance.scalar()).select("observed", "chance")


def top_index(rows: DataFrame, alias: str, groups: DataFrame, group: str = "index_group_no", keys: Sequence[str] = (),
              cols: Columns = Columns()) -> DataFrame:
    """Each user's most bought group value; equal counts go to the smaller value."""
    counts = (rows.groupBy(*keys, cols.user, cols.item).agg(F.count("*").alias("n"))
              .join(groups.select(cols.item, group), cols.item)
              .groupBy(*keys, cols.user, group).agg(F.sum("n").alias("n")))
    best = top_per_group(counts, [*keys, cols.user], [F.col("n").desc(), F.col(group)], 1)
    return best.select(*keys, cols.user, F.col(group).alias(alias))
