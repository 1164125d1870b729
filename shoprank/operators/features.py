"""Feature blocks. Each returns the block and the keys it is joined on."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoprank.functions.columns import days_between, weeks_before
from shoprank.operators.retrieval import seed_strength
from shoprank.operators.shared import ordered_ids, pair_history
from shoprank.schema import Columns, FoldInputs, Settings

# Article codes used as numeric features.
ARTICLE_CODES = ("garment_group_no", "section_no", "index_group_no",
                 "colour_group_code", "product_type_no", "department_no")
# Customer categoricals that get an index column.
CUSTOMER_CATEGORIES = ("club_member_status", "fashion_news_frequency")

Block = tuple[DataFrame, list[str]]


@dataclass(frozen=True)
class FeatureSource:
    """A named block together with the columns it promises."""

    name: str
    produces: tuple[str, ...]
    compute: Callable[[FoldInputs, DataFrame | None], Block]


# A sketch of 2^12 registers: three times its relative standard deviation of 1.04 / 2^6.
SKETCH_BITS, SKETCH_ERROR = 12, 3 * 1.04 / 2**6


def weekly_item_sketches(tx: DataFrame, anchor: date, cols: Columns = Columns()) -> DataFrame:
    """`(user, week, items)`: a mergeable sketch of the distinct items of every user and week.

    Weeks are counted back from `anchor`: week 0 ends on it. One table serves every window that ends a whole number of weeks
    before the anchor; rows after it are left out.
    """
    back = F.datediff(F.lit(anchor), F.col(cols.date))
    rows = tx.filter(back >= 0).select(cols.user, cols.item, F.floor(back / 7).cast("int").alias("week"))
    return rows.groupBy(cols.user, "week").agg(F.hll_sketch_agg(cols.item, SKETCH_BITS).alias("items"))


def distinct_in_windows(sketches: DataFrame, windows: Mapping[str, tuple[date, int]], anchor: date, cols: Columns = Columns()) -> DataFrame:
    """`(user, win, items)`: distinct items of each named window `(last day, weeks)`, from sketches merged per user."""
    merged = []
    for name, (end, weeks) in windows.items():
        shift, rest = divmod((anchor - end).days, 7)
        if rest or shift < 0:
            raise ValueError(f"window {name!r} does not end a whole number of weeks before {anchor}")
        merged.append(F.hll_union_agg(F.when(F.col("week").between(shift, shift + weeks - 1), F.col("items"))).alias(name))
    each = F.array(*[F.struct(F.lit(n).alias("win"), F.hll_sketch_estimate(F.col(f"`{n}`")).alias("items")) for n in windows])
    return sketches.groupBy(cols.user).agg(*merged).select(cols.user, F.explode(each).alias("e")).select(cols.user, "e.*").filter("items > 0")


def user_aggregates(fold: FoldInputs, recent_weeks: int = 12, exact_distinct: bool = False) -> Block:
    """Behaviour per user: over the recent window if there is any purchase in it, else lifetime.

    Both versions come out of one pass; the user's own recent count picks between them. Distinct
    items are a sketch, or exact from the history summed per pair, where a pair is one item.
    """
    cols, end = fold.columns, fold.train_end
    recent = F.col(cols.date) >= weeks_before(end, recent_weeks)
    channel = F.col("sales_channel_id").cast("double")

    def both(name, fn, value):
        return [fn(F.when(recent, value)).alias(f"r_{name}"), fn(value).alias(f"a_{name}")]

    day, price = F.col(cols.date), F.col("price")
    items = [] if exact_distinct else both("n_unique_items", lambda v: F.hll_sketch_estimate(F.hll_sketch_agg(v, SKETCH_BITS)), F.col(cols.item))
    sums = (both("purchases", F.count, F.lit(1)) + items + both("first", F.min, day) + both("last", F.max, day) + both("avg_price", F.avg, price)
            + both("std_price", F.stddev, price) + both("max_price", F.max, price)
            + both("avg_channel", F.avg, channel))
    wide = fold.history.groupBy(cols.user).agg(*sums)
    if exact_distinct:
        exact = pair_history(fold, recent_weeks).groupBy(cols.user).agg(
            F.count_if(F.col("n_recent") > 0).alias("r_n_unique_items"), F.count("*").alias("a_n_unique_items"))
        wide = wide.join(exact, cols.user)
    active = F.col("r_purchases") > 0

    def pick(name):
        return F.when(active, F.col(f"r_{name}")).otherwise(F.col(f"a_{name}"))

    block = wide.select(
        cols.user, pick("purchases").alias("user_purchases"), pick("n_unique_items").alias("user_n_unique_items"),
        days_between(end, pick("first")).alias("user_days_since_first"),
        days_between(end, pick("last")).alias("user_days_since_last"),
        pick("avg_price").alias("user_avg_price"), pick("std_price").alias("user_std_price"),
        pick("max_price").alias("user_max_price"), pick("avg_channel").alias("user_avg_channel"),
        active.cast("int").alias("is_active"))
    return block, [cols.user]


def item_aggregates(fold: FoldInputs, windows: Sequence[int] = (1, 4, 12)) -> Block:
    """Sales, reach, age and price of each item in the training window."""
    cols, end = fold.columns, fold.train_end
    day = F.col(cols.date)
    # per (item, user) first: the distinct buyers are then a plain count, and an item that holds
    # a third of the rows arrives as partial sums
    per_buyer = fold.train.groupBy(cols.item, cols.user).agg(
        *[F.count_if(day >= weeks_before(end, w)).alias(f"w{w}") for w in windows],
        F.count("*").alias("n"), F.min(day).alias("first"), F.max(day).alias("last"),
        F.sum("price").alias("price_sum"), F.count("price").alias("price_n"), F.max("price").alias("price_max"))
    block = per_buyer.groupBy(cols.item).agg(
        *[F.sum(f"w{w}").alias(f"item_purchases_{w}w") for w in windows],
        F.sum("n").alias("item_purchases_all"), F.count(cols.user).alias("item_n_unique_buyers"),
        days_between(end, F.min("first")).alias("item_days_since_first_sale"),
        days_between(end, F.max("last")).alias("item_days_since_last_sale"),
        F.try_divide(F.sum("price_sum"), F.sum("price_n")).alias("item_avg_price"),
        F.max("price_max").alias("item_max_price"))
    rate = F.try_divide(F.col("item_purchases_all"), F.col("item_n_unique_buyers"))
    return block.withColumn("item_repurchase_rate", rate), [cols.item]


def _weighted_pairs(fold: FoldInputs, recent_weeks: int) -> DataFrame:
    """(user, item, ..., n): recent count for users active in the window, lifetime count for the rest."""
    cols = fold.columns
    pairs = pair_history(fold, recent_weeks)
    if "active" not in pairs.columns:
        active = pairs.groupBy(cols.user).agg((F.sum("n_recent") > 0).alias("active"))
        pairs = pairs.join(active, cols.user)
    chosen = F.when(F.col("active"), F.col("n_recent")).otherwise(F.col("n"))
    return pairs.select(*[c for c in pairs.columns if c not in ("n", "n_recent", "last", "active")],
                        chosen.alias("n")).filter(F.col("n") > 0)


def category_affinity(fold: FoldInputs, key: str, recent_weeks: int = 12, out_name: str | None = None) -> Block:
    """Purchases of the user per value of one article attribute."""
    cols = fold.columns
    pairs = _weighted_pairs(fold, recent_weeks)
    if key not in pairs.columns:
        pairs = pairs.join(fold.articles.select(cols.item, key), cols.item, "left")
    block = pairs.groupBy(cols.user, key).agg(F.sum("n").alias(f"user_{out_name or key}_purchases"))
    return block, [cols.user, key]


def user_item_history(fold: FoldInputs) -> Block:
    cols = fold.columns
    block = pair_history(fold, fold.pairs_weeks or 12).select(
        cols.user, cols.item, F.col("n").alias("user_item_purchases"),
        days_between(fold.train_end, F.col("last")).alias("user_item_days_since_last"))
    return block, [cols.user, cols.item]


def item_buyer_demographic(fold: FoldInputs) -> Block:
    """Mean age behind an item's purchases: a buyer counts once per purchase."""
    cols = fold.columns
    ages = fold.customers.select(cols.user, F.col("age").try_cast("double").alias("age"))
    pairs = pair_history(fold, fold.pairs_weeks or 12)
    known = F.when(F.col("age").isNotNull(), F.col("n"))
    block = pairs.join(ages, cols.user).groupBy(cols.item).agg(
        F.try_divide(F.sum(F.col("age") * F.col("n")), F.sum(known)).alias("item_mean_buyer_age"))
    return block, [cols.item]


def category_index(customers: DataFrame, column: str) -> DataFrame:
    """(value, index) by falling frequency, ties by value; a missing value takes the next index."""
    levels = customers.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    numbered = ordered_ids(levels, [F.col("n").desc(), F.col("value")], "index").select("value", "index")
    missing = levels.agg(F.count("*").cast("int").alias("index")).select(F.lit(None).cast(levels.schema["value"].dataType).alias("value"), "index")
    return numbered.unionByName(missing)


def customer_metadata(fold: FoldInputs, categorical_cols: Sequence[str] = CUSTOMER_CATEGORIES) -> Block:
    """Age, and each categorical as the rank of its frequency."""
    cols = fold.columns
    block = fold.customers.select(cols.user, F.col("age").try_cast("double").alias("age"), *categorical_cols)
    for column in categorical_cols:
        levels = category_index(fold.customers, column).select(
            F.col("value").alias("_v"), F.col("index").cast("double").alias(f"{column}_idx"))
        block = block.join(levels, block[column].eqNullSafe(levels["_v"]), "left").drop("_v", column)
    return block, [cols.user]


def article_metadata(fold: FoldInputs, codes: Sequence[str] = ARTICLE_CODES) -> Block:
    cols = fold.columns
    return fold.articles.select(cols.item, *[F.col(c).try_cast("double").alias(c) for c in codes]), [cols.item]


def itemcf_score(fold: FoldInputs, neighbors: DataFrame | None, seed_weeks: int = 4) -> Block:
    """Summed and largest co-purchase count between a candidate and the user's recent items."""
    if neighbors is None:
        raise ValueError("itemcf_score needs the neighbour table of the retrieval stage")
    cols = fold.columns
    lately = fold.train.filter(F.col(cols.date) >= weeks_before(fold.train_end, seed_weeks))
    reached = seed_strength(lately, neighbors, cols)
    return reached.select(cols.user, cols.item, F.col("total").alias("itemcf_score"), F.col("largest").alias("itemcf_max_score")), [cols.user, cols.item]


def feature_sources(settings: Settings, exact_distinct: bool = False) -> list[FeatureSource]:
    """The blocks of a run in join order. One more affinity is one more entry in the settings."""
    windows = settings.features.item_weeks
    user_cols = ("user_purchases", "user_n_unique_items", "user_days_since_first", "user_days_since_last",
                 "user_avg_price", "user_std_price", "user_max_price", "user_avg_channel", "is_active")
    item_cols = (*[f"item_purchases_{w}w" for w in windows], "item_purchases_all", "item_n_unique_buyers",
                 "item_days_since_first_sale", "item_days_since_last_sale", "item_avg_price",
                 "item_max_price", "item_repurchase_rate")
    weeks = settings.features.active_weeks

    def affinity(key, out):
        return FeatureSource(f"category_affinity_{out}", (f"user_{out}_purchases",),
                             lambda f, e: category_affinity(f, key, weeks, out))

    return [
        FeatureSource("user_aggregates", user_cols, lambda f, e: user_aggregates(f, weeks, exact_distinct)),
        FeatureSource("item_aggregates", item_cols, lambda f, e: item_aggregates(f, windows)),
        *[affinity(key, out) for key, out in settings.features.affinities],
        FeatureSource("user_item_history", ("user_item_purchases", "user_item_days_since_last"),
                      lambda f, e: user_item_history(f)),
        FeatureSource("itemcf_score", ("itemcf_score", "itemcf_max_score"),
                      lambda f, e: itemcf_score(f, e, settings.retrieval.seed_weeks)),
        FeatureSource("item_buyer_demographic", ("item_mean_buyer_age",), lambda f, e: item_buyer_demographic(f)),
        FeatureSource("customer_metadata", ("age", *[f"{c}_idx" for c in CUSTOMER_CATEGORIES]),
                      lambda f, e: customer_metadata(f)),
        FeatureSource("article_metadata", ARTICLE_CODES, lambda f, e: article_metadata(f)),
    ]
