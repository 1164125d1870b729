"""What predicts the next weeks: the notebook studies, for all held-out windows in one pass.

Whether something lies in a fold's history depends only on its first date, so first dates are
computed once over the log and compared with every fold's cut-off; the log is not copied per fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoprank.functions.columns import price_tier
from shoprank.functions.session import written
from shoprank.operators.eda import agreement
from shoprank.operators.folds import FoldSpec
from shoprank.operators.shared import exact_percentiles, top_per_group
from shoprank.schema import Columns

# The demand groups, first match wins.
REPEAT = "1 repeat (exact item)"
SIBLING = "2 sibling (same product, new variant)"
SAME_TYPE = "3 product type (same type, new product)"
POPULAR = "4 popular (recent best-seller)"
UNCOVERED = "5 not covered by simple rules"

# Attribute name and article column of the loyalty study.
ATTRIBUTES = (("product_code", "product_code"), ("product_type", "product_type_no"),
              ("department", "department_no"), ("section", "section_no"), ("colour", "colour_group_code"),
              ("garment_group", "garment_group_no"), ("index_group", "index_group_no"))


def overview(tx: DataFrame, cols: Columns = Columns()) -> DataFrame:
    return tx.agg(F.count("*").alias("n_transactions"), F.count_distinct(cols.user).alias("n_customers"),
                  F.count_distinct(cols.item).alias("n_articles"), F.min(cols.date).alias("min_date"),
                  F.max(cols.date).alias("max_date"))


def duplicate_audit(tx: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Exact duplicate rows and same-day repeats of a pair."""
    rows = tx.groupBy(*tx.columns).agg(F.count("*").alias("copies"))
    keys = rows.groupBy(cols.user, cols.item, cols.date).agg(F.sum("copies").alias("copies"), F.count("*").alias("kinds"))
    return keys.agg(F.sum("copies").alias("n_rows"), (F.sum("copies") - F.sum("kinds")).alias("exact_duplicates"),
                    (F.sum("copies") - F.count("*")).alias("same_day_repeats"), F.count("*").alias("rows_after"))


def next_pairs(tx: DataFrame, specs: Sequence[FoldSpec], cols: Columns = Columns()) -> DataFrame:
    """Distinct `(fold, cut, user, item)` of each held-out window; `cut` is the end of its history."""
    day = F.col(cols.date)
    tags = [F.when(s.in_val(day), F.struct(F.lit(s.fold).alias("fold"), F.lit(s.train_end).alias("cut"))) for s in specs]
    return (tx.filter(day >= F.lit(min(s.val_start for s in specs)))
              .select(cols.user, cols.item, F.explode(F.array_compact(F.array(*tags))).alias("t"))
              .select("t.fold", "t.cut", cols.user, cols.item).distinct())


def _first_dates(tx: DataFrame, keys: Sequence[str], out: str, date_col: str) -> DataFrame:
    return tx.groupBy(*keys).agg(F.min(date_col).alias(out))


def demand_decomposition(tx: DataFrame, articles: DataFrame, specs: Sequence[FoldSpec], bestseller_weeks: int = 1,
                         n_bestsellers: int = 200, cols: Columns = Columns()) -> DataFrame:
    """Percent of each window's pairs explained by repeat, sibling, product type or bestseller."""
    attrs = articles.select(cols.item, "product_code", "product_type_no")
    pairs = _first_dates(tx, [cols.user, cols.item], "first_pair", cols.date)
    typed = pairs.join(attrs, cols.item)
    codes = _first_dates(typed, [cols.user, "product_code"], "first_code", "first_pair")
    types = _first_dates(typed, [cols.user, "product_type_no"], "first_type", "first_pair")

    day = F.col(cols.date)
    late = [F.when((day <= F.lit(s.train_end)) & (day > F.date_sub(F.lit(s.train_end), 7 * bestseller_weeks)), F.lit(s.fold))
            for s in specs]
    sold = (tx.select(cols.item, F.explode(F.array_compact(F.array(*late))).alias("fold"))
              .groupBy("fold", cols.item).agg(F.count("*").alias("n")))
    best = (top_per_group(sold, ["fold"], [F.col("n").desc(), F.col(cols.item)], n_bestsellers)
            .select("fold", cols.item, F.lit(True).alias("is_best")))

    tagged = (next_pairs(tx, specs, cols).join(attrs, cols.item, "left")
              .join(pairs, [cols.user, cols.item], "left").join(codes, [cols.user, "product_code"], "left")
              .join(types, [cols.user, "product_type_no"], "left").join(best, ["fold", cols.item], "left"))
    bucket = (F.when(F.col("first_pair") <= F.col("cut"), REPEAT).when(F.col("first_code") <= F.col("cut"), SIBLING)
               .when(F.col("first_type") <= F.col("cut"), SAME_TYPE).when(F.col("is_best"), POPULAR).otherwise(UNCOVERED))
    labels = (REPEAT, SIBLING, SAME_TYPE, POPULAR, UNCOVERED)
    counts = tagged.groupBy("fold").agg(F.count("*").alias("n_next"), *[
        F.count_if(bucket == label).alias(f"b{i}") for i, label in enumerate(labels)])
    return counts.select("fold", F.explode(F.array(*[
        F.struct(F.lit(label).alias("bucket"), F.col(f"b{i}").alias("pairs"), (100.0 * F.col(f"b{i}") / F.col("n_next")).alias("pct"))
        for i, label in enumerate(labels)])).alias("e")).select("fold", "e.*")


def decomposition_mean(per_fold: DataFrame) -> DataFrame:
    return per_fold.groupBy("bucket").agg(F.avg("pct").alias("pct"))


def new_item_shares(tx: DataFrame, specs: Sequence[FoldSpec], seed_weeks: int = 4, cols: Columns = Columns()) -> DataFrame:
    """Percent of each window's pairs whose item was launched lately, or never sold before."""
    first = _first_dates(tx, [cols.item], "first_sale", cols.date)
    known = F.col("first_sale") <= F.col("cut")
    late = known & (F.col("first_sale") > F.date_sub(F.col("cut"), 7 * seed_weeks))
    return next_pairs(tx, specs, cols).join(first, cols.item).groupBy("fold").agg(
        (100.0 * F.count_if(late) / F.count("*")).alias("new_arrival_pct"),
        (100.0 * F.count_if(~known) / F.count("*")).alias("unseen_pct"))


def attribute_loyalty(tx: DataFrame, articles: DataFrame, specs: Sequence[FoldSpec],
                      attributes: Sequence[tuple[str, str]] = ATTRIBUTES, cols: Columns = Columns()) -> DataFrame:
    """Per window and attribute: share of pairs with a value the user had bought, and the share
    expected from how common each value is.

    The log is summed per pair once and written. Articles are met by a sorted join while they have one row each, then pairs
    are dealt out by user and the seven values of each pair are made, counted and added up where they lie.
    """
    attribute_columns = dict.fromkeys(c for _, c in attributes)
    # never broadcast: an article's few bytes on disk are seven values of text in memory
    described = articles.select(cols.item, *attribute_columns).hint("merge")
    day = F.col(cols.date)
    pairs = written(tx.groupBy(cols.user, cols.item).agg(
        F.min(day).alias("first_pair"), *[F.max(F.coalesce(s.in_val(day), F.lit(False)).cast("int")).alias(f"next{i}") for i, s in enumerate(specs)]))
    values = F.explode(F.array(*[F.struct(F.lit(name).alias("attribute"), F.col(c).cast("string").alias("value")) for name, c in attributes]))
    met = pairs.join(described, cols.item).repartition(cols.user)
    owned = (met.select(cols.user, "first_pair", *[f"next{i}" for i in range(len(specs))], values.alias("e")).filter(F.col("e.value").isNotNull())
                .groupBy(cols.user, F.col("e.attribute").alias("attribute"), F.col("e.value").alias("value"))
                .agg(F.min("first_pair").alias("first_value"), *[F.sum(f"next{i}").alias(f"n{i}") for i in range(len(specs))]))

    def known(first: str, s: FoldSpec) -> Column:
        return F.col(first) <= F.lit(s.train_end)

    def of_folds(counted: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(s.fold).alias("fold"), *[F.col(f"{name}{i}").alias(name) for name in names]) for i, s in enumerate(specs)])
        return counted.select(*keys, F.explode(rows).alias("e")).select(*keys, "e.*")

    # pairs without a user are nobody's earlier choice
    counts = [column for i, s in enumerate(specs) for column in (
        F.sum(f"n{i}").alias(f"n{i}"), F.count_if(known("first_value", s)).alias(f"buyers{i}"),
        F.sum(F.when(known("first_value", s) & F.col(cols.user).isNotNull(), F.col(f"n{i}")).otherwise(0)).alias(f"matched{i}"))]
    by_value = of_folds(owned.groupBy("attribute", "value").agg(*counts), ["attribute", "value"], ["n", "buyers", "matched"]).filter(F.col("n") > 0)
    some = F.when(F.col("buyers") > 0, F.col("n"))
    sums = by_value.groupBy("fold", "attribute").agg(
        F.sum("matched").alias("matched"), F.try_divide(F.sum(some * F.col("buyers")), F.sum(some)).alias("mean_buyers"))
    people = pairs.groupBy(cols.user).agg(F.min("first_pair").alias("first_day"), *[F.sum(f"next{i}").alias(f"n{i}") for i in range(len(specs))])
    sizes = of_folds(people.agg(*[column for i, s in enumerate(specs) for column in (
        F.sum(f"n{i}").alias(f"n_next{i}"), F.count_if(known("first_day", s)).alias(f"n_customers{i}"))]), [], ["n_next", "n_customers"])
    return sums.join(sizes, "fold").select(
        "fold", "attribute", (100.0 * F.col("matched") / F.col("n_next")).alias("match_pct"),
        F.try_divide(100.0 * F.col("mean_buyers"), F.col("n_customers")).alias("chance_pct"))


def loyalty_mean(per_fold: DataFrame) -> DataFrame:
    return per_fold.groupBy("attribute").agg(
        F.avg("match_pct").alias("match_pct"), F.avg("chance_pct").alias("chance_pct"),
        F.try_divide(F.avg("match_pct"), F.avg("chance_pct")).alias("lift"), F.stddev("match_pct").alias("match_sd"))


def _user_fold_stats(tx: DataFrame, specs: Sequence[FoldSpec], stats: dict, cols: Columns) -> DataFrame:
    """`(fold, user, stats...)` from one aggregation: a conditional copy of each statistic per fold."""
    day = F.col(cols.date)
    columns, rows = [], []
    for i, s in enumerate(specs):
        known, held = day <= F.lit(s.train_end), s.in_val(day)
        columns += [fn(known, held).alias(f"{name}{i}") for name, fn in stats.items()]
        rows.append(F.struct(F.lit(s.fold).alias("fold"), F.lit(s.train_end).alias("cut"),
                             *[F.col(f"{name}{i}").alias(name) for name in stats]))
    return tx.groupBy(cols.user).agg(*columns).select(cols.user, F.explode(F.array(*rows)).alias("e")).select("e.fold", "e.cut", cols.user, *[f"e.{n}" for n in stats])


def who_buys(tx: DataFrame, customers: DataFrame, specs: Sequence[FoldSpec], seed_weeks: int = 4,
             affinity_weeks: int = 12, frequent: int = 10, cols: Columns = Columns()) -> DataFrame:
    """Share of customers with history who buy in the window, for all and for six groups."""
    stats = _user_fold_stats(tx, specs, {
        "last": lambda known, held: F.max(F.when(known, F.col(cols.date))),
        "purchases": lambda known, held: F.count_if(known),
        "bought": lambda known, held: F.max(held.cast("int"))}, cols).filter(F.col("purchases") > 0)
    people = stats.join(customers.select(cols.user, "fashion_news_frequency"), cols.user, "left")
    days, news = F.datediff("cut", "last"), F.col("fashion_news_frequency")
    groups = {"base": F.lit(True), "recent": days <= 7 * seed_weeks, "dormant": days > 7 * affinity_weeks,
              "frequent": F.col("purchases") >= frequent, "one_time": F.col("purchases") == 1,
              "newsletter": news == "Regularly", "no_news": news.isin("NONE", "None")}
    return people.groupBy("fold").agg(*[F.avg(F.when(c, F.col("bought"))).alias(n) for n, c in groups.items()])


def who_buys_mean(per_fold: DataFrame) -> DataFrame:
    """`(segment, buy_rate_pct, sd, lift)` over folds; lift is against the mean base rate."""
    names = [c for c in per_fold.columns if c not in ("fold", "base")]
    means = per_fold.agg(F.avg("base").alias("base"), *[F.avg(n).alias(f"m_{n}") for n in names],
                         *[F.stddev(n).alias(f"s_{n}") for n in names])
    return means.select("base", F.explode(F.array(*[
        F.struct(F.lit(n).alias("segment"), F.col(f"m_{n}").alias("m"), F.col(f"s_{n}").alias("s")) for n in names])).alias("e")
    ).select("e.segment", (100 * F.col("e.m")).alias("buy_rate_pct"), (100 * F.col("e.s")).alias("sd"),
             F.try_divide(F.col("e.m"), F.col("base")).alias("lift"))


def cold_buyer_share(tx: DataFrame, specs: Sequence[FoldSpec], cols: Columns = Columns()) -> DataFrame:
    """Share of each window's buyers who had no purchase before it."""
    stats = _user_fold_stats(tx, specs, {
        "purchases": lambda known, held: F.count_if(known), "held": lambda known, held: F.count_if(held)}, cols)
    return stats.filter(F.col("held") > 0).groupBy("fold").agg(
        (F.count_if(F.col("purchases") == 0) / F.count("*")).alias("cold_share"))


def behaviour_consistency(tx: DataFrame, articles: DataFrame, specs: Sequence[FoldSpec], exact_cuts: bool = False,
                          cols: Columns = Columns()) -> DataFrame:
    """Observed and chance agreement of price tier, channel and category, per window.

    A user's row holds what was usual and what came next, so price and channel need no join; users with history only count
    for the cut points of the tiers.
    """
    price, channel = F.col("price"), F.col("sales_channel_id").cast("double")
    stats = written(_user_fold_stats(tx, specs, {
        "known_rows": lambda known, held: F.count_if(known), "held_rows": lambda known, held: F.count_if(held),
        "p0": lambda known, held: F.avg(F.when(known, price)), "p1": lambda known, held: F.avg(F.when(held, price)),
        "c0": lambda known, held: F.avg(F.when(known, channel)), "c1": lambda known, held: F.avg(F.when(held, channel))}, cols))
    before = stats.filter(F.col("known_rows") > 0)
    if exact_cuts:
        marks = exact_percentiles(before, "fold", "p0", (0.33, 0.66))
        cuts = marks.groupBy("fold").agg(F.min_by("value", "share").alias("low"), F.max_by("value", "share").alias("high"))
    else:
        cuts = before.groupBy("fold").agg(F.percentile_approx("p0", 0.33, 10000).alias("low"), F.percentile_approx("p0", 0.66, 10000).alias("high"))
    low, high = F.col("low"), F.col("high")
    both = before.filter(F.col("held_rows") > 0).join(cuts, "fold").select("fold", F.explode(F.array(
        F.struct(F.lit("price").alias("dimension"), price_tier(F.col("p0"), low, high).cast("string").alias("usual"), price_tier(F.col("p1"), low, high).cast("string").alias("next_val")),
        F.struct(F.lit("channel").alias("dimension"), (F.col("c0") > 1.5).cast("string").alias("usual"), (F.col("c1") > 1.5).cast("string").alias("next_val")))).alias("e")
    ).select("fold", "e.*")
    category = _usual_category(tx, articles, specs, cols).join(_next_category(tx, articles, specs, cols), ["fold", cols.user])
    category = category.select("fold", F.lit("category").alias("dimension"), F.col("usual").cast("string").alias("usual"), F.col("next_val").cast("string").alias("next_val"))
    # counts per (usual, next) combination hold everything needed and are few
    combos = written(both.unionByName(category).groupBy("fold", "dimension", "usual", "next_val").agg(F.count("*").alias("n")))
    return agreement(combos, ["fold", "dimension"])


def _usual_category(tx, articles, specs, cols) -> DataFrame:
    day = F.col(cols.date)
    pairs = tx.groupBy(cols.user, cols.item).agg(*[F.count_if(day <= F.lit(s.train_end)).alias(f"n{i}") for i, s in enumerate(specs)])
    groups = pairs.join(articles.select(cols.item, "index_group_no"), cols.item).groupBy(cols.user, "index_group_no").agg(
        *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(specs))])
    # the most bought group of each fold, the smaller one of equals: one aggregation per user
    best = [F.max_by(F.when(F.col(f"n{i}") > 0, F.col("index_group_no")), F.when(F.col(f"n{i}") > 0, F.struct(F.col(f"n{i}"), -F.col("index_group_no")))).alias(f"g{i}")
            for i in range(len(specs))]
    rows = F.array(*[F.struct(F.lit(s.fold).alias("fold"), F.col(f"g{i}").alias("usual")) for i, s in enumerate(specs)])
    return groups.groupBy(cols.user).agg(*best).select(cols.user, F.explode(rows).alias("e")).select("e.fold", cols.user, "e.usual").filter(F.col("usual").isNotNull())


def _next_category(tx, articles, specs, cols) -> DataFrame:
    from shoprank.operators.eda import top_index

    return top_index(next_pairs(tx, specs, cols), "next_val", articles, "index_group_no", ["fold"], cols)


def consistency_mean(per_fold: DataFrame) -> DataFrame:
    return per_fold.groupBy("dimension").agg(
        F.avg("observed").alias("observed"), F.avg("chance").alias("chance"),
        F.try_divide(F.avg("observed"), F.avg("chance")).alias("ratio"))
