from datetime import date

import pytest
from pyspark.sql import functions as F

from shoprank.operators import eda, signals
from shoprank.operators.folds import fold_specs
from tests.conftest import rows


def log(spark, items):
    return spark.createDataFrame([(u, i, date.fromisoformat(d), 10.0) for u, i, d in items],
                                 "customer_id string, article_id string, t_dat date, price double")


def test_repurchase_ranks_leave_gaps_on_same_day_ties(spark):
    tx = log(spark, [("u", "a", "2020-01-01")] * 2 + [("u", "a", "2020-01-09"), ("v", "a", "2020-01-01"), ("v", "a", "2020-01-04"), ("v", "a", "2020-01-04")])
    r = eda.repurchase_rates(tx).first()
    assert r["repurchase_rate"] == 50.0 and r["repurchase_share"] == 50.0
    assert rows(eda.time_to_repurchase(tx), "days_to_repurchase", "n_pairs", "cum_pct") == [(3, 2, 100.0)]


def test_lorenz_unfolds_long_steps(spark):
    tx = log(spark, [("u", f"i{n}", "2020-01-01") for n in range(10)] + [("v", "i0", "2020-01-02")] * 9)
    points = rows(eda.lorenz(tx, run=3), "item_pct", "cum_purchase_pct")
    assert len(points) == 10 and points[0] == pytest.approx((10.0, 100 * 10 / 19)) and points[-1] == pytest.approx((100.0, 100.0))
    assert eda.top_share(tx, (1, 10)).first()["top10_pct"] == pytest.approx(100 * 10 / 19)
    assert eda.top_share(tx, (1,)).first()["top1_pct"] is None


def test_buckets_and_activity(spark):
    tx = log(spark, [("u", "a", "2020-01-01")] * 5 + [("v", "a", "2020-06-01")])
    assert rows(eda.interaction_buckets(tx, "customer_id", "n_users"), "log_bucket", "bucket_label", "n_users") == [(0, "1 - 1", 1), (2, "4 - 7", 1)]
    got = rows(eda.user_activity_segments(tx, date(2020, 6, 10)), "segment", "n_users", "pct_users")
    assert got == [("1_active", 1, 50.0), ("3_inactive", 1, 50.0)]
    assert rows(eda.recency_histogram(tx, date(2020, 6, 10)), "bucket") == [(0,), (154,)]


def test_decay(spark):
    tx = log(spark, [("u", "a", "2020-01-06"), ("u", "a", "2020-01-21"), ("v", "b", "2020-01-08"), ("v", "b", "2020-01-09")])
    assert rows(eda.survival_curve(tx), "week_offset", "pct_surviving") == [(0, 100.0), (2, 50.0)]
    assert rows(eda.volume_by_week_offset(tx), "cum_pct_volume") == [(75.0,), (100.0,)]
    assert rows(eda.item_lifespan(tx), "lifespan_weeks", "n_items") == [(0, 1), (2, 1)]


def test_consistency_against_chance(spark):
    usual = spark.createDataFrame([("u", "x"), ("v", "x"), ("w", "y"), ("q", None)], "customer_id string, usual string")
    following = spark.createDataFrame([("u", "x"), ("v", "y"), ("w", "y"), ("q", None)], "customer_id string, next_val string")
    r = eda.consistency(usual, following).first()
    assert r["observed"] == pytest.approx(2 / 3) and r["chance"] == pytest.approx((2 * 1 + 1 * 2 + 1 * 1) / 16)


def test_evaluate_source(spark):
    bought = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "a")], "customer_id string, article_id string")
    r = eda.evaluate_source("g", bought.select("article_id").filter("article_id = 'a'"), bought, 4, 1).first()
    assert (r["recall_pct"], r["precision_pct"], r["hit_rate_pct"]) == (pytest.approx(200 / 3), 50.0, 100.0)
    none = eda.evaluate_source("n", bought.filter("false"), bought).first()
    assert (none["recall_pct"], none["precision_pct"], none["hit_rate_pct"]) == (0.0, 0.0, 0.0)


def test_studies_use_only_the_past_of_each_window(spark):
    tx = log(spark, [("u", "a", "2020-01-01"), ("u", "a", "2020-01-20"), ("u", "b", "2020-01-20"), ("v", "c", "2020-01-20"), ("u", "b", "2020-01-27")])
    articles = spark.createDataFrame([("a", 1, 7), ("b", 1, 8), ("c", 2, 9)], "article_id string, product_code long, product_type_no long")
    specs = fold_specs("2020-01-29", None, 1, 2, False)
    got = {(r["fold"], r["bucket"][0]): r["pairs"] for r in signals.demand_decomposition(tx, articles, specs).collect() if r["pairs"]}
    assert got == {("fold_0", "1"): 1, ("fold_1", "1"): 1, ("fold_1", "2"): 1, ("fold_1", "5"): 1}
    assert rows(signals.cold_buyer_share(tx, specs), "fold", "cold_share") == [("fold_0", 0.0), ("fold_1", 0.5)]
    shares = {r["fold"]: r["unseen_pct"] for r in signals.new_item_shares(tx, specs).collect()}
    assert shares["fold_0"] == 0.0 and shares["fold_1"] == pytest.approx(200 / 3)


def test_duplicates_and_patterns(spark):
    tx = log(spark, [("u", "a", "2020-01-01")] * 2 + [("u", "a", "2020-01-02")]).withColumn("price", F.monotonically_increasing_id() * 0.0)
    r = signals.duplicate_audit(tx).first()
    assert tuple(r) == (3, 1, 1, 2)
    facts = eda.transaction_facts(eda.transaction_patterns(tx)).first()
    assert facts["n_weeks"] == 1 and facts["peak_transactions"] == 3 and facts["n_outliers"] == 0


def test_loyalty_never_broadcasts_the_values_and_counts_by_hand(spark):
    tx = log(spark, [("u", "a", "2020-01-01"), ("u", "b", "2020-01-27"), ("v", "a", "2020-01-02"), ("v", "c", "2020-01-28"), ("v", "c", "2020-01-29"),
                     (None, "a", "2020-01-03"), (None, "b", "2020-01-28"), ("w", "x", "2020-01-28")])
    articles = spark.createDataFrame([("a", "red"), ("b", "red"), ("b", "red"), ("c", None)], "article_id string, colour string")
    (spec,) = fold_specs("2020-01-29", None, 1, 1, False)
    table = signals.attribute_loyalty(tx, articles, [spec], [("colour", "colour")])
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [article_id" in plan
    # next: u-b, v-c, nobody's b, w-x; b is listed twice, so four values of which u's two match; red has three buyers, three customers
    r = table.first()
    assert (r["fold"], r["attribute"]) == ("fold_0", "colour") and r["match_pct"] == 100.0 * 2 / 4 and r["chance_pct"] == 100.0 * 3 / 3
