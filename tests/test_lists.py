import math

import pytest
from pyspark.sql import functions as F

from shoprank.operators import diagnostics, metrics, recommend, reports
from shoprank.sources import sinks
from tests.conftest import rows


def recs(spark, lists):
    return spark.createDataFrame([(u, i, p) for u, items in lists.items() for p, i in enumerate(items, 1)],
                                 "customer_id string, article_id string, pos int")


def pairs(spark, truth):
    return spark.createDataFrame([(u, i) for u, items in truth.items() for i in items], "customer_id string, article_id string")


def users(spark, names):
    return spark.createDataFrame([(n,) for n in names], "customer_id string")


def value(df):
    return df.first()[0]


def test_average_precision_and_population(spark):
    p, t = recs(spark, {"u": ["a", "x", "b"], "v": ["x"]}), pairs(spark, {"u": ["a", "b"], "v": ["q"]})
    assert value(metrics.mapk(p, t, 12, users(spark, ["u"]))) == pytest.approx(5 / 6)
    assert value(metrics.mapk(p, t)) == pytest.approx(5 / 12)
    assert value(metrics.mapk(p, t, 12, users(spark, ["u", "v", "w"]))) == pytest.approx(5 / 18)


def test_repeats_count_once_after_the_cut(spark):
    p, t = recs(spark, {"u": ["a", "a", "b"]}), pairs(spark, {"u": ["a", "b"]})
    assert value(metrics.mapk(p, t)) == pytest.approx((1 + 2 / 3) / 2)
    assert value(metrics.mapk(p, t, 2)) == pytest.approx(0.5)
    assert value(metrics.precision_at_k(p, t)) == pytest.approx(2 / 3)


def test_ndcg_precision_recall_mrr_hits(spark):
    p = recs(spark, {"u": ["x", "a"], "v": ["b", "y"], "w": ["z"]})
    t = pairs(spark, {"u": ["a"], "v": ["b", "c"], "q": ["d"]})
    best2 = 1 + 1 / math.log2(3)
    assert value(metrics.ndcg_at_k(p, t)) == pytest.approx((1 / math.log2(3) + 1 / best2) / 3)
    assert value(metrics.precision_at_k(p, t)) == pytest.approx((0.5 + 0.5 + 0) / 3)
    assert value(metrics.recall_at_k(p, t)) == pytest.approx((1 + 0.5 + 0) / 3)       # over u, v, q
    assert value(metrics.recall_at_k(p, t, 12, users(spark, ["u", "v"]))) == pytest.approx(0.75)
    assert value(metrics.mrr_at_k(p, t)) == pytest.approx((0.5 + 1 + 0) / 3)
    assert value(metrics.hit_rate_at_k(p, t)) == pytest.approx(2 / 3)


def test_empty_population_and_truth_give_zero(spark):
    p, none = recs(spark, {"u": ["a"]}), pairs(spark, {})
    assert value(metrics.mapk(p, none)) == 0 and value(metrics.recall_at_k(p, none)) == 0
    assert value(metrics.hit_rate(p, none)) == 0
    assert value(metrics.hit_rate(p, pairs(spark, {"u": ["a", "b"]}))) == 0.5


def test_top_k_breaks_ties_by_item(spark):
    scored = spark.createDataFrame([("u", "b", 1.0), ("u", "a", 1.0), ("u", "c", 2.0), ("v", "a", 0.0)], "customer_id string, article_id string, score double")
    best = recommend.top_k(scored, 2)
    assert rows(best, "customer_id", "pos", "article_id") == [("u", 1, "c"), ("u", 2, "a"), ("v", 1, "a")]
    assert rows(recommend.top_k(scored, 2, users(spark, ["v"])), "customer_id") == [("v",)]
    assert [r["items"] for r in recommend.to_lists(best).filter("customer_id = 'u'").collect()] == [["c", "a"]]


def test_backfill_pads_and_adds(spark):
    fallback = spark.createDataFrame([(1, "p"), (2, "a"), (3, "q")], "rank int, article_id string")
    got = recommend.backfill(recs(spark, {"u": ["a"], "full": ["x", "y", "z"], "out": ["m"]}), users(spark, ["u", "full", "w"]), fallback, 3)
    lists = {r["customer_id"]: r["items"] for r in recommend.to_lists(got).collect()}
    assert lists == {"u": ["a", "p", "q"], "full": ["x", "y", "z"], "w": ["p", "a", "q"], "out": ["m"]}


def test_sample_is_exact_and_stable(spark):
    everyone = spark.range(100).select(F.col("id").cast("string").alias("customer_id"))
    first = rows(recommend.sample_customers(everyone, 10), "customer_id")
    assert len(first) == 10 and rows(recommend.sample_customers(everyone.repartition(9), 10), "customer_id") == first
    assert recommend.sample_customers(everyone, 1000).count() == 100
    assert recommend.evaluation_users(everyone, None) is None
    features, val = recommend.sampled_inputs(everyone, everyone, 10)
    assert rows(features, "customer_id") == rows(val, "customer_id") == first
    assert recommend.sampled_inputs(everyone, everyone, None)[0] is everyone


def test_zero_baseline_has_no_lift(spark):
    p, t = recs(spark, {"u": ["a"]}), pairs(spark, {"u": ["a"]})
    best = spark.createDataFrame([(1, "z")], "rank int, article_id string")
    table = {r["metric"]: (r["baseline"], r["model"], r["lift"]) for r in recommend.compare_to_baseline(p, t, best).collect()}
    assert table["map"] == (0.0, 1.0, None) and set(table) == set(recommend.ACCURACY)


def candidates(spark):
    return spark.createDataFrame([("u", "a", 1, None, 1), ("u", "b", 2, 1, 2), ("v", "a", None, 1, 1)],
                                 "customer_id string, article_id string, x_rank int, y_rank int, n_sources int")


def test_source_rank_and_cap_reports(spark):
    c, t = candidates(spark), pairs(spark, {"u": ["a", "b"], "v": ["z"], "w": ["a"]})
    got = {r["source"]: r for r in diagnostics.per_source_report(c, t, customers=users(spark, ["u", "v", "w", "q"])).collect()}
    assert (got["x"]["candidates"], got["x"]["customers"], got["x"]["hits"]) == (2, 1, 2)
    assert got["UNION"]["recall_pct"] == 50.0 and got["UNION"]["customer_coverage_pct"] == 50.0
    assert got["UNION"]["hits"] >= max(got["x"]["hits"], got["y"]["hits"])
    sweep = {(r["source"], r["k"]): r["hits"] for r in diagnostics.rank_sweep(c, t, (1, 2)).collect()}
    assert sweep == {("x", 1): 1, ("x", 2): 2, ("y", 1): 1, ("y", 2): 1}
    caps = {r["cap"]: (r["rows"], r["hits"]) for r in diagnostics.cap_sweep(c, t, (1, None)).collect()}
    assert caps == {"1": (2, 1), "uncapped": (3, 2)}


def test_one_fold_has_no_deviation(spark):
    report = spark.createDataFrame([("f", "x", 1.0)], "fold string, source string, v double")
    r = diagnostics.across_folds(report, ["source"], ["v"]).first()
    assert (r["v_mean"], r["v_sd"]) == (1.0, None)


def test_business_panel(spark, make_fold):
    f = make_fold([("u", "a", "09-10", 10.0), ("v", "b", "01-01", 30.0)], [("u",), ("v",)], [("a", 1), ("b", 1), ("c", 1), ("d", 1)])
    p, t = recs(spark, {"u": ["a", "c"], "v": ["b"]}), pairs(spark, {"u": ["a"], "v": ["c"], "x": ["a"]})
    inputs = reports.business_inputs(f, users(spark, ["u", "v"]))
    got = dict(rows(reports.business_panel(p, t, inputs), "metric", "value"))
    assert got["revenue captured %"] == 100.0 and got["purchases captured %"] == 50.0       # c has no price
    assert got["price of recommended / purchased"] == pytest.approx((40 / 3) / 5)
    assert got["new arrivals in recommendations %"] == pytest.approx(100 / 3)
    assert got["replenishment share of hits %"] == 100.0 and got["catalogue coverage %"] == 75.0


def test_segments(spark, make_fold):
    f = make_fold([("u", "a", "09-10")], log=[("u", "a", "09-10"), ("l", "a", "08-01"), ("d", "a", "01-01")])
    p, t = recs(spark, {u: ["a"] for u in ("u", "l", "d", "c")}), pairs(spark, {"u": ["a"], "c": ["z"]})
    got = {r["segment"]: (r["customers"], r["buyers"], r["map"]) for r in reports.segment_report(p, t, reports.activity_segments(f)).collect()}
    assert got == {"active (<=4w)": (1, 1, 1.0), "lapsed (4-12w)": (1, 0, 0.0), "dormant (>12w)": (1, 0, 0.0), "cold (no history)": (1, 1, 0.0)}


def test_submission_checks(spark):
    out = sinks.submission_rows(recommend.to_lists(recs(spark, {"u": ["a", "b"], "v": ["a"], "z": ["a", "b"]})))
    want = spark.createDataFrame([("u",), ("v",), ("w",)], "customer_id string")
    assert dict(rows(sinks.submission_violations(out, want, 2), "problem", "n")) == {"missing": 1, "unexpected": 1, "wrong_length": 1}
    with pytest.raises(ValueError, match="missing"):
        sinks.validate_submission(out, want, 2)
    sinks.validate_submission(out.filter("customer_id = 'u'"), want.filter("customer_id = 'u'"), 2)
