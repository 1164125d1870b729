import pytest

from shoprank.operators import features, retrieval, transforms, union
from shoprank.plans.features import feature_blocks, feature_table, with_pairs
from shoprank.schema import Settings
from tests.conftest import rows


def test_user_aggregates_pick_window_or_lifetime(make_fold):
    f = make_fold([("new", "a", "09-10", 10.0)], log=[
        ("new", "a", "01-01", 99.0), ("new", "a", "09-10", 10.0), ("new", "b", "09-10", 20.0, 2), ("old", "a", "01-05", 5.0), ("old", "a", "01-09", 7.0)])
    for exact in (True, False):
        got = {r["customer_id"]: r for r in features.user_aggregates(f, 12, exact)[0].collect()}
        assert (got["new"]["is_active"], got["old"]["is_active"]) == (1, 0)
        assert (got["new"]["user_purchases"], got["new"]["user_n_unique_items"], got["new"]["user_max_price"]) == (2, 2, 20.0)
        assert (got["old"]["user_purchases"], got["old"]["user_n_unique_items"], got["old"]["user_avg_price"]) == (2, 1, 6.0)
        assert got["new"]["user_avg_channel"] == 1.5 and got["new"]["user_days_since_last"] == 0


def test_item_aggregates(make_fold):
    f = make_fold([("u", "a", "09-10"), ("v", "a", "09-05"), ("w", "a", "08-01", 40.0)])
    r = features.item_aggregates(f, (1, 12))[0].first()
    assert (r["item_purchases_1w"], r["item_purchases_12w"], r["item_purchases_all"]) == (2, 3, 3)
    assert (r["item_repurchase_rate"], r["item_avg_price"], r["item_days_since_first_sale"]) == (1.0, 20.0, 40)


def test_affinity_keeps_unknown_items_and_the_window_rule(make_fold):
    f = make_fold([("u", "a", "09-10")], (), [("a", 1), ("b", 2)],
                  log=[("u", "a", "09-10"), ("u", "a", "09-09"), ("u", "b", "01-01"), ("v", "b", "01-01"), ("u", "x", "09-08")])
    block, keys = features.category_affinity(f, "product_code", 12, "pcode")
    assert keys == ["customer_id", "product_code"]
    got = {(r[0], r[1]): r[2] for r in block.collect()}
    assert got == {("u", 1): 2, ("u", None): 1, ("v", 2): 1}


def test_pair_blocks_agree_with_and_without_shared_sums(make_fold):
    f = make_fold([("u", "a", "09-13")], [("u", 20.0), ("v", 40.0)],
                  log=[("u", "a", "09-01"), ("u", "a", "08-01"), ("v", "a", "09-01"), ("v", "a", "09-02"), ("u", "a", "09-13")])
    for fold in (f, with_pairs(f, Settings())):
        got = rows(features.user_item_history(fold)[0], "customer_id", "user_item_purchases", "user_item_days_since_last")
        assert got == [("u", 3, 0), ("v", 2, 11)]
        assert rows(features.item_buyer_demographic(fold)[0], "item_mean_buyer_age") == [(28.0,)]


def test_customer_index_is_by_frequency_with_missing_last(make_fold):
    people = [("a", 1.0, "p", "X"), ("b", None, "p", "Y"), ("c", 1.0, "p", "Y"), ("d", 1.0, "p", None), ("e", 1.0, "p", "A")]
    f = make_fold([("a", "i", "09-10")], people)
    got = {r["customer_id"]: r["club_member_status_idx"] for r in features.customer_metadata(f)[0].collect()}
    assert got == {"b": 0.0, "c": 0.0, "e": 1.0, "a": 2.0, "d": 3.0}


def test_itemcf_score(spark, make_fold):
    f = make_fold([("u", "s1", "09-10"), ("u", "s2", "09-09")])
    edges = spark.createDataFrame([("s1", "a", 3), ("s2", "a", 2), ("s2", "b", 2)], "seed string, article_id string, cocount long")
    got = rows(features.itemcf_score(f, edges)[0], "article_id", "itemcf_score", "itemcf_max_score")
    assert got == [("a", 5, 3), ("b", 2, 2)]
    with pytest.raises(ValueError):
        features.itemcf_score(f, None)


def test_labels_and_ratios(spark):
    c = spark.createDataFrame([("u", "a"), ("u", "b")], "customer_id string, article_id string")
    assert rows(transforms.attach_labels(c, None), "label") == [(0,), (0,)]
    assert rows(transforms.attach_labels(c, c.filter("article_id = 'a'").union(c.filter("article_id = 'a'"))), "article_id", "label") == [("a", 1), ("b", 0)]
    one = spark.createDataFrame([(10.0, 20.0, 2, 4, 2, 5, 30.0, 25.0)], "user_avg_price double, item_avg_price double, user_dept_purchases long, "
                                "user_purchases long, user_item_purchases long, item_purchases_all long, age double, item_mean_buyer_age double")
    r = transforms.derived_ratios(one).first()
    assert r["price_ratio"] == pytest.approx(2.0, abs=1e-5) and r["user_dept_ratio"] == pytest.approx(0.5, abs=1e-5)
    assert (r["bought_before"], r["age_gap"], r["user_item_ratio"]) == (1, 5.0, 2 / 6)


def test_full_table_has_every_feature_once(make_fold):
    log = [(f"u{n % 6}", f"i{(n * n) % 9}", f"0{1 + n % 9}-1{n % 9}", 5.0 + n) for n in range(60)]
    train = [r for r in log if r[2] >= "07"]
    f = make_fold(train, [(f"u{n}", 20.0 + n, "p", "S", "R") for n in range(6)], [(f"i{n}", n % 3, n % 2) for n in range(9)], log, [("u1", "i1", "12-01")])
    s = Settings()
    edges = retrieval.copurchase_neighbors(f)
    parts = {n: make(f, edges) for n, make in retrieval.source_table(s, with_als=False).items()}
    cand = union.source_flags(union.union_candidates(parts), list(parts))
    pairs = feature_blocks(f, edges, s)
    for source, (block, keys) in pairs:
        assert set(block.columns) == {*source.produces, *keys}, source.name
    table = feature_table(f, cand, [b for _, b in pairs], s)
    assert len(table.columns) == 3 + 51 and len(set(table.columns)) == 54      # two ALS columns are absent
    assert table.count() == cand.count()
    shared = feature_table(f, cand, [b for _, b in feature_blocks(with_pairs(f, s), edges, s)], s)
    keys = ("customer_id", "article_id", "user_pcode_purchases", "user_item_ratio", "itemcf_score", "item_mean_buyer_age")
    fill = {k: -1.0 for k in keys[2:]}
    assert rows(shared.fillna(fill), *keys) == rows(table.fillna(fill), *keys)


def test_weekly_sketches_serve_every_window(spark):
    from datetime import date

    log = spark.createDataFrame([("u", f"i{k % 9}", date(2020, 9, 1 + k)) for k in range(28)] + [("v", "i1", date(2020, 9, 28)), ("v", "i2", date(2020, 9, 30))],
                                "customer_id string, article_id string, t_dat date")
    sketches = features.weekly_item_sketches(log, date(2020, 9, 28))
    windows = {"last": (date(2020, 9, 28), 1), "before": (date(2020, 9, 21), 1), "all": (date(2020, 9, 28), 4)}
    got = {(r.customer_id, r.win): r["items"] for r in features.distinct_in_windows(sketches, windows, date(2020, 9, 28)).collect()}
    assert got == {("u", "last"): 7, ("u", "before"): 7, ("u", "all"): 9, ("v", "last"): 1, ("v", "all"): 1}
    with pytest.raises(ValueError, match="whole number"):
        features.distinct_in_windows(sketches, {"odd": (date(2020, 9, 20), 1)}, date(2020, 9, 28))
