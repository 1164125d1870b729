from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoprank.operators import nearest, retrieval, union
from shoprank.operators.shared import dense_ids
from tests.conftest import rows

RANKED = ("customer_id", "article_id", "rank")


def test_repurchase_counts_history(make_fold):
    f = make_fold([("u", "c", "09-10")], log=[("u", "b", "01-01"), ("u", "b", "02-01"), ("u", "a", "03-01"), ("u", "c", "09-10")])
    assert rows(retrieval.repurchase(f, 2), *RANKED) == [("u", "a", 2), ("u", "b", 1)]
    assert rows(retrieval.repurchase(f, 2, lifetime=False), *RANKED) == [("u", "c", 1)]


def test_popularity_serves_everyone_and_ignores_old_rows(make_fold):
    f = make_fold([("u", "old", "08-01"), ("u", "a", "09-10"), ("v", "a", "09-10"), ("v", "b", "09-10")], [("u",), ("v",), ("w",)])
    got = rows(retrieval.popularity(f, 5, weeks=1), *RANKED)
    assert got == [(u, i, r) for u in "uvw" for i, r in (("a", 1), ("b", 2))]


def test_product_code_ranks_variants_by_sales(make_fold):
    f = make_fold([("u", "a", "09-10"), ("v", "b", "09-10"), ("w", "b", "09-10"), ("w", "z", "01-01")], (),
                  [("a", 1), ("b", 1), ("c", 1), ("z", 2)])
    assert rows(retrieval.product_code(f, 2).filter("customer_id = 'u'"), *RANKED) == [("u", "a", 2), ("u", "b", 1)]
    assert retrieval.product_code(f, 5).filter("article_id = 'z'").count() == 0


def _baskets():
    return {f"u{n}": sorted({f"i{(n * k) % 17:02d}" for k in range(1, 3 + n % 9)}) for n in range(30)}


@pytest.mark.parametrize("size, hot", [(128, 0), (8, 0), (1, 0), (8, 90)])
def test_neighbours_equal_brute_force_with_any_slices(make_fold, size, hot):
    baskets = _baskets()
    if hot:                                                              # one user holds more than a third of all rows
        baskets["hot"] = [f"i{n:02d}" for n in range(hot)]
    f = make_fold([(u, i, "09-10") for u, items in baskets.items() for i in items for _ in range(2)])
    pairs = Counter(p for items in baskets.values() for a, b in combinations(items, 2) for p in ((a, b), (b, a)))
    want = []
    for seed in {a for a, _ in pairs}:
        best = sorted(((-n, b) for (a, b), n in pairs.items() if a == seed))[:5]
        want += [(seed, b, -n, r) for r, (n, b) in enumerate(best, 1)]
    got = rows(retrieval.copurchase_neighbors(f, 5, size), "seed", "article_id", "cocount", "r")
    assert got == sorted(want)


def test_itemcf_sums_over_recent_seeds(make_fold):
    f = make_fold([("u", "a", "09-10"), ("v", "a", "09-01"), ("v", "b", "09-01"), ("w", "a", "06-01"), ("w", "c", "06-01")])
    got = rows(retrieval.itemcf(f, 10).filter("customer_id = 'u'"), *RANKED)
    assert got == [("u", "b", 1), ("u", "c", 2)]


def test_segments_back_off(make_fold):
    people = [("u", 20.0, "p1"), ("v", 22.0, "p2"), ("x", None, None), ("n", None, "p1")]
    f = make_fold([("u", "a", "09-10"), ("v", "b", "09-10"), ("v", "b", "09-09"), ("v", "c", "09-10")], people)

    def of(user, mode):
        got = retrieval.segment_popularity(f, 3, 4, mode).filter(F.col("customer_id") == user)
        return [i for _, i in rows(got, "rank", "article_id")]

    assert of("u", "off") == ["a", "b", "c"] and of("v", "off") == ["b", "c", "a"]
    assert of("x", "off") == [] and of("x", "no_info_only") == ["b", "a", "c"]
    assert of("n", "no_info_only") == [] and of("n", "all") == ["b", "a", "c"]
    assert rows(retrieval.segment_popularity(f, 3, name="popularity").select("source").distinct(), "source") == [("popularity",)]
    with pytest.raises(ValueError):
        retrieval.segment_popularity(f, global_fallback="never")


def test_als_gives_ranked_lists(make_fold):
    f = make_fold([(f"u{n}", f"i{(n * k) % 11}", "09-10") for n in range(20) for k in range(1, 4)])
    got = retrieval.als_graph(f, 3, rank=4, iters=2)
    per_user = got.groupBy("customer_id").agg(F.sort_array(F.collect_list("rank")).alias("r"))
    assert {tuple(r["r"]) for r in per_user.collect()} == {(1, 2, 3)} and per_user.count() == 20


def test_dense_ids_are_dense(spark):
    ids = dense_ids(spark.range(500).selectExpr("concat('k', id % 123) AS k"), "k", "n", buckets=16)
    assert sorted(r["n"] for r in ids.collect()) == list(range(123))


def test_union_flags_and_cap(make_fold):
    f = make_fold([("u", "a", "09-10"), ("u", "b", "09-10"), ("v", "b", "09-10")], [("u",), ("v",)])
    parts = {"repurchase": retrieval.repurchase(f), "popularity": retrieval.popularity(f, 1)}
    wide = union.source_flags(union.union_candidates(parts), list(parts))
    got = {(r["customer_id"], r["article_id"]): (r["repurchase_rank"], r["popularity_rank"], r["n_sources"]) for r in wide.collect()}
    assert got == {("u", "a"): (1, None, 1), ("u", "b"): (2, 1, 2), ("v", "b"): (1, 1, 2)}
    assert rows(union.cap_per_customer(wide, 1), "customer_id", "article_id") == [("u", "b"), ("v", "b")]
    assert union.cap_per_customer(wide, None) is wide


def test_every_source_keeps_the_contract(make_fold):
    f = make_fold([(f"u{n % 7}", f"i{n % 5}", "09-10") for n in range(35)], [(f"u{n}", 20.0 + n, "p") for n in range(7)],
                  [(f"i{n}", n % 2) for n in range(5)])
    for got in (retrieval.repurchase(f, 3), retrieval.popularity(f, 3), retrieval.product_code(f, 3), retrieval.itemcf(f, 3),
                retrieval.segment_popularity(f, 3)):
        assert got.columns == ["customer_id", "article_id", "rank", "source"]
        lists = got.groupBy("customer_id").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
        assert lists and all(r["r"] == list(range(1, len(r["r"]) + 1)) and len(r["r"]) <= 3 for r in lists)


def test_factor_lists_equal_the_full_product(spark, make_fold):
    baskets = _baskets()
    f = make_fold([(u, i, "09-10") for u, items in baskets.items() for i in items])
    model, _, _ = retrieval.als_model(f, rank=4, iters=2)
    full = {r["_u"]: [x["rating"] for x in r["recommendations"]] for r in model.recommendForAllUsers(6).collect()}
    found = retrieval.nearest_by_factors(model.userFactors, model.itemFactors, 6, size=5)
    got = {}
    for r in found.orderBy("_u", "rank").collect():
        got.setdefault(r["_u"], []).append(r["score"])
    assert got.keys() == full.keys()
    for user, scores in got.items():
        assert scores == pytest.approx(full[user], abs=1e-4)
    plan = retrieval.als_graph(f, 6, 4, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    lists = rows(retrieval.als_graph(f, 6, 4, 2), "customer_id", "rank", "article_id")
    assert len(lists) == 6 * len(baskets) and len({(u, i) for u, _, i in lists}) == len(lists)


def _factors(spark, seed, n, width=5, scale=1.0):
    draw = np.random.default_rng(seed)
    x = (np.abs(draw.normal(size=(n, width))) * np.exp(scale * draw.normal(size=(n, 1)))).astype(np.float32)
    x[n // 2 :: 7] = x[0]                                     # equal rows, so equal scores
    return x, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id int, features array<float>")


@pytest.mark.parametrize("out_bytes", [1 << 20, 4 * 16 * 5, 0])
def test_nearest_items_equal_the_full_product(spark, out_bytes):
    """One broadcast for all blocks, or one block at a time with written lists in between."""
    (x, users), (y, items) = _factors(spark, 1, 60), _factors(spark, 2, 150)
    got = {}
    for r in nearest.nearest_by_factors(users, items, 7, size=16, out_bytes=out_bytes).orderBy("_u", "rank").collect():
        got.setdefault(r["_u"], []).append((r["rank"], r["_i"], r["score"]))
    full = x.astype(float) @ y.T.astype(float)
    for u in range(60):
        order = sorted(range(150), key=lambda i: (-round(full[u, i], 9), i))[:7]
        assert [(k, i) for k, i, _ in got[u]] == [(k + 1, i) for k, i in enumerate(order)]
        assert [s for _, _, s in got[u]] == pytest.approx(full[u, order], rel=1e-6)


def test_short_catalogues_and_empty_factors(spark):
    (_, users), (_, items) = _factors(spark, 1, 3), _factors(spark, 2, 2)
    assert nearest.nearest_by_factors(users, items, 5).groupBy("_u").count().select("count").distinct().collect()[0][0] == 2
    assert nearest.nearest_by_factors(users, items.limit(0), 5).count() == 0 and nearest.nearest_by_factors(users.limit(0), items, 5).count() == 0


def test_blocks_out_of_reach_stay_closed():
    y = np.diag(np.linspace(10, 0.1, 100)).astype(np.float32)
    opened = []
    boxes = [(float(y[k].max()), lambda k=k: opened.append(k) or (np.arange(k, k + 10), y[k : k + 10])) for k in range(0, 100, 10)]
    x = np.abs(np.random.default_rng(0).normal(size=(4, 100)))
    x[:, 0] = 50
    scores, ids = nearest.best_of_boxes(x, np.sqrt((x**2).sum(axis=1)), np.full((4, 1), -np.inf), np.full((4, 1), 99), boxes, 1)
    assert opened == [0] and ids.ravel().tolist() == [0] * 4 and np.allclose(scores, 500)


def test_item_factors_reach_tasks_as_packed_blocks(spark, monkeypatch):
    draw = np.random.default_rng(3)
    x, y = draw.random((30, 4)).astype(np.float32), draw.random((90, 4)).astype(np.float32)
    users = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, features array<float>")
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id int, features array<float>")

    def whole(self):
        raise AssertionError("a table of item factors as rows on the driver")

    monkeypatch.setattr(type(items), "toPandas", whole)
    got = {(r["_u"], r["rank"]): r["_i"] for r in nearest.nearest_by_factors(users, items, 5, size=8, out_bytes=8 * 4 * 4 * 3).collect()}
    products = x.astype(np.float64) @ y.T
    assert got == {(u, k + 1): int(i) for u in range(30) for k, i in enumerate(np.lexsort((np.arange(90), -products[u]))[:5])}


def test_one_shuffle_by_user_serves_union_and_cap(spark):
    parts = {n: spark.createDataFrame([("u", "a", 1, n), ("u", "b", 2, n)], "customer_id string, article_id string, rank int, source string")
             for n in ("x", "y")}
    wide = union.source_flags(union.union_candidates(parts), list(parts))
    plan = union.cap_per_customer(wide, 1)._jdf.queryExecution().executedPlan().toString()
    # nothing is held in memory before the shuffle, and the cap needs no second one
    assert plan.count("Exchange hashpartitioning(customer_id") == 1
    assert "HashAggregate" not in plan.split("Exchange hashpartitioning(customer_id")[1]


def test_segment_lists_never_broadcast_the_customers(make_fold):
    f = make_fold([("u", "a", "09-10")], [("u", 20.0, "p1"), ("x", None, None)])
    got = retrieval.segment_popularity(f, 3, global_fallback="off")
    assert "LeftOuter" in got._jdf.queryExecution().optimizedPlan().toString().split("Union")[0]
    assert rows(got, "customer_id", "article_id", "rank") == [("u", "a", 1)]


def test_tasks_are_given_little_of_a_shuffle(spark):
    # rows of a few numbers take many times their shuffled bytes in memory
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
