import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoprank.operators import boosting, ranker, recommend


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(7)
    data = [(f"u{u}", f"a{u}_{i}", int(f[0] > 0.8), *map(float, f)) for u in range(20) for i in range(15) for f in [draw.normal(size=3)]]
    return spark.createDataFrame(pd.DataFrame(data, columns=["customer_id", "article_id", "label", "f0", "f1", "f2"]))


@pytest.fixture(scope="module")
def model(table):
    return ranker.LambdaRanker(rounds=3, min_child_samples=5, learning_rate=0.3, num_leaves=8).fit(table)


def plain_gradients(score, label, starts, truncation):
    """Sums over all pairs of a group, of which one is among the first `truncation`."""
    g, h = np.zeros(len(score)), np.zeros(len(score))
    for a, b in zip(starts, [*starts[1:], len(score)], strict=True):
        order = sorted(range(a, b), key=lambda i: (-score[i], i))
        best = sum(1 / math.log2(i + 2) for i in range(min(int(label[a:b].sum()), truncation)))
        for i in range(min(truncation, len(order))):
            for j in range(i + 1, len(order)):
                x, y = order[i], order[j]
                if label[x] != label[y]:
                    up, down = (x, y) if label[x] else (y, x)
                    p = 1 / (1 + math.exp(score[up] - score[down]))
                    d = abs(1 / math.log2(i + 2) - 1 / math.log2(j + 2)) / best
                    g[up] += d * p
                    g[down] -= d * p
                    h[[up, down]] += d * p * (1 - p)
    return g, h


@pytest.mark.parametrize("truncation", [1, 4, 30])
def test_gradients_equal_the_sum_over_pairs(truncation):
    draw = np.random.default_rng(5)
    sizes = [1, 2, 3, 17, 40, 8, 1]
    starts = np.cumsum([0, *sizes[:-1]])
    score, label = np.round(draw.normal(size=sum(sizes)), 1), draw.integers(0, 2, sum(sizes))
    label[starts[4] : starts[4] + 40] = 0
    for got, want in zip(boosting.gradients(score, label, starts, truncation), plain_gradients(score, label, starts, truncation), strict=True):
        assert np.allclose(got, want, atol=1e-12)


def test_ndcg_by_hand():
    found = boosting.ndcg(np.array([3.0, 2, 1, 5, 4, 9]), np.array([0, 1, 1, 0, 0, 1]), np.array([0, 3, 5]), 2)
    assert np.allclose(found, [(1 / math.log2(3)) / (1 + 1 / math.log2(3)), 1.0])


def plain_tree(codes, widths, categorical, g, h, drawn, features, p):
    """Best-first growth one leaf at a time, every split tried from the rows themselves; (leaf of every row, leaf values, splits)."""
    scale = boosting.SCALE
    g, h = np.rint(g * scale).astype(np.int64), np.rint(h * scale).astype(np.int64)

    def best(rows, depth):
        rows = rows[drawn[rows]]
        G, H, found = g[rows].sum() / scale, h[rows].sum() / scale, None
        if len(rows) < 2 * p.min_child_samples or (p.max_depth is not None and depth >= p.max_depth):
            return None
        for f in [*[f for f in features if f not in categorical], *[f for f in features if f in categorical]]:
            c = codes[f][rows]
            if f in categorical:
                present = [v for v in range(widths[f] - 1) if (c == v).any()]
                step = {v: (g[rows[c == v]].sum() / scale) / (h[rows[c == v]].sum() / scale + p.level_smoothing) for v in present}
                ordered = sorted(present, key=lambda v: -step[v])
                choices = [frozenset(ordered[: k + 1]) for k in range(len(ordered))]
            else:
                choices = [frozenset(range(k + 1)) for k in range(widths[f] - 1)]
            for left in choices:
                inside = np.isin(c, list(left))
                gl, hl, n = g[rows[inside]].sum() / scale, h[rows[inside]].sum() / scale, int(inside.sum())
                if min(n, len(rows) - n) < p.min_child_samples or min(hl, H - hl) < p.min_child_weight:
                    continue
                gain = gl**2 / (hl + p.reg_lambda) + (G - gl) ** 2 / (H - hl + p.reg_lambda) - G**2 / (H + p.reg_lambda)
                if gain > (found[0] if found else 1e-12):
                    found = (gain, f, left)
        return found

    leaves = [(np.arange(len(g)), 0)]
    open_ = [best(*leaves[0])]
    splits = []
    while len(leaves) < p.num_leaves and any(open_):
        k = max(range(len(leaves)), key=lambda i: open_[i][0] if open_[i] else -1.0)
        (rows, depth), (gain, f, left) = leaves[k], open_[k]
        inside = np.isin(codes[f][rows], list(left))
        splits.append((f, round(gain, 9)))
        leaves[k : k + 1] = [(rows[inside], depth + 1), (rows[~inside], depth + 1)]
        open_[k : k + 1] = [best(*x) for x in leaves[k : k + 2]]
    value = np.zeros(len(g))
    for rows, _ in leaves:
        used = rows[drawn[rows]]
        value[rows] = p.learning_rate * (g[used].sum() / scale) / (h[used].sum() / scale + p.reg_lambda)
    return value, sorted(splits)


@pytest.mark.parametrize("node_rows", [boosting.NODE_ROWS, 100])
@pytest.mark.parametrize("changes", [{}, {"num_leaves": 5}, {"max_depth": 3}, {"subsample": 1.0, "colsample": 1.0, "reg_lambda": 0.1}])
def test_trees_equal_a_plain_version(spark, changes, node_rows, monkeypatch):
    monkeypatch.setattr(boosting, "NODE_ROWS", node_rows)
    draw = np.random.default_rng(11)
    n = 600
    frame = pd.DataFrame({"customer_id": [f"u{k % 23}" for k in range(n)], "article_id": [f"a{k:04d}" for k in range(n)]})
    frame["x"], frame["y"], frame["few"], frame["kind"] = draw.normal(size=n), draw.normal(size=n), draw.integers(0, 4, n), draw.integers(0, 40, n)
    frame["label"] = ((frame.x + 0.5 * frame.y * (frame.few == 2) + np.isin(frame.kind, [3, 7, 20]) + draw.normal(size=n) * 0.3) > 1.2).astype(int)
    names = ["x", "y", "few", "kind"]
    params = dict(rounds=4, min_child_samples=7, learning_rate=0.3, num_leaves=12, max_bins=16) | changes
    fitter = ranker.LambdaRanker(names, ["kind"], **params)
    model = fitter.fit(spark.createDataFrame(frame).repartition(3))
    p, bins = fitter.params, model.bins

    frame = frame.sort_values(["customer_id", "article_id"]).reset_index(drop=True)
    codes = np.stack([bins.codes(x, frame[x].to_numpy(np.float32)) for x in names])
    starts = np.flatnonzero(frame.customer_id != frame.customer_id.shift())
    drawn = np.array([r[0] for r in spark.createDataFrame(frame).select(F.xxhash64("customer_id", "article_id")).collect()])
    score = np.zeros(n)
    assert len(model.trees) == 4
    for r, tree in enumerate(model.trees):
        g, h = plain_gradients(score, frame.label.to_numpy(), list(starts), p.truncation)
        features = boosting.drawn_features(4, p, r)
        value, splits = plain_tree(codes, [bins.width(x) for x in names], {3}, g, h, boosting.mixed(drawn, p.seed + r) < p.subsample, features, p)
        assert sorted((f, round(x, 9)) for f, x in zip(tree.feature, tree.gain, strict=True) if f >= 0) == splits
        assert np.allclose(tree.scores(codes), value, atol=1e-12)
        score += tree.scores(codes)
    # the compiled forest gives what the walk gives
    got = model.transform(spark.createDataFrame(frame)).toPandas().sort_values(["customer_id", "article_id"]).score.to_numpy()
    assert np.allclose(got, score, atol=1e-12)


def test_parts_and_lost_state_change_nothing(spark, table, monkeypatch):
    fit = lambda df: ranker.LambdaRanker(rounds=3, min_child_samples=5, num_leaves=8).fit(df)      # noqa: E731
    want = fit(table)
    monkeypatch.setattr(boosting, "KEPT_ROWS", 0)
    monkeypatch.setattr(boosting, "ROWS", 40)
    monkeypatch.setattr(boosting.Sweeps, "SEALED", 1)
    got = fit(table.repartition(7))
    assert [(t.feature, t.cut, t.value) for t in got.trees] == [(t.feature, t.cut, t.value) for t in want.trees]


def test_jobs_per_tree(table, monkeypatch):
    """One job where the rows are few; at most one per level and one more where they are not. The trees are the same."""
    def fit():
        seen, original = [], boosting.grow

        def counted(sweeps, round_, watch):
            before = sweeps.jobs
            tree = original(sweeps, round_, watch)
            seen.append((sweeps.jobs - before, tree))
            return tree

        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(boosting, "grow", counted)
            ranker.LambdaRanker(["f1", "f2"], rounds=3, min_child_samples=2, num_leaves=20).fit(table)
        return seen

    def depth(tree, k=0):
        return 0 if tree.feature[k] < 0 else 1 + max(depth(tree, tree.left[k]), depth(tree, tree.right[k]))

    small = fit()
    monkeypatch.setattr(boosting, "NODE_ROWS", 60)
    mixed = fit()
    monkeypatch.setattr(boosting, "NODE_ROWS", 0)
    large = fit()
    shape = lambda fits: [(t.feature, t.cut, t.value) for _, t in fits]                              # noqa: E731
    assert shape(small) == shape(mixed) == shape(large) and max(t.leaves for _, t in small) == 20
    assert all(n == 1 for n, _ in small) and all(2 < n for n, _ in large)
    assert all(n <= tree.leaves for n, tree in mixed + large) and max(depth(t) for _, t in large) >= 4


def test_many_levels(spark):
    draw = np.random.default_rng(3)
    n, levels = 20_000, 5_000
    code = np.concatenate([np.arange(levels), draw.integers(0, levels, n - levels)])
    good = draw.random(levels) < 0.2
    frame = pd.DataFrame({"customer_id": [f"u{k % 500}" for k in range(n)], "article_id": np.arange(n), "kind": code, "label": (good[code] & (draw.random(n) < 0.9)).astype(int)})
    df = spark.createDataFrame(frame)
    model = ranker.LambdaRanker(["kind"], ["kind"], rounds=2, learning_rate=0.5).fit(df)
    assert model.bins.width("kind") == levels + 1 and model.bins.dtype is np.uint16
    means = model.transform(df).join(df, ["customer_id", "article_id"]).groupBy("label").agg(F.avg("score")).collect()
    assert dict(map(tuple, means))[1] > dict(map(tuple, means))[0]
    unknown = df.limit(1).withColumn("kind", F.lit(999_999))
    assert model.transform(unknown).count() == 1


def test_parameters():
    with pytest.raises(ValueError):
        ranker.RankerParams(num_leaves=65)


def test_model_learns_the_signal(table, model):
    assert model.feature_importance("gain").first()["feature"] == "f0"
    assert model.feature_importance("split").agg(F.sum("split")).first()[0] > 0
    joined = model.transform(table).join(table, ["customer_id", "article_id"])
    means = {r["label"]: r["m"] for r in joined.groupBy("label").agg(F.avg("score").alias("m")).collect()}
    assert means[1] > means[0]


def test_recommend_sizes_and_backfill(spark, table, model):
    recs = model.recommend(table, 5)
    assert recs.groupBy("customer_id").count().filter("count <> 5").count() == 0
    assert recs.distinct().count() == recs.count() == 100
    people = spark.createDataFrame([("u0",), ("nobody",)], "customer_id string")
    fallback = spark.createDataFrame([(1, "p1"), (2, "p2")], "rank int, article_id string")
    padded = recommend.to_lists(model.recommend(table, 5, people, fallback))
    assert padded.filter("customer_id = 'nobody'").first()["items"] == ["p1", "p2"] and padded.count() == 21


def test_early_stopping_and_categories(table):
    coded = table.withColumn("f2", F.round("f2"))
    fitted = ranker.LambdaRanker(categorical_features=["f2"], rounds=8, early_stopping_rounds=1, min_child_samples=5, learning_rate=0.5, num_leaves=8).fit(
        coded, eval_frame=coded)
    assert 1 <= len(fitted.trees) <= 8 and max(fitted.history) == fitted.history[len(fitted.trees) - 1]


def test_history_equals_a_recomputation(spark, table):
    held = table.filter("customer_id in ('u1', 'u2', 'u3')").withColumn("half", F.col("article_id") > "a1_5")
    model = ranker.LambdaRanker(["f0", "f1", "f2"], rounds=4, min_child_samples=5, learning_rate=0.4, num_leaves=6, eval_k=5).fit(
        table, eval_frame=held, eval_group_cols=["customer_id", "half"])
    assert len(model.history) == 4 and len(model.trees) == 4
    for r in range(4):
        part = ranker.LambdaRankModel(model.feature_cols, model.bins, model.trees[: r + 1], model.columns)
        x = part.transform(held).join(held, ["customer_id", "article_id"]).toPandas().sort_values(["customer_id", "half", "article_id"]).reset_index(drop=True)
        starts = np.flatnonzero((x.customer_id != x.customer_id.shift()) | (x.half != x.half.shift()))
        assert abs(boosting.ndcg(x.score.to_numpy(), x.label.to_numpy(), starts, 5).mean() - model.history[r]) < 1e-9


def test_downsampling_keeps_positives_and_ratio(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("customer_id"), F.lit("a").alias("article_id"), (F.col("id") < 40).cast("int").alias("label"))
    kept = ranker.downsample(rows, 15)
    n = {r["label"]: r["count"] for r in kept.groupBy("label").count().collect()}
    assert n[1] == 40 and 500 < n[0] < 700
    assert sorted(r[0] for r in ranker.downsample(rows.repartition(5), 15).collect()) == sorted(r[0] for r in kept.collect())
    with pytest.raises(ValueError):
        ranker.downsample(rows.withColumn("label", F.lit(0)))


def test_matrix_and_feature_names(table):
    assert ranker.resolve_features(table.withColumn("_fold", F.lit(1))) == ["f0", "f1", "f2"]
    assert ranker.resolve_features(table, explicit=["f1"]) == ["f1"]
    r = ranker.prepare_matrix(table.withColumn("f0", F.lit(None).cast("double")), ["f0"])
    assert r.select("f0").distinct().collect()[0][0] == 0.0 and r.schema["f0"].dataType.simpleString() == "float"


def test_python_scorer(table):
    got = recommend.score_in_python(lambda frame: frame["f0"] * 2, table, ["f0"])
    assert got.join(table, ["customer_id", "article_id"]).filter("abs(score - 2 * f0) > 1e-9").count() == 0
