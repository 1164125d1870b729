"""The registered fits use the shipped parameters and every fold."""

import os
import time

import pytest
from pyspark.sql import functions as F

from registry import load_all

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


class Stop(Exception):
    pass


def test_fit_takes_shipped_parameters_and_all_trained_folds(spark, monkeypatch):
    load_all()
    from registry import ranking
    from shoprank.operators import ranker

    seen = {}

    def fit(self, train, group_cols=None, **_):
        seen.update(params=self.params, folds={r[0] for r in train.select(ranker.FOLD).distinct().collect()}, groups=group_cols,
                    labels={r[0] for r in train.select("label").distinct().collect()})
        raise Stop

    monkeypatch.setattr(ranker.LambdaRanker, "fit", fit)
    with pytest.raises(Stop):
        ranking.trained_model(spark, DIR)
    assert seen == {"params": ranker.RankerParams(), "folds": {"fold_1", "fold_2", "fold_3"}, "groups": [ranker.FOLD, "customer_id"], "labels": {0, 1}}


def test_development_covers_all_folds(spark, monkeypatch):
    load_all()
    from registry import QUERIES, ranking

    seen = {}

    def scores(settings, inputs, features):
        seen.update(periods=settings.periods, ranker=settings.training.ranker, folds=[inputs(f"fold_{k}").name for k in range(4)], tables=[features(f"fold_{k}").columns[-1] for k in range(4)])
        raise Stop

    monkeypatch.setattr(ranking, "written", lambda df: df)
    monkeypatch.setattr(ranking, "full_features", lambda fold: fold.train.withColumn("label", F.lit(0)))
    monkeypatch.setattr(ranking.development, "development_scores", scores)
    with pytest.raises(Stop):
        QUERIES["development_metrics"](spark, DIR)
    assert (seen["periods"].count, seen["periods"].trained, seen["ranker"]) == (4, (0, 1, 2, 3), {})
    assert seen["tables"] == ["label"] * 4
    assert seen["folds"] == ["fold_0", "fold_1", "fold_2", "fold_3"]


def test_a_query_really_fits(spark, monkeypatch):
    load_all()
    from registry import QUERIES, ranking

    monkeypatch.setattr(ranking, "S", ranking.S.changed(training={"ranker": {"rounds": 2}}))
    monkeypatch.setattr(ranking, "_MODELS", {})
    scores = QUERIES["ranker_score"](spark, DIR)
    (model,) = ranking._MODELS.values()
    assert len(model.trees) == 2 and max(t.leaves for t in model.trees) > 1 and len(model.feature_cols) == 51
    assert scores.filter("score is null").count() == 0 and scores.select("score").distinct().count() > 1


def test_features_are_built_for_drawn_rows_only(spark, monkeypatch):
    load_all()
    from dataclasses import replace

    from registry import feature_blocks, ranking, tables

    built, original = [], feature_blocks.feature_table

    def counted(fold, rows, blocks, settings):
        built.append(rows.count())
        return original(fold, rows, blocks, settings)

    monkeypatch.setattr(feature_blocks, "feature_table", counted)
    fold = feature_blocks.prepared(tables.retail_fold(spark, DIR, 1))
    once, whole = ranking.drawn(fold), fold.candidates.count()
    n = once.count()
    assert built == [n] and 0 < n < whole
    whole_first = ranking.ranker.training_frame(feature_blocks.full_features(fold).withColumn(ranking.FOLD, F.lit("fold_1")), ranking.N)
    assert whole_first.select(*once.columns).exceptAll(once).count() == 0 and whole_first.count() == n
    # an article listed twice repeats rows of the feature table: the draw is made among those
    twice = replace(fold, articles=fold.articles.unionByName(fold.articles.filter("article_id % 3 = 0")))
    built.clear()
    ranking.drawn(twice)
    assert built == [whole]


def test_scores_are_read_from_unwritten_features(spark, monkeypatch):
    load_all()
    from registry import ranking

    def refused(df):
        raise AssertionError("a full feature table is written")

    monkeypatch.setattr(ranking, "written", refused)
    assert "label" in ranking.held_out(spark, DIR)[1].columns


def test_folds_are_measured_without_writing_candidates(spark, monkeypatch):
    load_all()
    from registry import lists
    from shoprank.operators import diagnostics

    stored = []
    monkeypatch.setattr(lists, "written", lambda df, write=lists.written: (stored.append(set(df.columns)), write(df))[1])
    report = lists.fold_reports(spark, DIR, lambda found, truth: diagnostics.cap_sweep(found, truth, (2, None), keys=["fold"]))
    assert {(r["fold"], r["cap"]) for r in report.collect()} == {(f"fold_{k}", c) for k in range(4) for c in ("2", "uncapped")}
    assert not any("n_sources" in columns for columns in stored)


def test_training_leaves_no_tables(spark, monkeypatch):
    load_all()
    from registry import ranking
    from shoprank.functions.session import ensure_checkpoint_dir, written
    from shoprank.operators import ranker

    def tables():
        return set(os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")))

    def fit(self, train, *_):
        assert written(train).count() == 9
        return "model"

    monkeypatch.setattr(ranking, "sampled_frame", lambda spark, d: written(spark.range(9)))
    monkeypatch.setattr(ranker.LambdaRanker, "fit", fit)
    before = tables()
    try:
        assert ranking.trained_model(spark, "own rows") == "model"
    finally:
        ranking._MODELS.pop((spark.sparkContext.applicationId, "own rows"), None)
    assert tables() == before


def test_shuffle_files_of_written_tables_are_released(spark):
    from shoprank.functions.session import written

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {name for name in (str(b.name()) for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllBlocks())) if name.startswith("shuffle_")}

    before = shuffles()
    assert written(spark.range(2000).repartition(7, "id")).count() == 2000
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before
