"""The whole run on a small generated shop, from CSV to the checked submission."""

from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shoprank.plans import development, stages
from shoprank.schema import Periods, Retrieval, Settings, Training
from shoprank.sources import readers
from tests.conftest import rows


@pytest.fixture(scope="module")
def settings(tmp_path_factory):
    raw, out = tmp_path_factory.mktemp("raw"), tmp_path_factory.mktemp("out")
    end = date(2020, 9, 22)
    lines = ["t_dat,customer_id,article_id,price,sales_channel_id"]
    for n in range(1800):
        user, day = n % 40, end - timedelta(days=(n * 7) % 84)
        item = (user * 3 + n // 40 % 6) % 30
        lines.append(f"{day},c{user},a{item:02d},{(item + 1) / 100},{1 + n % 2}")
    (raw / "transactions_train.csv").write_text("\n".join(lines))
    (raw / "customers.csv").write_text("customer_id,age,postal_code,club_member_status,fashion_news_frequency\n" + "\n".join(
        f"c{u},{'' if u % 7 == 0 else 20 + u},p{u % 3},ACTIVE,{'NONE' if u % 2 else 'Regularly'}" for u in range(42)))
    (raw / "articles.csv").write_text(
        "article_id,product_code,product_type_no,department_no,product_group_name,garment_group_no,section_no,index_group_no,colour_group_code\n"
        + "\n".join(f"a{i:02d},{i // 3},{i % 5},{i % 4},g{i % 3},{i % 6},{i % 7},{i % 2},{i % 8}" for i in range(30)))
    (raw / "sample_submission.csv").write_text("customer_id,prediction\n" + "\n".join(f"c{u},x" for u in range(42)))
    return Settings(raw_dir=str(raw), out_dir=str(out), submission_path=str(out / "submission"), periods=Periods(count=3, trained=(1, 2)),
                    retrieval=Retrieval(factors=4, sweeps=2, graph=5, repurchase=10, itemcf=10, popularity=10, product_code=5),
                    training=Training(ranker={"rounds": 2, "max_depth": 3, "min_child_samples": 5}))


@pytest.fixture(scope="module")
def model(spark, settings):
    return stages.run_all(spark, settings)


def test_run_writes_a_valid_submission(spark, settings, model):
    out = spark.read.option("header", True).csv(settings.submission_path)
    assert out.count() == 42 and out.filter(F.size(F.split("prediction", " ")) != 12).count() == 0


def test_features_are_complete_and_chunks_change_nothing(spark, settings, model):
    one = stages.read_features(spark, settings, ["fold_1"])
    assert len(one.columns) == 53 + 4                                     # keys, label, fold tag
    chunked = settings.changed(features={"passes": 3})
    before = rows(one.fillna(-1), "customer_id", "article_id", "label", "user_purchases", "user_item_purchases", "n_sources")
    stages.build_features(spark, chunked, "fold_1")
    after = rows(stages.read_features(spark, settings, ["fold_1"]).fillna(-1), "customer_id", "article_id", "label", "user_purchases", "user_item_purchases", "n_sources")
    assert before == after


def test_nothing_after_the_cut_reaches_a_fold(spark, settings, model):
    fold = stages.load_fold(spark, settings, "fold_1")
    assert fold.history.agg(F.max("t_dat")).first()[0] == fold.train_end < fold.val.agg(F.min("t_dat")).first()[0]
    assert not stages.load_fold(spark, settings, "fold_submission").has_labels
    checks = {r["fold"]: r["leak_check"] for r in stages.fold_table(spark, settings).collect()}
    assert checks["fold_0"] == "ok" and checks["fold_submission"] == "n/a"


def test_evaluation_and_development(spark, settings, model):
    r = stages.evaluate(spark, settings, model, "fold_0").first()
    assert r["customers"] == 42 and 0 < r["buyers"] <= 42 and all(0 <= r[m] <= 1 for m in ("map", "ndcg", "hit_rate", "precision", "recall"))
    scores = development.development_scores(
        settings, lambda f: stages.load_fold(spark, settings, f),
        lambda f: stages.read_features(spark, settings, [f]).drop("_fold"))
    assert rows(scores.select("fold", "training_weeks").distinct(), "fold", "training_weeks") == [("fold_1", 1)]
    assert development.development_metrics(scores).count() == 5


def test_own_sources_plug_in(spark, settings, model):
    from shoprank.operators.features import FeatureSource
    from shoprank.operators.retrieval import repurchase

    own = settings.changed(out_dir=settings.out_dir)
    cand = stages.build_candidates(spark, own, "fold_2", sources={"repeat": lambda f, e: repurchase(f, 3, "repeat")})
    assert {"repeat_rank", "src_repeat", "n_sources"} <= set(cand.columns)
    lifetime = FeatureSource("n", ("n_rows",), lambda f, e: (f.history.groupBy("customer_id").agg(F.count("*").alias("n_rows")), ["customer_id"]))
    from shoprank.plans.features import feature_blocks
    fold = stages.load_fold(spark, own, "fold_2")
    (source, (block, keys)), = feature_blocks(fold, None, own, sources=[lifetime])
    assert keys == ["customer_id"] and set(source.produces) < set(block.columns)


def test_a_killed_feature_stage_goes_on_where_it_was(spark, settings, model, monkeypatch):
    parts = settings.changed(features={"passes": 4})
    stages.build_candidates(spark, settings, "fold_2", with_als=False)
    stages.build_features(spark, settings, "fold_2")
    before = rows(stages.read_features(spark, settings, ["fold_2"]).fillna(-1), "customer_id", "article_id", "label", "user_purchases", "n_sources")
    computed, original = [], stages.feature_table

    def counted(inputs, candidates, blocks, settings_):
        if len(computed) == 2:
            raise KeyboardInterrupt
        computed.append(1)
        return original(inputs, candidates, blocks, settings_)

    monkeypatch.setattr(stages, "feature_table", counted)
    with pytest.raises(KeyboardInterrupt):
        stages.build_features(spark, parts, "fold_2")
    monkeypatch.setattr(stages, "feature_table", lambda *a: computed.append(1) or original(*a))
    stages.build_features(spark, parts, "fold_2")
    assert len(computed) == 4                                             # two before the kill, two after it
    after = rows(stages.read_features(spark, settings, ["fold_2"]).fillna(-1), "customer_id", "article_id", "label", "user_purchases", "n_sources")
    assert before == after and not Path(settings.out_dir, "feature_parts", "fold_2").exists()


def test_rebuilt_candidates_make_parts_stale(spark, settings, model):
    def plan():
        cand, edges = (spark.read.parquet(settings.table(f"{t}/fold=fold_1")) for t in ("candidates", "neighbors"))
        return stages.part_plan(settings, cand, edges, None)

    first = plan()
    assert plan() == first
    stages.build_candidates(spark, settings, "fold_1")
    assert plan() != first


def test_stages_leave_no_temporary_tables(spark, settings, model):
    from shoprank.functions.session import ensure_checkpoint_dir, temporary_tables, written

    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    stages.build_candidates(spark, settings, "fold_2", with_als=False)
    stages.build_features(spark, settings, "fold_2")
    assert {p.name for p in folder.iterdir()} == before
    with pytest.raises(ZeroDivisionError), temporary_tables(spark):
        written(spark.range(3))
        1 / 0
    assert {p.name for p in folder.iterdir()} == before


def test_the_run_uses_its_own_settings(spark, settings, monkeypatch):
    seen = {}
    monkeypatch.setattr(stages, "prepare", lambda session, *_: seen.update(skew=session.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin"), own=session is not spark))
    stages.run_all(spark, settings, ("prepare",))
    assert seen == {"skew": "true", "own": True}


def test_lines_that_do_not_fit_are_kept_apart(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,c\n1,2020-01-02,x\nno,2020-01-02,y\n2,soon,z\n3\n4,2020-01-02,w,more\n5,,\n")
    good, bad = readers.load_checked(spark, str(tmp_path / "x.csv"), "a int, b date, c string")
    assert sorted(r.a for r in good.select("a").collect()) == [1, 5]
    assert sorted(r.line for r in bad.collect()) == ["2,soon,z", "3", "4,2020-01-02,w,more", "no,2020-01-02,y"]


def test_stage_rules(spark, settings):
    with pytest.raises(ValueError, match="unknown"):
        stages.run_all(spark, settings, ("cook",))
    with pytest.raises(ValueError, match="train"):
        stages.run_all(spark, settings, ("submit",))
    with pytest.raises(ValueError, match="no fold"):
        stages.load_fold(spark, settings, "fold_9")
    assert [s.fold for s in stages.stored_specs(spark, settings)] == ["fold_0", "fold_1", "fold_2", "fold_submission"]
    with pytest.raises(FileNotFoundError, match="prepare"):
        stages.load_fold(spark, settings.changed(out_dir="/tmp/shoprank-none"), "fold_0")
