from datetime import date

import pytest
from pyspark.sql import functions as F

from shoprank.operators import folds, prep
from shoprank.schema import Columns, Settings
from shoprank.sources import readers, sinks
from tests.conftest import rows

COLS = Columns()


def log(spark, items):
    return spark.createDataFrame([(u, i, date.fromisoformat(d)) for u, i, d in items],
                                 "customer_id string, article_id string, t_dat date")


def test_readers_infer_format_and_cast(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2020-01-05\nx,never\n")
    raw = readers.load(spark, str(tmp_path / "a.csv"))
    assert raw.dtypes == [("a", "string"), ("b", "string")]
    typed = readers.apply_casts(raw, {"a": "int", "b": "date"})
    assert [tuple(r) for r in typed.collect()] == [(1, date(2020, 1, 5)), (None, None)]
    assert readers.apply_casts(raw, {}) is raw
    typed.write.parquet(str(tmp_path / "p"))
    typed.write.json(str(tmp_path / "j.json"))
    assert readers.load(spark, str(tmp_path / "p")).count() == readers.load(spark, str(tmp_path / "j.json")).count() == 2
    with pytest.raises(ValueError):
        readers.load(spark, "x", fmt="orc")


def test_write_once_keeps_or_rebuilds(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_once(spark.range(3), path)
    sinks.write_once(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3
    sinks.write_once(spark.range(5), path, overwrite=True)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(FileNotFoundError, match="candidates"):
        sinks.read_stage(spark, str(tmp_path / "none"), "candidates")


def test_dedup_keeps_first_known_extra(spark):
    tx = log(spark, [("u", "a", "2020-01-01")] * 3 + [("u", "a", "2020-01-02")])
    tx = tx.withColumn("price", F.when(F.col("t_dat") == "2020-01-02", 3.0)).withColumn("other", F.lit(1))
    assert prep.dedup_transactions(tx).count() == 2
    extra = prep.dedup_transactions(tx, COLS, ["price"])
    assert extra.columns == ["customer_id", "article_id", "t_dat", "price"]
    assert rows(extra.fillna(0.0), "price") == [(0.0,), (3.0,)]


def test_range_is_inclusive_and_may_be_open(spark):
    tx = log(spark, [("u", "a", f"2020-01-0{d}") for d in range(1, 6)])
    assert prep.filter_date_range(tx, COLS, "2020-01-02", date(2020, 1, 4)).count() == 3
    assert prep.filter_date_range(tx, COLS, start="2020-01-04").count() == 2
    assert prep.filter_date_range(tx, COLS, end="2020-01-01").count() == 1


def test_min_purchases_and_week(spark):
    tx = log(spark, [("u", "a", "2020-01-01"), ("u", "b", "2020-01-08"), ("v", "a", "2020-01-22")])
    assert rows(prep.filter_min_purchases(tx, 2), "customer_id") == [("u",), ("u",)]
    assert rows(prep.add_week(tx), "week") == [(0,), (1,), (3,)]


def test_fold_boundaries():
    specs = folds.fold_specs("2020-09-22", 6, 1, 2)
    assert (specs[0].train_end, specs[0].val_start, specs[0].val_end) == (date(2020, 9, 15), date(2020, 9, 16), date(2020, 9, 22))
    assert specs[0].train_start == date(2020, 8, 5)
    assert specs[1].val_end == date(2020, 9, 15)
    assert specs[2].fold == "submission" and specs[2].val_start is None and specs[2].train_end == date(2020, 9, 22)
    assert folds.fold_specs("2020-09-22", None, 1, 1, False)[0].train_start is None


def test_tags_equal_filtered_slices(spark):
    tx = log(spark, [("u", f"a{d}", f"2020-01-{d:02d}") for d in range(1, 31)])
    specs = folds.fold_specs("2020-01-30", 2, 1, 3)
    tagged = folds.tag_folds(tx, specs)
    for fold in folds.time_split(tx, specs):
        for split, part in (("train", fold.train), ("val", fold.val)):
            got = tagged.filter((F.col("fold") == fold.name) & (F.col("split") == split))
            assert rows(got, "article_id") == ([] if part is None else rows(part, "article_id"))
        assert fold.is_submission == (fold.name == "submission")
    report = {r["fold"]: r for r in folds.fold_report(tagged, specs).collect()}
    assert report["fold_0"]["leak_check"] == "ok" and report["submission"]["leak_check"] == "n/a"
    assert report["fold_0"]["val_rows"] == 7 and report["fold_0"]["train_rows"] == 14


def test_calendar_equals_specs(spark):
    tx = log(spark, [("u", "a", "2020-09-22"), ("u", "a", "2020-01-01")])
    calendar = folds.fold_calendar(tx, 3, 1, 6)
    specs = folds.spec_table(spark, folds.fold_specs("2020-09-22", 6, 1, 3, False))
    assert rows(calendar, *specs.columns) == rows(specs, *specs.columns)


@pytest.mark.parametrize("trained, expected", [((1, 2), "fold_0"), ((2,), "fold_1"), ((0, 1), None), ((), None)])
def test_holdout_is_the_next_newer_fold(trained, expected):
    found = folds.holdout_spec(folds.fold_specs("2020-09-22", 6, 1, 3), trained)
    assert (found and found.fold) == expected


@pytest.mark.filterwarnings("ignore")
def test_random_splits_are_stable_and_disjoint(spark):
    tx = log(spark, [(f"u{n % 50}", f"a{n}", "2020-01-01") for n in range(500)])
    fold = folds.random_split(tx, 0.2, 0.2, by="user")[0]
    users = [set(rows(p, "customer_id")) for p in (fold.train, fold.val, fold.test)]
    assert not (users[0] & users[1] or users[0] & users[2] or users[1] & users[2])
    assert sum(p.count() for p in (fold.train, fold.val, fold.test)) == 500
    again = folds.random_split(tx.repartition(7), 0.2, 0.2, by="user")[0]
    assert rows(again.val, "article_id") == rows(fold.val, "article_id")
    by_row = folds.random_split(tx, 0.2)[0]
    assert by_row.test is None and 50 < by_row.val.count() < 150
    with pytest.raises(ValueError):
        folds.random_labels(tx, by="item")


def test_empty_train_window_is_an_error(make_fold):
    with pytest.raises(ValueError):
        make_fold([])


def test_settings_reject_unknown_names():
    assert Settings().changed(lists={"length": 5}).lists.length == 5
    with pytest.raises(ValueError):
        Settings().changed(depth=3)
