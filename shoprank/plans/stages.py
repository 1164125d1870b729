"""The run from raw files to a submission, stage by stage.

Every stage reads the tables of the one before and ends in a written table below `out_dir`:
transactions, articles, customers, folds (their boundaries), neighbors, candidates and features
(each by fold), training.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoprank.functions.session import remove, temporary_tables, tune, written
from shoprank.operators import folds, recommend, retrieval, union
from shoprank.operators.features import FeatureSource
from shoprank.operators.ranker import FOLD, LambdaRanker, LambdaRankModel, training_frame
from shoprank.plans.features import feature_blocks, feature_table, with_pairs
from shoprank.schema import FoldInputs, Settings
from shoprank.sources import readers, sinks

log = logging.getLogger(__name__)

Source = Callable[[FoldInputs, DataFrame], DataFrame]

STAGES = ("prepare", "candidates", "features", "train", "evaluate", "submit")


def _raw(settings: Settings, name: str) -> str:
    return f"{settings.raw_dir}/{name}.csv"


def _of_fold(settings: Settings, table: str, fold: str) -> str:
    return settings.table(f"{table}/fold={fold}")


def trained_folds(settings: Settings) -> list[str]:
    return [spec.fold for spec in folds.trained_specs(folds.settings_specs(settings), settings.periods.trained)]


def prepare(spark: SparkSession, settings: Settings, overwrite: bool = False) -> list[folds.FoldSpec]:
    """Raw CSV to typed tables, and the folds' boundaries.

    Folds overlap, so their slices are not copied: a slice is a range of dates over the log, which is stored in sorted runs.
    """
    # Names of the raw files.
    tx = readers.load_transactions(spark, _raw(settings, "transactions_train"))
    # sorted runs give narrow date ranges per row group, so cut-offs skip most of the log
    sinks.write_once(tx.sortWithinPartitions(settings.columns.date), settings.table("transactions"), overwrite)
    for name in ("articles", "customers"):
        sinks.write_once(readers.load(spark, _raw(settings, name)), settings.table(name), overwrite)
    specs = folds.settings_specs(settings)
    sinks.write_once(folds.spec_table(spark, specs).coalesce(1), settings.table("folds"), overwrite)
    return specs


def stored_specs(spark: SparkSession, settings: Settings) -> list[folds.FoldSpec]:
    """The boundaries that `prepare` stored, one row per fold."""
    rows = sinks.read_stage(spark, settings.table("folds"), "prepare").collect()
    return [folds.FoldSpec(**row.asDict()) for row in sorted(rows, key=lambda r: (r["fold_index"] is None, r["fold_index"]))]


def fold_slices(spark: SparkSession, settings: Settings) -> DataFrame:
    """The log with `fold` and `split`: each row once per slice it lies in."""
    tx = sinks.read_stage(spark, settings.table("transactions"), "prepare")
    return folds.tag_folds(tx, stored_specs(spark, settings), settings.columns)


def fold_table(spark: SparkSession, settings: Settings) -> DataFrame:
    return folds.fold_report(fold_slices(spark, settings), stored_specs(spark, settings), settings.columns)


def load_fold(spark: SparkSession, settings: Settings, fold: str) -> FoldInputs:
    found = [spec for spec in stored_specs(spark, settings) if spec.fold == fold]
    if not found:
        raise ValueError(f"the run has no fold {fold!r}")
    tables = [sinks.read_stage(spark, settings.table(t), "prepare") for t in ("transactions", "articles", "customers")]
    return folds.spec_inputs(found[0], *tables, settings.columns)


def build_candidates(spark: SparkSession, settings: Settings, fold: str, inputs: FoldInputs | None = None,
                     with_als: bool = True, sources: Mapping[str, Source] | None = None) -> DataFrame:
    """Neighbour edges, then all sources united, flagged and capped; both tables are written.

    `sources` replaces the shipped list: any function of the fold and the edges that returns
    `(user, item, rank, source)` can be a source under its name.
    """
    with temporary_tables(spark):
        inputs = inputs or with_pairs(load_fold(spark, settings, fold), settings)
        edges = sinks.write_stage(retrieval.copurchase_neighbors(inputs, settings.retrieval.neighbors),
                                  _of_fold(settings, "neighbors", fold))
        sources = sources or retrieval.source_table(settings, with_als)
        parts = {name: make(inputs, edges) for name, make in sources.items()}
        flagged = union.source_flags(union.union_candidates(parts, settings.columns), list(parts))
        capped = union.cap_per_customer(flagged, settings.retrieval.cap, settings.columns)
        return sinks.write_stage(capped, _of_fold(settings, "candidates", fold))


def build_features(spark: SparkSession, settings: Settings, fold: str, inputs: FoldInputs | None = None,
                   candidates: DataFrame | None = None, sources: Sequence[FeatureSource] | None = None) -> DataFrame:
    """Candidates with all features, written in `features.passes` parts over slices of the users.

    `sources` replaces the shipped feature sources.
    More than one part bounds the shuffle held at once; the blocks are then computed once and shared by the parts. Finished
    parts are listed in a manifest beside them: a rerun over the same candidates and settings skips those, and the stage's
    table is written when all are listed. Parts and blocks are removed in the end.
    """
    if candidates is None:
        candidates = sinks.read_stage(spark, _of_fold(settings, "candidates", fold), "candidates")
    edges = sinks.read_stage(spark, _of_fold(settings, "neighbors", fold), "candidates")
    n, path = max(1, settings.features.passes), _of_fold(settings, "features", fold)
    parts, manifest = settings.table(f"feature_parts/{fold}"), settings.table(f"feature_parts/{fold}/manifest")
    plan = part_plan(settings, candidates, edges, sources)
    with temporary_tables(spark):
        missing = sorted(set(range(n)) - (sinks.finished_parts(spark, manifest, plan) if n > 1 else set()))
        if missing:
            inputs = inputs or with_pairs(load_fold(spark, settings, fold), settings)
            blocks = [block for _, block in feature_blocks(inputs, edges, settings, sources=sources)]
        if n == 1:
            return sinks.write_stage(feature_table(inputs, candidates, blocks, settings), path)
        if missing:
            blocks = [(written(block), keys) for block, keys in blocks]
        slice_ = F.pmod(F.xxhash64(settings.columns.user), F.lit(n))
        for k in missing:
            log.info("%s: part %d of %d", fold, k + 1, n)
            sinks.write_stage(feature_table(inputs, candidates.filter(slice_ == k), blocks, settings), f"{parts}/{plan}/{k}")
            sinks.record_part(spark, manifest, plan, k)
        made = [spark.read.parquet(f"{parts}/{plan}/{k}") for k in range(n)]
        table = sinks.write_stage(reduce(DataFrame.unionByName, made), path)
        remove(spark, parts)
    return table


def part_plan(settings: Settings, candidates: DataFrame, edges: DataFrame, sources: Sequence[FeatureSource] | None) -> str:
    """Names what the parts of a feature table are made from: a rebuilt input or another setting gives another name."""
    names = [s.name for s in sources] if sources else None
    made_from = [*sorted(candidates.inputFiles()), *sorted(edges.inputFiles()), repr((settings.features, settings.retrieval, settings.periods, settings.columns, names))]
    return hashlib.sha256("\n".join(made_from).encode()).hexdigest()[:16]


def read_features(spark: SparkSession, settings: Settings, fold_names: Sequence[str]) -> DataFrame:
    table = sinks.read_stage(spark, settings.table("features"), "features")
    return table.filter(F.col("fold").isin(list(fold_names))).withColumnRenamed("fold", FOLD)


def train(spark: SparkSession, settings: Settings) -> tuple[LambdaRankModel, DataFrame]:
    """The ranker fitted on the training folds; a user in two folds is two ranking problems."""
    sampled = training_frame(read_features(spark, settings, trained_folds(settings)), settings.training.negatives, settings.seed, settings.columns)
    frame = sinks.write_stage(sampled, settings.table("training"))
    ranker = LambdaRanker(columns=settings.columns, **settings.training.ranker)
    with temporary_tables(spark):
        return ranker.fit(frame, [FOLD, settings.columns.user]), frame


def score_fold(spark: SparkSession, settings: Settings, model: LambdaRankModel, fold: str) -> recommend.ScoredFold:
    features = read_features(spark, settings, [fold])
    users = recommend.evaluation_users(features, settings.lists.sample, settings.seed, settings.columns)
    return recommend.score_fold(load_fold(spark, settings, fold), model.transform(features), settings.lists.length,
                                settings.retrieval.popularity_weeks, users)


def evaluate(spark: SparkSession, settings: Settings, model: LambdaRankModel, fold: str) -> DataFrame:
    scored = score_fold(spark, settings, model, fold)
    return recommend.evaluate(scored.recs, scored.truth, settings.lists.length, settings.columns)


def write_submission(spark: SparkSession, settings: Settings, model: LambdaRankModel, fold: str | None = None) -> DataFrame:
    """Score the submission fold, serve every customer, write the CSV and check it."""
    fold = fold or folds.settings_specs(settings)[-1].fold
    inputs = load_fold(spark, settings, fold)
    fallback = recommend.popular_items(inputs, settings.retrieval.popularity_weeks, settings.lists.length)
    recs = model.recommend(read_features(spark, settings, [fold]), settings.lists.length, inputs.customers, fallback)
    sinks.write_submission_csv(sinks.submission_rows(recommend.to_lists(recs, settings.columns), settings.columns), settings.submission_path)
    # what is checked is what others will read
    rows = sinks.read_submission_csv(spark, settings.submission_path)
    sinks.validate_submission(rows, readers.load(spark, _raw(settings, "sample_submission")), settings.lists.length)
    return rows


def run_fold(spark: SparkSession, settings: Settings, fold: str, with_als: bool = True) -> DataFrame:
    """Candidates and features of one fold."""
    with temporary_tables(spark):
        inputs = with_pairs(load_fold(spark, settings, fold), settings)
        return build_features(spark, settings, fold, inputs, build_candidates(spark, settings, fold, inputs, with_als))


def run_all(spark: SparkSession, settings: Settings, stages: Sequence[str] = STAGES, overwrite: bool = False,
            with_als: bool = True) -> LambdaRankModel | None:
    """Run the chosen stages in order. The held-out fold is evaluated where there is one."""
    unknown = sorted(set(stages) - set(STAGES))
    if unknown:
        raise ValueError(f"unknown stages {unknown}; choose from {STAGES}")
    for needy in ("evaluate", "submit"):
        if needy in stages and "train" not in stages:
            raise ValueError(f"{needy!r} needs a model: include the 'train' stage")
    # the settings hold for a session of the run's own
    spark = tune(spark)
    specs = folds.settings_specs(settings)
    newest = folds.holdout_spec(specs, settings.periods.trained)
    holdout = newest.fold if newest else None
    needed = [*trained_folds(settings), *([holdout] if holdout and "evaluate" in stages else []), specs[-1].fold]
    if "prepare" in stages:
        prepare(spark, settings, overwrite)
    for fold in needed:
        if "candidates" in stages:
            build_candidates(spark, settings, fold, with_als=with_als)
        if "features" in stages:
            build_features(spark, settings, fold)
    model = train(spark, settings)[0] if "train" in stages else None
    if "evaluate" in stages:
        if holdout is None:
            log.warning("nothing to evaluate on: training includes the newest fold")
        else:
            log.info("%s: %s", holdout, evaluate(spark, settings, model, holdout).first())
    if "submit" in stages:
        write_submission(spark, settings, model)
    return model
