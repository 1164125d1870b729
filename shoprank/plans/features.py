"""The feature stage of one fold as one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoprank.functions.session import written
from shoprank.operators.features import Block, FeatureSource, feature_sources
from shoprank.operators.shared import pair_history
from shoprank.operators.transforms import assemble
from shoprank.schema import FoldInputs, Settings


def with_pairs(fold: FoldInputs, settings: Settings) -> FoldInputs:
    """The fold with its history summed per pair, written once for retrieval and features.

    Each pair also carries whether its user is active and the attributes the affinities count by,
    so those blocks need no join of their own. A user's pairs number at most the catalogue.
    """
    cols, weeks = fold.columns, settings.features.active_weeks
    attributes = fold.articles.select(cols.item, *[key for key, _ in settings.features.affinities])
    active = F.sum("n_recent").over(Window.partitionBy(cols.user)) > 0
    pairs = pair_history(fold, weeks).withColumn("active", active).join(attributes, cols.item, "left")
    return replace(fold, pairs=written(pairs), pairs_weeks=weeks)


def feature_blocks(fold: FoldInputs, edges: DataFrame, settings: Settings,
                   exact_distinct: bool = False,
                   sources: Sequence[FeatureSource] | None = None) -> list[tuple[FeatureSource, Block]]:
    sources = sources or feature_sources(settings, exact_distinct)
    return [(source, source.compute(fold, edges)) for source in sources]


def feature_table(fold: FoldInputs, candidates: DataFrame, blocks: list[Block], settings: Settings) -> DataFrame:
    """Candidates with all features and labels."""
    keys = fold.articles.select(fold.columns.item, *[key for key, _ in settings.features.affinities])
    return assemble(candidates, keys, blocks, fold.val, fold.columns)
