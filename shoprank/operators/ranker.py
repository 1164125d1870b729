"""Training frame and the learning-to-rank model.

The ranker is LambdaMART as a loop of Spark jobs over blocks of binned rows (see `boosting`). Rows stay distributed; the
driver holds trees and the histograms of the tree that grows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from shoprank.functions.columns import unit_hash
from shoprank.operators.boosting import Bins, Sweeps, Tree, boost, fit_bins, gradients, lay_out, ndcg, received, shipped, whole_groups
from shoprank.operators.recommend import backfill, top_k
from shoprank.schema import Columns

# Executors need no copy of this module on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the column that tells training folds apart.
FOLD = "_fold"


# --- training frame ------------------------------------------------------------------------

def downsample(features: DataFrame, negatives_per_positive: int = 15, seed: int = 42,
               cols: Columns = Columns(), fold: str | None = None) -> DataFrame:
    """All positives and a Bernoulli sample of the negatives at the wanted ratio (per fold).

    A row's draw depends on its keys only, so retries and repartitioning keep the same rows.
    """
    keys = [fold] if fold else []
    counts = features.groupBy(*keys).agg(F.count_if(F.col("label") == 1).alias("_pos"),
                                         F.count_if(F.col("label") == 0).alias("_neg"))
    # one row per fold
    if any(row["_pos"] == 0 for row in counts.collect()):
        raise ValueError("no positive labels: is this the submission fold?")
    rate = F.least(F.lit(1.0), F.try_divide(F.lit(float(negatives_per_positive)) * F.col("_pos"), F.col("_neg")))
    keep = (F.col("label") == 1) | (unit_hash(*keys, cols.user, cols.item, seed=seed) < F.col("_rate"))
    rates = counts.select(*keys, rate.alias("_rate"))
    marked = features.join(rates, keys) if keys else features.withColumn("_rate", rates.scalar())
    return marked.filter(keep).drop("_rate")


def training_frame(features: DataFrame, negatives_per_positive: int = 15, seed: int = 42,
                   cols: Columns = Columns(), fold: str = FOLD) -> DataFrame:
    """Downsampled rows of all training folds; the fold column keeps their groups apart."""
    return downsample(features, negatives_per_positive, seed, cols, fold)


def resolve_features(df: DataFrame, cols: Columns = Columns(), explicit: Sequence[str] | None = None) -> list[str]:
    """Every column that is no key, label or fold tag, unless a list is given."""
    return list(explicit) if explicit else [c for c in df.columns if c not in (cols.user, cols.item, "label", FOLD)]


def prepare_matrix(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Features as 32-bit floats with 0 for missing values."""
    zero = F.lit(0.0).cast("float")
    return df.withColumns({n: F.coalesce(F.col(n).cast("float"), zero) for n in names})


# --- objective -----------------------------------------------------------------------------

def _by_group(rows: DataFrame, group: Sequence[str], tie: str, keys: Sequence[str], schema: StructType, fn: Callable) -> DataFrame:
    """`fn(table, scores, labels, starts)` over whole groups, each ordered by `tie`; `keys` come behind position, score and label."""
    inside = Window.partitionBy(*group).orderBy(tie)
    ordered = rows.select(F.row_number().over(inside).alias("_pos"), F.col("score").cast("double").alias("_score"), F.col("label").cast("int").alias("_label"), *keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            pos, score, label = (table.column(i).to_numpy() for i in range(3))
            yield from fn(table, score, label, np.flatnonzero(pos == 1))

    return ordered.mapInArrow(run, schema)


def lambda_gradients(rows: DataFrame, group: Sequence[str], tie: str, truncation: int = 30) -> DataFrame:
    """`(group..., tie, g, h)`: gradient and curvature of NDCG for scored and labelled rows, as a round of the ranker sees them."""
    keys = [*group, tie]
    schema = StructType([*rows.select(*keys).schema.fields, StructField("g", DoubleType()), StructField("h", DoubleType())])

    def grade(table: pa.Table, score: np.ndarray, label: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        g, h = gradients(score, label, starts, truncation)
        yield from pa.table([*table.columns[3:], pa.array(g), pa.array(h)], names=schema.names).to_batches()

    return _by_group(rows, group, tie, keys, schema, grade)


def group_ndcg(rows: DataFrame, group: Sequence[str], tie: str, k: int = 12) -> DataFrame:
    """`(groups, ndcg)`: mean NDCG@k over the groups that hold a positive."""
    def measure(table: pa.Table, score: np.ndarray, label: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = ndcg(score, label, starts, k)
        yield pa.RecordBatch.from_pydict({"total": [float(found.sum())], "n": [len(found)]})

    schema = StructType([StructField("total", DoubleType()), StructField("n", LongType())])
    sums = _by_group(rows, group, tie, [], schema, measure).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("groups"), F.sum("total").alias("total"))
    return sums.select("groups", F.coalesce(F.try_divide("total", "groups"), F.lit(0.0)).alias("ndcg"))


# --- model ---------------------------------------------------------------------------------

@dataclass(frozen=True)
class RankerParams:
    """Boosting parameters.

    `truncation` is part of the objective: only pairs with a member among the first rows of a group count. `max_depth` is
    unbounded unless given; `num_leaves` bounds a tree, which grows best leaf first. `level_smoothing` is added to the
    curvature by which levels of a categorical feature are ordered.
    """

    rounds: int = 400
    learning_rate: float = 0.05
    num_leaves: int = 63
    max_depth: int | None = None
    min_child_samples: int = 50
    min_child_weight: float = 1e-3
    subsample: float = 0.8
    colsample: float = 0.8
    reg_lambda: float = 1.0
    truncation: int = 30
    max_bins: int = 64
    level_smoothing: float = 10.0
    early_stopping_rounds: int | None = None
    eval_k: int = 12
    seed: int = 42

    def __post_init__(self):
        if not 2 <= self.num_leaves <= 64:
            raise ValueError("num_leaves must lie between 2 and 64: a tree's leaves are the bits of one word")


class Forest:
    """All trees as one table per feature: bin of the feature x tree -> leaves that stay possible.

    A row's bins pick one word per tree and feature; and-ing the words leaves one bit, the row's leaf. Every feature is read once.
    """

    def __init__(self, trees: Sequence[Tree], bins: Bins):
        self.bins, self.size = bins, len(trees)
        self.values = np.zeros((len(trees), 64))
        self.tables: list[tuple[int, np.ndarray, np.ndarray]] = []
        words: dict[int, dict[int, np.ndarray]] = {}
        for t, tree in enumerate(trees):
            self._add(t, tree, 0, [0], words)
        for f, by_tree in sorted(words.items()):
            used = np.array(sorted(by_tree))
            self.tables.append((f, used, np.stack([by_tree[t] for t in used.tolist()], axis=1)))

    def _add(self, t: int, tree: Tree, node: int, leaves: list[int], words: dict) -> int:
        """Number the leaves below a node from left to right; returns them as a word."""
        if tree.feature[node] < 0:
            self.values[t, leaves[0]] = tree.value[node]
            leaves[0] += 1
            return 1 << (leaves[0] - 1)
        left = self._add(t, tree, tree.left[node], leaves, words)
        right = self._add(t, tree, tree.right[node], leaves, words)
        f = tree.feature[node]
        width = self.bins.width(self.bins.names[f])
        goes_left = tree.left_bins[node] if node in tree.left_bins else np.arange(width) <= tree.cut[node]
        word = words.setdefault(f, {}).setdefault(t, np.full(width, 2**64 - 1, np.uint64))
        word &= np.where(goes_left, np.uint64(2**64 - 1 - right), np.uint64(2**64 - 1 - left))
        return left | right

    def scores(self, columns: Sequence[np.ndarray], rows: int = 1024) -> np.ndarray:
        """Sum of the trees' leaf values for every row; `columns` are the features in the order of the bins."""
        n = len(columns[0]) if columns else 0
        out = np.zeros(n)
        codes = {f: self.bins.codes(self.bins.names[f], columns[f]) for f, _, _ in self.tables}
        offset = 64 * np.arange(self.size)
        for a in range(0, n if self.size else 0, rows):
            left = np.full((min(rows, n - a), self.size), 2**64 - 1, np.uint64)
            for f, used, table in self.tables:
                left[:, used] &= table[codes[f][a : a + rows]]
            # trees of a single leaf have no table; their leaf is bit 0
            leaf = np.bitwise_count((left & (~left + np.uint64(1))) - np.uint64(1)).astype(np.int64)
            out[a : a + rows] = self.values.reshape(-1)[leaf + offset].sum(axis=1)
        return out


@dataclass
class LambdaRankModel:
    feature_cols: list[str]
    bins: Bins
    trees: list[Tree] = field(default_factory=list)
    columns: Columns = Columns()
    history: list[float] = field(default_factory=list)

    def transform(self, features: DataFrame) -> DataFrame:
        """`(user, item, score)`; higher is better."""
        cols, names = self.columns, self.feature_cols
        rows = prepare_matrix(features.select(cols.user, cols.item, *names), names)
        forest = shipped(features.sparkSession, Forest(self.trees, self.bins))
        schema = StructType([*rows.schema.fields[:2], StructField("score", DoubleType())])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = received(forest).scores([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(names))])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=schema.names)

        return rows.mapInArrow(score, schema)

    def recommend(self, features: DataFrame, k: int = 12, users: DataFrame | None = None,
                  fallback: DataFrame | None = None, scored: DataFrame | None = None) -> DataFrame:
        """Top-k lists, padded for `users` when a fallback list is given; `scored` are the features' scores, where they are at hand."""
        recs = top_k(self.transform(features) if scored is None else scored, k, None, self.columns)
        return recs if fallback is None else backfill(recs, users, fallback, k, self.columns)

    def feature_importance(self, kind: str = "gain") -> DataFrame:
        """`(feature, gain)` or `(feature, split)`, largest first: sums over the splits as the histograms gave them."""
        if kind not in ("gain", "split"):
            raise ValueError("kind must be 'gain' or 'split'")
        totals = dict.fromkeys(self.feature_cols, 0.0)
        for tree in self.trees:
            for f, gain in zip(tree.feature, tree.gain, strict=True):
                if f >= 0:
                    totals[self.feature_cols[f]] += gain if kind == "gain" else 1
        spark = SparkSession.getActiveSession()
        table = spark.createDataFrame(list(totals.items()), f"feature string, {kind} double")
        return table.orderBy(F.col(kind).desc(), "feature")


class LambdaRanker:
    """Gradient-boosted trees on NDCG gradients."""

    def __init__(self, feature_cols: Sequence[str] | None = None, categorical_features: Sequence[str] = (),
                 columns: Columns = Columns(), **params):
        self.feature_cols = list(feature_cols) if feature_cols else None
        self.categorical_features = list(categorical_features)
        self.columns = columns
        self.params = replace(RankerParams(), **params)

    def fit(self, train: DataFrame, group_cols: Sequence[str] | None = None,
            eval_frame: DataFrame | None = None, eval_group_cols: Sequence[str] | None = None) -> LambdaRankModel:
        """Fit on `train`; `eval_frame` (with its own groups, if given) is watched for early stopping."""
        p, cols = self.params, self.columns
        group = list(group_cols or [cols.user])
        names = resolve_features(train, cols, self.feature_cols)
        matrix = prepare_matrix(train, names)
        bins = fit_bins(matrix, names, self.categorical_features, p.max_bins)

        def blocks(df: DataFrame, keys: list[str], held: bool) -> DataFrame:
            return lay_out(df, bins, keys, cols.item, F.xxhash64(*keys, cols.item), held)

        rows = blocks(matrix, group, False)
        if eval_frame is not None:
            rows = rows.unionByName(blocks(prepare_matrix(eval_frame, names), list(eval_group_cols or group), True))
        sweeps = Sweeps(rows, bins, p)
        try:
            trees, history = boost(sweeps)
        finally:
            sweeps.close()
        return LambdaRankModel(names, bins, trees, cols, history)
