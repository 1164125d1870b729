"""Building blocks used by several operator families."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoprank.functions.columns import weeks_before
from shoprank.functions.session import written
from shoprank.schema import Columns, FoldInputs


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  out: str = "rank") -> DataFrame:
    """The best `n` rows of each group, numbered from 1.

    A `row_number <= n` filter is planned as a group limit on both sides of the exchange, so a
    key that holds a third of the rows ships at most `n` of them per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= n)


def pair_history(fold: FoldInputs, recent_weeks: int = 12) -> DataFrame:
    """`(user, item, n, n_recent, last)`: the history summed per pair.

    Repurchases, affinities, pair features and buyer ages all start from it, so a run computes it
    once and hands it on as `fold.pairs`.
    """
    if fold.pairs is not None and fold.pairs_weeks == recent_weeks:
        return fold.pairs
    cols = fold.columns
    recent = F.col(cols.date) >= weeks_before(fold.train_end, recent_weeks)
    return fold.history.groupBy(cols.user, cols.item).agg(
        F.count("*").alias("n"), F.count_if(recent).alias("n_recent"), F.max(cols.date).alias("last"))


def bestsellers(tx: DataFrame, cols: Columns, n: int) -> DataFrame:
    """The `n` most bought items as `(rank, item)`; equal counts are ordered by item."""
    best = (tx.groupBy(cols.item).agg(F.count("*").alias("n"))
              .orderBy(F.col("n").desc(), F.col(cols.item)).limit(n))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), cols.item)))
    return (best.agg(ordered.alias("best"))
                .select(F.posexplode("best").alias("pos", "entry"))
                .select((F.col("pos") + 1).alias("rank"), F.col(f"entry.{cols.item}").alias(cols.item)))


def as_list(ranked: DataFrame, cols: Columns) -> Column:
    """A `(rank, item)` list of fixed length as a scalar subquery: an array of items, best first.

    Readers explode the array instead of cross joining with the list.
    """
    entries = F.array_sort(F.collect_list(F.struct("rank", cols.item)))
    items = F.transform(entries, lambda e: e[cols.item])
    return ranked.agg(items.alias("items")).scalar()


def dense_ids(df: DataFrame, key: str, out: str, buckets: int = 1024) -> DataFrame:
    """Number the distinct values of `key` 0, 1, 2, ... without a global sort.

    Values are hashed to buckets, numbered inside their bucket and shifted by the size of the
    buckets before. Only the bucket sizes (`buckets` rows) meet in one task.
    """
    values = (df.select(key).filter(F.col(key).isNotNull()).distinct()
                .withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    sizes = values.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1
    return (values.withColumn("_i", inside).join(offsets, "_b")
                  .select(key, (F.col("_offset") + F.col("_i")).cast("int").alias(out)))


def ordered_ids(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Number all rows 0, 1, 2, ... in the given order, without bringing them into one task.

    Rows are dealt out by range and numbered inside their part; only the sizes of the parts meet.
    """
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_i", inside).join(offsets, "_part").select(*df.columns, (F.col("_before") + F.col("_i")).cast("int").alias(out))


def exact_percentiles(df: DataFrame, key: str, value: str, shares: Sequence[float], margin: float = 2e-4) -> DataFrame:
    """`(key, share, value)`: percentiles with linear interpolation for all keys at once, without holding a key's values anywhere.

    A sketch gives a narrow range of values around each position. One pass counts what lies below the range and how often
    each value occurs inside it; only those few values are ordered. Ranges that miss their position are widened.
    """
    known = df.select(key, F.col(value).alias("v")).filter(F.col("v").isNotNull())
    while True:
        marks = [m for s in shares for m in (max(0.0, s - margin), min(1.0, s + margin))]
        sketch = known.groupBy(key).agg(F.count("*").alias("n"), F.percentile_approx("v", F.lit(marks), 20000).alias("m"))
        ranges = written(sketch.select(key, F.explode(F.array(*[
            F.struct(F.lit(float(s)).alias("share"), (F.lit(float(s)) * (F.col("n") - 1)).alias("at"), F.col("m")[2 * i].alias("lo"), F.col("m")[2 * i + 1].alias("hi"))
            for i, s in enumerate(shares)])).alias("r")).select(key, "r.*"))
        # one row per value of a range, and one (without value) for all that lies below it
        inside = F.when(F.col("v") >= F.col("lo"), F.col("v"))
        counted = known.join(ranges, key).filter(F.col("v") <= F.col("hi")).groupBy(key, "share", "at", inside.alias("v")).agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy(key, "share").orderBy(F.col("v").asc_nulls_first()))
        placed = counted.withColumn("upto", upto).filter(F.col("v").isNotNull() | (F.col("upto") > F.floor("at")))

        def order_statistic(position: Column) -> Column:
            return F.min(F.when(F.col("upto") > position, F.struct(F.col("upto"), F.col("v"))))

        found = written(placed.groupBy(key, "share", "at").agg(order_statistic(F.floor("at")).alias("a"), order_statistic(F.ceil("at")).alias("b")))
        # a position below its range finds the row without value, one above it finds none
        missed = found.filter(F.col("a.v").isNull() | F.col("b.v").isNull()).count() + ranges.count() - found.count()
        if not missed:
            low, high, at = F.col("a.v"), F.col("b.v"), F.col("at")
            between = (F.ceil(at) - at) * low + (at - F.floor(at)) * high
            return found.select(key, "share", F.when(F.floor(at) == F.ceil(at), low).otherwise(between).alias("value"))
        margin = min(1.0, 4 * margin)
