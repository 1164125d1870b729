"""Stage tables. A stage ends in a written table, so losing an executor later costs a re-read."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoprank.schema import Columns

log = logging.getLogger(__name__)


def _present(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
    except AnalysisException:
        return False
    return True


def write_once(df: DataFrame, path: str, overwrite: bool = False, partition_by: Sequence[str] = ()) -> None:
    """Write a Parquet table unless it is there already; `overwrite` rebuilds it."""
    if not overwrite and _present(df.sparkSession, path):
        log.warning("%s is already there and is kept; pass overwrite=True to rebuild it", path)
        return
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_stage(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Write a stage's result and hand back the written table."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


def read_stage(spark: SparkSession, path: str, made_by: str) -> DataFrame:
    """A stage's table, or an error that names the stage to run first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"{path} is missing: run the {made_by!r} stage first") from error


def finished_parts(spark: SparkSession, manifest: str, plan: str) -> set[int]:
    """Parts of this plan that a manifest lists as finished; a manifest that isn't there lists none."""
    if not _present(spark, manifest):
        return set()
    return {r["part"] for r in spark.read.parquet(manifest).filter(F.col("plan") == plan).select("part").distinct().collect()}


def record_part(spark: SparkSession, manifest: str, plan: str, part: int) -> None:
    """List a part as finished. Its table is complete before this is called."""
    spark.createDataFrame([(plan, part)], "plan string, part int").coalesce(1).write.mode("append").parquet(manifest)


def submission_rows(lists: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """`(user, items[])` as `customer_id, prediction` with space-joined items."""
    text = F.concat_ws(" ", F.transform("items", lambda i: i.cast("string")))
    # The column names of a submission.
    return lists.select(F.col(cols.user).cast("string").alias("customer_id"), text.alias("prediction"))


def write_submission_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_submission_csv(spark: SparkSession, path: str) -> DataFrame:
    """A written submission as it will be read by others: text columns, nothing for an empty list."""
    return spark.read.schema("customer_id string, prediction string").option("header", True).csv(path).fillna({"prediction": ""})


def submission_violations(rows: DataFrame, expected: DataFrame, k: int = 12) -> DataFrame:
    """`(problem, n)` for customers missing, unexpected or with a wrong number of items."""
    wanted = expected.select("customer_id").distinct().withColumn("wanted", F.lit(1))
    given = rows.groupBy("customer_id").agg(
        F.count_if(F.size(F.filter(F.split("prediction", " +"), lambda t: t != "")) != k).alias("bad"),
        F.lit(1).alias("given"))
    joined = wanted.join(given, "customer_id", "full")
    counts = joined.agg(F.count_if(F.col("given").isNull()).alias("missing"),
                        F.count_if(F.col("wanted").isNull()).alias("unexpected"), F.coalesce(F.sum("bad"), F.lit(0)).alias("wrong_length"))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("problem"), F.col(p).alias("n"))
                                              for p in ("missing", "unexpected", "wrong_length")])).alias("e")).select("e.*")


def validate_submission(rows: DataFrame, expected: DataFrame, k: int = 12) -> None:
    problems = {r["problem"]: r["n"] for r in submission_violations(rows, expected, k).collect() if r["n"]}
    if problems:
        raise ValueError(f"submission rejected: {problems}")
