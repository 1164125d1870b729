"""The driver's tables as an interaction log with customer and article dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Columns read from each table. Stating them saves the pass over the file footers.
_COLUMNS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_extendedprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "part": "p_partkey bigint, p_brand string, p_type string, p_size int",
    "events": "user_id bigint, ts timestamp_ntz, event_type string, value double, props string",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def retail_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as one purchase."""
    lines, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("customer_id"), F.col("l_partkey").alias("article_id"),
        F.col("o_orderdate").cast("date").alias("t_dat"), F.col("l_extendedprice").alias("price"),
        (F.col("l_linenumber") % 2 + 1).cast("int").alias("sales_channel_id"))


def retail_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    no_age, no_postal = key % 13 == 0, (key % 13 == 0) | (key % 17 == 0)
    news = F.when(key % 3 == 0, "Regularly").when(key % 3 == 1, "NONE").otherwise("Monthly")
    return _table(spark, sf_dir, "customer").select(
        key.alias("customer_id"), F.when(~no_age, (key % 60 + 18).cast("double")).alias("age"),
        F.when(~no_postal, F.col("c_nationkey").cast("string")).alias("postal_code"),
        F.col("c_mktsegment").alias("club_member_status"), news.alias("fashion_news_frequency"))


def retail_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("article_id"), F.concat_ws("|", "p_brand", "p_type").alias("product_code"),
        size.cast("int").alias("product_type_no"), F.substring("p_brand", 7, 9).cast("int").alias("department_no"),
        F.col("p_type").alias("product_group_name"), (size % 7).cast("int").alias("garment_group_no"),
        (size % 11).cast("int").alias("section_no"), (size % 5).cast("int").alias("index_group_no"),
        (size % 13).cast("int").alias("colour_group_code"))


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one interaction with the item named in its properties: few items, dense weeks."""
    events = _table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("customer_id"), F.get_json_object("props", "$.k").cast("bigint").alias("article_id"),
        F.col("ts").cast("date").alias("t_dat"), F.col("value").alias("price"),
        F.when(F.col("event_type").isin("purchase", "signup"), 2).otherwise(1).alias("sales_channel_id"))


def event_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of the items seen in the events, from their number."""
    item = F.col("article_id")
    return event_transactions(spark, sf_dir).select("article_id").distinct().select(
        "article_id", F.concat_ws("-", F.lit("p"), F.floor(item / 4).cast("bigint").cast("string")).alias("product_code"),
        F.floor(item / 10).cast("int").alias("product_type_no"), (item % 9).cast("int").alias("department_no"),
        F.concat_ws("-", F.lit("g"), (item % 6).cast("string")).alias("product_group_name"),
        (item % 7).cast("int").alias("garment_group_no"), (item % 11).cast("int").alias("section_no"),
        (item % 5).cast("int").alias("index_group_no"), (item % 13).cast("int").alias("colour_group_code"))
