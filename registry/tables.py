"""Shared inputs of the registered queries, in Spark and as SQL building blocks."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from registry import cte
from shoprank.functions.session import ensure_checkpoint_dir, written
from shoprank.operators.folds import FoldSpec, fold_specs, spec_inputs
from shoprank.schema import FeatureWindows, FoldInputs, Periods, Retrieval, Settings
from shoprank.sources import adapters

# Order dates are spread thinly over six years, so the weeks are scaled up for the retail tables.
RETAIL = Settings(
    periods=Periods(date(2001, 8, 1), 52, 26, 4, (1, 2, 3)),
    retrieval=Retrieval(repurchase=20, itemcf=20, product_code=10, popularity=15, graph=10, neighbors=15, seed_weeks=26,
                        popularity_weeks=26, factors=8, sweeps=3),
    features=FeatureWindows(52, (13, 26, 52)))
EVENTS_END = date(2024, 1, 30)


def retail(spark: SparkSession, d: str) -> DataFrame:
    return adapters.retail_transactions(spark, d)


def stored_retail(spark: SparkSession, d: str) -> DataFrame:
    """The log written once for a query that reads several slices of it; sorted runs let a slice skip the others' rows."""
    return written(retail(spark, d).sortWithinPartitions("t_dat"))


def run_folder(spark: SparkSession) -> str:
    """A new folder's path for the files of one query, where all executors reach it."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/query-{uuid.uuid4().hex}"


def events(spark: SparkSession, d: str) -> DataFrame:
    return adapters.event_transactions(spark, d)


def retail_specs(submission: bool = True) -> list[FoldSpec]:
    s = RETAIL
    return fold_specs(s.periods.last_day, s.periods.history_weeks, s.periods.held_out_weeks, s.periods.count, submission)


def open_specs() -> list[FoldSpec]:
    """Folds with unbounded history, as the studies use them."""
    s = RETAIL
    return fold_specs(s.periods.last_day, None, s.periods.held_out_weeks, s.periods.count, False)


def event_specs(n_folds: int = 3) -> list[FoldSpec]:
    return fold_specs(EVENTS_END, None, 1, n_folds, False)


def retail_fold(spark: SparkSession, d: str, index: int = 0, log: DataFrame | None = None) -> FoldInputs:
    """One fold; queries over several folds hand in the `log` they stored."""
    return spec_inputs(retail_specs()[index], stored_retail(spark, d) if log is None else log, adapters.retail_articles(spark, d),
                       adapters.retail_customers(spark, d))


cte("tx", """SELECT o.o_custkey AS customer_id, l.l_partkey AS article_id, CAST(o.o_orderdate AS DATE) AS t_dat,
  l.l_extendedprice AS price, CAST(l.l_linenumber % 2 + 1 AS INTEGER) AS sales_channel_id
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
cte("people", """SELECT c_custkey AS customer_id,
  CASE WHEN c_custkey % 13 <> 0 THEN CAST(c_custkey % 60 + 18 AS DOUBLE) END AS age,
  CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS postal_code,
  c_mktsegment AS club_member_status,
  CASE c_custkey % 3 WHEN 0 THEN 'Regularly' WHEN 1 THEN 'NONE' ELSE 'Monthly' END AS fashion_news_frequency
  FROM customer""")
cte("articles", """SELECT p_partkey AS article_id, p_brand || '|' || p_type AS product_code,
  CAST(p_size AS INTEGER) AS product_type_no, CAST(substr(p_brand, 7) AS INTEGER) AS department_no,
  p_type AS product_group_name, p_size % 7 AS garment_group_no, p_size % 11 AS section_no,
  p_size % 5 AS index_group_no, p_size % 13 AS colour_group_code FROM part""")
cte("etx", """SELECT user_id AS customer_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS article_id,
  CAST(ts AS DATE) AS t_dat, value AS price,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 2 ELSE 1 END AS sales_channel_id FROM events""")
cte("earticles", """SELECT article_id, 'p-' || CAST(article_id // 4 AS VARCHAR) AS product_code,
  CAST(article_id // 10 AS INTEGER) AS product_type_no, article_id % 9 AS department_no,
  'g-' || CAST(article_id % 6 AS VARCHAR) AS product_group_name, article_id % 7 AS garment_group_no,
  article_id % 11 AS section_no, article_id % 5 AS index_group_no, article_id % 13 AS colour_group_code
  FROM (SELECT DISTINCT article_id FROM etx)""")


def _specs_sql(specs: list[FoldSpec]) -> str:
    def lit(d):
        return f"DATE '{d}'" if d else "CAST(NULL AS DATE)"

    rows = ", ".join(f"('{s.fold}', {'NULL' if s.fold_index is None else s.fold_index}, {lit(s.train_start)}, "
                     f"{lit(s.train_end)}, {lit(s.val_start)}, {lit(s.val_end)})" for s in specs)
    return (f"SELECT * FROM (VALUES {rows}) v(fold, fold_index, train_start, train_end, val_start, val_end)")


cte("specs", _specs_sql(retail_specs()))
cte("ospecs", _specs_sql(open_specs()))
cte("especs", _specs_sql(event_specs()))
# fold 0 of the retail tables
cte("train", "SELECT t.* FROM tx t JOIN specs s ON s.fold = 'fold_0' AND t.t_dat BETWEEN s.train_start AND s.train_end")
cte("val", "SELECT t.* FROM tx t JOIN specs s ON s.fold = 'fold_0' AND t.t_dat BETWEEN s.val_start AND s.val_end")
cte("cut", "SELECT max(t_dat) AS d FROM train")
cte("history", "SELECT * FROM tx WHERE t_dat <= (SELECT d FROM cut)")
cte("truth", "SELECT DISTINCT customer_id, article_id FROM val")
