"""Reading, casting, clean-up and splitting."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from registry import query
from registry.tables import RETAIL, events, retail, retail_fold, retail_specs
from shoprank.operators import folds, prep
from shoprank.schema import Columns
from shoprank.sources import adapters, readers

COLS = Columns()
TX = "customer_id:long article_id:long t_dat:date price:float sales_channel_id:int"


@query("load_parquet", "c_custkey:long c_name:str c_nationkey:int c_acctbal:float c_mktsegment:str", "SELECT * FROM customer")
def _(spark, d):
    return readers.load(spark, f"{d}/customer.parquet")


@query("apply_casts", "event_id:long day:date price:float k:int odd:int", """
SELECT event_id, CAST(ts AS DATE) AS day, value AS price, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  TRY_CAST(event_type AS INTEGER) AS odd FROM events""")
def _(spark, d):
    raw = readers.load(spark, f"{d}/events.parquet").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("value").cast("string").alias("price"),
        F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("odd"))
    return readers.apply_casts(raw, {"day": "date", "price": "double", "k": "int", "odd": "int"})


@query("load_transactions", TX, "SELECT * FROM tx")
def _(spark, d):
    as_text = retail(spark, d).select(*[F.col(c).cast("string") for c in ("customer_id", "article_id", "t_dat", "price", "sales_channel_id")])
    return readers.apply_casts(as_text, readers.TRANSACTION_CASTS)


@query("load_fold", "train_rows:long val_rows:long history_rows:long train_end:date", """
SELECT (SELECT count(*) FROM train) AS train_rows, (SELECT count(*) FROM val) AS val_rows,
  (SELECT count(*) FROM history) AS history_rows, (SELECT d FROM cut) AS train_end""")
def _(spark, d):
    f = retail_fold(spark, d)
    sizes = [df.agg(F.count("*")).scalar() for df in (f.val, f.history)]
    return f.train.agg(F.count("*").alias("train_rows")).select(
        "train_rows", sizes[0].alias("val_rows"), sizes[1].alias("history_rows"), F.lit(f.train_end).alias("train_end"))


@query("prepare", "fold:str split:str n_rows:long n_users:long n_items:long revenue:float", """
SELECT s.fold, p.split, count(*) AS n_rows, count(DISTINCT customer_id) AS n_users, count(DISTINCT article_id) AS n_items,
  sum(CAST(price AS DECIMAL(18, 2))) AS revenue
FROM tx t JOIN specs s ON true JOIN (VALUES ('train'), ('val')) p(split) ON
  (p.split = 'train' AND t_dat BETWEEN s.train_start AND s.train_end) OR
  (p.split = 'val' AND t_dat BETWEEN s.val_start AND s.val_end)
GROUP BY 1, 2""")
def _(spark, d):
    tagged = folds.tag_folds(retail(spark, d), retail_specs())
    return tagged.groupBy("fold", "split").agg(
        F.count("*").alias("n_rows"), F.count_distinct("customer_id").alias("n_users"),
        F.count_distinct("article_id").alias("n_items"), F.sum(F.col("price").cast("decimal(18,2)")).alias("revenue"))


CALENDAR = "fold:str fold_index:int train_start:date train_end:date val_start:date val_end:date"


def _calendar_sql(table: str, n: int, val_weeks: int, train_weeks: int) -> str:
    step = 7 * val_weeks
    return f"""SELECT 'fold_' || i AS fold, i AS fold_index,
  CAST(last - {step} * i - {step} - {7 * train_weeks - 1} AS DATE) AS train_start, last - {step} * i - {step} AS train_end,
  last - {step} * i - {step - 1} AS val_start, last - {step} * i AS val_end
FROM (SELECT max(t_dat) AS last FROM {table}), (SELECT CAST(range AS INTEGER) AS i FROM range({n}))"""


@query("build_folds", CALENDAR, _calendar_sql("tx", RETAIL.periods.count, RETAIL.periods.held_out_weeks, RETAIL.periods.history_weeks))
def _(spark, d):
    return folds.fold_calendar(retail(spark, d), RETAIL.periods.count, RETAIL.periods.held_out_weeks, RETAIL.periods.history_weeks)


@query("fold_week_ends", "fold:str week_end:date history_end:date", f"""
SELECT fold, val_end AS week_end, train_end AS history_end FROM ({_calendar_sql('etx', 4, 1, 6)})""")
def _(spark, d):
    return folds.fold_calendar(events(spark, d), 4).select(
        "fold", F.col("val_end").alias("week_end"), F.col("train_end").alias("history_end"))


@query("holdout_fold", CALENDAR, f"""
SELECT * FROM ({_calendar_sql('tx', RETAIL.periods.count, RETAIL.periods.held_out_weeks, RETAIL.periods.history_weeks)})
WHERE fold_index = (SELECT min(i) - 1 FROM (VALUES (1), (2), (3)) v(i))""")
def _(spark, d):
    calendar = folds.fold_calendar(retail(spark, d), RETAIL.periods.count, RETAIL.periods.held_out_weeks, RETAIL.periods.history_weeks)
    return calendar.filter(F.col("fold") == folds.holdout_spec(retail_specs(), RETAIL.periods.trained).fold)


@query("dedup_transactions", "customer_id:long article_id:long t_dat:date", "SELECT DISTINCT customer_id, article_id, t_dat FROM tx")
def _(spark, d):
    return prep.dedup_transactions(retail(spark, d))


@query("dedup_with_extras", TX, """
SELECT customer_id, article_id, t_dat, min(price) AS price, min(sales_channel_id) AS sales_channel_id FROM tx GROUP BY ALL""")
def _(spark, d):
    return prep.dedup_transactions(retail(spark, d), COLS, ["price", "sales_channel_id"])


@query("filter_date_range", TX, "SELECT * FROM tx WHERE t_dat >= DATE '1996-03-01' AND t_dat <= DATE '1999-09-30'")
def _(spark, d):
    return prep.filter_date_range(retail(spark, d), COLS, "1996-03-01", "1999-09-30")


@query("filter_min_purchases", TX, """
SELECT * FROM tx WHERE customer_id IN (SELECT customer_id FROM tx GROUP BY 1 HAVING count(*) >= 40)""")
def _(spark, d):
    return prep.filter_min_purchases(retail(spark, d), 40)


@query("add_week", "customer_id:long article_id:long t_dat:date week:int", """
SELECT customer_id, article_id, t_dat, date_diff('day', (SELECT min(t_dat) FROM tx), t_dat) // 7 AS week FROM tx""")
def _(spark, d):
    return prep.add_week(retail(spark, d))


@query("time_series_split", "fold:str split:str customer_id:long article_id:long t_dat:date price:float", """
SELECT s.fold, 'train' AS split, customer_id, article_id, t_dat, price FROM tx JOIN specs s ON t_dat BETWEEN s.train_start AND s.train_end
UNION ALL
SELECT s.fold, 'val', customer_id, article_id, t_dat, price FROM tx JOIN specs s ON t_dat BETWEEN s.val_start AND s.val_end""")
def _(spark, d):
    return folds.tag_folds(retail(spark, d), retail_specs())


def _hash_sql(parts: list[str], seed: int) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || substr(md5({text} || '|{seed}'), 1, 8) AS BIGINT) / 4294967296.0)"


def _split_sql(parts: list[str], body: str) -> str:
    h = _hash_sql(parts, 42)
    return f"SELECT *, CASE WHEN {h} < 0.1 THEN 'val' WHEN {h} < 0.25 THEN 'test' ELSE 'train' END AS split FROM {body}"


@query("random_split_rows", "event_id:long user_id:long event_type:str split:str",
       _split_sql(["event_id", "user_id", "event_type"], "(SELECT event_id, user_id, event_type FROM events)"))
def _(spark, d):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rows = readers.load(spark, f"{d}/events.parquet").select("event_id", "user_id", "event_type")
        return folds.random_labels(rows, 0.1, 0.15, "row", 42)


@query("random_split_users", TX + " split:str", _split_sql(["customer_id"], "tx"))
def _(spark, d):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return folds.random_labels(retail(spark, d), 0.1, 0.15, "user", 42)


@query("fold_table", "fold:str train_start:date train_end:date val_start:date train_rows:long val_rows:long leak_check:str", """
SELECT s.fold, s.train_start, s.train_end, s.val_start,
  count(*) FILTER (t.t_dat BETWEEN s.train_start AND s.train_end) AS train_rows,
  count(*) FILTER (t.t_dat BETWEEN s.val_start AND s.val_end) AS val_rows,
  CASE WHEN min(t.t_dat) FILTER (t.t_dat BETWEEN s.val_start AND s.val_end) IS NULL THEN 'n/a'
       WHEN max(t.t_dat) FILTER (t.t_dat BETWEEN s.train_start AND s.train_end)
          < min(t.t_dat) FILTER (t.t_dat BETWEEN s.val_start AND s.val_end) THEN 'ok' ELSE 'LEAK' END AS leak_check
FROM specs s JOIN tx t ON true GROUP BY ALL""")
def _(spark, d):
    specs = retail_specs()
    return folds.fold_report(folds.tag_folds(retail(spark, d), specs), specs)
