"""Exploration of the whole log."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import cte, query
from registry.candidates import candidates
from registry.tables import EVENTS_END, RETAIL, events, retail, retail_fold
from shoprank.functions.columns import price_tier
from shoprank.operators import eda, recommend
from shoprank.sources import adapters

cte("weekly", """SELECT CAST(date_trunc('week', t_dat) AS DATE) AS week, count(*) AS n_transactions,
  count(DISTINCT customer_id) AS n_active_users, count(DISTINCT article_id) AS n_distinct_items, avg(price) AS avg_price FROM tx GROUP BY 1""")
cte("weekly_flagged", """SELECT *, abs(n_transactions - avg(n_transactions) OVER ()) > 2 * stddev_samp(n_transactions) OVER () AS is_outlier FROM weekly""")
cte("user_counts", "SELECT customer_id AS id, count(*) AS n FROM tx GROUP BY 1")
cte("item_counts", "SELECT article_id AS id, count(*) AS n FROM tx GROUP BY 1")


@query("transaction_patterns", "week:date n_transactions:long n_active_users:long n_distinct_items:long avg_price:float is_outlier:bool",
       "SELECT * FROM weekly_flagged")
def _(spark, d):
    return eda.transaction_patterns(retail(spark, d))


@query("transaction_facts", "first_week:date last_week:date n_weeks:long peak_week:date peak_transactions:long lowest_week:date lowest_transactions:long n_outliers:long", """
SELECT min(week) AS first_week, max(week) AS last_week, count(*) AS n_weeks,
  (SELECT week FROM weekly ORDER BY n_transactions DESC, week LIMIT 1) AS peak_week, max(n_transactions) AS peak_transactions,
  (SELECT week FROM weekly ORDER BY n_transactions, week LIMIT 1) AS lowest_week, min(n_transactions) AS lowest_transactions,
  count(*) FILTER (is_outlier) AS n_outliers FROM weekly_flagged""")
def _(spark, d):
    return eda.transaction_facts(eda.transaction_patterns(retail(spark, d)))


@query("interaction_summary", "n_transactions:long n_users:long n_items:long sparsity:float", """
SELECT count(*) AS n_transactions, count(DISTINCT customer_id) AS n_users, count(DISTINCT article_id) AS n_items,
  1.0 - count(*) / (count(DISTINCT customer_id) * count(DISTINCT article_id)) AS sparsity FROM tx""")
def _(spark, d):
    return eda.interaction_summary(retail(spark, d))


def _bucket_sql(counts: str, out: str) -> str:
    return f"""SELECT b AS log_bucket, count(*) AS {out}, CAST(2 ** b AS BIGINT) || ' - ' || (CAST(2 ** (b + 1) AS BIGINT) - 1) AS bucket_label
FROM (SELECT CAST(floor(log2(n)) AS INTEGER) AS b FROM {counts}) GROUP BY 1"""


@query("user_buckets", "log_bucket:int n_users:long bucket_label:str", _bucket_sql("user_counts", "n_users"))
def _(spark, d):
    return eda.interaction_buckets(retail(spark, d), "customer_id", "n_users")


@query("item_buckets", "log_bucket:int n_items:long bucket_label:str", _bucket_sql("item_counts", "n_items"))
def _(spark, d):
    return eda.interaction_buckets(retail(spark, d), "article_id", "n_items")




@query("cold_shares", "cold_user_pct:float cold_item_pct:float", """
SELECT 100.0 * count(*) FILTER (n = 1) / count(*) AS cold_user_pct,
  (SELECT 100.0 * count(*) FILTER (n = 1) / count(*) FROM item_counts) AS cold_item_pct FROM user_counts""")
def _(spark, d):
    tx = retail(spark, d)
    return eda.cold_shares(eda.interaction_buckets(tx, "customer_id", "n_users"), eda.interaction_buckets(tx, "article_id", "n_items"))


@query("item_lifespan", "lifespan_weeks:int n_items:long", """
SELECT lifespan_weeks, count(*) AS n_items FROM (SELECT article_id,
  date_diff('day', CAST(date_trunc('week', min(t_dat)) AS DATE), CAST(date_trunc('week', max(t_dat)) AS DATE)) // 7 AS lifespan_weeks
  FROM tx GROUP BY 1) GROUP BY 1""")
def _(spark, d):
    return eda.item_lifespan(retail(spark, d))


cte("item_week", "SELECT article_id, CAST(date_trunc('week', t_dat) AS DATE) AS week, count(*) AS n FROM tx GROUP BY 1, 2")
cte("offsets", """SELECT date_diff('day', f.first_week, w.week) // 7 AS week_offset, count(DISTINCT w.article_id) AS n_active_items, sum(n) AS n_purchases
  FROM item_week w JOIN (SELECT article_id, min(week) AS first_week FROM item_week GROUP BY 1) f USING (article_id) GROUP BY 1""")
cte("decay", """SELECT week_offset, n_active_items, n_active_items / (SELECT count(DISTINCT article_id) FROM tx) * 100 AS pct_surviving, n_purchases,
  n_purchases / (SELECT count(*) FROM tx) * 100 AS pct_volume,
  sum(n_purchases) OVER (ORDER BY week_offset) / (SELECT count(*) FROM tx) * 100 AS cum_pct_volume FROM offsets""")


@query("survival_curve", "week_offset:int n_active_items:long pct_surviving:float", "SELECT week_offset, n_active_items, pct_surviving FROM decay")
def _(spark, d):
    return eda.survival_curve(retail(spark, d))


@query("volume_by_week_offset", "week_offset:int n_purchases:long pct_volume:float cum_pct_volume:float", "SELECT * FROM decay")
def _(spark, d):
    return eda.volume_by_week_offset(retail(spark, d))


@query("decay_thresholds", "measure:str pct:int week_offset:int", " UNION ALL ".join(
    [f"SELECT 'volume' AS measure, {p} AS pct, min(week_offset) AS week_offset FROM decay WHERE cum_pct_volume >= {p}" for p in (50, 80, 95)]
    + [f"SELECT 'survival', {p}, min(week_offset) FROM decay WHERE pct_surviving <= {p}" for p in (50, 20)]))
def _(spark, d):
    return eda.decay_thresholds(retail(spark, d))


cte("ordered_items", """SELECT row_number() OVER (ORDER BY n DESC, id) AS r, sum(n) OVER (ORDER BY n DESC, id ROWS UNBOUNDED PRECEDING) AS bought,
  (SELECT count(*) FROM item_counts) AS items, (SELECT count(*) FROM tx) AS rows FROM item_counts""")


@query("lorenz", "item_pct:float cum_purchase_pct:float", "SELECT r / items * 100 AS item_pct, bought / rows * 100 AS cum_purchase_pct FROM ordered_items")
def _(spark, d):
    return eda.lorenz(retail(spark, d))


@query("top_share", "top1_pct:float top10_pct:float", """
SELECT max(bought / rows * 100) FILTER (r * 100 <= items) AS top1_pct, max(bought / rows * 100) FILTER (r * 100 <= items * 10) AS top10_pct FROM ordered_items""")
def _(spark, d):
    return eda.top_share(retail(spark, d))


cte("e_week", "SELECT CAST(date_trunc('week', t_dat) AS DATE) AS week, article_id, count(*) AS n FROM etx GROUP BY 1, 2")
cte("e_next", "SELECT week, lead(week) OVER (ORDER BY week) AS following FROM (SELECT DISTINCT week FROM e_week)")
cte("e_shared", """SELECT c.week, p.n AS n_before, c.n FROM (SELECT * FROM e_week QUALIFY row_number() OVER (PARTITION BY week ORDER BY n DESC, article_id) <= 1000) p
  JOIN e_next x ON x.week = p.week JOIN e_week c ON c.week = x.following AND c.article_id = p.article_id""")
cte("e_ranked", """SELECT week, rank() OVER (PARTITION BY week ORDER BY n_before) + (count(*) OVER (PARTITION BY week, n_before) - 1) / 2 AS x,
  rank() OVER (PARTITION BY week ORDER BY n) + (count(*) OVER (PARTITION BY week, n) - 1) / 2 AS y FROM e_shared""")
cte("stability", "SELECT week, corr(x, y) AS spearman_r FROM e_ranked GROUP BY 1 HAVING count(*) > 10")


@query("weekly_rank_stability", "week:date spearman_r:float", "SELECT * FROM stability")
def _(spark, d):
    return eda.weekly_rank_stability(events(spark, d))


@query("concentration_summary", "top1_pct:float top10_pct:float mean_rank_corr:float", """
SELECT max(bought / rows * 100) FILTER (r * 100 <= items) AS top1_pct, max(bought / rows * 100) FILTER (r * 100 <= items * 10) AS top10_pct,
  (SELECT avg(spearman_r) FROM stability) AS mean_rank_corr
FROM (SELECT row_number() OVER w AS r, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS bought, count(*) OVER () AS items, sum(n) OVER () AS rows
  FROM (SELECT article_id, count(*) AS n FROM etx GROUP BY 1) WINDOW w AS (ORDER BY n DESC, article_id))""")
def _(spark, d):
    return eda.concentration_summary(events(spark, d))


cte("purchase_ranks", "SELECT *, rank() OVER (PARTITION BY customer_id, article_id ORDER BY t_dat) AS pr FROM tx")
cte("waits", """SELECT date_diff('day', a.t_dat, b.t_dat) AS days_to_repurchase, count(*) AS n_pairs
  FROM purchase_ranks a JOIN purchase_ranks b USING (customer_id, article_id) WHERE a.pr = 1 AND b.pr = 2 GROUP BY 1""")
cte("waits_cum", "SELECT *, sum(n_pairs) OVER (ORDER BY days_to_repurchase) / sum(n_pairs) OVER () * 100 AS cum_pct FROM waits")
RATE = "100.0 * count(DISTINCT customer_id) FILTER (pr = 2) / count(DISTINCT customer_id)"
SHARE = "100.0 * count(*) FILTER (pr >= 2) / count(*)"


@query("repurchase_rates", "repurchase_rate:float repurchase_share:float", f"SELECT {RATE} AS repurchase_rate, {SHARE} AS repurchase_share FROM purchase_ranks")
def _(spark, d):
    return eda.repurchase_rates(retail(spark, d))


@query("time_to_repurchase", "days_to_repurchase:int n_pairs:long cum_pct:float", "SELECT * FROM waits_cum")
def _(spark, d):
    return eda.time_to_repurchase(retail(spark, d))


@query("repurchase_summary", "repurchase_rate_pct:float repurchase_share_pct:float median_days_to_repurchase:int mean_days_to_repurchase:float days_to_80_pct:int", f"""
SELECT (SELECT round({RATE}, 2) FROM purchase_ranks) AS repurchase_rate_pct, (SELECT round({SHARE}, 2) FROM purchase_ranks) AS repurchase_share_pct,
  min(days_to_repurchase) FILTER (cum_pct >= 50) AS median_days_to_repurchase,
  round(sum(days_to_repurchase * n_pairs) / sum(n_pairs), 1) AS mean_days_to_repurchase,
  min(days_to_repurchase) FILTER (cum_pct >= 80) AS days_to_80_pct FROM waits_cum""")
def _(spark, d):
    return eda.repurchase_summary(retail(spark, d))


cte("last_seen", "SELECT customer_id, date_diff('day', max(t_dat), (SELECT max(t_dat) FROM tx)) AS days FROM tx GROUP BY 1")


def _reference(tx):
    return tx.agg(F.max("t_dat")).scalar()


@query("user_activity_segments", "segment:str n_users:long pct_users:float", """
SELECT CASE WHEN days <= 28 THEN '1_active' WHEN days <= 84 THEN '2_lapsed' WHEN days <= 365 THEN '3_inactive' ELSE '4_gone' END AS segment,
  count(*) AS n_users, count(*) / (SELECT count(*) FROM last_seen) * 100 AS pct_users FROM last_seen GROUP BY 1""")
def _(spark, d):
    tx = retail(spark, d)
    return eda.user_activity_segments(tx, _reference(tx))


@query("recency_histogram", "bucket:long n_users:long", "SELECT days // 14 * 14 AS bucket, count(*) AS n_users FROM last_seen GROUP BY 1")
def _(spark, d):
    tx = retail(spark, d)
    return eda.recency_histogram(tx, _reference(tx))


@query("make_fold", "part:str n_rows:long n_users:long n_items:long", f"""
SELECT 'history' AS part, count(*) AS n_rows, count(DISTINCT customer_id) AS n_users, count(DISTINCT article_id) AS n_items FROM etx WHERE t_dat <= DATE '{EVENTS_END}' - 7
UNION ALL SELECT 'next', count(*), count(DISTINCT customer_id), count(DISTINCT article_id) FROM (
  SELECT DISTINCT customer_id, article_id FROM etx WHERE t_dat > DATE '{EVENTS_END}' - 7 AND t_dat <= DATE '{EVENTS_END}')""")
def _(spark, d):
    history, following = eda.make_fold(events(spark, d), EVENTS_END)
    both = (history.select("customer_id", "article_id", F.lit("history").alias("part"))
            .unionByName(following.select("customer_id", "article_id", F.lit("next").alias("part"))))
    return both.groupBy("part").agg(F.count("*").alias("n_rows"), F.count_distinct("customer_id").alias("n_users"), F.count_distinct("article_id").alias("n_items"))


EVALUATED = "source:str recall_pct:float precision_pct:float hit_rate_pct:float"


def _evaluated_sql(name: str, found: str, n_candidates: str) -> str:
    return f"""SELECT '{name}' AS source, 100.0 * count(*) FILTER (found) / count(*) AS recall_pct,
  100.0 * count(*) FILTER (found) / ({n_candidates}) AS precision_pct,
  100.0 * count(DISTINCT customer_id) FILTER (found) / count(DISTINCT customer_id) AS hit_rate_pct FROM (SELECT *, {found} AS found FROM truth t)"""


@query("evaluate_source_pairs", EVALUATED, _evaluated_sql(
    "union", "EXISTS (SELECT 1 FROM cand c WHERE c.customer_id = t.customer_id AND c.article_id = t.article_id)", "SELECT count(*) FROM cand"))
def _(spark, d):
    f = retail_fold(spark, d)
    return eda.evaluate_source("union", candidates(f), recommend.ground_truth(f.val))


@query("evaluate_source_global", EVALUATED, _evaluated_sql(
    "bestsellers", "article_id IN (SELECT article_id FROM best12)", "SELECT 12 * count(*) FROM people"))
def _(spark, d):
    f = retail_fold(spark, d)
    people = f.customers.agg(F.count("*")).scalar()
    return eda.evaluate_source("bestsellers", recommend.popular_items(f, RETAIL.retrieval.popularity_weeks, 12), recommend.ground_truth(f.val), people, 12)


cte("tiers", """SELECT l.customer_id, CASE WHEN l.p <= 30000 THEN 'budget' WHEN l.p <= 60000 THEN 'mid' ELSE 'premium' END AS usual,
  CASE WHEN r.p <= 30000 THEN 'budget' WHEN r.p <= 60000 THEN 'mid' ELSE 'premium' END AS next_val
  FROM (SELECT customer_id, avg(price) AS p FROM history GROUP BY 1) l JOIN (SELECT customer_id, avg(price) AS p FROM val GROUP BY 1) r USING (customer_id)""")


@query("consistency", "observed:float chance:float", """
SELECT (SELECT avg(CAST(usual = next_val AS INTEGER)) FROM tiers) AS observed, sum(a.n * b.n) / (SELECT count(*) ** 2 FROM tiers) AS chance
FROM (SELECT usual AS v, count(*) AS n FROM tiers GROUP BY 1) a JOIN (SELECT next_val AS v, count(*) AS n FROM tiers GROUP BY 1) b USING (v)""")
def _(spark, d):
    f = retail_fold(spark, d)

    def tiers(df, name):
        return df.groupBy("customer_id").agg(F.avg("price").alias("p")).select("customer_id", price_tier(F.col("p"), 30000, 60000).alias(name))

    return eda.consistency(tiers(f.history, "usual"), tiers(f.val, "next_val"))


@query("price_tier", "tier:str n:long", """
SELECT CASE WHEN price <= 20000 THEN 'budget' WHEN price <= 70000 THEN 'mid' ELSE 'premium' END AS tier, count(*) AS n FROM tx GROUP BY 1""")
def _(spark, d):
    return retail(spark, d).groupBy(price_tier(F.col("price"), 20000, 70000).alias("tier")).agg(F.count("*").alias("n"))


@query("top_index", "customer_id:long usual:int", """
SELECT customer_id, index_group_no AS usual FROM (SELECT customer_id, index_group_no, row_number() OVER (
  PARTITION BY customer_id ORDER BY count(*) DESC, index_group_no) AS rk FROM tx JOIN articles USING (article_id) GROUP BY 1, 2) WHERE rk = 1""")
def _(spark, d):
    return eda.top_index(retail(spark, d), "usual", adapters.retail_articles(spark, d))
