"""What predicts the next weeks, over several held-out windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import cte, query
from registry.tables import RETAIL, event_specs, events, open_specs, retail
from shoprank.operators import signals
from shoprank.sources import adapters

SEED = RETAIL.retrieval.seed_weeks
BEST_WEEKS, N_BEST = 13, 200


@query("overview", "n_transactions:long n_customers:long n_articles:long min_date:date max_date:date", """
SELECT count(*) AS n_transactions, count(DISTINCT customer_id) AS n_customers, count(DISTINCT article_id) AS n_articles,
  min(t_dat) AS min_date, max(t_dat) AS max_date FROM tx""")
def _(spark, d):
    return signals.overview(retail(spark, d))


@query("duplicate_audit", "n_rows:long exact_duplicates:long same_day_repeats:long rows_after:long", """
SELECT (SELECT count(*) FROM etx) AS n_rows, (SELECT count(*) FROM etx) - (SELECT count(*) FROM (SELECT DISTINCT * FROM etx)) AS exact_duplicates,
  (SELECT count(*) FROM etx) - count(*) AS same_day_repeats, count(*) AS rows_after FROM (SELECT DISTINCT customer_id, article_id, t_dat FROM etx)""")
def _(spark, d):
    return signals.duplicate_audit(events(spark, d))


cte("next_pairs", "SELECT DISTINCT s.fold, s.train_end AS cut, customer_id, article_id FROM tx JOIN ospecs s ON t_dat BETWEEN s.val_start AND s.val_end")
cte("past", "SELECT s.fold, t.* FROM tx t JOIN ospecs s ON t.t_dat <= s.train_end")
cte("past_pairs", "SELECT DISTINCT fold, customer_id, article_id FROM past")
cte("past_attrs", "SELECT DISTINCT fold, customer_id, product_code, product_type_no FROM past JOIN articles USING (article_id)")
cte("past_best", f"""SELECT fold, article_id FROM (SELECT p.fold, article_id, row_number() OVER (PARTITION BY p.fold ORDER BY count(*) DESC, article_id) AS r
  FROM past p JOIN ospecs s ON s.fold = p.fold AND p.t_dat > s.train_end - {7 * BEST_WEEKS} GROUP BY 1, 2) WHERE r <= {N_BEST}""")
cte("demand", f"""SELECT n.fold, CASE
  WHEN EXISTS (SELECT 1 FROM past_pairs p WHERE p.fold = n.fold AND p.customer_id = n.customer_id AND p.article_id = n.article_id) THEN '{signals.REPEAT}'
  WHEN EXISTS (SELECT 1 FROM past_attrs p WHERE p.fold = n.fold AND p.customer_id = n.customer_id AND p.product_code = a.product_code) THEN '{signals.SIBLING}'
  WHEN EXISTS (SELECT 1 FROM past_attrs p WHERE p.fold = n.fold AND p.customer_id = n.customer_id AND p.product_type_no = a.product_type_no) THEN '{signals.SAME_TYPE}'
  WHEN EXISTS (SELECT 1 FROM past_best p WHERE p.fold = n.fold AND p.article_id = n.article_id) THEN '{signals.POPULAR}'
  ELSE '{signals.UNCOVERED}' END AS bucket FROM next_pairs n LEFT JOIN articles a USING (article_id)""")
LABELS = ", ".join(f"('{b}')" for b in (signals.REPEAT, signals.SIBLING, signals.SAME_TYPE, signals.POPULAR, signals.UNCOVERED))
cte("demand_shares", f"""SELECT s.fold, b.bucket, count(d.bucket) AS pairs,
  100.0 * count(d.bucket) / any_value(n.n) AS pct FROM ospecs s JOIN (VALUES {LABELS}) b(bucket) ON true
  JOIN (SELECT fold, count(*) AS n FROM next_pairs GROUP BY 1) n ON n.fold = s.fold
  LEFT JOIN demand d ON d.fold = s.fold AND d.bucket = b.bucket GROUP BY 1, 2""")


def _demand(spark, d):
    return signals.demand_decomposition(retail(spark, d), adapters.retail_articles(spark, d), open_specs(), BEST_WEEKS, N_BEST)


@query("demand_decomposition", "fold:str bucket:str pairs:long pct:float", "SELECT * FROM demand_shares")
def _(spark, d):
    return _demand(spark, d)


@query("demand_decomposition_mean", "bucket:str pct:float", "SELECT bucket, avg(pct) AS pct FROM demand_shares GROUP BY 1")
def _(spark, d):
    return signals.decomposition_mean(_demand(spark, d))


@query("new_item_shares", "fold:str new_arrival_pct:float unseen_pct:float", f"""
SELECT n.fold, 100.0 * count(*) FILTER (f.first_sale > n.cut - {7 * SEED}) / count(*) AS new_arrival_pct,
  100.0 * count(*) FILTER (f.first_sale IS NULL) / count(*) AS unseen_pct
FROM next_pairs n LEFT JOIN (SELECT fold, article_id, min(t_dat) AS first_sale FROM past GROUP BY 1, 2) f ON f.fold = n.fold AND f.article_id = n.article_id
GROUP BY 1""")
def _(spark, d):
    return signals.new_item_shares(retail(spark, d), open_specs(), SEED)


_VALUES = " UNION ALL ".join(f"SELECT article_id, '{n}' AS attribute, CAST({c} AS VARCHAR) AS value FROM articles" for n, c in signals.ATTRIBUTES)
cte("attr_values", _VALUES)
cte("owned_values", "SELECT DISTINCT p.fold, p.customer_id, v.attribute, v.value FROM past_pairs p JOIN attr_values v USING (article_id)")
cte("value_buyers", "SELECT fold, attribute, value, count(*) AS buyers FROM owned_values GROUP BY 1, 2, 3")
cte("loyalty", """SELECT n.fold, v.attribute, 100.0 * count(o.customer_id) / any_value(s.n_next) AS match_pct,
  100.0 * avg(b.buyers / s.n_customers) AS chance_pct
FROM next_pairs n JOIN attr_values v USING (article_id)
LEFT JOIN owned_values o ON o.fold = n.fold AND o.customer_id = n.customer_id AND o.attribute = v.attribute AND o.value = v.value
LEFT JOIN value_buyers b ON b.fold = n.fold AND b.attribute = v.attribute AND b.value = v.value
JOIN (SELECT a.fold, a.n_next, c.n_customers FROM (SELECT fold, count(*) AS n_next FROM next_pairs GROUP BY 1) a
      JOIN (SELECT fold, count(DISTINCT customer_id) AS n_customers FROM past GROUP BY 1) c USING (fold)) s ON s.fold = n.fold
GROUP BY 1, 2""")


def _loyalty(spark, d):
    return signals.attribute_loyalty(retail(spark, d), adapters.retail_articles(spark, d), open_specs())


@query("attribute_loyalty", "fold:str attribute:str match_pct:float chance_pct:float", "SELECT * FROM loyalty")
def _(spark, d):
    return _loyalty(spark, d)


@query("attribute_loyalty_mean", "attribute:str match_pct:float chance_pct:float lift:float match_sd:float", """
SELECT attribute, avg(match_pct) AS match_pct, avg(chance_pct) AS chance_pct, avg(match_pct) / avg(chance_pct) AS lift,
  stddev_samp(match_pct) AS match_sd FROM loyalty GROUP BY 1""")
def _(spark, d):
    return signals.loyalty_mean(_loyalty(spark, d))


cte("next_buyers", "SELECT DISTINCT fold, customer_id FROM next_pairs")
cte("who", f"""SELECT c.fold, avg(b) AS base, avg(b) FILTER (days <= {7 * SEED}) AS recent, avg(b) FILTER (days > {7 * 52}) AS dormant,
  avg(b) FILTER (purchases >= 40) AS frequent, avg(b) FILTER (purchases = 1) AS one_time,
  avg(b) FILTER (fashion_news_frequency = 'Regularly') AS newsletter, avg(b) FILTER (fashion_news_frequency IN ('NONE', 'None')) AS no_news
FROM (SELECT p.fold, p.customer_id, date_diff('day', max(p.t_dat), any_value(s.train_end)) AS days, count(*) AS purchases,
        CAST(any_value(n.customer_id) IS NOT NULL AS INTEGER) AS b
      FROM past p JOIN ospecs s USING (fold) LEFT JOIN next_buyers n ON n.fold = p.fold AND n.customer_id = p.customer_id GROUP BY 1, 2) c
LEFT JOIN people USING (customer_id) GROUP BY 1""")
WHO = "base:float recent:float dormant:float frequent:float one_time:float newsletter:float no_news:float"


def _who(spark, d):
    return signals.who_buys(retail(spark, d), adapters.retail_customers(spark, d), open_specs(), SEED, 52, 40)


@query("who_buys_next", "fold:str " + WHO, "SELECT * FROM who")
def _(spark, d):
    return _who(spark, d)


@query("who_buys_next_mean", "segment:str buy_rate_pct:float sd:float lift:float", " UNION ALL ".join(
    f"SELECT '{n}' AS segment, 100 * avg({n}) AS buy_rate_pct, 100 * stddev_samp({n}) AS sd, avg({n}) / avg(base) AS lift FROM who"
    for n in ("recent", "dormant", "frequent", "one_time", "newsletter", "no_news")))
def _(spark, d):
    return signals.who_buys_mean(_who(spark, d))


@query("cold_buyer_share", "fold:str cold_share:float", """
SELECT fold, count(*) FILTER (NOT EXISTS (SELECT 1 FROM past p WHERE p.fold = n.fold AND p.customer_id = n.customer_id)) / count(*) AS cold_share
FROM next_buyers n GROUP BY 1""")
def _(spark, d):
    return signals.cold_buyer_share(retail(spark, d), open_specs())


cte("e_past", "SELECT s.fold, t.* FROM etx t JOIN especs s ON t.t_dat <= s.train_end")
cte("e_week_rows", "SELECT s.fold, t.* FROM etx t JOIN especs s ON t.t_dat BETWEEN s.val_start AND s.val_end")
cte("e_before", "SELECT fold, customer_id, avg(price) AS p, avg(sales_channel_id) AS c FROM e_past GROUP BY 1, 2")
cte("e_after", "SELECT fold, customer_id, avg(price) AS p, avg(sales_channel_id) AS c FROM e_week_rows GROUP BY 1, 2")
cte("e_cuts", "SELECT fold, quantile_cont(p, 0.33) AS low, quantile_cont(p, 0.66) AS high FROM e_before GROUP BY 1")
_TIER = "CASE WHEN {0}.p <= k.low THEN 'budget' WHEN {0}.p <= k.high THEN 'mid' ELSE 'premium' END"
_TOP = """SELECT fold, customer_id, index_group_no AS v FROM (SELECT fold, customer_id, index_group_no,
  row_number() OVER (PARTITION BY fold, customer_id ORDER BY count(*) DESC, index_group_no) AS rk FROM {0} JOIN earticles USING (article_id) GROUP BY 1, 2, 3) WHERE rk = 1"""
cte("e_pairs", "SELECT DISTINCT fold, customer_id, article_id FROM e_week_rows")
cte("matched", f"""SELECT 'price' AS dimension, b.fold, {_TIER.format('b')} AS u, {_TIER.format('a')} AS x
  FROM e_before b JOIN e_after a USING (fold, customer_id) JOIN e_cuts k ON k.fold = b.fold
  UNION ALL SELECT 'channel', fold, CAST(b.c > 1.5 AS VARCHAR), CAST(a.c > 1.5 AS VARCHAR) FROM e_before b JOIN e_after a USING (fold, customer_id)
  UNION ALL SELECT 'category', fold, CAST(b.v AS VARCHAR), CAST(a.v AS VARCHAR)
  FROM ({_TOP.format('e_past')}) b JOIN ({_TOP.format('e_pairs')}) a USING (fold, customer_id)""")
cte("agreement", """SELECT o.fold, o.dimension, o.observed, c.chance FROM (
    SELECT fold, dimension, avg(CAST(u = x AS INTEGER)) AS observed, count(*) AS n FROM matched GROUP BY 1, 2) o
  JOIN (SELECT a.fold, a.dimension, sum(a.n * b.n) / any_value(t.n) ** 2 AS chance
    FROM (SELECT fold, dimension, u AS v, count(*) AS n FROM matched GROUP BY 1, 2, 3) a
    JOIN (SELECT fold, dimension, x AS v, count(*) AS n FROM matched GROUP BY 1, 2, 3) b USING (fold, dimension, v)
    JOIN (SELECT fold, dimension, count(*) AS n FROM matched GROUP BY 1, 2) t USING (fold, dimension) GROUP BY 1, 2) c
  ON c.fold = o.fold AND c.dimension = o.dimension""")


def _behaviour(spark, d, exact=True):
    return signals.behaviour_consistency(events(spark, d), adapters.event_articles(spark, d), event_specs(), exact)


@query("behaviour_consistency", "fold:str dimension:str observed:float chance:float", "SELECT * FROM agreement")
def _(spark, d):
    return _behaviour(spark, d)


@query("behaviour_consistency_sketch", "fold:str dimension:str observed:float chance:float")
def _(spark, d):
    return _behaviour(spark, d, exact=False)


@query("behaviour_consistency_sketch_facts", "fold:str dimension:str close:bool", "SELECT fold, dimension, true AS close FROM agreement")
def _(spark, d):
    """Whether cut points from a sketch move a share by less than one percent of the customers."""
    names = ["fold", "dimension"]
    rough = _behaviour(spark, d, exact=False).select(*names, F.col("observed").alias("o"), F.col("chance").alias("c"))
    both = _behaviour(spark, d).join(rough, names)
    return both.select(*names, ((F.abs(F.col("observed") - F.col("o")) < 0.01) & (F.abs(F.col("chance") - F.col("c")) < 0.01)).alias("close"))


@query("behaviour_consistency_mean", "dimension:str observed:float chance:float ratio:float", """
SELECT dimension, avg(observed) AS observed, avg(chance) AS chance, avg(observed) / avg(chance) AS ratio FROM agreement GROUP BY 1""")
def _(spark, d):
    return signals.consistency_mean(_behaviour(spark, d))
