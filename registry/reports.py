"""Commercial and per-segment reports of the scored fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import cte, query
from registry.lists import COMPARED, FIVE, K, MEANS, _compare_sql, scored_fold
from registry.tables import RETAIL, retail_fold
from shoprank.operators import recommend, reports

SEED, POP = RETAIL.retrieval.seed_weeks, RETAIL.retrieval.popularity_weeks

cte("prices", f"""SELECT article_id, avg(price) AS price, min(t_dat) > (SELECT d FROM cut) - {7 * SEED} AS is_new FROM history GROUP BY 1""")
cte("known", "SELECT DISTINCT customer_id, article_id FROM history WHERE customer_id IN (SELECT customer_id FROM buyers)")
cte("slots", "SELECT a.*, coalesce(p.price, 0) AS price, coalesce(p.is_new, false) AS is_new FROM arms a LEFT JOIN prices p USING (article_id)")
cte("wanted", """SELECT t.customer_id, t.article_id, coalesce(p.price, 0) AS price FROM truth t
  JOIN scored_users USING (customer_id) LEFT JOIN prices p USING (article_id)""")
cte("panel", """SELECT s.arm, 100 * h.value / w.value AS "revenue captured %", 100.0 * h.n / w.n AS "purchases captured %",
  s.mean_price / (w.value / w.n) AS "price of recommended / purchased", s.new_pct AS "new arrivals in recommendations %",
  100.0 * h.known / h.n AS "replenishment share of hits %",
  100.0 * s.items / (SELECT count(*) FROM articles) AS "catalogue coverage %"
FROM (SELECT arm, avg(price) AS mean_price, 100.0 * count(*) FILTER (is_new) / count(*) AS new_pct, count(DISTINCT article_id) AS items
      FROM slots GROUP BY 1) s
JOIN (SELECT s.arm, count(*) AS n, sum(s.price) AS value, count(k.customer_id) AS known FROM slots s
      JOIN wanted w ON w.customer_id = s.customer_id AND w.article_id = s.article_id
      LEFT JOIN known k ON k.customer_id = s.customer_id AND k.article_id = s.article_id GROUP BY 1) h ON h.arm = s.arm
JOIN (SELECT count(*) AS n, sum(price) AS value FROM wanted) w ON true""")
cte("panel_long", "SELECT * FROM (UNPIVOT panel ON "
    + ", ".join(f'"{n}"' for n in reports.PANEL) + " INTO NAME metric VALUE value)")
cte("activity", """SELECT customer_id, CASE WHEN d <= 28 THEN 'active (<=4w)' WHEN d <= 84 THEN 'lapsed (4-12w)' ELSE 'dormant (>12w)' END AS segment
  FROM (SELECT customer_id, date_diff('day', max(t_dat), (SELECT d FROM cut)) AS d FROM history GROUP BY 1)""")
cte("segmented", f"""SELECT coalesce(a.segment, 'cold (no history)') AS segment, {MEANS}
  FROM per_user LEFT JOIN activity a USING (customer_id) GROUP BY 1""")


def _inputs(fold, scored):
    return reports.business_inputs(fold, scored.buyers, SEED, POP, K)


@query("business_inputs_items", "article_id:long price:float is_new:bool", "SELECT * FROM prices")
def _(spark, d):
    return _inputs(*scored_fold(spark, d)).items


@query("business_inputs_prior_pairs", "customer_id:long article_id:long", "SELECT * FROM known")
def _(spark, d):
    return _inputs(*scored_fold(spark, d)).prior_pairs


@query("business_panel", "metric:str value:float", "SELECT metric, value FROM panel_long WHERE arm = 'model'")
def _(spark, d):
    fold, scored = scored_fold(spark, d)
    return reports.business_panel(scored.recs, scored.truth, _inputs(fold, scored), K)


@query("business_table", "metric:str model:float baseline:float", """
SELECT metric, max(value) FILTER (arm = 'model') AS model, max(value) FILTER (arm = 'baseline') AS baseline FROM panel_long GROUP BY 1""")
def _(spark, d):
    fold, scored = scored_fold(spark, d)
    return reports.business_table(scored, _inputs(fold, scored), K)


@query("activity_segments", "customer_id:long segment:str", "SELECT * FROM activity")
def _(spark, d):
    return reports.activity_segments(retail_fold(spark, d))


@query("segment_report", "segment:str customers:long buyers:long " + FIVE, "SELECT * FROM segmented")
def _(spark, d):
    fold, scored = scored_fold(spark, d)
    return reports.segment_report(scored.recs, scored.truth, reports.activity_segments(fold), K)


@query("segment_table", "segment:str customers:long buyers:long buyer_rate_pct:float " + FIVE,
       "SELECT *, 100.0 * buyers / customers AS buyer_rate_pct FROM segmented")
def _(spark, d):
    fold, scored = scored_fold(spark, d)
    return reports.segment_table(scored, reports.activity_segments(fold), K)


@query("accuracy_table", COMPARED + " map_everyone:float", f"""
SELECT *, (SELECT avg(ap) FROM per_user) AS map_everyone FROM ({_compare_sql('per_buyer_arms')})""")
def _(spark, d):
    return reports.accuracy_table(scored_fold(spark, d)[1], K)
