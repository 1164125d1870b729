"""Candidate sources, their union and the cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import cte, query
from registry.tables import RETAIL, retail_fold
from shoprank.functions.columns import age_band
from shoprank.operators import retrieval, union
from shoprank.operators.nearest import nearest_by_factors
from shoprank.schema import FoldInputs, Retrieval

S = RETAIL
CAND = "customer_id:long article_id:long rank:int source:str"
BACK = f"(SELECT d FROM cut) - {7 * S.retrieval.seed_weeks}"
POP_BACK = f"(SELECT d FROM cut) - {7 * S.retrieval.popularity_weeks}"


def _ranked(body: str, order: str, n: int, source: str, partition: str = "customer_id") -> str:
    return f"""SELECT customer_id, article_id, CAST(rank AS INTEGER) AS rank, '{source}' AS source FROM (
  SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY {order}) AS rank FROM ({body})) WHERE rank <= {n}"""


cte("c_repurchase", _ranked("SELECT customer_id, article_id, count(*) AS n FROM history GROUP BY 1, 2",
                            "n DESC, article_id", S.retrieval.repurchase, "repurchase"))
cte("best", f"""SELECT article_id, row_number() OVER (ORDER BY count(*) DESC, article_id) AS rank FROM train
  WHERE t_dat > {POP_BACK} GROUP BY 1 QUALIFY rank <= {S.retrieval.popularity}""")
cte("c_bestseller", "SELECT customer_id, article_id, CAST(rank AS INTEGER) AS rank, 'popularity' AS source FROM people, best")
cte("c_product_code", _ranked(f"""SELECT DISTINCT u.customer_id, a.article_id, coalesce(p.n, 0) AS n
  FROM (SELECT DISTINCT t.customer_id, b.product_code FROM train t JOIN articles b USING (article_id) WHERE t.t_dat > {BACK}) u
  JOIN articles a ON a.product_code = u.product_code
  LEFT JOIN (SELECT article_id, count(*) AS n FROM train GROUP BY 1) p ON p.article_id = a.article_id""",
                              "n DESC, article_id", S.retrieval.product_code, "product_code"))
cte("neighbours", f"""SELECT seed, article_id, cocount, r FROM (
  SELECT a.article_id AS seed, b.article_id, count(*) AS cocount,
    row_number() OVER (PARTITION BY a.article_id ORDER BY count(*) DESC, b.article_id) AS r
  FROM (SELECT DISTINCT customer_id, article_id FROM train) a JOIN (SELECT DISTINCT customer_id, article_id FROM train) b
    ON a.customer_id = b.customer_id AND a.article_id <> b.article_id GROUP BY 1, 2) WHERE r <= {S.retrieval.neighbors}""")
cte("c_itemcf", _ranked(f"""SELECT s.customer_id, e.article_id, sum(e.cocount) AS n
  FROM (SELECT DISTINCT customer_id, article_id FROM train WHERE t_dat > {BACK}) s JOIN neighbours e ON e.seed = s.article_id
  GROUP BY 1, 2""", "n DESC, article_id", S.retrieval.itemcf, "itemcf"))
cte("placed", """SELECT customer_id, CASE WHEN age < 25 THEN 'youth' WHEN age < 35 THEN 'young_adult' WHEN age < 45 THEN 'adult'
    WHEN age < 55 THEN 'middle' WHEN age IS NOT NULL THEN 'senior' ELSE 'unknown' END AS age_group,
  coalesce(postal_code, 'NA') AS postal_code, age IS NULL AND coalesce(postal_code, 'NA') = 'NA' AS no_info FROM people""")
cte("seg_recent", f"SELECT t.article_id, p.age_group, p.postal_code FROM train t LEFT JOIN placed p USING (customer_id) WHERE t.t_dat > {POP_BACK}")


def _segment_sql(mode: str, source: str, n: int) -> str:
    levels = [
        f"""SELECT p.customer_id, k.article_id, k.rk AS pri FROM placed p JOIN (SELECT age_group, postal_code, article_id,
  row_number() OVER (PARTITION BY age_group, postal_code ORDER BY count(*) DESC, article_id) AS rk
  FROM seg_recent GROUP BY 1, 2, 3 QUALIFY rk <= {n}) k USING (age_group, postal_code)""",
        f"""SELECT p.customer_id, k.article_id, 1000000 + k.rk FROM placed p JOIN (SELECT age_group, article_id,
  row_number() OVER (PARTITION BY age_group ORDER BY count(*) DESC, article_id) AS rk
  FROM seg_recent GROUP BY 1, 2 QUALIFY rk <= {n}) k USING (age_group)"""]
    if mode != "off":
        levels.append(f"""SELECT p.customer_id, k.article_id, 2000000 + k.rk FROM placed p, (SELECT article_id,
  row_number() OVER (ORDER BY count(*) DESC, article_id) AS rk FROM seg_recent GROUP BY 1 QUALIFY rk <= {n}) k
  WHERE {'true' if mode == 'all' else 'p.no_info'}""")
    merged = f"SELECT customer_id, article_id, min(pri) AS pri FROM ({' UNION ALL '.join(levels)}) GROUP BY 1, 2"
    return _ranked(merged, "pri", n, source)


cte("c_popularity", _segment_sql("no_info_only", "popularity", S.retrieval.popularity))

NAMES = ("repurchase", "itemcf", "product_code", "popularity")
cte("stacked", " UNION ALL ".join(f"SELECT * FROM c_{n}" for n in NAMES))
cte("united", "SELECT customer_id, article_id, "
    + ", ".join(f"min(rank) FILTER (source = '{n}') AS {n}_rank" for n in NAMES) + " FROM stacked GROUP BY 1, 2")
cte("cand", "SELECT *, " + ", ".join(f"CAST({n}_rank IS NOT NULL AS INTEGER) AS src_{n}" for n in NAMES)
    + ", " + " + ".join(f"CAST({n}_rank IS NOT NULL AS INTEGER)" for n in NAMES) + " AS n_sources FROM united")

cte("labelled", """SELECT c.*, CAST(t.customer_id IS NOT NULL AS INTEGER) AS label
  FROM cand c LEFT JOIN truth t USING (customer_id, article_id)""")

UNITED = "customer_id:long article_id:long " + " ".join(f"{n}_rank:int" for n in NAMES)
FLAGGED = UNITED + " " + " ".join(f"src_{n}:int" for n in NAMES) + " n_sources:int"


def candidates(fold: FoldInputs, edges: DataFrame | None = None) -> DataFrame:
    """The four sources that need no fitted factors, united and flagged."""
    edges = retrieval.copurchase_neighbors(fold, S.retrieval.neighbors) if edges is None else edges
    table = retrieval.source_table(S, with_als=False)
    parts = {name: make(fold, edges) for name, make in table.items()}
    return union.source_flags(union.union_candidates(parts, fold.columns), list(parts))


@query("repurchase", CAND, "SELECT * FROM c_repurchase")
def _(spark, d):
    return retrieval.repurchase(retail_fold(spark, d), S.retrieval.repurchase)


@query("popularity", CAND, "SELECT * FROM c_bestseller")
def _(spark, d):
    return retrieval.popularity(retail_fold(spark, d), S.retrieval.popularity, S.retrieval.popularity_weeks)


@query("product_code", CAND, "SELECT * FROM c_product_code")
def _(spark, d):
    return retrieval.product_code(retail_fold(spark, d), S.retrieval.product_code, S.retrieval.seed_weeks)


@query("itemcf_neighbors", "seed:long article_id:long cocount:long r:int", "SELECT * FROM neighbours")
def _(spark, d):
    return retrieval.copurchase_neighbors(retail_fold(spark, d), S.retrieval.neighbors)


@query("itemcf", CAND, "SELECT * FROM c_itemcf")
def _(spark, d):
    return retrieval.itemcf(retail_fold(spark, d), S.retrieval.itemcf, S.retrieval.neighbors, S.retrieval.seed_weeks)


@query("age_group", "age_group:str customers:long", "SELECT age_group, count(*) AS customers FROM placed GROUP BY 1")
def _(spark, d):
    return retail_fold(spark, d).customers.groupBy(age_band(F.col("age")).alias("age_group")).agg(F.count("*").alias("customers"))


@query("segment_topk", "age_group:str article_id:long rk:int", """
SELECT age_group, article_id, row_number() OVER (PARTITION BY age_group ORDER BY count(*) DESC, article_id) AS rk
FROM history JOIN placed USING (customer_id) GROUP BY 1, 2 QUALIFY rk <= 25""")
def _(spark, d):
    f = retail_fold(spark, d)
    people = f.customers.select("customer_id", age_band(F.col("age")).alias("age_group"))
    return retrieval.segment_top(f.history.join(people, "customer_id"), ["age_group"], f.columns, 25)


def _register_segment(mode: str) -> None:
    @query(f"segment_popularity_{mode}", CAND, _segment_sql(mode, "coldstart", S.retrieval.popularity))
    def _(spark, d):
        return retrieval.segment_popularity(retail_fold(spark, d), S.retrieval.popularity, S.retrieval.popularity_weeks, mode)


for _mode in retrieval.FALLBACK_MODES:
    _register_segment(_mode)


@query("als_graph", CAND)
def _(spark, d):
    return retrieval.als_graph(retail_fold(spark, d), S.retrieval.graph, S.retrieval.factors, S.retrieval.sweeps)


@query("als_graph_facts", "customers:long full_lists:long unknown:long unordered:long repeated:long", """
SELECT count(DISTINCT customer_id) AS customers, count(DISTINCT customer_id) AS full_lists, 0 AS unknown, 0 AS unordered, 0 AS repeated FROM train""")
def _(spark, d):
    """What SQL can say about the factor lists at the shipped size: n items each, all sold before, scores falling, no item twice."""
    f = retail_fold(spark, d)
    shipped = Retrieval()
    model, users, items = retrieval.als_model(f, shipped.factors, shipped.sweeps)
    near = nearest_by_factors(model.userFactors, model.itemFactors, shipped.graph).join(items, "_i", "left").join(users, "_u", "left")
    near = near.select("customer_id", "article_id", "rank", "score")
    lists = near.groupBy("customer_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "article_id"))).alias("l"))
    known = F.size("l") == shipped.graph
    falling = F.forall(F.sequence(F.lit(1), F.size("l") - 1), lambda k: F.get("l", k - 1)["score"] >= F.get("l", k)["score"])
    return lists.agg(F.count("*").alias("customers"), F.count_if(known & (F.element_at("l", -1)["rank"] == shipped.graph)).alias("full_lists"),
                     F.count_if(F.col("customer_id").isNull() | F.exists("l", lambda e: e["article_id"].isNull())).alias("unknown"),
                     F.count_if(~falling).alias("unordered"), F.count_if(F.size(F.array_distinct(F.transform("l", lambda e: e["article_id"]))) < F.size("l")).alias("repeated"))


@query("union_candidates", UNITED, "SELECT * FROM united")
def _(spark, d):
    return candidates(retail_fold(spark, d))


@query("source_flags", FLAGGED, "SELECT * FROM cand")
def _(spark, d):
    return candidates(retail_fold(spark, d))


@query("cap_per_customer", FLAGGED, """
SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY n_sources DESC, article_id) <= 12""")
def _(spark, d):
    return union.cap_per_customer(candidates(retail_fold(spark, d)), 12)


@query("build_candidates", "source:str candidates:long customers:long", """
SELECT source, count(*) AS candidates, count(DISTINCT customer_id) AS customers FROM stacked GROUP BY 1""")
def _(spark, d):
    table = candidates(retail_fold(spark, d))
    long = table.select("customer_id", F.explode(F.array_compact(F.array(*[
        F.when(F.col(f"src_{n}") == 1, F.lit(n)) for n in NAMES]))).alias("source"))
    return long.groupBy("source").agg(F.count("*").alias("candidates"), F.count_distinct("customer_id").alias("customers"))
