"""From scored candidates to lists, metrics and diagnostics."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registry import cte, of_fold, query
from registry.candidates import NAMES, candidates
from registry.preparation import _hash_sql
from registry.tables import RETAIL, retail, retail_fold, retail_specs, run_folder, stored_retail
from shoprank.functions.session import side_by_side, written
from shoprank.operators import diagnostics, metrics, recommend
from shoprank.operators.folds import tag_folds
from shoprank.operators.retrieval import window_neighbors
from shoprank.schema import FoldInputs
from shoprank.sources import adapters, sinks

K = RETAIL.lists.length
MISSING = 500


def blended(table: DataFrame) -> DataFrame:
    """A score without a fitted model: most corroborated, then best rank at any source."""
    best = F.least(*[F.coalesce(f"{n}_rank", F.lit(MISSING)) for n in NAMES])
    return table.select("customer_id", "article_id", (F.col("n_sources") * 1000.0 - best).alias("score"))


def scored(fold: FoldInputs) -> DataFrame:
    return blended(candidates(fold))


def scored_fold(spark, d) -> tuple[FoldInputs, recommend.ScoredFold]:
    fold = retail_fold(spark, d)
    return fold, recommend.score_fold(fold, scored(fold), K, RETAIL.retrieval.popularity_weeks)


cte("scores", "SELECT customer_id, article_id, n_sources * 1000.0 - least("
    + ", ".join(f"coalesce({n}_rank, {MISSING})" for n in NAMES) + ") AS score FROM cand")
cte("recs", f"""SELECT customer_id, article_id, pos FROM (SELECT *, row_number() OVER (
  PARTITION BY customer_id ORDER BY score DESC, article_id) AS pos FROM scores) WHERE pos <= {K}""")
cte("recs_model", "SELECT 'model' AS arm, customer_id, article_id, pos FROM recs")
cte("best12", f"SELECT article_id, rank FROM best WHERE rank <= {K}")
cte("scored_users", "SELECT DISTINCT customer_id FROM recs")
cte("recs_base", "SELECT 'baseline' AS arm, customer_id, article_id, rank AS pos FROM scored_users, best12")
cte("arms", "SELECT * FROM recs_model UNION ALL SELECT * FROM recs_base")
cte("buyers", "SELECT customer_id FROM scored_users WHERE customer_id IN (SELECT customer_id FROM truth)")


def per_user_sql(recs: str, users: str, truth: str = "truth") -> str:
    """Per-user scores of `recs(arm, customer_id, article_id, pos)` over `users(arm, customer_id)`."""
    return f"""SELECT u.arm, u.customer_id, coalesce(t.n_true, 0) AS n_true, coalesce(n.n_pred, 0) AS n_pred,
  coalesce(h.gain / least(t.n_true, {K}), 0) AS ap,
  coalesce(h.dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, {K + 1}) r(i) WHERE i <= t.n_true), 0) AS ndcg,
  CASE WHEN h.hits > 0 THEN 1.0 ELSE 0.0 END AS hit, coalesce(h.hits / n.n_pred, 0) AS precision,
  coalesce(h.hits / t.n_true, 0) AS recall, coalesce(1.0 / h.first, 0) AS rr
FROM {users} u
LEFT JOIN (SELECT customer_id, count(DISTINCT article_id) AS n_true FROM {truth} GROUP BY 1) t ON t.customer_id = u.customer_id
LEFT JOIN (SELECT arm, customer_id, count(*) AS n_pred FROM {recs} WHERE pos <= {K} GROUP BY 1, 2) n
  ON n.arm = u.arm AND n.customer_id = u.customer_id
LEFT JOIN (SELECT arm, customer_id, count(*) AS hits, min(pos) AS first, sum(1 / log2(pos + 1)) AS dcg, sum(nth / pos) AS gain
  FROM (SELECT r.*, row_number() OVER (PARTITION BY r.arm, r.customer_id ORDER BY pos) AS nth
    FROM (SELECT arm, customer_id, article_id, min(pos) AS pos FROM {recs} WHERE pos <= {K} GROUP BY 1, 2, 3) r
    JOIN {truth} v ON v.customer_id = r.customer_id AND v.article_id = r.article_id) GROUP BY 1, 2) h
  ON h.arm = u.arm AND h.customer_id = u.customer_id"""


MEANS = ("count(*) AS customers, count(*) FILTER (n_true > 0) AS buyers, coalesce(avg(ap), 0) AS map, coalesce(avg(ndcg), 0) AS ndcg, "
         "coalesce(avg(hit), 0) AS hit_rate, coalesce(avg(precision), 0) AS precision, coalesce(avg(recall), 0) AS recall, "
         "coalesce(avg(rr), 0) AS mrr")
cte("model_users", "SELECT 'model' AS arm, customer_id FROM scored_users")
cte("both_users", "SELECT arm, customer_id FROM scored_users, (VALUES ('model'), ('baseline')) a(arm)")
cte("both_buyers", "SELECT arm, customer_id FROM buyers, (VALUES ('model'), ('baseline')) a(arm)")
cte("per_user", per_user_sql("arms", "model_users"))
cte("per_user_arms", per_user_sql("arms", "both_users"))
cte("per_buyer_arms", per_user_sql("arms", "both_buyers"))
cte("per_person", per_user_sql("arms", "(SELECT 'model' AS arm, customer_id FROM people)"))
cte("per_true_user", per_user_sql("arms", "(SELECT DISTINCT 'model' AS arm, customer_id FROM truth)"))

REC = "customer_id:long article_id:long pos:int"
FIVE = "map:float ndcg:float hit_rate:float precision:float recall:float"


@query("score_top_k", REC, "SELECT * FROM recs")
def _(spark, d):
    return recommend.top_k(scored(retail_fold(spark, d)), K)


@query("score_top_k_lists", "customer_id:long items:str", """
SELECT customer_id, string_agg(CAST(article_id AS VARCHAR), ' ' ORDER BY pos) AS items FROM recs GROUP BY 1""")
def _(spark, d):
    lists = recommend.to_lists(recommend.top_k(scored(retail_fold(spark, d)), K))
    return lists.select("customer_id", F.concat_ws(" ", F.transform("items", lambda i: i.cast("string"))).alias("items"))


@query("score_in_python", "customer_id:long article_id:long score:float", "SELECT * FROM scores")
def _(spark, d):
    def predict(frame):
        ranks = frame[[f"{n}_rank" for n in ("repurchase", "itemcf", "product_code", "popularity")]].fillna(500)
        return frame["n_sources"] * 1000.0 - ranks.min(axis=1)

    columns = [*[f"{n}_rank" for n in NAMES], "n_sources"]
    return recommend.score_in_python(predict, candidates(retail_fold(spark, d)), columns)


cte("sampled", f"SELECT customer_id FROM (SELECT DISTINCT customer_id FROM cand) ORDER BY {_hash_sql(['customer_id'], 42)}, customer_id LIMIT 400")


@query("sample_customers", "customer_id:long", "SELECT * FROM sampled")
def _(spark, d):
    return recommend.sample_customers(candidates(retail_fold(spark, d)), 400)


@query("score_sampled_users", REC, "SELECT * FROM recs WHERE customer_id IN (SELECT customer_id FROM sampled)")
def _(spark, d):
    table = candidates(retail_fold(spark, d))
    return recommend.top_k(blended(table), K, recommend.evaluation_users(table, 400))



cte("own_lists", "SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY rank) AS pos FROM c_product_code")


@query("apply_backfill", REC, f"""
SELECT customer_id, article_id, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY late, place) AS pos FROM (
    SELECT customer_id, article_id, 0 AS late, pos AS place FROM own_lists
    UNION ALL SELECT p.customer_id, b.article_id, 1, b.rank FROM people p, best12 b
    WHERE NOT EXISTS (SELECT 1 FROM own_lists o WHERE o.customer_id = p.customer_id AND o.article_id = b.article_id)))
WHERE pos <= {K}""")
def _(spark, d):
    from shoprank.operators.retrieval import product_code

    f = retail_fold(spark, d)
    own = product_code(f, RETAIL.retrieval.product_code, RETAIL.retrieval.seed_weeks).withColumnRenamed("rank", "pos")
    return recommend.backfill(own, f.customers, recommend.popular_items(f, RETAIL.retrieval.popularity_weeks, K), K)


@query("recommend_with_backfill", REC, f"""
SELECT customer_id, article_id, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY late, place) AS pos FROM (
    SELECT customer_id, article_id, 0 AS late, pos AS place FROM recs
    UNION ALL SELECT p.customer_id, b.article_id, 1, b.rank FROM people p, best12 b
    WHERE NOT EXISTS (SELECT 1 FROM recs o WHERE o.customer_id = p.customer_id AND o.article_id = b.article_id)))
WHERE pos <= {K}""")
def _(spark, d):
    f = retail_fold(spark, d)
    return recommend.backfill(recommend.top_k(scored(f), K), f.customers, recommend.popular_items(f, RETAIL.retrieval.popularity_weeks, K), K)


@query("buyers_of", "customer_id:long", "SELECT * FROM buyers")
def _(spark, d):
    return scored_fold(spark, d)[1].buyers


@query("ground_truth", "customer_id:long article_id:long", "SELECT * FROM truth")
def _(spark, d):
    return recommend.ground_truth(retail_fold(spark, d).val)


@query("popular_items", "rank:int article_id:long", "SELECT * FROM best12")
def _(spark, d):
    return recommend.popular_items(retail_fold(spark, d), RETAIL.retrieval.popularity_weeks, K)


EVALUATION = "customers:long buyers:long " + FIVE + " map_buyers:float"


@query("evaluate", EVALUATION, f"SELECT {MEANS}, coalesce(avg(ap) FILTER (n_true > 0), 0) AS map_buyers FROM per_user")
def _(spark, d):
    _, s = scored_fold(spark, d)
    return recommend.evaluate(s.recs, s.truth, K)


@query("accuracy_metrics", FIVE, f"SELECT {MEANS} FROM per_person")
def _(spark, d):
    f, s = scored_fold(spark, d)
    return recommend.accuracy_metrics(s.recs, s.truth, K, f.customers)


def _compare_sql(source: str) -> str:
    return f"""SELECT metric, max(value) FILTER (arm = 'baseline') AS baseline, max(value) FILTER (arm = 'model') AS model,
  max(value) FILTER (arm = 'model') / nullif(max(value) FILTER (arm = 'baseline'), 0) AS lift
FROM (UNPIVOT (SELECT arm, {MEANS} FROM {source} GROUP BY 1) ON map, ndcg, hit_rate, precision, recall INTO NAME metric VALUE value)
GROUP BY 1"""


COMPARED = "metric:str baseline:float model:float lift:float"


@query("compare_to_baseline", COMPARED, _compare_sql("per_user_arms"))
def _(spark, d):
    _, s = scored_fold(spark, d)
    return recommend.compare_to_baseline(s.recs, s.truth, s.best, K)


cte("fold_recs", f"""SELECT fold AS arm, customer_id, article_id, row_number() OVER (
  PARTITION BY fold, customer_id ORDER BY count(*) DESC, article_id) AS pos
  FROM tx JOIN specs s ON t_dat <= s.train_end AND s.val_start IS NOT NULL GROUP BY 1, 2, 3 QUALIFY pos <= {K}""")
cte("fold_truth", """SELECT DISTINCT fold AS arm, customer_id, article_id FROM tx JOIN specs s ON t_dat BETWEEN s.val_start AND s.val_end""")


@query("metrics_table", "fold:str " + EVALUATION, f"""
SELECT arm AS fold, {MEANS}, coalesce(avg(ap) FILTER (n_true > 0), 0) AS map_buyers FROM ({
    ' UNION ALL '.join('SELECT * FROM (' + per_user_sql(
        f"(SELECT * FROM fold_recs WHERE arm = 'fold_{i}')", f"(SELECT DISTINCT arm, customer_id FROM fold_recs WHERE arm = 'fold_{i}')",
        f"(SELECT * FROM fold_truth WHERE arm = 'fold_{i}')") + ')' for i in range(RETAIL.periods.count))}) GROUP BY 1""")
def _(spark, d):
    from shoprank.operators.folds import fold_specs
    from shoprank.operators.shared import top_per_group

    open_end = fold_specs(RETAIL.periods.last_day, None, RETAIL.periods.held_out_weeks, RETAIL.periods.count, False)
    tx, day = stored_retail(spark, d), F.col("t_dat")
    pairs = tx.groupBy("customer_id", "article_id").agg(*[F.count_if(spec.in_train(day)).alias(spec.fold) for spec in open_end])
    each = F.explode(F.array(*[F.struct(F.lit(spec.fold).alias("fold"), F.col(spec.fold).alias("n")) for spec in open_end])).alias("e")
    counts = pairs.select("customer_id", "article_id", each).select("e.fold", "customer_id", "article_id", "e.n").filter("n > 0")
    recs = top_per_group(counts, ["fold", "customer_id"], [F.col("n").desc(), F.col("article_id")], K, "pos")
    return recommend.evaluate(recs, tag_folds(tx, open_end).filter("split = 'val'"), K, keys=["fold"])


def _register_metric(name: str, fn, column: str, source: str, out: str) -> None:
    @query(name, f"{out}:float", f"SELECT coalesce(avg({column}), 0) AS {out} FROM {source}")
    def _(spark, d):
        _, s = scored_fold(spark, d)
        return fn(s.recs, s.truth, K)


for _name, _fn, _column, _source, _out in (
        ("mapk", metrics.mapk, "ap", "per_user", "mapk"), ("ndcg_at_k", metrics.ndcg_at_k, "ndcg", "per_user", "ndcg"),
        ("precision_at_k", metrics.precision_at_k, "precision", "per_user", "precision"),
        ("recall_at_k", metrics.recall_at_k, "recall", "per_true_user", "recall"),
        ("mrr_at_k", metrics.mrr_at_k, "rr", "per_user", "mrr"),
        ("hit_rate_at_k", metrics.hit_rate_at_k, "hit", "per_user", "hit_rate")):
    _register_metric(_name, _fn, _column, _source, _out)


@query("apk", "customer_id:long ap:float ndcg:float rr:float n_true:long", "SELECT * FROM per_user")
def _(spark, d):
    _, s = scored_fold(spark, d)
    return metrics.user_scores(s.recs, s.truth, K)


@query("mean_over_users", "customers:long buyers:long " + FIVE + " mrr:float", f"SELECT {MEANS} FROM per_person")
def _(spark, d):
    f, s = scored_fold(spark, d)
    return metrics.mean_scores(metrics.user_scores(s.recs, s.truth, K, f.customers))


@query("hit_rate", "hit_rate:float", """
SELECT count(*) FILTER (EXISTS (SELECT 1 FROM cand c WHERE c.customer_id = t.customer_id AND c.article_id = t.article_id)) / count(*) AS hit_rate
FROM truth t""")
def _(spark, d):
    f = retail_fold(spark, d)
    return metrics.hit_rate(candidates(f), f.val)


@query("write_submission", "customer_id:str prediction:str", f"""
SELECT CAST(customer_id AS VARCHAR) AS customer_id, string_agg(CAST(article_id AS VARCHAR), ' ' ORDER BY pos) AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY late, place) AS pos FROM (
    SELECT customer_id, article_id, 0 AS late, pos AS place FROM recs
    UNION ALL SELECT p.customer_id, b.article_id, 1, b.rank FROM people p, best12 b
    WHERE NOT EXISTS (SELECT 1 FROM recs o WHERE o.customer_id = p.customer_id AND o.article_id = b.article_id)))
WHERE pos <= {K} GROUP BY 1""")
def _(spark, d):
    f = retail_fold(spark, d)
    padded = recommend.backfill(recommend.top_k(scored(f), K), f.customers, recommend.popular_items(f, RETAIL.retrieval.popularity_weeks, K), K)
    path = run_folder(spark)
    sinks.write_submission_csv(sinks.submission_rows(recommend.to_lists(padded)), path)
    return sinks.read_submission_csv(spark, path)


@query("validate_submission", "problem:str n:long", f"""
SELECT 'missing' AS problem, count(*) AS n FROM people WHERE customer_id NOT IN (SELECT customer_id FROM own_lists)
UNION ALL SELECT 'unexpected', count(DISTINCT customer_id) FROM own_lists WHERE customer_id NOT IN (SELECT customer_id FROM people)
UNION ALL SELECT 'wrong_length', count(*) FROM (SELECT customer_id FROM own_lists GROUP BY 1 HAVING count(*) <> {RETAIL.retrieval.product_code})""")
def _(spark, d):
    from shoprank.operators.retrieval import product_code

    f = retail_fold(spark, d)
    own = product_code(f, RETAIL.retrieval.product_code, RETAIL.retrieval.seed_weeks).withColumnRenamed("rank", "pos")
    expected = f.customers.select(F.col("customer_id").cast("string").alias("customer_id"))
    return sinks.submission_violations(sinks.submission_rows(recommend.to_lists(own)), expected, RETAIL.retrieval.product_code)


# --- diagnostics ---------------------------------------------------------------------------

def _found(n: str) -> str:
    return "true" if n == "UNION" else f"{n}_rank IS NOT NULL"


def _source_sql(coverage: bool) -> str:
    extra = ", 100.0 * count(DISTINCT customer_id) / (SELECT count(*) FROM people) AS customer_coverage_pct" if coverage else ""
    return " UNION ALL ".join(f"""SELECT '{n}' AS source, count(*) AS candidates, count(DISTINCT customer_id) AS customers,
  count(*) / count(DISTINCT customer_id) AS cands_per_customer, sum(label) AS hits,
  100.0 * sum(label) / (SELECT count(*) FROM truth) AS recall_pct{extra} FROM labelled WHERE {_found(n)}""" for n in (*NAMES, "UNION"))


SOURCE = "source:str candidates:long customers:long cands_per_customer:float hits:long recall_pct:float"


@query("per_source_report", SOURCE + " customer_coverage_pct:float", _source_sql(True))
def _(spark, d):
    f = retail_fold(spark, d)
    return diagnostics.per_source_report(candidates(f), f.val, customers=f.customers)


KS = (2, 5, 10, 20)


@query("rank_sweep", "source:str k:int hits:long recall_pct:float", " UNION ALL ".join(
    f"""SELECT '{n}' AS source, {k} AS k, count(*) FILTER ({n}_rank <= {k} AND label = 1) AS hits,
  100.0 * count(*) FILTER ({n}_rank <= {k} AND label = 1) / (SELECT count(*) FROM truth) AS recall_pct FROM labelled"""
    for n in NAMES for k in KS))
def _(spark, d):
    f = retail_fold(spark, d)
    return diagnostics.rank_sweep(candidates(f), f.val, KS)


CAPS = (10, 25, 40, None)
cte("placed_cand", "SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY n_sources DESC, article_id) AS place FROM labelled")


@query("cap_sweep", "cap:str rows:long cands_per_customer:float hits:long recall_pct:float", " UNION ALL ".join(
    f"""SELECT '{c or 'uncapped'}' AS cap, count(*) AS rows, count(*) / (SELECT count(DISTINCT customer_id) FROM cand) AS cands_per_customer,
  sum(label) AS hits, 100.0 * sum(label) / (SELECT count(*) FROM truth) AS recall_pct FROM placed_cand WHERE {f'place <= {c}' if c else 'true'}"""
    for c in CAPS))
def _(spark, d):
    f = retail_fold(spark, d)
    return diagnostics.cap_sweep(candidates(f), f.val, CAPS)


def fold_reports(spark, d, measure: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """`measure` of every fold's united sources and truth, both with a `fold` column; one small table of all folds.

    The log is stored once, neighbours of all folds come from one pass over it, and the folds run side by side. A fold is
    measured where its candidates are united by user, so they are neither written nor shuffled again.
    """
    log, specs = stored_retail(spark, d), retail_specs(submission=False)
    edges = written(window_neighbors(log, specs, RETAIL.retrieval.neighbors))

    def build(spec):
        f = retail_fold(spark, d, spec.fold_index, log)
        found = candidates(f, edges.filter(F.col("fold") == spec.fold).drop("fold"))
        return written(measure(found.withColumn("fold", F.lit(spec.fold)), f.val.withColumn("fold", F.lit(spec.fold))))

    return reduce(DataFrame.unionByName, side_by_side(build, specs))


FOLDS = range(RETAIL.periods.count)
cte("fold_labelled", " UNION ALL ".join(f"SELECT 'fold_{k}' AS fold, * FROM {of_fold('labelled', k)}" for k in FOLDS))
cte("fold_sizes", " UNION ALL ".join(f"SELECT 'fold_{k}' AS fold, count(*) AS n_truth FROM {of_fold('truth', k)}" for k in FOLDS))
cte("fold_report", " UNION ALL ".join(f"""SELECT fold, '{n}' AS source, count(*) AS candidates, count(DISTINCT customer_id) AS customers,
  count(*) / count(DISTINCT customer_id) AS cands_per_customer, sum(label) AS hits,
  100.0 * sum(label) / any_value(n_truth) AS recall_pct FROM fold_labelled JOIN fold_sizes USING (fold)
  WHERE {_found(n)} GROUP BY 1""" for n in (*NAMES, "UNION")))
cte("fold_ranks", " UNION ALL ".join(f"""SELECT fold, '{n}' AS source, {k} AS k, count(*) FILTER ({n}_rank <= {k} AND label = 1) AS hits,
  100.0 * count(*) FILTER ({n}_rank <= {k} AND label = 1) / any_value(n_truth) AS recall_pct FROM fold_labelled JOIN fold_sizes USING (fold) GROUP BY 1"""
    for n in NAMES for k in KS))
cte("fold_placed", "SELECT *, row_number() OVER (PARTITION BY fold, customer_id ORDER BY n_sources DESC, article_id) AS place FROM fold_labelled")
cte("fold_caps", " UNION ALL ".join(f"""SELECT fold, '{c or 'uncapped'}' AS cap, count(*) FILTER ({f'place <= {c}' if c else 'true'}) AS rows,
  count(*) FILTER ({f'place <= {c}' if c else 'true'}) / count(DISTINCT customer_id) AS cands_per_customer,
  100.0 * sum(label) FILTER ({f'place <= {c}' if c else 'true'}) / any_value(n_truth) AS recall_pct FROM fold_placed JOIN fold_sizes USING (fold) GROUP BY 1"""
    for c in CAPS))


def _spread(report: str, index: str, values: str) -> tuple[str, str]:
    """Columns and SQL of a report's mean and deviation over folds."""
    names = values.split()
    columns = index + " folds:long " + " ".join(f"{v}_mean:float {v}_sd:float" for v in names)
    keys = ", ".join(part.split(":")[0] for part in index.split())
    return columns, f"SELECT {keys}, count(*) AS folds, " + ", ".join(f"avg({v}) AS {v}_mean, stddev_samp({v}) AS {v}_sd" for v in names) + f" FROM {report} GROUP BY {keys}"


@query("neighbors_by_fold", "fold:str seed:long article_id:long cocount:long r:int", " UNION ALL ".join(
    f"SELECT 'fold_{k}' AS fold, * FROM {of_fold('neighbours', k)}" for k in FOLDS))
def _(spark, d):
    return window_neighbors(retail(spark, d), retail_specs(submission=False), RETAIL.retrieval.neighbors)


@query("across_folds_rank_sweep", *_spread("fold_ranks", "source:str k:int", "hits recall_pct"))
def _(spark, d):
    report = fold_reports(spark, d, partial(diagnostics.rank_sweep, ks=KS, keys=["fold"]))
    return diagnostics.across_folds(report, ["source", "k"], ["hits", "recall_pct"])


@query("across_folds_cap_sweep", *_spread("fold_caps", "cap:str", "rows cands_per_customer recall_pct"))
def _(spark, d):
    report = fold_reports(spark, d, partial(diagnostics.cap_sweep, caps=CAPS, keys=["fold"]))
    return diagnostics.across_folds(report, ["cap"], ["rows", "cands_per_customer", "recall_pct"])


@query("per_source_by_fold", "fold:str " + SOURCE, "SELECT * FROM fold_report")
def _(spark, d):
    return fold_reports(spark, d, partial(diagnostics.per_source_report, keys=["fold"]))


@query("across_folds", "source:str folds:long candidates_mean:float candidates_sd:float hits_mean:float hits_sd:float recall_pct_mean:float recall_pct_sd:float", """
SELECT source, count(*) AS folds, avg(candidates) AS candidates_mean, stddev_samp(candidates) AS candidates_sd, avg(hits) AS hits_mean,
  stddev_samp(hits) AS hits_sd, avg(recall_pct) AS recall_pct_mean, stddev_samp(recall_pct) AS recall_pct_sd FROM fold_report GROUP BY 1""")
def _(spark, d):
    report = fold_reports(spark, d, partial(diagnostics.per_source_report, keys=["fold"]))
    return diagnostics.across_folds(report, ["source"], ["candidates", "hits", "recall_pct"])


@query("fold_inputs_sampled", "customer_id:long article_id:long", "SELECT * FROM truth WHERE customer_id IN (SELECT customer_id FROM sampled)")
def _(spark, d):
    f = retail_fold(spark, d)
    return recommend.ground_truth(recommend.sampled_inputs(candidates(f), f.val, 400)[1])
