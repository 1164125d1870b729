"""Feature blocks, labels, cross features and the assembled table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registry import cte, query
from registry.candidates import FLAGGED, candidates
from registry.tables import RETAIL, retail, retail_fold, retail_specs
from shoprank.functions.session import written
from shoprank.operators import features, retrieval, transforms
from shoprank.operators.recommend import ground_truth
from shoprank.plans.features import feature_blocks, feature_table, with_pairs
from shoprank.schema import FoldInputs

S = RETAIL
W = 7 * S.features.active_weeks
ITEM_WINDOWS = " ".join(f"item_purchases_{w}w:long" for w in S.features.item_weeks)

cte("active", f"SELECT DISTINCT customer_id FROM history WHERE t_dat >= (SELECT d FROM cut) - {W}")
cte("behaviour", f"""SELECT h.*, a.customer_id IS NOT NULL AS act FROM history h LEFT JOIN active a USING (customer_id)
  WHERE a.customer_id IS NULL OR h.t_dat >= (SELECT d FROM cut) - {W}""")
cte("f_user", """SELECT customer_id, count(*) AS user_purchases, count(DISTINCT article_id) AS user_n_unique_items,
  date_diff('day', min(t_dat), (SELECT d FROM cut)) AS user_days_since_first,
  date_diff('day', max(t_dat), (SELECT d FROM cut)) AS user_days_since_last, avg(price) AS user_avg_price,
  stddev_samp(price) AS user_std_price, max(price) AS user_max_price, avg(sales_channel_id) AS user_avg_channel,
  CAST(bool_or(act) AS INTEGER) AS is_active FROM behaviour GROUP BY 1""")
cte("f_item", "SELECT article_id, " + ", ".join(
    f"count(*) FILTER (t_dat >= (SELECT d FROM cut) - {7 * w}) AS item_purchases_{w}w" for w in S.features.item_weeks)
    + """, count(*) AS item_purchases_all, count(DISTINCT customer_id) AS item_n_unique_buyers,
  date_diff('day', min(t_dat), (SELECT d FROM cut)) AS item_days_since_first_sale,
  date_diff('day', max(t_dat), (SELECT d FROM cut)) AS item_days_since_last_sale,
  avg(price) AS item_avg_price, max(price) AS item_max_price, count(*) / count(DISTINCT customer_id) AS item_repurchase_rate
  FROM train GROUP BY 1""")
for _key, _out in S.features.affinities:
    cte(f"f_{_out}", f"""SELECT customer_id, {_key}, count(*) AS user_{_out}_purchases
  FROM behaviour LEFT JOIN articles USING (article_id) GROUP BY 1, 2""")
cte("f_pair", """SELECT customer_id, article_id, count(*) AS user_item_purchases,
  date_diff('day', max(t_dat), (SELECT d FROM cut)) AS user_item_days_since_last FROM history GROUP BY 1, 2""")
cte("f_age", """SELECT article_id, avg(age) AS item_mean_buyer_age FROM history JOIN people USING (customer_id) GROUP BY 1""")


def _index_sql(column: str) -> str:
    return f"""(SELECT {column} AS v, row_number() OVER (ORDER BY n DESC, {column}) - 1 AS idx
  FROM (SELECT {column}, count(*) AS n FROM people WHERE {column} IS NOT NULL GROUP BY 1))"""


def _indexed(column: str, alias: str) -> str:
    return f"coalesce({alias}.idx, (SELECT count(DISTINCT {column}) FROM people))"


cte("f_customer", f"""SELECT customer_id, age, {_indexed('club_member_status', 'a')} AS club_member_status_idx,
  {_indexed('fashion_news_frequency', 'b')} AS fashion_news_frequency_idx
  FROM people LEFT JOIN {_index_sql('club_member_status')} a ON a.v = club_member_status
  LEFT JOIN {_index_sql('fashion_news_frequency')} b ON b.v = fashion_news_frequency""")
cte("f_article", "SELECT article_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in features.ARTICLE_CODES) + " FROM articles")
cte("f_cf", f"""SELECT s.customer_id, e.article_id, sum(e.cocount) AS itemcf_score, max(e.cocount) AS itemcf_max_score
  FROM (SELECT DISTINCT customer_id, article_id FROM train WHERE t_dat >= (SELECT d FROM cut) - {7 * S.retrieval.seed_weeks}) s
  JOIN neighbours e ON e.seed = s.article_id GROUP BY 1, 2""")
cte("joined", """SELECT l.*, u.* EXCLUDE (customer_id), i.* EXCLUDE (article_id), """
    + ", ".join(f"f_{o}.user_{o}_purchases" for _, o in S.features.affinities)
    + """, p.user_item_purchases, p.user_item_days_since_last, cf.itemcf_score, cf.itemcf_max_score, g.item_mean_buyer_age,
  k.* EXCLUDE (customer_id), m.* EXCLUDE (article_id)
  FROM labelled l LEFT JOIN articles x USING (article_id) LEFT JOIN f_user u USING (customer_id)
  LEFT JOIN f_item i USING (article_id) """
    + " ".join(f"LEFT JOIN f_{o} ON f_{o}.customer_id = l.customer_id AND f_{o}.{k} = x.{k}" for k, o in S.features.affinities)
    + """ LEFT JOIN f_pair p ON p.customer_id = l.customer_id AND p.article_id = l.article_id
  LEFT JOIN f_cf cf ON cf.customer_id = l.customer_id AND cf.article_id = l.article_id
  LEFT JOIN f_age g ON g.article_id = l.article_id LEFT JOIN f_customer k ON k.customer_id = l.customer_id
  LEFT JOIN f_article m ON m.article_id = l.article_id""")
cte("feats", """SELECT *, item_avg_price / (user_avg_price + 1e-6) AS price_ratio,
  user_dept_purchases / (user_purchases + 1e-6) AS user_dept_ratio, CAST(user_item_purchases > 0 AS INTEGER) AS bought_before,
  age - item_mean_buyer_age AS age_gap, user_item_purchases / (item_purchases_all + 1.0) AS user_item_ratio FROM joined""")

USER = ("customer_id:long user_purchases:long user_n_unique_items:long user_days_since_first:int user_days_since_last:int "
        "user_avg_price:float user_std_price:float user_max_price:float user_avg_channel:float is_active:int")
ITEM = ("article_id:long " + ITEM_WINDOWS + " item_purchases_all:long item_n_unique_buyers:long item_days_since_first_sale:int "
        "item_days_since_last_sale:int item_avg_price:float item_max_price:float item_repurchase_rate:float")
PAIR = "customer_id:long article_id:long user_item_purchases:long user_item_days_since_last:int"
CF = "customer_id:long article_id:long itemcf_score:long itemcf_max_score:long"
CUSTOMER = "customer_id:long age:float club_member_status_idx:float fashion_news_frequency_idx:float"
ARTICLE = "article_id:long " + " ".join(f"{c}:float" for c in features.ARTICLE_CODES)
RATIOS = "price_ratio:float user_dept_ratio:float bought_before:int age_gap:float user_item_ratio:float"


def _rest(text: str, drop: int) -> str:
    return " ".join(text.split()[drop:])


ALL = " ".join([FLAGGED, "label:int", _rest(USER, 1), _rest(ITEM, 1),
                " ".join(f"user_{o}_purchases:long" for _, o in S.features.affinities), _rest(PAIR, 2), _rest(CF, 2),
                "item_mean_buyer_age:float", _rest(CUSTOMER, 1), _rest(ARTICLE, 1), RATIOS])


def prepared(fold: FoldInputs) -> FoldInputs:
    """The fold with its pairs, neighbours and candidates written once."""
    if fold.candidates is not None:
        return fold
    fold = with_pairs(fold, S)
    edges = written(retrieval.copurchase_neighbors(fold, S.retrieval.neighbors))
    return replace(fold, edges=edges, candidates=written(candidates(fold, edges)))


def features_of(fold: FoldInputs, rows) -> DataFrame:
    """Features and labels of some candidates of a prepared fold."""
    blocks = [block for _, block in feature_blocks(fold, fold.edges, S, exact_distinct=True)]
    return feature_table(fold, rows, blocks, S)


def full_features(fold: FoldInputs) -> DataFrame:
    fold = prepared(fold)
    return features_of(fold, fold.candidates)


def drawn_features(fold: FoldInputs, draw) -> DataFrame:
    """`draw(full_features(fold))` for a `draw` that looks at keys and labels only.

    Rows are drawn among the labelled candidates and features are built for those alone. Articles or customers that are
    listed twice repeat rows of the feature table, which a draw by counts sees: there it is made from the whole table.
    """
    fold = prepared(fold)
    cols = fold.columns
    listed = [fold.articles.select(F.col(cols.item).alias("k")), fold.customers.select(F.col(cols.user).alias("k"))]
    if any(not table.filter("k IS NOT NULL").groupBy("k").count().filter("count > 1").isEmpty() for table in listed):
        return draw(features_of(fold, fold.candidates))
    drawn = draw(transforms.attach_labels(fold.candidates, fold.val, cols))
    return features_of(fold, written(drawn.drop("label")))


@query("user_aggregates", USER, "SELECT * FROM f_user")
def _(spark, d):
    return features.user_aggregates(retail_fold(spark, d), S.features.active_weeks, exact_distinct=True)[0]


@query("user_aggregates_sketch", USER)
def _(spark, d):
    return features.user_aggregates(retail_fold(spark, d), S.features.active_weeks)[0]


@query("user_aggregates_sketch_facts", "customers:long outside:long", "SELECT count(*) AS customers, 0 AS outside FROM f_user")
def _(spark, d):
    """Customers, and those whose estimated number of distinct items lies outside the sketch's stated error."""
    fold = retail_fold(spark, d)
    rough, exact = (features.user_aggregates(fold, S.features.active_weeks, e)[0].select("customer_id", F.col("user_n_unique_items").alias(n)) for n, e in (("rough", False), ("exact", True)))
    far = F.abs(F.col("rough") - F.col("exact")) > F.greatest(F.lit(0.5), features.SKETCH_ERROR * F.col("exact"))
    return exact.join(rough, "customer_id").agg(F.count("*").alias("customers"), F.count_if(far).alias("outside"))


# Distinct items over the windows of all folds from one table of sketches; held against exact counts.
_WINDOWS = {f"{spec.fold} {w}": (spec.train_end, w) for spec in retail_specs(submission=False) for w in S.features.item_weeks}


@query("windowed_distinct_items", "win:str customers:long outside:long", " UNION ALL ".join(
    f"SELECT '{name}' AS win, count(DISTINCT customer_id) AS customers, 0 AS outside FROM tx WHERE t_dat <= DATE '{end}' AND t_dat > DATE '{end}' - {7 * weeks}"
    for name, (end, weeks) in _WINDOWS.items()))
def _(spark, d):
    """Customers of each window, and those whose estimate lies outside the sketch's stated error (three deviations)."""
    tx = retail(spark, d)
    sketches = written(features.weekly_item_sketches(tx, RETAIL.periods.last_day))
    found = features.distinct_in_windows(sketches, _WINDOWS, RETAIL.periods.last_day)
    exact = [F.count_distinct(F.when((F.col("t_dat") <= F.lit(end)) & (F.col("t_dat") > F.date_sub(F.lit(end), 7 * w)), F.col("article_id"))).alias(name) for name, (end, w) in _WINDOWS.items()]
    long = tx.groupBy("customer_id").agg(*exact).select("customer_id", F.explode(F.array(*[F.struct(F.lit(n).alias("win"), F.col(f"`{n}`").alias("n")) for n in _WINDOWS])).alias("e")).select("customer_id", "e.*")
    both = long.filter("n > 0").join(found, ["customer_id", "win"], "left")
    far = F.col("items").isNull() | (F.abs(F.col("items") - F.col("n")) > F.greatest(F.lit(0.5), features.SKETCH_ERROR * F.col("n")))
    return both.groupBy("win").agg(F.count("*").alias("customers"), F.count_if(far).alias("outside"))


@query("item_aggregates", ITEM, "SELECT * FROM f_item")
def _(spark, d):
    return features.item_aggregates(retail_fold(spark, d), S.features.item_weeks)[0]


_TYPES = {"product_code": "str", "product_group_name": "str"}


def _register_affinity(key: str, out: str) -> None:
    @query(f"category_affinity_{out}", f"customer_id:long {key}:{_TYPES.get(key, 'int')} user_{out}_purchases:long", f"SELECT * FROM f_{out}")
    def _(spark, d):
        return features.category_affinity(retail_fold(spark, d), key, S.features.active_weeks, out)[0]


for _key, _out in S.features.affinities:
    _register_affinity(_key, _out)


@query("user_item_history", PAIR, "SELECT * FROM f_pair")
def _(spark, d):
    return features.user_item_history(retail_fold(spark, d))[0]


@query("item_buyer_demographic", "article_id:long item_mean_buyer_age:float", "SELECT * FROM f_age")
def _(spark, d):
    return features.item_buyer_demographic(retail_fold(spark, d))[0]


@query("customer_metadata", CUSTOMER, "SELECT * FROM f_customer")
def _(spark, d):
    return features.customer_metadata(retail_fold(spark, d))[0]


@query("postal_code_index", "customer_id:long postal_code_idx:float", f"""
SELECT customer_id, {_indexed('postal_code', 'a')} AS postal_code_idx
FROM people LEFT JOIN {_index_sql('postal_code')} a ON a.v = postal_code""")
def _(spark, d):
    return features.customer_metadata(retail_fold(spark, d), ["postal_code"])[0]


@query("article_metadata", ARTICLE, "SELECT * FROM f_article")
def _(spark, d):
    return features.article_metadata(retail_fold(spark, d))[0]


@query("itemcf_score", CF, "SELECT * FROM f_cf")
def _(spark, d):
    f = retail_fold(spark, d)
    return features.itemcf_score(f, retrieval.copurchase_neighbors(f, S.retrieval.neighbors), S.retrieval.seed_weeks)[0]


@query("attach_labels", FLAGGED + " label:int", "SELECT * FROM labelled")
def _(spark, d):
    f = retail_fold(spark, d)
    return transforms.attach_labels(candidates(f), ground_truth(f.val))


@query("derived_ratios", "customer_id:long article_id:long " + RATIOS, "SELECT * FROM feats")
def _(spark, d):
    return full_features(retail_fold(spark, d))


@query("build_features", ALL, "SELECT * FROM feats")
def _(spark, d):
    return full_features(retail_fold(spark, d))


MATRIX = [part.split(":")[0] for part in ALL.split() if part.split(":")[0] not in ("customer_id", "article_id", "label")]


@query("prepare_matrix", "customer_id:long article_id:long " + " ".join(f"{c}:float" for c in MATRIX),
       "SELECT customer_id, article_id, " + ", ".join(f"CAST(coalesce({c}, 0) AS FLOAT) AS {c}" for c in MATRIX) + " FROM feats")
def _(spark, d):
    from shoprank.operators.ranker import prepare_matrix

    return prepare_matrix(full_features(retail_fold(spark, d)), MATRIX)
