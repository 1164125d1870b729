"""Registered queries of the subpackage, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoprank.llm import (contamination, infill, language_model, languages, merkle, ngram_join, oracles, pieces, pii, quality, repeats,
                          topk, tree_bpe, url_lists)
from shoprank.llm.common import id_bucket

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = dict(oracles.SQL)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """Place of the public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_model() -> str:
    """Place of the public byte-level vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def hex_of(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


@query
def op4_pii(spark, d):
    """Personal data in every document, with the digest of the base spans."""
    docs = pii.find_spans(table(spark, d, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return docs.select("doc_id", *map(count, pii.BASE_KINDS), hex_of(pii.digest(base)).alias("base_sha256"), pii.digest(F.col("pii")).alias("spans"))


@query
def op7_pieces(spark, d):
    """Ids and decoded text of every document."""
    return pieces.encode_texts(table(spark, d, "documents"), piece_model())


@query
def op9_contamination(spark, d):
    """Benchmark windows in every document."""
    found = contamination.find_matches(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), hex_of(F.array_join("item_ids", ",")).alias("items_sha256"), "contaminated")


@query
def op10_topk(spark, d):
    """The ten best rows for every hundredth vector."""
    rows = table(spark, d, "embeddings")
    return topk.top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


@query
def op1_ngram_join(spark, d):
    """Near-duplicate groups of all documents."""
    return ngram_join.near_duplicates(table(spark, d, "documents")).drop("class_id")


@query
def op2_language(spark, d):
    """Language of all documents."""
    return languages.identify(table(spark, d, "documents"), piece_model())


@query
def op3_quality(spark, d):
    """Quality of all documents."""
    return quality.score_quality(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op5_repeats(spark, d):
    """Bytes of all documents that lie in repeated strings."""
    return repeats.remove_repeats(table(spark, d, "documents")).drop("spans")


@query
def op8_language_model(spark, d):
    """Language-model score of all documents."""
    return language_model.score_texts(table(spark, d, "documents"))


@query
def op11_merkle(spark, d):
    """Manifest of all documents, and what a changed third of them folds to along the original paths."""
    docs = table(spark, d, "documents")
    fields = [F.translate("text", oracles.U, oracles.L) if f == "text" else F.col(f) for f in merkle.FIELDS]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf_digest(*fields))
    proofs = merkle.manifest(docs.withColumn("changed", changed), keep=["doc_id", "changed"])
    folded = merkle.fold(F.coalesce("row.changed", "leaf"), F.col("path"))
    out = proofs.select("row.doc_id", "leaf", "subroot", "root", hex_of(merkle.siblings(F.col("path"))).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op12_infill(spark, d):
    """Every document with its middle last, and the text rebuilt from that."""
    return infill.fill_in_middle(table(spark, d, "documents"))


@query
def op13_tree_bpe(spark, d):
    """Byte-level ids and decoded text of every document."""
    return tree_bpe.encode_texts(table(spark, d, "documents"), byte_model())


# The tables hold neither fetch times nor lists, so both follow from the pages: fetch days are spread over a year, and
# hosts, their parent domains and sections seen in the pages are listed, removed and listed again on days of their own.
@query
def op6_url_lists(spark, d):
    """Every page against the list entries active on its fetch day."""
    pages = table(spark, d, "pages").select("page_id", "url", F.expr("cast((page_id * 37) % 366 as int)").alias("fetched"))
    seen = pages.select(url_lists.host_of(F.col("url")).alias("host"), url_lists.section_of(F.col("url")).alias("section")).where("host <> ''").distinct()
    names = seen.select(F.explode(F.array(F.col("host"), F.regexp_replace("host", "^[^.]*[.]", ""), F.when(F.col("section") != "", F.concat_ws("/", "host", "section")))).alias("pattern"))
    u = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("long") / F.lit(16777216.0)
    patterns = names.where("pattern is not null").distinct().withColumn("u", u).withColumns({
        "day": F.floor(F.col("u") * 400).cast("int"), "turn": F.floor(F.col("u") * 1000).cast("int"), "ads": F.col("pattern").like("%ads%")})
    category = F.when(F.col("ads"), "ads").when(F.col("u") < 0.2, "spam").otherwise("adult")
    steps = F.array(F.struct(F.lit("add").alias("action"), F.col("day").alias("listed"), (F.col("ads") | (F.col("u") < 0.4)).alias("on")),
                    F.struct(F.lit("remove").alias("action"), (F.col("day") + 60).alias("listed"), ((F.col("u") < 0.4) & (F.col("turn") % 2 == 0)).alias("on")),
                    F.struct(F.lit("add").alias("action"), (F.col("day") + 120).alias("listed"), ((F.col("u") < 0.4) & (F.col("turn") % 4 == 0)).alias("on")))
    entries = patterns.select("pattern", category.alias("category"), F.explode(steps).alias("e")).where("e.on").select("pattern", "category", "e.action", "e.listed")
    out = url_lists.judge(pages, entries)
    return out.select("page_id", "fetched", F.array_join("categories", ",").alias("categories"), "since", "blocked")


ORACLES["op6_url_lists"] = """
WITH captures AS (SELECT page_id, CAST((page_id * 37) % 366 AS INTEGER) AS fetched,
    lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '')) AS host,
    lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1), '')) AS section FROM pages),
hosts AS (SELECT DISTINCT host, section FROM captures WHERE host <> ''),
names AS (SELECT host AS pattern FROM hosts UNION SELECT regexp_replace(host, '^[^.]*[.]', '') FROM hosts
    UNION SELECT host || '/' || section FROM hosts WHERE section <> ''),
numbered AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 6) AS BIGINT) / 16777216.0 AS u FROM names),
patterns AS (SELECT pattern, u, CAST(floor(u * 400) AS INTEGER) AS day, CAST(floor(u * 1000) AS INTEGER) AS turn, pattern LIKE '%ads%' AS ads FROM numbered),
entries AS (SELECT pattern, day AS listed, 'add' AS action FROM patterns WHERE ads OR u < 0.4
    UNION ALL SELECT pattern, day + 60, 'remove' FROM patterns WHERE u < 0.4 AND turn % 2 = 0
    UNION ALL SELECT pattern, day + 120, 'add' FROM patterns WHERE u < 0.4 AND turn % 4 = 0),
valid AS (SELECT pattern, action, listed AS valid_from, lead(listed) OVER (PARTITION BY pattern ORDER BY listed) AS valid_to FROM entries),
listed AS (SELECT v.pattern, CASE WHEN p.ads THEN 'ads' WHEN p.u < 0.2 THEN 'spam' ELSE 'adult' END AS category, v.valid_from, v.valid_to
    FROM valid v JOIN patterns p USING (pattern) WHERE v.action = 'add'),
covers AS (SELECT host, section, host AS pattern FROM hosts
    UNION SELECT host, section, array_to_string(list_slice(string_split(host, '.'), k, 99), '.') FROM hosts, range(2, 12) r(k) WHERE k <= len(string_split(host, '.'))
    UNION SELECT host, section, host || '/' || section FROM hosts WHERE section <> ''),
hits AS (SELECT c.page_id, string_agg(DISTINCT l.category, ',' ORDER BY l.category) AS categories, min(l.valid_from) AS since
    FROM captures c JOIN covers k ON c.host = k.host AND c.section = k.section JOIN listed l ON l.pattern = k.pattern
    WHERE c.fetched >= l.valid_from AND (l.valid_to IS NULL OR c.fetched < l.valid_to) GROUP BY 1)
SELECT c.page_id, c.fetched, coalesce(h.categories, '') AS categories, h.since, h.since IS NOT NULL AS blocked
FROM captures c LEFT JOIN hits h USING (page_id)"""
