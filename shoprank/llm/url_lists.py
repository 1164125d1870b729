"""URL filters over time: list entries become validity intervals, captures are judged as of their fetch time.

Only built-in SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoprank.llm.common import free_names

#: host of a URL, without user and port
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: first part of the path
SECTION = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host_of(url: Column) -> Column:
    """Lower-cased host; empty where the URL names none."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def section_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SECTION, 1))


def keys_of(host: Column, section: Column) -> Column:
    """What an entry can name to cover a URL: the host, each parent domain, and host/section."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    domains = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, k, n), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.concat(domains, F.when(section == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(host, F.lit("/"), section)))))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, valid_from, valid_to) of dated entries (pattern, category, action, listed).

    `add` opens an interval that the pattern's next entry of the same category ends; without one it stays
    open (valid_to is null). Entries of one time: `remove` wins. Entries that lack pattern, action or time
    say nothing; a missing category counts as ''.
    """
    full = entries.where(F.col("pattern").isNotNull() & F.col("action").isNotNull() & F.col("listed").isNotNull()).select(
        F.lower("pattern").alias("pattern"), F.coalesce("category", F.lit("")).alias("category"), "action", "listed")
    one = full.groupBy("pattern", "category", "listed").agg(F.max((F.col("action") == "remove").cast("int")).alias("out"), F.max((F.col("action") == "add").cast("int")).alias("in_"))
    w = Window.partitionBy("pattern", "category").orderBy("listed")
    return one.withColumn("valid_to", F.lead("listed").over(w)).where("out = 0 and in_ = 1").select("pattern", "category", F.col("listed").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds `categories` (sorted, of all entries active at fetch time), `since` (start of the oldest of these
    intervals) and `blocked` to captures.

    captures: url, fetched and further columns (those three names are replaced); entries: see `intervals`.
    An interval holds its start and not its end. A capture without URL, host or fetch time is not blocked.
    Every row gives a row, repeated rows included.

    Captures of one host, section and time are judged once and the verdict is joined back on all three, so a
    host with a third of all captures is spread over its fetch times; hosts that no entry names fall out early.
    """
    own = free_names(captures, "__host", "__section", "__fetched")
    placed = captures.withColumns({own[0]: F.coalesce(host_of(F.col("url")), F.lit("")), own[1]: F.coalesce(section_of(F.col("url")), F.lit("")), own[2]: F.col("fetched")})
    asked = placed.where(f"{own[0]} <> '' and {own[2]} is not null").select(*own).distinct()
    named = asked.select(*own, F.explode(keys_of(F.col(own[0]), F.col(own[1]))).alias("pattern"))
    valid = intervals(entries)
    active = named.join(valid, "pattern").where((F.col(own[2]) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(own[2]) < F.col("valid_to"))))
    verdict = active.groupBy(*own).agg(F.sort_array(F.collect_set("category")).alias("categories"), F.min("valid_from").alias("since"))
    free = [c for c in captures.columns if c not in ("categories", "since", "blocked")]
    judged = placed.select(*free, *own).join(verdict, list(own), "left")
    return judged.select(*free, F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), "since", F.col("since").isNotNull().alias("blocked"))
