"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper age limits (exclusive) and their labels.
AGE_BANDS = ((25, "youth"), (35, "young_adult"), (45, "adult"), (55, "middle"))
OLDEST_BAND, NO_AGE = "senior", "unknown"

# Days since the last purchase (inclusive upper limits) and their labels.
BUSINESS_RECENCY = ((28, "active (<=4w)"), (84, "lapsed (4-12w)"))
BUSINESS_RECENCY_REST, NO_HISTORY = "dormant (>12w)", "cold (no history)"
EXPLORE_RECENCY = ((28, "1_active"), (84, "2_lapsed"), (365, "3_inactive"))
EXPLORE_RECENCY_REST = "4_gone"

# Price tiers, cheapest first.
PRICE_TIERS = ("budget", "mid", "premium")


def weeks_before(end: date, weeks: int) -> Column:
    """The date `weeks` before `end`, as a literal so that it reaches the scan."""
    return F.lit(end - timedelta(weeks=weeks))


def days_between(end, start: Column) -> Column:
    return F.datediff(F.lit(end), start)


def week_of(column: str | Column) -> Column:
    """Monday of the calendar week."""
    return F.date_trunc("week", column).cast("date")


def age_band(age: Column) -> Column:
    steps = None
    for limit, label in AGE_BANDS:
        steps = F.when(age < limit, label) if steps is None else steps.when(age < limit, label)
    return steps.when(age.isNotNull(), OLDEST_BAND).otherwise(NO_AGE)


def recency_band(days: Column, limits, rest: str) -> Column:
    steps = F
    for limit, label in limits:
        steps = steps.when(days <= limit, label)
    return steps.otherwise(rest)


def price_tier(price: Column, low: Column | float, high: Column | float) -> Column:
    """Tier of a price given the two cut points; a missing price is in the last tier."""
    return (F.when(price <= low, PRICE_TIERS[0])
             .when(price <= high, PRICE_TIERS[1])
             .otherwise(PRICE_TIERS[2]))


def log2_bucket(count: Column) -> Column:
    return F.floor(F.log2(count)).cast("int")


def log2_label(bucket: Column) -> Column:
    low = F.pow(F.lit(2), bucket).cast("bigint")
    high = F.pow(F.lit(2), bucket + 1).cast("bigint") - 1
    return F.concat_ws(" - ", low.cast("string"), high.cast("string"))


def unit_hash(*parts: str | Column, seed: int) -> Column:
    """Uniform value in [0, 1) that depends on the row and the seed only.

    Unlike `sample`/`randomSplit` the outcome does not move with the partitioning, so a retried
    task picks the same rows.
    """
    texts = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    digest = F.md5(F.concat_ws("|", *[F.coalesce(t, F.lit("")) for t in texts], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))
