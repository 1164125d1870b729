"""Steps on the candidate table itself: labels, cross features and the block joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoprank.operators.features import Block
from shoprank.schema import Columns


def attach_labels(df: DataFrame, held_out: DataFrame | None, cols: Columns = Columns()) -> DataFrame:
    """`label` = 1 where the pair was bought in the held-out weeks; 0 everywhere without any."""
    if held_out is None:
        return df.withColumn("label", F.lit(0))
    positives = held_out.select(cols.user, cols.item).distinct().withColumn("label", F.lit(1))
    return df.join(positives, [cols.user, cols.item], "left").fillna({"label": 0})


def derived_ratios(df: DataFrame) -> DataFrame:
    """Cross features from columns already joined. Small constants keep divisors off zero."""
    return df.withColumns({
        "price_ratio": F.col("item_avg_price") / (F.col("user_avg_price") + F.lit(1e-6)),
        "user_dept_ratio": F.col("user_dept_purchases") / (F.col("user_purchases") + F.lit(1e-6)),
        "bought_before": (F.col("user_item_purchases") > 0).cast("int"),
        "age_gap": F.col("age") - F.col("item_mean_buyer_age"),
        "user_item_ratio": F.col("user_item_purchases") / (F.col("item_purchases_all") + F.lit(1.0)),
    })


def merge_blocks(blocks: Sequence[Block]) -> list[Block]:
    """Blocks with equal keys joined with each other first.

    The blocks are far smaller than the candidates, so every block folded into another one saves
    the candidate table a join.
    """
    merged: dict[tuple[str, ...], DataFrame] = {}
    for block, keys in blocks:
        at = tuple(keys)
        merged[at] = merged[at].join(block, list(keys), "full") if at in merged else block
    return [(block, list(at)) for at, block in merged.items()]


def assemble(candidates: DataFrame, article_keys: DataFrame, blocks: Sequence[Block],
             held_out: DataFrame | None, cols: Columns = Columns()) -> DataFrame:
    """Candidates with every block, labels and cross features.

    Item blocks are joined first, in one go; the joins on the user and on the user with a second
    key follow on a table laid out by user. The raw article attributes in `article_keys` serve as
    keys under a private name and leave again at the end.
    """
    keyed = {a: f"_key_{a}" for a in article_keys.columns if a != cols.item}
    renamed = article_keys.select(cols.item, *[F.col(a).alias(k) for a, k in keyed.items()])
    item_blocks, user_blocks = [(renamed, [cols.item])], []
    for block, keys in blocks:
        if keys == [cols.item]:
            item_blocks.append((block, keys))
        else:
            user_blocks.append((block.withColumnsRenamed({k: keyed[k] for k in keys if k in keyed}),
                                [keyed.get(k, k) for k in keys]))
    table = candidates
    for block, keys in merge_blocks(item_blocks) + merge_blocks(user_blocks):
        table = table.join(block, keys, "left")
    table = derived_ratios(attach_labels(table, held_out, cols))
    return table.drop(*keyed.values())
