"""Items nearest to each user in a factor space, by blocks of items that are opened only while they can matter."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoprank.functions.session import written
from shoprank.operators.shared import ordered_ids

# Executors need no copy of this module on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: items of a block, users multiplied at a time, bytes of item factors that are out at the same time; results depend on none
BLOCK_ITEMS, USER_ROWS, OUT_BYTES = 2048, 1024, 128 << 20
#: a product may exceed its bound by rounding
SLACK = 1 + 1e-6

#: a block's largest norm, and what opens it: (ids, factors)
Box = tuple[float, Callable[[], tuple[np.ndarray, np.ndarray]]]


def best_of_boxes(x: np.ndarray, norm: np.ndarray, scores: np.ndarray, ids: np.ndarray, boxes: Sequence[Box], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists (scores, ids; best first, equal scores by id) after the boxes, which come by falling norm.

    No product exceeds the norms' product. A user whose n-th score lies above that for a box is done with it and all later
    ones; a box that no user of the batch needs stays closed.
    """
    scores, ids = scores.copy(), ids.copy()
    for top, opened in boxes:
        rows = np.flatnonzero(norm * top * SLACK >= scores[:, -1])
        if not len(rows):
            break
        names, factors = opened()
        found = x[rows] @ factors.T
        # only what reaches the list's end is ordered
        at, col = np.nonzero(found >= scores[rows, -1:])
        touched = np.unique(at)
        if not len(touched):
            continue
        inside = rows[touched]
        row = np.concatenate([np.repeat(touched, n), at])
        score, name = np.concatenate([scores[inside].ravel(), found[at, col]]), np.concatenate([ids[inside].ravel(), names[col]])
        order = np.lexsort((name, -score, row))
        first = np.searchsorted(row[order], touched)
        best = order[first[:, None] + np.arange(n)]
        scores[inside], ids[inside] = score[best], name[best]
    return scores, ids


def packed_blocks(placed: DataFrame, size: int) -> DataFrame:
    """`(b, ids, factors)`: the items of every block of `size` places as 4-byte numbers, packed by the tasks."""
    def pack(block: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"b": [int(block["place"].iloc[0]) // size], "ids": [block["id"].to_numpy(np.int32).tobytes()],
                             "factors": [np.stack(block["features"]).astype(np.float32).tobytes()]})

    return placed.select("id", "features", "place").groupBy(F.expr(f"place div {size}")).applyInPandas(pack, "b long, ids binary, factors binary")


def nearest_by_factors(users: DataFrame, items: DataFrame, n: int, size: int = BLOCK_ITEMS, out_bytes: int = OUT_BYTES) -> DataFrame:
    """`(_u, _i, score, rank)`: the n items with the largest product of factors for every user; equal scores are ordered by id.

    users, items: `id int, features array<float>`. Items are dealt into blocks by falling norm. Users are never shuffled: each
    task walks down the blocks and stops where the rest can't reach. At most `out_bytes` of item factors are broadcast at
    a time; if that doesn't hold the catalogue, lists are written and go on with the next blocks, for users still open.
    """
    squares = F.aggregate("features", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
    normed = items.select("id", "features", F.sqrt(squares).alias("norm"))
    placed = written(ordered_ids(normed, [F.col("norm").desc(), F.col("id")], "place"))
    context = users.sparkSession.sparkContext
    # one row per block of items
    tops = [r[1] for r in placed.groupBy(F.expr(f"place div {size}").alias("b")).agg(F.max("norm").alias("top")).orderBy("b").collect()]
    schema = "id int, features array<float>, scores array<double>, ids array<int>, open boolean"
    state = users.select("id", "features", F.array().cast("array<double>").alias("scores"), F.array().cast("array<int>").alias("ids"), F.lit(True).alias("open"))
    if not tops:
        return state.select(F.col("id").alias("_u"), F.col("id").alias("_i"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    width = max(1, len(placed.select("features").first()[0]))
    per = max(1, out_bytes // (4 * size * width))
    done = []
    for start in range(0, len(tops), per):
        group = tops[start : start + per]
        part = placed.filter(F.col("place").between(start * size, (start + per) * size - 1))
        # one block at a time, as the bytes that a task packed
        out = {r["b"]: context.broadcast((np.frombuffer(r["ids"], np.int32), np.frombuffer(r["factors"], np.float32).reshape(-1, width)))
               for r in packed_blocks(part, size).toLocalIterator()}
        boxes = [(top, out[start + k]) for k, top in enumerate(group)]
        rest = tops[start + per] if start + per < len(tops) else None

        def search(batches: Iterator[pd.DataFrame], boxes=boxes, rest=rest) -> Iterator[pd.DataFrame]:
            lazy = [(top, lambda box=box: box.value) for top, box in boxes]
            for batch in batches:
                for at in range(0, len(batch), USER_ROWS):
                    part = batch.iloc[at : at + USER_ROWS]
                    x = np.stack(part["features"]).astype(np.float64)
                    norm = np.sqrt((x**2).sum(axis=1))
                    scores, ids = np.full((len(part), n), -np.inf), np.full((len(part), n), np.iinfo(np.int32).max, np.int32)
                    for i, (s, names) in enumerate(zip(part["scores"], part["ids"], strict=True)):
                        scores[i, : len(s)], ids[i, : len(s)] = s, names
                    scores, ids = best_of_boxes(x, norm, scores, ids, lazy, n)
                    known = (scores > -np.inf).sum(axis=1)
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "features": list(part["features"]),
                                        "scores": [s[:k] for s, k in zip(scores, known)], "ids": [i[:k] for i, k in zip(ids, known)],
                                        "open": np.zeros(len(part), bool) if rest is None else norm * rest * SLACK >= scores[:, -1]})

        found = state.mapInPandas(search, schema)
        if rest is None:
            done.append(found)
            break
        found = written(found)
        for box in out.values():
            box.destroy()
        done.append(found.filter(~F.col("open")))
        state = found.filter("open")
        if state.isEmpty():
            break
    lists = done[0]
    for more in done[1:]:
        lists = lists.unionByName(more)
    return (lists.select(F.col("id").alias("_u"), F.posexplode(F.arrays_zip("ids", "scores")).alias("at", "e"))
                 .select("_u", F.col("e.ids").alias("_i"), F.col("e.scores").alias("score"), (F.col("at") + 1).alias("rank")))
