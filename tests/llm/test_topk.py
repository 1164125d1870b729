import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoprank.llm import topk


def brute(rows, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    ints = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in good]
    out = []
    for i, q in ints:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ints if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit(1) for c in ("id", "v", "norm2", "block", "rank", "score")})


def search(spark, rows, k, **blocks):
    df = table(spark, rows)
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), k, **blocks)
    return sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("query_block, row_block", [(512, 4096), (3, 40)])
def test_equals_all_products(spark, query_block, row_block):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 5])).tolist()) for i in range(900)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)]                   # ties
    rows += [(2000, [0.0] * 8), (2001, [0.0] * 8), (2100, [-1.0] * 8), rows[3], (2200, [1.0, 2.0])]
    rows += [(3000, None), (3001, []), (3002, [1.0, None] + [0.0] * 6), (3100, [float("nan")] * 8), (3003, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    assert search(spark, rows, 10, query_block=query_block, row_block=row_block) == brute(rows, 10)


@pytest.mark.parametrize("rows", [[], [(100, None)], [(100, [1.0])], [(100, [1.0]), (101, [2.0]), (102, None)], [(1, [1.0])]])
def test_few_rows(spark, rows):
    assert search(spark, rows, 10) == brute(rows, 10)


def test_no_cross_join(spark):
    df = table(spark, [(i, [float(i), 1.0]) for i in range(300)])
    plan = topk.top_k(df, df.where("vec_id % 100 = 0"), 3, row_block=50)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
