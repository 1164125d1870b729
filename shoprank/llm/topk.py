"""Exact top-k by inner product: candidates by descending length, SVD-rotated partial sums, residual bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoprank.llm.common import Scratch

#: rows of a block of queries and of candidates; both bound what one task holds
QUERY_BLOCK, ROW_BLOCK = 512, 4096
#: rotated dimensions summed before the bound is tried
HEAD = 16


def integer_vectors(table: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v, norm2): floor(1024 x) of every component; vectors that are null, empty or hold null or non-finite components go."""
    x = F.col(column)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return table.where(F.col(id_column).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad).select(
        F.col(id_column).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * 1024).cast("long")).alias("v")).withColumn(
        "norm2", F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as one matrix; shorter vectors end in zeros."""
    sizes = np.asarray(column.value_lengths())
    out = np.zeros((len(sizes), dims), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors of all rows, from the dims x dims sum of products (added up over partitions)."""
    def run(batches):
        total = np.zeros((dims, dims))
        for b in batches:
            m = _matrix(b.column(0), dims).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(dims)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    add = vectors.select("v").mapInArrow(run, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    total = np.zeros((dims, dims))
    for r in add.collect():                                             # dims x dims numbers
        total[r["i"], r["j"]] = r["x"]
    values, basis = np.linalg.eigh(total)
    return basis[:, np.argsort(-values)]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    return np.lexsort((ids, -score))[:k]


def _search(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, x: np.ndarray, x_ids: np.ndarray, basis: np.ndarray, k: int):
    """(query, id, score) of candidates that may belong to a query's k best among these rows; the rows come by descending length."""
    qr, xr = q @ basis, x @ basis
    head = min(HEAD, q.shape[1])
    q_len, x_len = np.sqrt((qr**2).sum(1)), np.sqrt((xr**2).sum(1))
    q_rest, x_rest = np.sqrt((qr[:, head:] ** 2).sum(1)), np.sqrt((xr[:, head:] ** 2).sum(1))
    slack = 1e-9 * (q_len * (x_len.max() if len(x_len) else 0)) + 1e-6     # rounding of the rotated sums
    near = qr[:, :head] @ xr[:, :head].T
    near += np.outer(q_rest, x_rest)
    near += slack[:, None]
    for j in range(len(q)):
        alive = np.flatnonzero((near[j] >= floor[j]) & (x_ids != q_ids[j]))
        low, got_s, got_i, at, step = floor[j], np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 4 * k
        alive = alive[np.argsort(-near[j][alive], kind="stable")]           # tightest bounds first
        while at < len(alive) and near[j][alive[at]] >= low:
            part = alive[at : at + step]
            s, i = np.concatenate([got_s, x[part] @ q[j]]), np.concatenate([got_i, x_ids[part]])
            best = _best(s, i, k)
            got_s, got_i = s[best], i[best]
            if len(best) == k:
                low = max(low, got_s[-1])
            at += step
            step *= 2
        yield q_ids[j], got_i, got_s


def top_k(table: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", column: str = "embedding", query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """The k rows of `table` with the highest integer inner product, for every row of `queries`.

    Both tables: an id and an array column; further columns are not read. Returns query_id, rank (from 1),
    vec_id, score; ties go to the smaller vec_id, a row with the query's own id is no candidate, fewer rows
    give fewer ranks. Vectors that are null, empty or hold null or non-finite components take no part, nor do
    rows without an id; shorter vectors count as ending in zeros. Equal rows are ranked next to each other;
    a row that repeats id and vector counts once.

    Rows are cut into blocks by descending length. The first part (the longest rows) gives each query a score
    that its k-th best at least reaches; a query block meets a further block only if length x length of the block's
    first row can still reach it. Within a block, sums over the first rotated dimensions plus the
    Cauchy-Schwarz bound of the rest sort out candidates before whole products are taken.
    """
    spark, scratch = table.sparkSession, Scratch(table.sparkSession)
    rows = scratch.write(integer_vectors(table, id_column, column).distinct())
    asked = integer_vectors(queries, id_column, column).distinct()
    size = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = int(size[1] or 1)
    dims = max(dims, int(asked.agg(F.max(F.size("v"))).first()[0] or 1))
    n_blocks = max(1, -(-size[0] // row_block))
    basis = spark.sparkContext.broadcast(_rotation(rows, dims))

    def pack(df: DataFrame, n: int) -> DataFrame:
        """Blocks of rows by descending length, each one row of flat arrays."""
        def run(batches):
            held = []
            for b in batches:
                held.append(b)
                while sum(x.num_rows for x in held) >= n:
                    t = pa.Table.from_batches(held)
                    yield block(t.slice(0, n))
                    held = t.slice(n).to_batches()
            if sum(x.num_rows for x in held):
                yield block(pa.Table.from_batches(held))

        def block(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            m = _matrix(t["v"].chunk(0), dims)
            ids = np.asarray(t["id"].chunk(0))
            return pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((m.astype(float) ** 2).sum(1)).max())]), pa.array([ids.tobytes()]), pa.array([m.tobytes()])], ["longest", "ids", "m"])

        return df.mapInArrow(run, "longest double, ids binary, m binary")

    # part 0 holds the longest rows; a block's part and number say which rows it holds
    ordered = rows.repartitionByRange(n_blocks, F.desc("norm2"), "id").sortWithinPartitions(F.desc("norm2"), "id")
    blocks = scratch.write(pack(ordered, row_block).withColumn("part", F.spark_partition_id()).withColumn("block", F.monotonically_increasing_id()))
    last = blocks.agg(F.max("part")).first()[0]
    q_blocks = scratch.write(pack(asked, query_block).withColumn("q_block", F.monotonically_increasing_id()).select("q_block", F.col("longest").alias("q_longest"), F.col("ids").alias("q_ids"), F.col("m").alias("q")))

    def search(batches):
        for b in batches:
            for r in b.to_pylist():
                q_ids, x_ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q, x = (np.frombuffer(r[c], np.int64).reshape(-1, dims) for c in ("q", "m"))
                floor = np.frombuffer(r["floor"]) if r["floor"] else np.full(len(q_ids), -np.inf)
                found = list(_search(q, q_ids, floor, x, x_ids, basis.value, k))
                n = [len(i) for _, i, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(sum(n), r["q_block"])), pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate([i for _, i, _ in found] or [np.zeros(0, np.int64)])),
                                                  pa.array(np.concatenate([s for *_, s in found] or [np.zeros(0, np.int64)]))], ["q_block", "query_id", "vec_id", "score"])

    out = "q_block long, query_id long, vec_id long, score long"
    names = ["q_block", "q_ids", "q", "ids", "m", "floor"]
    none = F.lit(None).cast("binary")
    if last is None:                                                    # no candidate at all
        return _ranked(q_blocks.where("q_block < 0").select("q_block", "q_ids", "q", F.col("q_ids").alias("ids"), F.col("q").alias("m"), none.alias("floor")).mapInArrow(search, out), k)

    def meet(q: DataFrame, low: int, high: int, bound: str) -> DataFrame:
        """Pairs of query blocks and the row blocks of parts `low` to `high` that satisfy `bound`, joined on the part."""
        sizes = blocks.select("part", "block", "longest")
        return q.withColumn("part", F.explode(F.sequence(F.lit(low), F.lit(high)))).join(sizes, "part").where(bound).select("q_block", "block")

    pairs = meet(q_blocks.select("q_block"), 0, 0, "true")
    rows_of = blocks.select("block", "ids", "m")
    begun = scratch.write(pairs.join(q_blocks, "q_block").join(rows_of, "block").withColumn("floor", none).select(*names).mapInArrow(search, out))

    def floors(t: pa.Table) -> pa.Table:
        """One query block: its ids in order with the k-th best score so far (minus infinity while there are fewer)."""
        q_ids = np.frombuffer(t["q_ids"][0].as_py(), np.int64)
        low = {}
        found = t.filter(t["vec_id"].is_valid())
        for q, s in zip(found["query_id"].to_pylist(), found["score"].to_pylist(), strict=True):
            low.setdefault(q, []).append(s)
        f = np.array([sorted(low[q])[-k] if len(low.get(q, ())) >= k else -np.inf for q in q_ids.tolist()], float)
        return pa.table({"q_block": [t["q_block"][0].as_py()], "floor": [f.tobytes()], "q_floor": [float((f).min()) if len(f) else 0.0]})

    known = q_blocks.select("q_block", "q_ids").join(begun, "q_block", "left").groupBy("q_block").applyInArrow(floors, "q_block long, floor binary, q_floor double")
    known = scratch.write(known)
    if last == 0:
        return _ranked(begun, k)
    wanted = q_blocks.select("q_block", "q_longest").join(known.select("q_block", "q_floor"), "q_block")
    pairs = meet(wanted, 1, last, "q_longest * longest * (1 + 1e-9) + 1e-6 >= q_floor")
    rest = pairs.join(q_blocks, "q_block").join(known.select("q_block", "floor"), "q_block").join(rows_of, "block").select(*names).mapInArrow(search, out)
    return _ranked(begun.unionByName(rest), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """k best of each query, by aggregation in the tasks and then per query."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
