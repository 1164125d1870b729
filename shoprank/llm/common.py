"""Helpers shared by the operators: input columns, vectorised word hashing, tables in the shared folder."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shoprank.functions.session import ensure_checkpoint_dir

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: words between the ASCII blanks \x20 and \x09-\x0D
BLANK_WORDS = np.ones(256, bool)
BLANK_WORDS[[32, *range(9, 14)]] = False
#: words of digits, letters and everything beyond ASCII, after lower-casing
LETTER_WORDS = np.zeros(256, bool)
LETTER_WORDS[48:58] = LETTER_WORDS[97:123] = LETTER_WORDS[128:] = True

_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
#: odd multipliers, one per word of a shingle
ODD = np.random.default_rng(2024).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    h = h ^ (h >> _S)
    h *= _M1
    h ^= h >> _S
    h *= _M2
    h ^= h >> _S
    return h


def word_spans(text: str, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased UTF-8 bytes of `text` (eight zero bytes behind them) with start and end of every word."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.zeros(len(raw) + 8, np.uint8)
    data[:-8] = LOWER[np.frombuffer(raw, np.uint8)]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = keep[data[:-8]]
    step = np.diff(inside)
    return data, np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(text: str, keep: np.ndarray = BLANK_WORDS) -> np.ndarray:
    """A 64-bit hash of every word of the lower-cased text, in order."""
    data, start, end = word_spans(text, keep)
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    size = end - start
    h = mix((eight[start] & _MASK[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * ODD[40]))
    rest, at = np.flatnonzero(size > 8), 8
    while len(rest):
        h[rest] = mix(h[rest] * ODD[41] + (eight[start[rest] + at] & _MASK[np.minimum(size[rest] - at, 8)]))
        at += 8
        rest = rest[size[rest] > at]
    return h


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of `n` words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * ODD[k]
    return mix(total)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Distinct n-word shingles of the text, sorted; with fewer words the whole sequence is the only one."""
    words = word_hashes(text or "")
    return np.unique(windows(words, min(n, len(words)))) if len(words) else words


def id_bucket(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a missing id counts as bucket 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n, F.lit(0))


def schema_of(df: DataFrame, more: str) -> StructType:
    """Columns of `df` and those of a DDL text behind them."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores behind it as it takes to be no column of `df`."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def packed(docs: DataFrame) -> DataFrame:
    """Text, doc_id and lang of every row with all its columns but the text in the struct `row`, so that no added name clashes."""
    names = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    beside = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("doc_id", "lang", "text")]
    return docs.select(F.struct(*names).alias("row"), *beside)


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that `packed` was given, in their order."""
    return rows.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns])


def per_text(docs: DataFrame, columns: list[str], fn: Callable[[str], tuple], schema: str) -> DataFrame:
    """`columns` of every row with what `fn` returns for its whole text (null counts as empty)."""
    kept = docs.select(*columns, F.coalesce("text", F.lit("")).alias("text"))
    full = schema_of(kept.select(*columns), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(full)
        for batch in (part for whole in batches for part in slices(whole, len(columns))):
            rows = list(zip(*[fn(x) for x in batch.column(len(columns)).to_pylist()], strict=True))
            new = [pa.array(v, target.field(len(columns) + k).type) for k, v in enumerate(rows)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).cast(target.field(k).type) for k in range(len(columns))], *new], schema=target)

    return kept.mapInArrow(run, full)


def slices(batch: pa.RecordBatch, texts: int, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `size` bytes of text (column number `texts`) each, so that arrays made from them stay small."""
    if not batch.num_rows:
        return
    bytes_ = np.nan_to_num(np.asarray(pc.binary_length(batch.column(texts)).fill_null(0)))
    part = np.cumsum(bytes_) // size
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cut, cut[1:]):
        yield batch.slice(a, b - a)


class Scratch:
    """Tables of one run below the shared checkpoint folder; `drop` removes those no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.made = spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.at}/{self.made}"
        df.write.parquet(path)
        self.collect_garbage()
        table = self.spark.read.schema(df.schema).parquet(path)
        table.scratch_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def collect_garbage(self) -> None:
        """Lets Spark remove the shuffle files of finished steps now."""
        gc.collect()
        self.spark._jvm.System.gc()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links (a, b); comp is the smallest node that can be reached.

    Large-star and small-star rounds: links move to smaller nodes until every node points to its smallest.
    A round's links are a written table, so its lineage is one read.
    """
    links = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = scratch.write(small)
        stat = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(links)
        links = after
        if stat == before:
            break
        before = stat
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
