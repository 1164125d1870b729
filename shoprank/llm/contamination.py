"""Benchmark decontamination: suffix arrays over shards of the corpus, searched for every benchmark suffix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoprank.llm.common import LETTER_WORDS, Scratch, packed, schema_of, slices, unpacked, windows, word_hashes

N_WORDS = 10
#: benchmark windows searched in one pass over the corpus (bounds what every task holds to some 24 MB)
PASS_WINDOWS = 1_000_000
#: bytes of text in one suffix array (bounds a task's memory; the matches do not depend on it)
SHARD_BYTES = 4_000_000


def benchmark_windows(bench: DataFrame, n: int = N_WORDS) -> DataFrame:
    """(item_id, at, size, finger): every window of every item; an item of fewer words is one window."""
    def run(batches):
        for batch in batches:
            out = ([], [], [], [])
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = word_hashes(text, LETTER_WORDS)
                size = min(n, len(words))
                if size:
                    f = windows(words, size).view(np.int64)
                    for column, values in zip(out, ([item] * len(f), range(len(f)), [size] * len(f), f.tolist()), strict=True):
                        column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *[pa.array(x, pa.int64()) for x in out[1:]]], ["item_id", "at", "size", "finger"])

    rows = bench.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "item_id string, at long, size long, finger long")


class SuffixArray:
    """Word suffixes of a shard of texts, sorted by their first `n` words (by the fingerprint of these words).

    Any fixed order of the n-word prefixes serves a binary search for equal ones. Suffixes do not run over
    the end of a text.
    """

    def __init__(self, texts: list[np.ndarray], n: int):
        count = np.array([max(0, len(w) - n + 1) for w in texts])
        keys = np.concatenate([windows(w, n) for w in texts] or [np.zeros(0, np.uint64)])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.text = np.repeat(np.arange(len(texts)), count)
        self.at = np.arange(len(keys)) - np.repeat(np.cumsum(count) - count, count)

    def search(self, fingers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into fingers, text, word position) of every suffix that begins with a searched window."""
        low, high = np.searchsorted(self.keys, fingers, "left"), np.searchsorted(self.keys, fingers, "right")
        size = high - low
        which = np.repeat(np.arange(len(fingers)), size)
        at = self.order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)]
        return which, self.text[at], self.at[at]


def shard_hits(texts: list[str], by_size: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, list[tuple]]]:
    """Number of words and matches (word position, window length, item) of each text; by_size: fingers and their items, by window length."""
    words = [word_hashes(t, LETTER_WORDS) for t in texts]
    found: dict[int, list] = {}
    for size, (fingers, items) in by_size.items():
        which, text, at = SuffixArray(words, size).search(fingers)
        for w, t, a in zip(which.tolist(), text.tolist(), at.tolist(), strict=True):
            found.setdefault(t, []).append((a, size, items[w]))
    for k, w in enumerate(words):
        yield len(w), found.get(k, [])


def find_matches(docs: DataFrame, bench: DataFrame, columns: list[str] | None = None, n: int = N_WORDS, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """Where benchmark windows occur in the documents.

    docs: doc_id, text; bench: item_id, text; further columns are not read. Returns `columns` (doc_id), n_words, n_hit
    (words inside any occurrence), item_ids (sorted as strings, without repeats), spans (maximal runs of hit
    words: start, end), longest (words of the longest run) and contaminated. Every document row gives
    a row, repeated rows and missing ids included; null and empty texts have no words. Items without words
    occur nowhere; an item without an id counts for hits but is not listed. An empty benchmark finds nothing.

    A task builds the suffix array of each of its shards and searches all benchmark windows by bisection, so
    documents are not shuffled. A benchmark of more than `pass_windows` windows is searched in as many passes
    as it takes, each of which adds to what the ones before have found.
    """
    columns, scratch = columns or ["doc_id"], Scratch(docs.sparkSession)
    fingers = scratch.write(benchmark_windows(bench, n))
    passes = max(1, -(-fingers.count() // pass_windows))
    rows = docs.select(*columns, F.coalesce("text", F.lit("")).alias("__text"))
    for k in range(passes):
        rows = _pass(rows, columns, fingers.where(F.pmod(F.xxhash64("finger"), F.lit(passes)) == k), first=k == 0, last=k == passes - 1)
        rows = rows if k == passes - 1 else scratch.write(rows)
    size = F.expr("transform(spans, s -> s.end - s.start)")
    n_hit = F.aggregate(size, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return rows.select(*columns, "n_words", n_hit.alias("n_hit"), "item_ids", "spans", F.coalesce(F.array_max(size), F.lit(0)).cast("long").alias("longest"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Documents in which no benchmark window occurs; columns and kept rows stay as they are."""
    return unpacked(find_matches(packed(docs), bench, ["row", "text"]).where(~F.col("contaminated")), docs.columns)


def _runs(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unites overlapping and touching (start, end)."""
    out: list[list[int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _pass(rows: DataFrame, columns: list[str], fingers: DataFrame, first: bool, last: bool) -> DataFrame:
    """One search of all documents for windows that a task can hold."""
    held = fingers.select("size", "finger", "item_id").toPandas()      # at most about PASS_WINDOWS rows
    by_size = {int(s): (g["finger"].to_numpy(np.int64).view(np.uint64), g["item_id"].tolist()) for s, g in held.groupby("size")}
    box = rows.sparkSession.sparkContext.broadcast(by_size)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    n = len(columns)
    kept = columns if last else [*columns, "__text"]

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, n, SHARD_BYTES)):
            out: list[tuple] = []
            before = [None] * batch.num_rows if first else list(zip(batch.column("spans").to_pylist(), batch.column("item_ids").to_pylist(), strict=True))
            for (n_words, found), old in zip(shard_hits(batch.column(n).to_pylist(), box.value), before, strict=True):
                runs = _runs([(a, a + s) for a, s, _ in found] + [(s["start"], s["end"]) for s in (old[0] if old else [])])
                items = {i for *_, i in found if i is not None} | set(old[1] if old else [])
                out.append((n_words, [{"start": a, "end": b} for a, b in runs], sorted(items)))
            counts, covered, items = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(kept))], pa.array(counts, pa.int64()), pa.array(covered, spans), pa.array(items, pa.list_(pa.string()))],
                                             [*kept, "n_words", "spans", "item_ids"])

    return rows.mapInArrow(run, schema_of(rows.select(*kept), "n_words long, spans array<struct<start: long, end: long>>, item_ids array<string>"))
