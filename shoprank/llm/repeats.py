"""Removal of long byte strings that occur more than once in the corpus, after a suffix-array scheme."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoprank.llm.common import ODD, Scratch, mix, slices

#: shortest repeated string, first length compared (a power of two below it), offsets in one block
SIZE, GRAM, BLOCK = 400, 64, 16
_BYTE = np.random.default_rng(99).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACE = np.uint64((1 << 28) - 1)


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; the longest tables made so far are kept."""
    def table(b):
        x = np.full(n, b)
        x[0] = 1
        return np.cumprod(x, dtype=np.uint64)

    if not _TABLES or len(_TABLES[0][0]) < n:
        _TABLES[:] = [(table(_BASE), table(_INVERSE))]
    return _TABLES[0]


class Fingers:
    """Fingerprints of all substrings of one text: equal strings, equal fingerprints. They stand for suffix ranks,
    of which only equality is used."""

    def __init__(self, raw: bytes):
        self.n = len(raw)
        up, self.down = _powers(1 << max(12, (self.n + 1).bit_length()))
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_BYTE[np.frombuffer(raw, np.uint8)] * up[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray, *more: np.ndarray) -> np.ndarray:
        """Fingerprints of [start, end), mixed with further numbers."""
        h = mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * ODD[60])
        for k, x in enumerate(more):
            h = mix(h + x.astype(np.uint64) * ODD[61 + k])
        return h


def anchors(f: Fingers, size: int = SIZE) -> tuple[np.ndarray, ...]:
    """(place, first start, last start, gram) of the sampled positions of a text.

    Each string of `size` bytes is represented by its position with the least gram fingerprint (the leftmost
    of equal ones), which depends on the string alone, so equal strings have it at the same distance.
    """
    if f.n < size:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    gram = f.of(np.arange(f.n - GRAM + 1), np.arange(GRAM, f.n + 1))
    w, n = size - GRAM + 1, len(gram)
    value = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    value[:n] = (gram & ~_PLACE) | np.arange(n, dtype=np.uint64)
    grid = value.reshape(-1, w)
    left = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    right = np.minimum.accumulate(grid, 1).ravel()
    at = (np.minimum(left[: n - w + 1], right[w - 1 : n]) & _PLACE).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    last = np.append(first[1:] - 1, len(at) - 1)
    place = at[first]
    return place, first, last, gram[place]


def _blocks(f: Fingers, place: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(anchor index, block, first start, last start): starts of one anchor by BLOCK distances to it."""
    low, high = (place - last) // BLOCK, (place - first) // BLOCK
    n = high - low + 1
    which = np.repeat(np.arange(len(place)), n)
    block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]
    return which, block, np.maximum(0, place[which] - BLOCK * block - BLOCK + 1), np.minimum(f.n - size, place[which] - BLOCK * block)


def _by_text(rows: DataFrame, fn, schema: str, names: list[str]) -> DataFrame:
    """Rows that `fn(key, bytes, lists)` gives as numpy columns for each text."""
    n_lists = len(rows.columns) - 2

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1, 1_000_000)):
            parts = [fn(k, (t or "").encode("utf-8", "surrogatepass"), [np.array(batch.column(2 + j)[i].as_py() or []) for j in range(n_lists)])
                     for i, (k, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))]
            if any(len(p[0]) for p in parts):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in range(len(names))], names)

    return rows.mapInArrow(run, schema)


def _classes(scratch: Scratch, rows: DataFrame, wide: str, narrow: str, *who: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose narrow string occurs elsewhere too, and one row of each narrow class whose wide string has several.

    Classes of more than a thousandth of all rows number less than a thousand and go to every task; the
    rows of all others are joined by shuffle, where no class is large.
    """
    each = scratch.write(rows.groupBy(wide, narrow).agg(F.count("*").alias("c"), F.min(F.struct(*who)).alias("one")))
    several = each.groupBy(wide).agg(F.count("*").alias("kinds")).where("kinds > 1").select(wide)
    large = F.col("c") * 1000 > max(rows.count(), 10_000)
    marked = rows.join(F.broadcast(each.where(large).select(wide, narrow, F.lit(True).alias("large"))), [wide, narrow], "left")
    small = marked.where("large is null").join(each.where(~large & (F.col("c") > 1)).select(wide, narrow), [wide, narrow])
    repeated = scratch.write(small.select(*who).unionByName(marked.where("large").select(*who)))
    open_ = scratch.write(each.join(several, wide).select("one.*"))
    scratch.drop(each)
    return repeated, open_


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Removes every byte that lies in a string of `size` bytes starting at another place of the corpus too.

    docs: doc_id, text; further columns are not read. Returns doc_id, n_bytes, n_removed, n_spans, spans
    (maximal removed runs: start, end in bytes) and kept_sha256. Texts count as UTF-8 bytes, strings do not run
    over the end of a text, and all are judged on the input. Null and empty texts have no bytes. Every row
    gives a row; repeated rows are repeats of each other.

    Ranks of strings are fingerprints, so a rank pair at a growing offset is a fingerprint of the longer
    string. Round one ranks strings of GRAM bytes at sampled positions, of which every long string holds
    one at a place given by its content. Round two ranks what surrounds them: where all strings of an anchor
    occur elsewhere, they are settled; where the GRAM bytes are unique, too. Only the others go on, in blocks of
    starts (common core unique: settled; whole block repeated: settled) and then start by start. A class of
    equal strings sends one member on, so groups of copies do not grow from round to round.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("string"), "text").alias("key"), "text")
    keyed = texts.select("key", "text")

    def first_round(key, raw, _):
        f = Fingers(raw)
        place, first, last, gram = anchors(f, size)
        return np.full(len(place), key), place, gram.view(np.int64), f.of(first, last + size, place - first).view(np.int64)

    long_ = keyed.where(F.octet_length("text") >= size)
    rows = scratch.write(_by_text(long_, first_round, "key long, place long, gram long, span long", ["key", "place", "gram", "span"]))
    whole, open_ = _classes(scratch, rows, "gram", "span", "key", "place")

    def ranges(raw, places):
        f = Fingers(raw)
        place, first, last, gram = anchors(f, size)
        at = np.searchsorted(place, np.unique(places))
        return f, place[at], first[at], last[at], gram[at]

    def second_round(key, raw, lists):
        f, place, first, last, gram = ranges(raw, lists[0])
        which, block, low, high = _blocks(f, place, first, last, size)
        core_start = place[which] - BLOCK * block
        core = f.of(core_start, core_start - BLOCK + 1 + size, gram[which], block)
        return np.full(len(which), key), place[which], block, core.view(np.int64), f.of(low, high + size, gram[which], block, place[which] - low).view(np.int64)

    def joined(lists: DataFrame) -> DataFrame:
        return keyed.join(lists, "key")

    asked = open_.groupBy("key").agg(F.collect_list("place").alias("places"))
    rows2 = scratch.write(_by_text(joined(asked), second_round, "key long, place long, block long, core long, span long", ["key", "place", "block", "core", "span"]))
    blocks, open2 = _classes(scratch, rows2, "core", "span", "key", "place", "block")

    def third_round(key, raw, lists):
        f = Fingers(raw)
        end = lists[0] - BLOCK * lists[1]
        starts = np.unique((end[:, None] - np.arange(BLOCK)).ravel())
        starts = starts[(starts >= 0) & (starts <= f.n - size)]
        return np.full(len(starts), key), starts, f.of(starts, starts + size).view(np.int64)

    asked2 = open2.groupBy("key").agg(F.collect_list(F.struct("place", "block")).alias("x")).select("key", "x.place", "x.block")
    rows3 = scratch.write(_by_text(joined(asked2), third_round, "key long, start long, string long", ["key", "start", "string"]))
    twice = rows3.groupBy("string").agg(F.count("*").alias("c")).where("c > 1").select("string")
    starts = rows3.join(twice, "string", "left_semi").select("key", "start")

    none = F.lit(None).cast("long")
    found = scratch.write(whole.select("key", "place", none.alias("block"), none.alias("start")).unionByName(blocks.select("key", "place", "block", none.alias("start")))
                          .unionByName(starts.select("key", none.alias("place"), none.alias("block"), "start")).groupBy("key")
                          .agg(*[F.collect_list(F.when(c, F.struct("place", "block", "start"))).alias(n) for n, c in
                                 (("w", F.col("start").isNull() & F.col("block").isNull()), ("b", F.col("block").isNotNull()), ("s", F.col("start").isNotNull()))])
                          .select("key", F.col("w.place").alias("w"), F.col("b.place").alias("bp"), F.col("b.block").alias("bb"), F.col("s.start").alias("s")))
    scratch.drop(rows, rows2, rows3, whole, open_, blocks, open2)

    def cover(raw: bytes, w, bp, bb, s) -> np.ndarray:
        """Start and end of every maximal run of removed bytes."""
        low, high = [np.array(s, np.int64)], [np.array(s, np.int64)]
        if len(w):
            place, first, last, _ = anchors(Fingers(raw), size)
            at = np.searchsorted(place, np.unique(w))
            low.append(first[at])
            high.append(last[at])
        if len(bp):
            end = np.array(bp) - BLOCK * np.array(bb)
            low.append(np.maximum(0, end - BLOCK + 1))
            high.append(np.minimum(len(raw) - size, end))
        step = np.zeros(len(raw) + 1, np.int64)
        np.add.at(step, np.concatenate(low), 1)
        np.add.at(step, np.concatenate(high) + size, -1)
        inside = np.concatenate([[0], (np.cumsum(step)[:-1] > 0).astype(np.int8), [0]])
        return np.stack([np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)], 1)

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(batches):
        for batch in (part for whole_ in batches for part in slices(whole_, 1)):
            out = []
            for text, w, bp, bb, s in zip(*[batch.column(k).to_pylist() for k in range(1, 6)], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                runs = cover(raw, w, bp, bb, s).tolist() if w or bp or s else []
                kept, at = [], 0
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                out.append((len(raw), sum(b - a for a, b in runs), len(runs), [{"start": a, "end": b} for a, b in runs], sha256(b"".join(kept)).hexdigest()))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], spans), pa.array(columns[4])],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"])

    rows4 = texts.join(found, "key", "left").select("doc_id", "text", "w", "bp", "bb", "s")
    return rows4.mapInArrow(finish, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept_sha256 string")
