"""N-gram Jaccard join by PartEnum signatures, and the groups its links form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoprank.llm.common import ODD, Scratch, components, mix, packed, schema_of, shingles, slices, unpacked

#: two sets link when SAME of TOTAL parts of their union are common; then at most
#: (|r| + |s|) * (TOTAL - SAME) / (TOTAL + SAME) = (|r| + |s|) / 7 shingles are in one of them only
SAME, TOTAL = 3, 4
STAR_ROUNDS = 2
#: places of a set's parity sketch
SKETCH = 2048
#: sets of one shingle that a task compares with each other or with as many others
SLICE = 1024


def n_parts(band: int) -> int:
    """Parts of the shingle domain for sets of 2^band to 2^(band+1) - 1 shingles."""
    return 2 + (6 * (1 << band) + 6) // 7


def n_shared(band: int) -> int:
    """Signatures that two linked sets of the band share at least."""
    return 1 + (1 << band) // 24


def signatures(found: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(band, signatures) of one set of sorted shingle hashes.

    The domain is cut into `n_parts` ranges of the hash; the content of a set within one part gives that
    part's signature. Linked sets differ in at most k shingles, so in at most k parts, and agree in the
    others. Signatures are ranked alike for all sets (most shingles first, then by value); among the first
    k + l signatures of either set, at least l agree. A set also gives signatures for the next band if a
    larger partner can lie there.
    """
    n, out = len(found), []
    own = n.bit_length() - 1
    for band in (own, own + 1):
        largest = min(n * TOTAL // SAME, (2 << band) - 1)
        if largest < 1 << band:
            break
        k, parts = (n + largest) // 7, n_parts(band)
        part = ((found >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        count = np.bincount(part.astype(np.int64), minlength=parts)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found ^ ODD[50]))])
        end = np.cumsum(count)
        token = mix(mix(total[end] - total[end - count]) + np.arange(parts, dtype=np.uint64) * ODD[51] + np.full(parts, band, np.uint64) * ODD[52])
        out.append((band, token[np.lexsort((token, -count))[: k + n_shared(band)]]))
    return out


def _sets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` and text of every row with n (set size) and node (fingerprint of the set, null if empty)."""
    rows = rows.select(*columns, "text")

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, len(columns))):
            n, node = [], []
            for text in batch.column(len(columns)).to_pylist():
                s = shingles(text)
                n.append(len(s))
                both = np.stack([mix(s ^ ODD[53]), mix(s + ODD[54])]).sum(1)
                node.append(int(mix(both[:1] ^ mix(both[1:])).view(np.int64)[0]) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(node, pa.int64())], [*columns, "text", "n", "node"])

    return rows.mapInArrow(run, schema_of(rows, "n long, node long")).withColumn("at", F.monotonically_increasing_id())


def _tokens(sets: DataFrame) -> DataFrame:
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1, 1_000_000)):
            seen: set[int] = set()
            token, node, band = [], [], []
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at not in seen:
                    seen.add(at)
                    for b, t in signatures(shingles(text)):
                        token.append(t)
                        node.append(np.full(len(t), at, np.int64))
                        band.append(np.full(len(t), b, np.int8))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(node)), pa.array(np.concatenate(band))], ["token", "node", "band"])

    return sets.where("node is not null").select("node", "text").mapInArrow(run, "token long, node long, band byte")


def sketch(found: np.ndarray) -> np.ndarray:
    """Parity of the set's shingles in each of SKETCH places, as 64-bit words.

    A shingle that only one of two sets holds turns one place over, so two sketches differ in no more places
    than the sets in shingles.
    """
    odd = np.bincount((found & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _with_sketch(texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 2)):
            rows = pa.array([sketch(shingles(t)) for t in batch.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], ["node", "n", "text", "sketch"])

    return texts.select("node", "n", "text").mapInArrow(run, "node long, n long, text string, sketch array<long>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose sets link, by the sets themselves; pairs that sizes or sketches rule out are not compared."""
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 2)):
            keep, last, left = [], None, None
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if a != last:
                    last, left = a, shingles(x)
                right = shingles(y)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(TOTAL * both >= SAME * (len(left) + len(right) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def side(k: str, *names: str) -> DataFrame:
        return texts.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in names])

    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    near = pairs.join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b").where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)").where(
        apart * (TOTAL + SAME) <= (F.col("n_a") + F.col("n_b")) * (TOTAL - SAME)).select("a", "b")
    return near.join(side("a", "text"), "a").join(side("b", "text"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _rarest(texts: DataFrame) -> DataFrame:
    """(shingle, node, n, c): the signatures of the finest partition, one shingle to a part, rarest first.

    A set of n shingles shares at least 3/4 n of them with a partner. What occurs in one set only is not
    shared; of its c other shingles, the c - 3/4 n + 1 rarest hold one of any partner's. A passage that many
    sets hold is common, so sets that share nothing else do not meet over it.
    """
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 2, 1_000_000)):
            found = [shingles(t) for t in batch.column(2).to_pylist()]
            size = [len(f) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(np.asarray(batch.column(0)), size)), pa.array(np.repeat(np.asarray(batch.column(1)), size))],
                                             ["shingle", "node", "n"])

    every = texts.mapInArrow(run, "shingle long, node long, n long")
    by_shingle, own = Window.partitionBy("shingle"), Window.partitionBy("node")
    shared = every.withColumn("df", F.count("*").over(by_shingle)).where("df > 1")
    ranked = shared.withColumns({"c": F.count("*").over(own), "k": F.row_number().over(own.orderBy("df", "shingle"))})
    return ranked.where("k <= c - ceil(n * 3 / 4) + 1").select("shingle", "node", "n", "c")


def _grouped(batches, width: int):
    """(columns as numpy arrays, cuts): whole groups of rows that agree in the first `width` columns, lying between two cuts each.

    Rows come sorted by these columns; the last column is a list of SKETCH bits. A group may run over several batches.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(c) for c in batch.columns[:-1]] + [np.asarray(batch.columns[-1].flatten()).view(np.uint64).reshape(batch.num_rows, -1)]
        if held is not None:
            columns = [np.concatenate(both) for both in zip(held, columns, strict=True)]
        new = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns[:width]], axis=0)) + 1
        last = int(new[-1]) if len(new) else 0
        if last:
            yield [c[:last] for c in columns], [0, *new.tolist()]
        held = [c[last:] for c in columns]
    if held is not None:
        yield held, [0, len(held[0])]


def _met(rare: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of different components that share a shingle of `rare` and that neither sizes nor sketches rule out.

    The sets of a shingle are dealt into slices, and a task compares a slice with itself or with another: copies of one text
    that narrowly miss each other are no rows of a join, only what may link leaves the task. A set is sent once per slice of
    its shingle, so a shingle of m sets sends m * ceil(m / SLICE) rows however many pairs they form.
    """
    own = Window.partitionBy("shingle")
    several = rare.withColumns({"m": F.count("*").over(own), "lo": F.min("comp").over(own), "hi": F.max("comp").over(own)}).where("lo <> hi")
    dealt = several.withColumn("parts", F.ceil(F.col("m") / SLICE)).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    sent = dealt.join(texts.select("node", "sketch"), "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    keys = {"low": F.least("part", "other"), "high": F.greatest("part", "other")}
    rows = sent.withColumns(keys).select("shingle", "low", "high", "part", "node", "comp", "n", "c", "sketch")

    def run(batches):
        for (_, low, high, part, node, comp, n, c, bits), cuts in _grouped(batches, 3):
            left, right = [], []
            for start, end in zip(cuts, cuts[1:]):
                one = low[start] == high[start]
                y = np.arange(start, end) if one else start + np.flatnonzero(part[start:end] == high[start])
                x = y if one else start + np.flatnonzero(part[start:end] == low[start])
                step = max(1, (1 << 16) // max(1, len(y)))
                for at in range(0, len(x), step):
                    i = x[at : at + step, None]
                    fit = (comp[i] != comp[y]) & (TOTAL * np.minimum(n[i], n[y]) >= SAME * np.maximum(n[i], n[y])) & (
                        (TOTAL + SAME) * np.minimum(c[i], c[y]) >= SAME * (n[i] + n[y]))
                    if one:
                        fit &= i < y
                    a, b = np.nonzero(fit)
                    a, b = i[a, 0], y[b]
                    apart = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
                    near = apart * (TOTAL + SAME) <= (n[a] + n[b]) * (TOTAL - SAME)
                    left.append(node[a[near]])
                    right.append(node[b[near]])
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return rows.repartition("shingle", "low", "high").sortWithinPartitions("shingle", "low", "high").mapInArrow(run, "a long, b long").distinct()


def _components(scratch: Scratch, sets: DataFrame) -> DataFrame:
    """doc_id, n, node, at of every row, with comp: the component of its node (null without shingles)."""
    by_token = Window.partitionBy("token")
    shared = scratch.write(_tokens(sets).withColumns({"lo": F.min("node").over(by_token), "hi": F.max("node").over(by_token)}).where("lo <> hi").select("token", "node", "band").distinct())
    df = shared.groupBy("token").agg(F.count("*").alias("df"))
    own = Window.partitionBy("node", "band")
    # a set that many others are edits of shares most of its signatures with most of them
    ranked = shared.join(df, "token").withColumns({"c": F.count("*").over(own), "k": F.row_number().over(own.orderBy("df", "token")), "central": F.sum("df").over(own)})
    need = (1 + F.floor(F.pow(F.lit(2.0), F.col("band").cast("double")) / 24)).cast("int")
    buckets = scratch.write(ranked.where(F.col("k") <= F.col("c") - need + 1).select("token", "node", "central"))
    alive = buckets.select("node").distinct()
    texts = scratch.write(_with_sketch(sets.where("node is not null").join(alive, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("text").alias("text"))))
    scratch.drop(shared)

    comp = edges = None

    def members() -> DataFrame:
        """Buckets that still hold several components."""
        m = buckets.withColumn("comp", F.col("node")) if comp is None else buckets.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        open_ = m.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
        return m.join(open_, "token", "left_semi")

    def connect(pairs: DataFrame) -> bool:
        nonlocal comp, edges
        new = scratch.write(_verified(pairs, texts))
        if new.isEmpty():
            return False
        edges = new if edges is None else scratch.write(edges.unionByName(new))
        comp = components(scratch, edges)
        return True

    for r in range(STAR_ROUNDS):
        m = scratch.write(members())
        first_of = F.col("central") if r == 0 else F.xxhash64("node", F.lit(r))
        lead = m.groupBy("token").agg(F.max(F.struct(first_of.alias("h"), F.col("node").alias("leader"), F.col("comp").alias("l_comp"))).alias("l")).select("token", "l.leader", "l.l_comp")
        votes = m.join(lead, "token").where("comp <> l_comp").groupBy("node", "leader").agg(F.count("*").alias("votes"))
        best = votes.groupBy("node").agg(F.max(F.struct("votes", "leader")).alias("v")).select(F.col("v.leader").alias("a"), F.col("node").alias("b"))
        if not connect(best):
            break
    left = scratch.write(members().select("node", "comp").distinct())
    rare = scratch.write(_rarest(left.join(texts, "node").select("node", "n", "text")).join(left, "node"))
    connect(_met(rare, texts))

    rows = sets.select("doc_id", "n", "node", "at")
    placed = rows.withColumn("comp", F.col("node")) if comp is None else rows.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = scratch.write(placed)
    scratch.drop(buckets, texts)
    return placed


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of documents that links connect: doc_id, n_shingles, component_id and class_id for every row.

    docs: doc_id, text; further columns are not read. A text's set holds its distinct five-word shingles
    (words between blanks, A-Z lower-cased), with fewer words the whole sequence. Sets link when
    100 x intersection >= 75 x union. class_id is the fingerprint of the set (equal sets, equal class);
    component_id the smallest doc_id that can be reached. Null, empty and blank texts have no shingles, link
    with nothing and are their own component. A row without an id is a document too; the smallest id of its
    group names it, or null if there is none. Repeated rows stay.

    Equal sets are one node. Signatures are grouped, and only nodes that share enough of them with others go
    on, each with its rarest ones. Within such a bucket everything is compared with one leader first: the set
    that shares most with others, then one by hash. What this connects is not compared again. The sets of buckets that still hold
    several components are cut to the finest partition, one shingle to a part, and those that share one of
    their rarest shared shingles are compared, slice by slice, so no link between components is missed.
    """
    scratch = Scratch(docs.sparkSession)
    sets = scratch.write(_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]))
    placed = _components(scratch, sets)
    first = placed.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("smallest"))
    out = scratch.write(placed.join(first, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"), F.col("node").alias("class_id")))
    scratch.drop(sets, placed)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of `near_duplicates`: that with the smallest doc_id (of equal ones, any; missing ids last).

    Texts without shingles are in no group and stay. Columns and kept rows stay as they are.
    """
    scratch = Scratch(docs.sparkSession)
    sets = scratch.write(_sets(packed(docs), ["row", "doc_id"]))
    placed = _components(scratch, sets)
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "at")
    kept = placed.where("comp is not null").groupBy("comp").agg(F.min(order).alias("first")).select("first.at").unionByName(placed.where("comp is null").select("at"))
    return unpacked(sets.join(kept, "at", "left_semi"), docs.columns)
