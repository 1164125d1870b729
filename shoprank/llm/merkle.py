"""Merkle manifest of a table: one root for all documents, and for each document the path that proves it.

A document's leaf is a digest of its columns; leaves of one language form a tree of their own, and the tops of these trees
form the tree of the whole table. Trees are kept as strings: an aligned block of 512 nodes holds each of its levels as one
string of hex digests. Substrings of fixed width are hashed to the level above, substrings beside a node are its siblings,
and the blocks' tops are the nodes of the next round.

Rules: missing values enter a leaf as `-`. Documents without a language form the first tree. In a tree documents ascend by
doc_id, missing ids first, ties by leaf; rows equal in both take neighbouring places in any order and share everything but
the path. Empty and very long texts are hashed like any other. A table without rows has no manifest rows. Added columns
never clash with the caller's, which are returned in the struct `row`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoprank.llm.common import Scratch

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, DIGEST = 8, 64
#: levels that one block holds as strings, and its nodes
LEVELS = 3
BLOCK = FANOUT**LEVELS
RUN = FANOUT * DIGEST

_PATH = "array<struct<left:string,right:string>>"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 over the fields, each as `-` or its UTF-8 length, `:` and value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along its path."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """All sibling digests of a path as one string, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, keep: Sequence[str] | None = None) -> DataFrame:
    """`(row, position, leaf, subroot, root, path)` for every document.

    `row` holds the columns `keep` (all but the text), `position` is the place in the tree of the language, `path` the
    siblings of each level as `(left, right)`. Texts are hashed where they are read; digests alone are shuffled, by range of
    (language, id, leaf), so a language or an id with a third of the rows is dealt over as many tasks as its size asks for.
    """
    scratch = Scratch(docs.sparkSession)
    kept = [c for c in docs.columns if c != "text"] if keep is None else list(keep)
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").alias("id"), leaf_digest(*[F.col(f"`{f}`") for f in fields]).alias("digest"), row.alias("row"))
    # written first: dealing out by range looks at its input twice, and texts are to be read and hashed once
    trees = climb(scratch, numbered(scratch, scratch.write(leaves), ["tree", "id", "digest"]))
    tops = tops_of(trees).select(F.lit("").alias("tree"), F.col("digest"), F.struct("tree").alias("row"))
    whole = climb(scratch, numbered(scratch, tops, ["row.tree"]))
    root = tops_of(whole).select("tree", F.array().cast(_PATH).alias("path"), F.struct(F.col("digest").alias("root")).alias("facts"))
    above = paths(scratch, whole, root).select("row.tree", "path", F.struct(F.col("digest").alias("subroot"), "facts.root").alias("facts"))
    out = paths(scratch, trees, scratch.write(above))
    return out.select("row", F.col("pos").alias("position"), F.col("digest").alias("leaf"), "facts.subroot", "facts.root", "path")


def numbered(scratch: Scratch, nodes: DataFrame, order: list[str]) -> DataFrame:
    """Nodes with their place `pos` in their tree and the tree's size `n`.

    Rows are dealt out by range and sorted; only the sizes of (part, tree) are added up. A number dealt in the scan
    spreads rows that are equal in all that counts.
    """
    spread = nodes.withColumn("spread", F.monotonically_increasing_id())
    parts = spread.repartitionByRange(*order, "spread").sortWithinPartitions(*order, "spread").drop("spread")
    placed = scratch.write(parts.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)))
    runs = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("size"))
    tree = Window.partitionBy("tree")
    before = F.sum("size").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    runs = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("size").over(tree).alias("n"))
    return placed.join(runs, ["tree", "part"]).select("tree", (F.col("place") + F.col("shift")).alias("pos"), "n", "digest", "row")


def _parents(level: str) -> Column:
    """The level above a string of digests."""
    return F.expr(f"array_join(transform(sequence(0, (length({level}) - 1) div {RUN}), i -> sha2(cast(substring({level}, int(i * {RUN} + 1), {RUN}) as binary), 256)), '')")


def climb(scratch: Scratch, nodes: DataFrame) -> list[DataFrame]:
    """Blocks of every round, written: members in order, the levels as strings, the digest at the block's top."""
    rounds = []
    while True:
        members = F.array_sort(F.collect_list(F.struct("pos", "digest", "row"))).alias("members")
        blocks = nodes.groupBy("tree", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.max("n").alias("n"), members)
        blocks = blocks.withColumn("l0", F.array_join(F.transform("members", lambda m: m["digest"]), ""))
        for k in range(LEVELS):
            blocks = blocks.withColumn(f"l{k + 1}", F.when(F.col("n") > FANOUT**k, _parents(f"l{k}")))
        top = F.coalesce(*[F.col(f"l{k}") for k in range(LEVELS, -1, -1)])
        rounds.append(scratch.write(blocks.withColumn("top", top).drop(f"l{LEVELS}")))
        # one number: the size of the largest tree
        largest = rounds[-1].agg(F.max("n")).first()[0]
        if largest is None or largest <= BLOCK:
            return rounds
        nodes = rounds[-1].where(F.col("n") > BLOCK).select(
            "tree", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("top").alias("digest"), F.lit(None).cast("int").alias("row"))


def tops_of(rounds: list[DataFrame]) -> DataFrame:
    """`(tree, digest)` of every tree; a tree ends in the round where one block holds it."""
    ended = [r.where(F.col("n") <= BLOCK).select("tree", F.col("top").alias("digest")) for r in rounds]
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    return out


def _beside(k: int) -> Column:
    """What flanks a node's ancestor in level k of its block, inside the run that is hashed together."""
    at = f"shiftright(i, {3 * k})"
    left = f"substring(l{k}, int(({at} div {FANOUT}) * {RUN} + 1), int(({at} % {FANOUT}) * {DIGEST}))"
    right = f"substring(l{k}, int(({at} + 1) * {DIGEST} + 1), int(({FANOUT - 1} - {at} % {FANOUT}) * {DIGEST}))"
    return F.expr(f"if(n > {FANOUT**k}, named_struct('left', {left}, 'right', {right}), null)")


def paths(scratch: Scratch, rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Nodes of the first round with the path up through their tree and what `above` has for the tree: `path` and `facts`.

    Paths come down block by block; a block's nodes share what lies above it.
    """
    down = None
    for r, blocks in reversed(list(enumerate(rounds))):
        known = blocks.where(F.col("n") <= BLOCK).join(above, "tree")
        if down is not None:
            known = known.unionByName(blocks.where(F.col("n") > BLOCK).join(down, ["tree", "block"]))
        nodes = known.select("*", F.posexplode("members").alias("i", "m"))
        own = F.filter(F.array(*[_beside(k) for k in range(LEVELS)]), lambda s: s.isNotNull())
        nodes = nodes.select("tree", "m.pos", "m.digest", "m.row", F.concat(own, F.col("path")).alias("path"), "facts")
        if r:
            down = scratch.write(nodes.select("tree", F.col("pos").alias("block"), "path", "facts"))
    return nodes
