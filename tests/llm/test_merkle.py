from hashlib import sha256

from pyspark.sql import functions as F

from shoprank.llm import merkle
from shoprank.llm.common import Scratch
from tests.llm.common import AWKWARD, documents


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(digests):
    """Root and, for every place, the siblings of each level as (left, right)."""
    found = [[] for _ in digests]
    where, level = list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, at in enumerate(where):
            run = at // 8 * 8
            found[i].append(("".join(level[run:at]), "".join(level[at + 1 : run + 8])))
            where[i] = at // 8
        level = [digest(*level[k : k + 8]) for k in range(0, len(level), 8)]
    return level[0], found


def plain(rows, fields):
    """(doc_id, lang) -> leaf, subroot, root and path, for rows of different leaves."""
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of([r[f] for f in fields])))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    tops = {x: climb([leaf for _, _, leaf in sorted(trees[x])]) for x in names}
    root, upper = climb([tops[x][0] for x in names])
    out = []
    for k, x in enumerate(names):
        out += [(leaf, tops[x][0], root, tuple(path + upper[k])) for (_, _, leaf), path in zip(sorted(trees[x]), tops[x][1], strict=True)]
    return sorted(out)


def manifest_rows(df, fields):
    got = merkle.manifest(df, fields=fields).collect()
    return sorted((r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in got)


def test_awkward_rows_and_many_languages(spark):
    rows = [(i, t, lang) for lang in (None, "", "en", "zh", "é") for i, t in AWKWARD] + [(100 + k, f"t{k}", f"l{k % 11}") for k in range(40)]
    rows = [r for k, r in enumerate(rows) if r not in rows[:k]]
    df = documents(spark, rows)
    assert manifest_rows(df, ["doc_id", "lang", "text"]) == plain([r.asDict() for r in df.collect()], ["doc_id", "lang", "text"])


def test_several_rounds_of_blocks(spark):
    # 8^3 nodes a block: trees of 1, 8, 9, 512, 513 and 4,500 leaves end after no, one or two rounds
    sizes = {"a": 1, "b": 8, "c": 9, "d": 512, "e": 513, "f": 4500}
    rows = [(k * 7 % n, f"{lang}{k}", lang) for lang, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = manifest_rows(df, ["doc_id", "text"])
    assert got == plain([r.asDict() for r in df.collect()], ["doc_id", "text"])


def test_repeated_rows_share_a_tree(spark):
    df = spark.createDataFrame([(1, "same", "en")] * 700 + [(2, "other", "en")], "doc_id long, text string, lang string")
    got = merkle.manifest(df, fields=["doc_id", "text"])
    whole = [leaf_of([1, "same"])] * 700 + [leaf_of([2, "other"])]
    assert {r.root for r in got.collect()} == {climb(whole)[0]} and sorted(r.position for r in got.collect()) == list(range(701))
    assert got.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


def test_a_changed_leaf_leads_elsewhere_and_an_empty_table_nowhere(spark):
    df = documents(spark, [(k, f"Text {k}", "en") for k in range(30)])
    got = merkle.manifest(df, fields=["doc_id", "text"])
    assert got.where(merkle.fold(F.sha2(F.concat("leaf", F.lit("x")).cast("binary"), 256), F.col("path")) == F.col("root")).count() == 0
    assert "own row" in {r.row["row"] for r in got.collect()}
    assert merkle.manifest(documents(spark, []), fields=["doc_id", "text"]).count() == 0


def test_numbers_do_not_depend_on_the_parts(spark):
    df = spark.range(1000).selectExpr("cast(id % 3 as string) tree", "id", "sha2(cast(cast(id as string) as binary), 256) digest", "struct(id) row")
    for parts in (1, 7):
        got = merkle.numbered(Scratch(spark), df.repartition(parts), ["tree", "id", "digest"])
        assert [(r.tree, r.pos, r.n) for r in got.where("row.id >= 990").orderBy("row.id").collect()] == [
            (str(i % 3), i // 3, 334 - (i % 3 > 0)) for i in range(990, 1000)]
