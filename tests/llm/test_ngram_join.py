from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shoprank.llm import ngram_join
from shoprank.llm.common import shingles
from tests.llm.common import AWKWARD, blank_words, documents, text, tuples


def brute(rows):
    """n_shingles and smallest reachable id of every row, by all pairs."""
    sets = []
    for _, t in rows:
        w = blank_words(t)
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [r[0] for r, g in zip(rows, group) if g == group[i] and r[0] is not None]
        out.append((doc_id, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc_id))
    return sorted(out, key=repr)


def edited(words, places):
    return " ".join(w if k not in places else f"new{k}" for k, w in enumerate(words))


def rows_near_the_bound():
    rng, rows = np.random.default_rng(5), list(AWKWARD)
    for group in range(6):
        words = [f"w{group}x{k}" for k in range(int(rng.integers(5, 160)))]
        for copy in range(14):
            places = set(rng.integers(0, len(words), int(rng.integers(0, 1 + len(words) // 16))).tolist())
            rows.append((100 + 50 * group + copy, edited(words, places)))
            rows.append((10_000 + 50 * group + copy, edited(words[: max(1, len(words) - copy)], set())))
    passage = [f"p{k}" for k in range(60)]                               # a passage that many documents share
    rows += [(20_000 + k, " ".join([f"a{k}y{j}" for j in range(10 + k)] + passage)) for k in range(40)]
    return rows


def test_components_equal_all_pairs(spark):
    rows = rows_near_the_bound()
    got = ngram_join.near_duplicates(documents(spark, rows))
    assert tuples(got, "doc_id", "n_shingles", "component_id") == brute(rows)


def edits_of_one_text(copies):
    """Copies of one text, each edited so that most pairs miss the threshold and some meet it."""
    rng, words = np.random.default_rng(11), [f"w{k}" for k in range(150)]
    return [(k, edited_by(words, k, rng.integers(0, 150, 4 if k % 5 else 2))) for k in range(copies)]


def edited_by(words, who, places):
    return " ".join(f"own{who}x{k}" if k in places else w for k, w in enumerate(words))


def test_copies_that_miss_each_other_are_no_rows(spark, monkeypatch):
    handed, verified = [], ngram_join._verified

    def counted(pairs, texts):
        pairs = pairs.persist()
        handed.append(pairs.count())
        return verified(pairs, texts)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    rows = edits_of_one_text(200)
    got = ngram_join.near_duplicates(documents(spark, rows))
    assert tuples(got, "doc_id", "n_shingles", "component_id") == brute(rows)
    assert sum(handed) < 5 * len(rows)


@pytest.mark.parametrize("size", [1, 7, 1024])
def test_slices_of_a_shingle_meet_each_other(spark, monkeypatch, size):
    monkeypatch.setattr(ngram_join, "SLICE", size)
    rows = edits_of_one_text(60)
    sets = {int(r["node"]): shingles(r["text"]) for r in ngram_join._sets(documents(spark, rows), ["doc_id"]).collect()}
    texts = ngram_join._with_sketch(spark.createDataFrame([(k, len(sets[k]), t) for k, (_, t) in zip(sets, rows)], "node long, n long, text string"))
    rare = ngram_join._rarest(texts).withColumn("comp", F.col("node"))
    got = {tuple(r) for r in ngram_join._met(rare, texts).collect()}
    both = {(min(p), max(p)): len(np.intersect1d(sets[p[0]], sets[p[1]])) for p in combinations(sets, 2)}
    linked = {p for p, k in both.items() if 4 * k >= 3 * (len(sets[p[0]]) + len(sets[p[1]]) - k)}
    assert len(linked) > 5 and linked <= got and len(got) < 3 * len(linked) < len(both) / 2


def test_groups_run_over_batches():
    bits = pa.array([[k, -k] for k in range(6)], pa.list_(pa.int64()))
    whole = pa.RecordBatch.from_arrays([pa.array([1, 1, 1, 2, 3, 3]), pa.array([0, 0, 0, 0, 0, 0]), bits], ["x", "y", "bits"])
    for size in (1, 2, 4, 6):
        parts = [whole.slice(k, size) for k in range(0, 6, size)]
        got = [columns[2][a:b, 0].astype(int).tolist() for columns, cuts in ngram_join._grouped(parts, 2) for a, b in zip(cuts, cuts[1:])]
        assert got == [[0, 1, 2], [3], [4, 5]]
    assert list(ngram_join._grouped([], 2)) == []


def test_linked_sets_share_enough_signatures():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        other = np.unique(np.concatenate([base[rng.random(len(base)) > 0.12], rng.integers(0, 2**63, max(0, n // 9), dtype=np.uint64) * np.uint64(2)]))
        both = len(np.intersect1d(base, other))
        if not len(other) or 4 * both < 3 * (len(base) + len(other) - both):
            continue
        a, b = dict(ngram_join.signatures(base)), dict(ngram_join.signatures(other))
        assert any(len(np.intersect1d(a[k], b[k])) >= ngram_join.n_shared(k) for k in a.keys() & b.keys())


def test_one_of_each_keeps_columns_and_texts_without_words(spark):
    rows = [*AWKWARD, (50, text(2, 40).upper()), (51, text(2, 40) + " end")]
    docs = documents(spark, rows)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 4, 5, 6, 7, 8, 10] and ids.count(None) == 1


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (1, "")]])
def test_nothing_to_join(spark, rows):
    assert tuples(ngram_join.near_duplicates(documents(spark, rows)), "doc_id", "n_shingles", "component_id") == [(r[0], 0, r[0]) for r in rows]
    assert ngram_join.one_of_each(documents(spark, rows)).count() == len(rows)


def test_shingles_of_short_texts():
    assert len(shingles("a b c d")) == 1 and shingles("a b c d") == shingles("A  b\nc d") and len(shingles(None)) == 0
    assert shingles("a b c d")[0] != shingles("a b c")[0]
