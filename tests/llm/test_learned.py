"""Language identification, quality and language-model scores."""

import math
from collections import Counter

import numpy as np
import pytest

from shoprank.llm import language_model, languages, quality
from shoprank.llm.common import Scratch
from shoprank.llm.queries import piece_model
from tests.llm.common import AWKWARD, blank_words, bucket, documents, text, tuples

GERMAN = "der die und das ist nicht mit dem auf eine sich auch werden haben ich wird sind noch wie einem über einen so zum war".split()
FRENCH = "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas vous par sur faire plus dire".split()


def speech(words, seed, n=40):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(words, n))


def lattice_sum(lattice, word, p):
    """Probability of a word by listing every segmentation."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        piece = lattice.ids.get(word[:k], lattice.size if k == 1 else None)
        if piece is not None:
            total += p[piece] * lattice_sum(lattice, word[k:], p)
    return total


def test_long_words_count_all_their_segmentations():
    lattice = languages.Lattice(piece_model())
    q = languages.with_extra(np.random.default_rng(4).dirichlet(np.ones(lattice.size), 1))[:, 0]

    def listed(word):
        """(probability, pieces) of every segmentation."""
        if not word:
            return [(1.0, ())]
        out = []
        for k in range(1, len(word) + 1):
            piece = lattice.ids.get(word[:k], lattice.size if k == 1 else None)
            if piece is not None:
                out += [(q[piece] * x, (piece, *rest)) for x, rest in listed(word[k:])]
        return out

    for word in ("▁the", "▁unterwegs", "▁xq漢z"):
        want, every = np.zeros(len(q)), listed(word)
        for x, pieces in every:
            np.add.at(want, list(pieces), x / sum(p for p, _ in every))
        for step in (1, 3, 1 << 16):
            assert np.allclose(languages.long_counts(lattice, word, q, step), want)
    # every segmentation covers the whole word, however long
    size = np.array([len(p) for p in sorted(lattice.ids, key=lattice.ids.get)] + [1, 0])
    for word in ("▁" + "donaudampfschifffahrt" * 30, "▁" + "x" * 3000):
        assert abs(languages.long_counts(lattice, word, q, 500) @ size - len(word)) < 1e-6


def test_letters_are_the_unicode_letters():
    import sys
    import unicodedata

    letters = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and languages.LETTERS.fullmatch(chr(c))]
    assert letters == [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "L"]
    assert languages.words_of("½ ² ② Ⅷ _ 12") == [] and languages.words_of("x² Aé漢1b") == ["x", "aé漢", "b"]


def test_forward_sums_all_segmentations():
    lattice, rng = languages.Lattice(piece_model()), np.random.default_rng(0)
    p = rng.random((2, lattice.size)) / lattice.size
    table = languages.with_extra(p)
    words = ["the", "straße", "漢", "ab", "q", "überall", "zz漢z"]
    got = languages.word_logs(lattice, words, table)
    for w, row in zip(words, got):
        assert row == pytest.approx([math.log(lattice_sum(lattice, "▁" + w, table[:, k])) for k in range(2)])
    long = "überallzusammen" * 6
    split = languages.long_word(lattice, "▁" + long, table)
    assert split == pytest.approx(np.log(languages.forward(lattice.edges(["▁" + long]), table)[-1][0]))


def test_languages_are_told_apart(spark):
    rows = [(20 + i, speech(GERMAN, i), "de") for i in range(40)] + [(100 + i, speech(FRENCH, 100 + i), "fr") for i in range(40)]
    rows += [(500, speech(GERMAN, 500), None), (501, speech(FRENCH, 501), None), *AWKWARD]
    got = {(r["doc_id"], r["lang_pred"], r["held_out"]): r["score"] for r in languages.identify(documents(spark, rows), piece_model()).collect()}
    assert len(rows) - 1 == len(got)                                     # one row is there twice
    for doc_id, pred, held in got:
        assert held == (bucket(doc_id, 5) == 0) and 0 <= got[doc_id, pred, held] <= 1
        if doc_id is not None and (20 <= doc_id < 60 or doc_id == 500):
            assert pred == "de"
        if doc_id is not None and (100 <= doc_id < 140 or doc_id == 501):
            assert pred == "fr"
    assert {k[1] for k in got if k[0] == 0} == {"und"} == {k[1] for k in got if k[0] == 10}
    kept = languages.keep_known(documents(spark, rows), piece_model())
    assert kept.columns == documents(spark, []).columns and not {0, 1, 2, 10} & {r["doc_id"] for r in kept.collect()}


def test_without_languages(spark):
    assert {r[0] for r in tuples(languages.identify(documents(spark, AWKWARD), piece_model()), "lang_pred")} == {"und"}
    assert languages.identify(documents(spark, []), piece_model()).count() == 0


def test_quality_ranks_held_out_rows(spark):
    rows = [(i, text(i, 60) + "." if i % 5 else "!! ".join(speech(GERMAN, i).upper().split()) + "!!") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 400, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality.score_quality(documents(spark, [*rows, *[r for r in AWKWARD if r[0] is None or r[0] < 3]]), labels).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (bucket(r["doc_id"], 4) == 2) for r in got)
    held = [(r["score"], r["doc_id"] % 5 > 0) for r in got if r["held_out"] and r["doc_id"] and r["doc_id"] > 10]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert len(got) == 404


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r[0] for r in tuples(quality.score_quality(documents(spark, AWKWARD), none), "score")} == {0.5}
    assert quality.score_quality(documents(spark, []), none).count() == 0


def test_risk_is_not_negative_even_when_overfit():
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, (30, 40)), np.concatenate([rng.normal(1, 1, (30, 40)), rng.normal(-1, 1, (30, 40))])
    mean, scale, w, b = quality.fit(p, u, 0.5, epochs=400)

    def f(x):
        return 1 / (1 + np.exp(-np.clip((x - mean) / scale, -8, 8) @ w - b))

    negative = -np.log(1 - f(u) + 1e-12).mean() + 0.5 * np.log(1 - f(p) + 1e-12).mean()
    assert negative > -0.2 and f(u[:30]).mean() > f(u[30:]).mean() + 0.5


def model_rows():
    return [*AWKWARD, *[(50 + k, speech(GERMAN if k % 2 else FRENCH, k, 60)) for k in range(60)], (200, "neverseen " * 5), (60, None)]


@pytest.mark.parametrize("frequent", [200_000, 7])
def test_base_score_equals_the_formula(spark, frequent):
    rows = model_rows()
    count = Counter(w for i, t in rows if bucket(i, 10) for w in [*blank_words(t), None])
    n, v = sum(count.values()), len(count)
    got = tuples(language_model.score_texts(documents(spark, rows), frequent=frequent), "doc_id", "n_tokens", "n_known", "train_tokens", "held_out", "base_score")
    want = []
    for i, t in rows:
        w = [*blank_words(t), None]
        want.append((i, len(w), sum(count[x] > 0 for x in w), n, bucket(i, 10) == 0, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    want.sort(key=repr)
    key = lambda r: (repr(r[:5]), round(r[5], 6))                        # noqa: E731
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])


def test_model_probabilities_add_up_to_one():
    rng = np.random.default_rng(3)
    model = language_model.Model(rng.random((language_model.OUTER, language_model.INNER)) + 0.1)
    model.w[:] = rng.normal(size=model.w.shape)
    model.w2[:] = rng.normal(size=model.w2.shape)
    flat, features = language_model.context([language_model.tokens("one two three one"), language_model.tokens(None)])
    leaves = np.arange(64, dtype=np.uint64) << np.uint64(58)
    for row in features:
        gain = model.gains(leaves, np.repeat(row[None], 64, 0))
        assert (10.0**gain * model.base.ravel()).sum() == pytest.approx(1)
    assert len(flat) == 6


def test_context_is_learned(spark):
    rng = np.random.default_rng(9)
    pairs = {w: f"{w}2" for w in (f"w{k}" for k in range(30))}
    rows = [(i, " ".join(x for w in rng.choice(list(pairs), 150) for x in (w, pairs[w]))) for i in range(250)]
    got = language_model.score_texts(documents(spark, rows)).where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) * 0.97


def test_nothing_to_learn_from(spark):
    assert language_model.score_texts(documents(spark, [])).count() == 0
    held = [(i, "a b") for i in range(200) if bucket(i, 10) == 0]
    for r in language_model.score_texts(documents(spark, held)).collect():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


def test_a_step_equals_the_plain_formula():
    rng = np.random.default_rng(5)
    flat, features = language_model.context([rng.integers(0, 2**63, 300, dtype=np.uint64) for _ in range(3)])
    model = language_model.Model(rng.random((language_model.OUTER, language_model.INNER)) + 0.1)
    model.w[:], model.w2[:] = rng.normal(size=model.w.shape), rng.normal(size=model.w2.shape)
    outer, inner = language_model.leaf_of(flat)
    for weights, bias, label, rows in zip(("w", "w2"), (model.bias, model.bias2[outer]), (outer, inner), model.rows(features, outer)):
        w = getattr(model, weights).astype(float)
        z = np.exp(bias + w[rows].sum(1))
        error = z / z.sum(1, keepdims=True) - np.eye(8)[label]
        step = np.zeros_like(w)
        for k in range(rows.shape[1]):
            np.add.at(step, rows[:, k], error)
        new = language_model.Model.of(model.state())
        new.bias, new.bias2 = model.bias, model.bias2
        squares = [np.zeros(len(w), np.float32), np.zeros(len(w), np.float32)]
        new.learn(flat, features, squares)
        want = w - language_model.RATE * step / np.sqrt((step * step).mean(1) + 1.0)[:, None]
        assert np.allclose(getattr(new, weights), want, atol=1e-4)


def test_words_that_stand_beside_the_same_words_share_a_class(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"{('the a', 'to b')[k % 2]}{rng.integers(100)}" for k in range(40))) for i in range(250)]
    words = sorted({w for _, t in rows for w in t.split()}, key=lambda w: int(language_model.word_hashes(w)[0]))
    h = np.concatenate([language_model.word_hashes(w) for w in words])
    classes = language_model.learn_classes(documents(spark, rows), Scratch(spark), h, np.full(len(h), 40))
    of = {kind: {c for w, c in zip(words, classes.leaf.tolist(), strict=True) if w[0] == kind and w[1:].isdigit()} for kind in "ab"}
    assert of["a"] and of["b"] and not of["a"] & of["b"]
    # which kind comes next is known from the word before
    got = language_model.score_texts(documents(spark, rows)).where("held_out").collect()
    gain = sum(r["score"] - r["base_score"] for r in got) / sum(r["n_tokens"] for r in got)
    assert gain > 0.05, gain


def test_classes_without_words():
    h = np.array([0, 2**64 - 1, 11 << 58], np.uint64)
    assert [x.tolist() for x in language_model.leaf_of(h)] == [[0, 7, 1], [0, 7, 3]]
    classes = language_model.Classes(np.array([5, 9], np.uint64), np.array([63, 17]), 4)
    assert [x.tolist() for x in language_model.leaf_of(np.array([9, 6, 5, 2**64 - 1], np.uint64), classes)] == [[2, 0, 7, 0], [1, 4, 7, 4]]
