import re

import numpy as np
import pytest

from shoprank.llm import contamination
from shoprank.llm.common import LETTER_WORDS, word_hashes
from tests.llm.common import AWKWARD, documents, lower, text, tuples

ITEMS = [(1, text(6, 40)), (2, "Alpha beta, gamma"), (3, text(7, 10)), (4, None), (5, ""), (6, "?!"), (None, text(8, 14)), (10, text(6, 40)), (7, "solo")]
ROWS = [*AWKWARD, (20, "x " + text(6, 25) + " y"), (21, "ALPHA-beta (gamma) alpha beta gamma"), (22, text(7, 9)), (23, text(7, 10)),
        (24, text(8, 13) + " " + text(6, 12)), (25, "solo"), (26, "so lo")]


def words(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s))


def brute():
    wins = []
    for item, t in ITEMS:
        w = words(t)
        m = min(10, len(w))
        wins += [(tuple(w[k:k + m]), item) for k in range(len(w) - m + 1 if m else 0)]
    out = []
    for doc_id, t in ROWS:
        w, hit, items = words(t), set(), set()
        for window, item in wins:
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k:k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    items |= {str(item)} - {"None"}
        out.append((doc_id, len(w), len(hit), sorted(items), bool(hit)))
    return sorted(out, key=repr)


def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("pass_windows", [1_000_000, 9])
def test_hits_equal_brute_force_in_one_pass_and_in_several(spark, pass_windows):
    got = contamination.find_matches(documents(spark, ROWS), bench(spark), pass_windows=pass_windows)
    assert tuples(got, "doc_id", "n_words", "n_hit", "item_ids", "contaminated") == brute()
    longest = {r["doc_id"]: r["longest"] for r in got.collect()}
    assert longest[20] == 25 and longest[22] == 0


def test_only_affected_documents_go(spark):
    docs = documents(spark, ROWS)
    kept = contamination.drop_contaminated(docs, bench(spark))
    assert kept.columns == docs.columns
    assert tuples(kept, "doc_id") == sorted(((r[0],) for r in brute() if not r[4]), key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.find_matches(documents(spark, []), bench(spark)).count() == 0
    assert contamination.drop_contaminated(documents(spark, ROWS), none).count() == len(ROWS)


def test_suffix_array_finds_every_place():
    texts = [word_hashes(t, LETTER_WORDS) for t in ("a b c a b c a b", "x", "", "b c a b")]
    array = contamination.SuffixArray(texts, 3)
    which, text_, at = array.search(np.array([contamination.windows(texts[3], 3)[0], 12345], np.uint64))
    assert sorted(zip(which.tolist(), text_.tolist(), at.tolist())) == [(0, 0, 1), (0, 0, 4), (0, 3, 0)]
    assert (np.diff(array.keys.astype(object)) >= 0).all()
