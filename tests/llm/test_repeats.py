from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from shoprank.llm import repeats
from tests.llm.common import AWKWARD, documents, text, tuples

NAMES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows, size):
    raws = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(r[k:k + size] for _, r in raws for k in range(len(r) - size + 1))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - size + 1):
            if count[r[k:k + size]] > 1:
                gone[k:k + size] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((i, len(r), int(gone.sum()), int((edge == 1).sum()), sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def rows():
    rng = np.random.default_rng(3)
    words = [f"{k}{'äbc'[k % 3]}" for k in range(5000)]
    passage = " ".join(words[:120])
    out = [(i, t) for i, t in AWKWARD if i != 6]
    out += [(100 + k, text(k, 20) + passage[int(rng.integers(0, 200)): int(rng.integers(300, 560))] + text(k + 1, 30)) for k in range(30)]
    out += [(200 + k, passage) for k in range(3)]                        # copies
    out += [(300 + k, passage[:k * 7] + "#" + passage[k * 7:]) for k in range(12)]   # near copies
    out += [(400, "line one is this\n" * 60), (401, "ab" * 500), (402, "x" * 399), (403, "x" * 400), (404, passage[:400]), (405, passage[1:400])]
    return out


@pytest.mark.parametrize("size", [400, 96])
def test_equals_all_strings(spark, size):
    got = repeats.remove_repeats(documents(spark, rows()), size)
    assert tuples(got, *NAMES) == brute(rows(), size)


def test_spans_add_up(spark):
    for r in repeats.remove_repeats(documents(spark, rows())).collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_no_rows(spark):
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


def test_equal_strings_have_their_sample_at_equal_distance():
    rng = np.random.default_rng(8)
    core = bytes(rng.integers(97, 101, 700).astype(np.uint8))
    seen = set()
    for before in (b"", b"zq", core[:333]):
        place, first, last, _ = repeats.anchors(repeats.Fingers(before + core + b"tail" * 40))
        k = np.searchsorted(last, len(before) + 123)
        seen.add(int(place[k] - len(before)))
        assert first[k] <= len(before) + 123 <= last[k] and len(place) < 30
    assert len(seen) == 1
