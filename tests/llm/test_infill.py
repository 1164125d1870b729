import re
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shoprank.llm.infill import SkipList, fill_in_middle, rebuild, token_widths, transform
from tests.llm.common import AWKWARD, documents, tuples


def tokens(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text)


def plain(doc_id, text):
    """The definition, word for word."""
    t = tokens(text)
    h = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, text
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if h4 % 100 < 20:
        return len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = st.text(st.one_of(st.sampled_from("aZ <>PSM\n\r\x00é漢😀0"), st.characters(exclude_categories=("Cs",))), max_size=60)


@settings(max_examples=500, deadline=None)
@given(TEXTS, st.integers(0, 10_000))
def test_outputs_equal_the_definition_and_rebuild(text, doc_id):
    got = transform(text, str(doc_id))
    assert got == plain(doc_id, text) and rebuild(got[4], got[1]) == text


@pytest.mark.parametrize("fan", [2, 3, 32])
@pytest.mark.parametrize("size", [0, 1, 2, 31, 32, 33, 1024, 1025, 5000])
def test_every_rank_of_a_skip_list(size, fan):
    text = "".join(("word" * (k % 3 + 1), "é", " ", "漢")[k % 4] for k in range(size))
    parts = tokens(text)
    skip, at = SkipList(token_widths(text), fan), 0
    assert skip.size == len(parts) and all(len(u) <= fan for u in skip.units[-1:] if size > fan)
    for rank in range(0, len(parts) + 1):
        assert skip.code_points_before(rank) == at
        at += len(parts[rank]) if rank < len(parts) else 0
    with pytest.raises(IndexError):
        skip.code_points_before(len(parts) + 1)


def test_rows(spark):
    rows = [*AWKWARD, (20, "a <P> b"), (21, "<S>"), (22, "x<M"), (23, "<<S"), (24, "P>"), (25, "w " * 60_000)]
    got = fill_in_middle(documents(spark, rows), with_text=True)

    def want(doc_id, text):
        n, form, a, b, out = plain(doc_id, text or "")
        return doc_id, n, form, a, b, sha256(out.encode()).hexdigest(), sha256((text or "").encode()).hexdigest(), out, text or ""

    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output", "restored")
    assert tuples(got, *names) == sorted((want(*r) for r in rows), key=repr)
    assert fill_in_middle(documents(spark, [])).count() == 0
    assert tuples(fill_in_middle(documents(spark, [(1, "a b")]), columns=["row", "spans"]), "row", "spans") == [("own row", "own spans")]
