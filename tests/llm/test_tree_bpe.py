from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shoprank.llm.queries import byte_model
from shoprank.llm.tree_bpe import MARGIN, TreeCoder, encode_texts, halves
from tests.llm.common import AWKWARD, documents, tuples

LIBRARY = Tokenizer.from_file(byte_model())
CODER = TreeCoder(byte_model())
# a window that has to grow, and parts encoded by the library itself
NARROW = TreeCoder(byte_model(), window=2)
NARROW.ranked = None


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


AWKWARD_CHARS = st.sampled_from(["'", "s", "'s", "'ll", " ", "  ", "\n", "\t", "a", "é", "漢", "😀", "1", "!", "<|endoftext|>", "<|endof", "text|>", "the", " the", "xx", "\x00", " ", " "])
TEXTS = st.lists(st.tuples(st.one_of(AWKWARD_CHARS, st.text(max_size=4)), st.sampled_from([1, 1, 1, 2, 7, 90])), max_size=60).map(
    lambda parts: "".join(p * n for p, n in parts).encode("utf-8", "ignore").decode())


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(1, 700))
def test_joined_halves_equal_the_library(text, part):
    for coder in (CODER, NARROW):
        ids = coder.concatenate([coder.encode(p) for p in halves(text, part)])
        assert ids.tolist() == library(text)


@pytest.mark.parametrize("unit", ["x", " ", "\n", "ab", "漢", "😀", "'s", "' ", "1", "<|endoftext|>", "<|endoftext|", "internationalisation", "!?", "aé", " \n", " ", "=-"])
@pytest.mark.parametrize("part", [1000, 4096])
def test_long_runs_without_a_break(unit, part):
    for text in (unit * (20_000 // len(unit)), "a " + unit * (9_000 // len(unit)) + " end's"):
        ids = CODER.concatenate([CODER.encode(p) for p in halves(text, part)])
        assert ids.tolist() == library(text) and CODER.decode(ids).decode() == text


def test_cut_at_every_place_of_a_break(seed=3):
    text = "It's  the\n\n mill's <|endoftext|>'s old '' wheel 'll  <|endoftext|>  \t12 34漢字 😀s"
    around = "abc def " * MARGIN
    whole = around + text + around
    want = library(whole)
    for k in range(len(around), len(around) + len(text)):
        assert CODER.join(CODER.encode(whole[:k]), CODER.encode(whole[k:])).tolist() == want


def test_only_windows_are_encoded_again(monkeypatch):
    left, right = CODER.encode("the old mill " * 5000), CODER.encode(" and the river" * 5000)
    seen = []
    monkeypatch.setattr(CODER, "encode", lambda t: seen.append(len(t)) or np.array(library(t), np.int32))
    CODER.join(left, right)
    assert sum(seen) < 3000


def test_other_models_are_left_to_the_library():
    import json

    from shoprank.llm.tree_bpe import rank_encoder

    assert rank_encoder(LIBRARY) is not None

    def changed(**parts):
        whole = json.loads(LIBRARY.to_str())
        for k, v in parts.items():
            whole[k] = v
        return rank_encoder(Tokenizer.from_str(json.dumps(whole)))

    model = json.loads(LIBRARY.to_str())["model"]
    assert changed(normalizer={"type": "Lowercase"}) is None
    assert changed(pre_tokenizer={"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}) is None
    assert changed(model={**model, "merges": model["merges"][::-1]}) is None


def test_every_kind_of_character_divides_words_alike():
    """One character of each category, every 97th of all: letters, digits, blanks and marks mean the same to both encoders."""
    import sys
    import unicodedata

    by_kind = {unicodedata.category(chr(c)): c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF}
    for c in {*by_kind.values(), *(c for c in range(0, sys.maxunicode, 97) if not 0xD800 <= c <= 0xDFFF)}:
        text = f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}? {chr(c)}{chr(c)} {chr(c)}\n'{chr(c)}s  {chr(c)}"
        assert CODER.encode(text).tolist() == library(text)


def test_halves_are_a_power_of_two():
    assert halves("", 3) == [""] and halves("abc", 3) == ["abc"] and len(halves("a" * 13, 3)) == 8
    assert "".join(halves("é" * 1001, 10)) == "é" * 1001 and max(map(len, halves("é" * 1001, 10))) <= 10


def test_rows(spark):
    rows = [*AWKWARD, (11, "y" * 50_000 + " <|endoftext|> z"), (12, "漢字 😀 " * 4_000), (12, "漢字 😀 " * 4_000), (None, "long " * 9_000)]

    def want(text):
        ids = library(text or "")
        return len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids

    got = encode_texts(documents(spark, rows), byte_model(), ["doc_id", "row"], part=1_000, with_ids=True)
    expected = sorted(((i, *want(t), t or "", "own row") for i, t in rows), key=repr)
    assert tuples(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded", "row") == expected
    assert encode_texts(documents(spark, []), byte_model()).count() == 0
    assert tuples(encode_texts(documents(spark, rows), byte_model()), "doc_id", "n_tokens") == sorted(((i, want(t)[0]) for i, t in rows), key=repr)
