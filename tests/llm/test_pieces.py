from hashlib import sha256

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from shoprank.llm.pieces import ChunkTable, encode_texts
from shoprank.llm.queries import piece_model
from tests.llm.common import AWKWARD, documents, tuples

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=piece_model())
TABLE = ChunkTable(piece_model(), limit=50)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁\n\t\r09aeé漢😀.,<>/s\x00​"), st.characters(exclude_categories=("Cs",))), max_size=40))
def test_ids_equal_the_library(text):
    rows = TABLE.encode(text)
    ids = [i for r in rows for i in r[3].tolist()]
    assert ids == LIBRARY.encode(text) and "".join(r[2] for r in rows)[1:] == LIBRARY.decode(ids)


def test_rows(spark):
    def want(text):
        ids = LIBRARY.encode(text or "")
        return len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(LIBRARY.decode(ids).encode()).hexdigest(), ids

    got = encode_texts(documents(spark, AWKWARD), piece_model(), with_ids=True)
    assert tuples(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids") == sorted(((i, *want(t)) for i, t in AWKWARD), key=repr)
    assert encode_texts(documents(spark, []), piece_model()).count() == 0


def test_a_model_with_pieces_over_blanks_is_refused(monkeypatch):
    class Crossing:
        def __init__(self, model_file):
            self.names = ["▁a", "b▁c"]

        get_piece_size = lambda self: 2                                  # noqa: E731
        id_to_piece = lambda self, i: self.names[i]                      # noqa: E731
        is_control = is_unknown = is_byte = lambda self, i: False        # noqa: E731

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError, match="white space"):
        ChunkTable("any")
