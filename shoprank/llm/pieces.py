"""SentencePiece encoding and decoding by a table of distinct chunks."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

MARK = "▁"


class ChunkTable:
    """Segments each distinct chunk once and keeps its ids; what a text needs is joined back by position.

    A chunk is a run of marks with the characters up to the next mark. No piece of the vocabulary has a
    mark behind another character, and characters that occur in no longer piece (line ends, digits, ...)
    merge with nothing, so a chunk also ends before each of them. The table is emptied when it holds
    `limit` chunks, which bounds its memory and changes no result; chunks over `long` characters are not kept.
    """

    def __init__(self, model: str, limit: int = 200_000, long: int = 64):
        import sentencepiece

        self.sp, self.limit, self.long = sentencepiece.SentencePieceProcessor(model_file=model), limit, long
        sp = self.sp
        ordinary = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(MARK in p.lstrip(MARK) for p in ordinary):
            raise ValueError("pieces of this model cross white space; chunks cannot be segmented alone")
        merging = {c for p in ordinary if len(p) > 1 for c in p}
        self.alone = "".join(chr(c) for c in range(128) if chr(c) not in merging and c != 32)
        bound = re.escape(self.alone)
        self.split = re.compile(f"{MARK}+[^{MARK}{bound}]*|[{bound}][^{MARK}{bound}]*" if bound else f"{MARK}+[^{MARK}]*").findall
        self.mark, self.probe = sp.piece_to_id(MARK), sp.encode("a")
        self.known: dict[str, tuple] = {}

    def segment(self, chunks: list[str]) -> list[tuple]:
        """Ids in decimal, joined by commas, number of ids, decoded text and ids of each chunk."""
        marked = [c[0] == MARK for c in chunks]
        found = self.sp.encode([c[1:].replace(MARK, " ") if m else c for c, m in zip(chunks, marked, strict=True)], num_threads=1)
        ids = [(x or [self.mark]) if m else x[1:] for x, m in zip(found, marked, strict=True)]
        text = self.sp.decode([self.probe + x for x in ids], num_threads=1)
        return [(",".join(map(str, x)), len(x), t[1:], np.array(x, np.int32)) for x, t in zip(ids, text, strict=True)]

    def encode(self, text: str) -> list[tuple]:
        """Table rows of the text's chunks, in order."""
        if not text:
            return []
        chunks = self.split((MARK + text).replace(" ", MARK))
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        new = [c for c in dict.fromkeys(chunks) if c not in known]
        rows = dict(zip(new, self.segment(new), strict=True)) if new else {}
        known.update((c, r) for c, r in rows.items() if len(c) <= self.long)
        return [known.get(c) or rows[c] for c in chunks]


def coder(model: str, with_ids: bool = False) -> Callable[[str], tuple]:
    """(n_tokens, SHA-256 of the ids in decimal, SHA-256 of the decoded text and, if asked for, the ids and the text) of one text.

    One table per Python task serves all its texts.
    """
    from hashlib import sha256

    state: list[ChunkTable] = []

    def run(text: str) -> tuple:
        if not state:
            state.append(ChunkTable(model))
        rows = state[0].encode(text)
        ids, decoded = ",".join([r[0] for r in rows]), "".join([r[2] for r in rows])
        decoded = decoded[1:] if rows else ""
        out = (sum([r[1] for r in rows]), sha256(ids.encode()).hexdigest(), sha256(decoded.encode()).hexdigest())
        return (*out, np.concatenate([r[3] for r in rows] or [np.zeros(0, np.int32)]), decoded) if with_ids else out

    return run


def encode_texts(docs, model: str, columns: list[str] | None = None, with_ids: bool = False):
    """Encodes and decodes every whole text exactly as the library does with this model.

    docs: doc_id, text and any other columns. Returns `columns` (doc_id) with n_tokens, ids_sha256 and
    decoded_sha256; `with_ids` adds ids (array) and decoded. Null and empty texts have
    no ids; every row gives a row, repeated rows and missing ids included. No row is shuffled.
    """
    from shoprank.llm.common import per_text

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return per_text(docs, columns or ["doc_id"], coder(model, with_ids), schema)
