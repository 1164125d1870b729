"""Byte-level BPE of whole texts by tree concatenation.

A long text is halved until its parts are short. The parts are rows of their own, dealt over the cluster and encoded side by
side; neighbours are then joined pairwise up the tree. At a join the last tokens of the left and the first tokens of the
right half are decoded and encoded again as one window, which grows until the window's ids agree with both halves: with the
left one behind its start, with the right one before its end. What lies between these two places replaces the halves' ids.

Why this is exact: BPE ids of a word are those whose neighbours, taken pairwise, are encoded as themselves, and every pair of
the joined list stands next to each other in one of the three encodings. Where words and special tokens end depends on a few
characters beside the place, so agreement counts `MARGIN` bytes away from the window's ends and from the join only. A
window that has grown over both halves is the whole text.

Rules: missing and empty texts have no ids. The text of a special token counts as that token, as in the library. Every row
gives a row, repeated rows and missing ids included; rows of one long text meet by a number dealt to the row, not by its id,
so a hot id is no hot group: a group is one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from shoprank.llm.common import Scratch, slices

#: bytes on either side of a place that can decide whether a word or a special token ends there, with room to spare
MARGIN = 128


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes: printable Latin-1 for itself, the rest from 256 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + k): b for k, b in enumerate(rest)}}


# Fixed value: how byte-level pre-tokenization divides a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def rank_encoder(tokenizer):
    """The same vocabulary for an encoder that merges by rank and builds no offsets, or None if it could encode otherwise.

    It gives the same ids if ids rise in the order of the merges, words are divided by `WORDS` alone and special tokens
    are plain strings.
    """
    import json

    import tiktoken

    whole = json.loads(tokenizer.to_str())
    model, words, special = whole["model"], whole["pre_tokenizer"] or {}, whole["added_tokens"]
    if (model.get("type") != "BPE" or whole["normalizer"] or words.get("type") != "ByteLevel" or words.get("add_prefix_space") or not words.get("use_regex", True)
            or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
            or any(t[k] for t in special for k in ("single_word", "lstrip", "rstrip", "normalized"))):
        return None
    vocabulary, alphabet = model["vocab"], byte_alphabet()
    merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])) or len(vocabulary) != 256 + len(merged) or any(c not in alphabet for t in vocabulary for c in t):
        return None
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocabulary.items()}
    return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in special})


class TreeCoder:
    """Encodes parts as the library does and joins their ids."""

    def __init__(self, model: str, window: int = 512):
        from tokenizers import Tokenizer

        self.tokenizer, self.window = Tokenizer.from_file(model), window
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        alphabet = byte_alphabet()
        self.bytes_of: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        special = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if any(len(t) > MARGIN // 2 for t in special.values()):
            raise ValueError("a special token of this model is longer than the margin of a join allows")
        self.bytes_of.update(special)
        self.size = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.size[i] = len(b)
        self.ranked = rank_encoder(self.tokenizer)
        self.decimal = [str(i) for i in range(len(self.size))]

    def encode(self, text: str) -> np.ndarray:
        if self.ranked is not None:
            return self.ranked.encode_to_numpy(text, allowed_special="all").astype(np.int32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the ids in decimal."""
        return sha256(",".join([self.decimal[i] for i in ids.tolist()]).encode()).hexdigest()

    def text_of(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids.tolist()])

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids in UTF-8."""
        if self.ranked is not None:
            return self.ranked.decode_bytes(ids.tolist())
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()

    def _tail(self, ids: np.ndarray, want: int) -> int:
        """Tokens to leave out so that the rest begins at a character and has at least `want` bytes."""
        behind = np.cumsum(self.size[ids[::-1]])
        k = len(ids) - int(np.searchsorted(behind, want) + 1)
        while k > 0 and self.bytes_of[int(ids[k])][0] & 0xC0 == 0x80:
            k -= 1
        return max(k, 0)

    def _head(self, ids: np.ndarray, want: int) -> int:
        """Tokens to take so that they end at a character and have at least `want` bytes."""
        k = int(np.searchsorted(np.cumsum(self.size[ids]), want) + 1)
        while k < len(ids) and self.bytes_of[int(ids[k])][0] & 0xC0 == 0x80:
            k += 1
        return min(k, len(ids))

    def _common(self, window: np.ndarray, half: np.ndarray, shift: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Where both lists have the same token between the bytes `low` and `high` of the half, which begins `shift` bytes into the window."""
        a, b = np.cumsum(self.size[window]) - self.size[window] - shift, np.cumsum(self.size[half]) - self.size[half]
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        same = (window[i] == half[j]) & (b[j] >= low) & (b[j] + self.size[half[j]] <= high)
        return i[same], j[same]

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the two halves' texts put together."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        want = self.window
        while True:
            a, b = self._tail(left, want), self._head(right, want)
            tail, head = left[a:], right[:b]
            before, after = self.text_of(tail), self.text_of(head)
            middle = self.encode((before + after).decode())
            # a window that holds a whole half needs no agreement with it
            start, keep_left, stop, keep_right = 0, 0, len(middle), len(right)
            agreed = True
            if a > 0:
                i, j = self._common(middle, tail, 0, MARGIN, len(before) - MARGIN)
                agreed = len(i) > 0
                if agreed:
                    start, keep_left = int(i[0]), a + int(j[0])
            if b < len(right):
                i, j = self._common(middle, head, len(before), MARGIN, len(after) - MARGIN)
                agreed = agreed and len(i) > 0
                if agreed:
                    stop, keep_right = int(i[-1]), int(j[-1])
            if agreed:
                return np.concatenate([left[:keep_left], middle[start:stop], right[keep_right:]])
            want *= 2

    def concatenate(self, parts: list[np.ndarray]) -> np.ndarray:
        """Ids of all parts' texts put together, joined pairwise up the tree."""
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else np.zeros(0, np.int32)


def halves(text: str, part: int) -> list[str]:
    """The text halved until no piece has more than `part` characters: a power of two of pieces, in order."""
    n = 1
    while len(text) > part * n:
        n *= 2
    cut = [len(text) * k // n for k in range(n + 1)]
    return [text[a:b] for a, b in zip(cut, cut[1:])]


def encode_texts(docs: DataFrame, model: str, columns: list[str] | None = None, part: int = 16_384, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text exactly as the library does with this model.

    docs: doc_id, text and any other columns. Returns `columns` (doc_id) with n_tokens, ids_sha256 and decoded_sha256;
    `with_ids` adds ids (array) and decoded. One pass finishes texts of up to `part` characters and halves the others; the
    halves are a written table, whose rows are encoded wherever there is room. Only ids of long texts are shuffled to be joined.
    """
    scratch, names = Scratch(docs.sparkSession), columns or ["doc_id"]
    results = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.monotonically_increasing_id().alias("key"), F.coalesce("text", F.lit("")).alias("text"))

    def coder() -> TreeCoder:
        import sys
        import types

        # one coder per Python process; functions travel by value, so it hangs on a module of its own
        store = sys.modules.setdefault("_tree_coders", types.ModuleType("_tree_coders")).__dict__
        if model not in store:
            store[model] = TreeCoder(model)
        return store[model]

    def result(ids: np.ndarray) -> tuple:
        decoded = coder().decode(ids)
        out = (len(ids), coder().digest(ids), sha256(decoded).hexdigest())
        return (*out, ids, decoded.decode()) if with_ids else out

    own = StructType([StructField(f.name, f.dataType) for f in kept.schema.fields])
    first = StructType([*own.fields, *StructType.fromDDL(f"at int, parts int, {results}").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(first)
        for batch in (piece for whole in batches for piece in slices(whole, 2)):
            texts = batch.column(2).to_pylist()
            short = [k for k, t in enumerate(texts) if len(t) <= part]
            done = {k: result(coder().encode(texts[k])) for k in short}
            # (row, text of a piece, its place, pieces, results)
            out = [(k, None, 0, 1, done[k]) if k in done else (k, piece, i, len(pieces), (None,) * (5 if with_ids else 3))
                   for k, t in enumerate(texts) for pieces in ([t] if k in done else halves(t, part),) for i, piece in enumerate(pieces)]
            rows = pa.array([o[0] for o in out], pa.int64())
            columns_ = [batch.column(0).take(rows).cast(target.field(0).type), batch.column(1).take(rows), [o[1] for o in out], [o[2] for o in out], [o[3] for o in out], *zip(*[o[4] for o in out])]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns_, target, strict=True)], schema=target)

    table = scratch.write(kept.mapInArrow(cut, first))
    encoded = StructType([first["key"], first["at"], first["row"], *StructType.fromDDL("ids binary").fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(encoded)
        for batch in batches:
            ids = [coder().encode(t).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(target.field(2).type), pa.array(ids, pa.binary())], schema=target)

    whole = StructType([first["row"], *StructType.fromDDL(results).fields])

    def put_together(rows: pa.Table) -> pa.Table:
        target, rows = to_arrow_schema(whole), rows.sort_by("at")
        ids = coder().concatenate([np.frombuffer(b, np.int32) for b in rows.column("ids").to_pylist()])
        values = [pa.array([v], f.type) for v, f in zip(result(ids), list(target)[1:], strict=True)]
        return pa.Table.from_arrays([rows.column("row").slice(0, 1).cast(target.field(0).type), *values], schema=target)

    pieces = table.where("text is not null").select("key", "at", "row", "text").repartition("key", "at").mapInArrow(encode, encoded)
    joined = pieces.groupBy("key").applyInArrow(put_together, whole)
    return table.where("text is null").select("row", *joined.columns[1:]).unionByName(joined).select("row.*", *joined.columns[1:])
