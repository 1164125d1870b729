"""Fill-in-the-middle: a text is cut at two token ranks and written with its middle last.

Ranks count tokens, cuts need code points. Each text gets an indexable skip list: the lowest lane holds its tokens, each
express lane above has one node for `fan` nodes below it, and a node carries how many tokens and how many code points it
spans. A search descends from the top lane, adding up widths, and ends exactly at the wanted rank.

Rules: a missing text counts as empty; an empty text and one that holds a sentinel stay plain. A missing id draws like the
empty id; equal ids draw equal numbers, so repeated rows get equal results. Lanes take a few bytes per token, so a long text
costs a small multiple of its own size; no text is cut short. Every row gives a row.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoprank.llm.common import per_text

PREFIX, SUFFIX, MIDDLE = SENTINELS = "<P>", "<S>", "<M>"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def token_widths(text: str) -> np.ndarray:
    """Code points of every token: runs of the letters A-Z and a-z, and single other code points."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    letter = _LETTER[raw]
    first = (raw & 0xC0) != 0x80
    starts = first.copy()
    starts[1:] &= ~(letter[1:] & letter[:-1])
    at = np.flatnonzero(starts)
    return np.add.reduceat(first, at, dtype=np.int32) if len(at) else np.zeros(0, np.int32)


class SkipList:
    """Tokens of one text with express lanes; every node carries its width in tokens and in code points."""

    def __init__(self, widths: np.ndarray, fan: int = 32):
        self.fan, self.size = fan, len(widths)
        self.units, self.points = [np.ones(len(widths), np.int64)], [widths]
        while len(self.points[-1]) > fan:
            at = np.arange(0, len(self.points[-1]), fan)
            self.units.append(np.add.reduceat(self.units[-1], at))
            self.points.append(np.add.reduceat(self.points[-1], at, dtype=np.int64))

    def code_points_before(self, rank: int) -> int:
        """Code points in front of the token with this rank (0 to size)."""
        if not 0 <= rank <= self.size:
            raise IndexError(rank)
        units = points = node = 0
        for lane in range(len(self.units) - 1, -1, -1):
            node *= self.fan
            ahead = np.cumsum(self.units[lane][node : node + self.fan])
            steps = int(np.searchsorted(ahead, rank - units, "right"))
            if steps:
                units += int(ahead[steps - 1])
                points += int(self.points[lane][node : node + steps].sum())
                node += steps
        return points


def draws(key: str, seed: int) -> list[int]:
    """Four unsigned numbers of 32 bits that depend on the seed and the key only."""
    h = sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def rebuild(output: str, form: str) -> str:
    """The text behind an output. No sentinel occurs in a transformed text, so the first occurrences are the cuts."""
    if form == "plain":
        return output
    if form == "psm":
        prefix, rest = output[len(PREFIX) :].split(SUFFIX, 1)
        suffix, middle = rest.split(MIDDLE, 1)
    else:
        suffix, rest = output[len(SUFFIX) :].split(PREFIX, 1)
        prefix, middle = rest.split(MIDDLE, 1)
    return prefix + middle + suffix


def transform(text: str, key: str, seed: int = 1, share: int = 90, spm: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, code points of prefix and middle, output) of one text.

    Of a hundred texts `share` are transformed, `spm` of a hundred of those with the suffix first.
    """
    tokens = SkipList(token_widths(text))
    h1, h2, h3, h4 = draws(key, seed)
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= share:
        return tokens.size, "plain", None, None, text
    low, high = sorted((h1 % (tokens.size + 1), h2 % (tokens.size + 1)))
    a, b = tokens.code_points_before(low), tokens.code_points_before(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return tokens.size, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return tokens.size, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, columns: list[str] | None = None, seed: int = 1, share: int = 90, spm: int = 20,
                   key: Column | None = None, with_text: bool = False) -> DataFrame:
    """Transforms every whole text.

    docs: doc_id, text and any other columns. Returns `columns` (doc_id) with n, form, prefix_chars, middle_chars,
    output_sha256 and restored_sha256; `with_text` adds output and restored. `key` names a row for the draws (doc_id). No row is shuffled.
    """
    names = columns or ["doc_id"]
    own = F.coalesce((F.col("doc_id") if key is None else key).cast("string"), F.lit(""))
    # the key travels in front of the text, divided from it by its length
    rows = docs.select(*names, F.concat(F.length(own), F.lit(":"), own, F.coalesce("text", F.lit(""))).alias("text"))

    def run(packed: str) -> tuple:
        size, rest = packed.split(":", 1)
        n, form, a, b, output = transform(rest[int(size) :], rest[: int(size)], seed, share, spm)
        restored = rebuild(output, form)
        out = (n, form, a, b, sha256(output.encode()).hexdigest(), sha256(restored.encode()).hexdigest())
        return (*out, output, restored) if with_text else out

    schema = ("n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
              + ", output string, restored string" * with_text)
    return per_text(rows, names, run, schema)
