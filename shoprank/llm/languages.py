"""Language identification: unigram pieces per language, summed over all segmentations."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoprank.llm.common import Scratch, id_bucket, packed, schema_of, slices, unpacked

MARK = "▁"
EM_ROUNDS = 2
#: probability of a character that no piece covers; added count of every piece; longest word summed without rescaling
UNKNOWN, SMOOTH, PLAIN = 1e-7, 0.02, 32
#: words a task remembers before it starts anew (bounds its memory, changes no result)
REMEMBER = 200_000
#: odd factor of the rolling hash under which pieces are looked up
FACTOR = 0x9E3779B97F4A7C15


def _other_numerals() -> str:
    """Characters that count as word characters and are neither letters nor decimal digits (fractions, superscripts, Roman numerals), as ranges."""
    found = {c for c in range(sys.maxunicode + 1) if chr(c).isalnum() and unicodedata.category(chr(c))[0] != "L" and not chr(c).isdecimal()}
    firsts, lasts = sorted(c for c in found if c - 1 not in found), sorted(c for c in found if c + 1 not in found)
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(firsts, lasts, strict=True))


ALMOST = re.compile(r"[^\W\d_]+")
LETTERS = re.compile(rf"[^\W\d_{_other_numerals()}]+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters (Unicode categories L*)."""
    words = ALMOST.findall(text.lower())
    # the quick pattern takes some numerals for letters; few texts hold any
    if not words or "".join(words).isalpha():
        return words
    return [part for w in words for part in ([w] if w.isalpha() else LETTERS.findall(w))]


class Lattice:
    """The pieces of a public vocabulary as edges over marked words."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.ids = {p: k for k, p in enumerate(names)}
        self.size = len(names)                                # two more columns: unknown characters, and no edge
        self.longest = max(map(len, names))
        self.index = pd.Index([self.hash_of(p) for p in names], dtype="uint64")
        if not self.index.is_unique:
            raise ValueError("two pieces have one hash")

    @staticmethod
    def hash_of(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * FACTOR + ord(c) + 1) % 2**64
        return h

    def edges(self, words: list[str]) -> np.ndarray:
        """Piece of [word, start, length - 1] for marked words of one length."""
        n, length = len(words), len(words[0])
        reach = min(self.longest, length)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length).astype(np.uint64) + np.uint64(1)
        out = np.full((n, length, reach), self.size + 1, np.int32)
        h = np.zeros((n, length), np.uint64)
        for k in range(reach):
            h = h[:, : length - k] * np.uint64(FACTOR) + chars[:, k:]
            found = self.index.get_indexer(h.ravel()).reshape(h.shape)
            out[:, : length - k, k] = np.where(found < 0, self.size + (k > 0), found)
        return out


def with_extra(p: np.ndarray) -> np.ndarray:
    """Piece probabilities (languages x pieces) with the columns for unknown characters and for no edge, pieces first."""
    return np.concatenate([p, np.full((len(p), 1), UNKNOWN), np.zeros((len(p), 1))], 1).T.copy()


def forward(edges: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probability of every start of the words, summed over all segmentations: [position, word, language]."""
    n, length, reach = edges.shape
    a = np.zeros((length + 1, n, p.shape[1]))
    a[0] = 1
    for i in range(length):
        for k in range(min(reach, length - i)):
            a[i + k + 1] += a[i] * p[edges[:, i, k]]
    return a


def backward(edges: np.ndarray, p: np.ndarray) -> np.ndarray:
    n, length, reach = edges.shape
    b = np.zeros((length + 1, n, p.shape[1]))
    b[length] = 1
    for i in range(length - 1, -1, -1):
        for k in range(min(reach, length - i)):
            b[i] += p[edges[:, i, k]] * b[i + k + 1]
    return b


def long_word(lattice: Lattice, word: str, p: np.ndarray) -> np.ndarray:
    """Log probability of one long marked word, rescaled at every position."""
    recent, log = [np.ones(p.shape[1])], np.zeros(p.shape[1])
    for end in range(1, len(word) + 1):
        a = np.zeros(p.shape[1])
        for k in range(1, min(lattice.longest, end) + 1):
            piece = lattice.ids.get(word[end - k : end], lattice.size if k == 1 else -1)
            if piece >= 0:
                a += recent[-k] * p[piece]
        recent = [r / a for r in recent[-lattice.longest + 1 :]] + [np.ones(p.shape[1])]
        log += np.log(a)
    return log


def long_counts(lattice: Lattice, word: str, q: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Expected number of times each piece is used in one long marked word under one language, over all its segmentations.

    Forward and backward sums are kept as logarithms; edges are looked up in parts, so a word takes some bytes per character.
    """
    length = len(word)
    with np.errstate(divide="ignore"):
        logs = np.log(q)
    starts = range(0, length, step)

    def edges(lo: int) -> np.ndarray:
        return lattice.edges([word[lo : lo + step + lattice.longest]])[0][: min(step, length - lo)]

    ahead, behind = np.full(length + 1, -np.inf), np.full(length + 1, -np.inf)
    ahead[0] = behind[length] = 0.0
    for lo in starts:
        w = logs[edges(lo)]
        for i in range(len(w)):
            to = slice(lo + i + 1, min(lo + i + 1 + w.shape[1], length + 1))
            ahead[to] = np.logaddexp(ahead[to], ahead[lo + i] + w[i, : to.stop - to.start])
    counts = np.zeros(len(q))
    for lo in reversed(starts):
        e = edges(lo)
        w = logs[e]
        for i in reversed(range(len(w))):
            to = slice(lo + i + 1, min(lo + i + 1 + w.shape[1], length + 1))
            through = w[i, : to.stop - to.start] + behind[to]
            behind[lo + i] = np.logaddexp.reduce(through)
            np.add.at(counts, e[i, : len(through)], np.exp(ahead[lo + i] + through - ahead[length]))
    return counts


def by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    return groups


def word_logs(lattice: Lattice, words: list[str], p: np.ndarray) -> np.ndarray:
    """Log probability of each word under each language: [word, language]."""
    out = np.empty((len(words), p.shape[1]))
    marked = [MARK + w for w in words]
    for length, at in by_length(marked).items():
        if length > PLAIN:
            for k in at:
                out[k] = long_word(lattice, marked[k], p)
        else:
            for lo in range(0, len(at), 4096):
                part = at[lo : lo + 4096]
                out[part] = np.log(forward(lattice.edges([marked[k] for k in part]), p)[-1])
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over the whole texts; tasks add up before the shuffle."""
    def run(batches):
        count: Counter = Counter()

        def flush():
            if count:
                keys = list(count)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([count[k] for k in keys], pa.int64())], ["lang", "word", "n"])
                count.clear()

        for batch in (part for whole in batches for part in slices(whole, 1)):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, n in Counter(words_of(text)).items():
                    count[lang, w] += n
            if len(count) > 2 * REMEMBER:
                yield from flush()
        yield from flush()

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, model: str, rounds: int = EM_ROUNDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, piece probabilities, log prior) from rows (lang, text): expectation maximisation over the word counts.

    The driver gets one number per language and piece of the fixed vocabulary.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    prior = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(prior)
    lattice = Lattice(model)
    if not langs:
        return [], np.zeros((0, lattice.size)), np.zeros(0)
    words = scratch.write(word_counts(known))
    p = np.full((len(langs), lattice.size), 1 / lattice.size)
    for _ in range(rounds):
        box = spark.sparkContext.broadcast(with_extra(p))

        def expect(batches, box=box):
            table, probs = Lattice(model), box.value
            place = {x: k for k, x in enumerate(langs)}
            total = np.zeros((len(langs), table.size + 2))
            for b in batches:
                words, n = [MARK + w for w in b.column(1).to_pylist()], b.column(2).to_numpy().astype(float)
                lang = np.array([place[x] for x in b.column(0).to_pylist()], np.int64)
                for length, at in by_length(words).items():
                    if length > PLAIN:
                        for x in at:
                            total[lang[x]] += n[x] * long_counts(table, words[x], probs[:, lang[x]])
                        continue
                    for lo in range(0, len(at), 4096):
                        part = np.array(at[lo : lo + 4096])
                        for k in np.unique(lang[part]):
                            own = part[lang[part] == k]
                            e = table.edges([words[x] for x in own])
                            q = probs[:, k : k + 1]
                            fw, bw = forward(e, q)[:, :, 0], backward(e, q)[:, :, 0]
                            each = n[own] / fw[-1]
                            weight = q[:, 0][e]
                            for i in range(e.shape[1]):
                                for j in range(min(e.shape[2], e.shape[1] - i)):
                                    weight[:, i, j] *= each * fw[i] * bw[i + j + 1]
                            total[k] += np.bincount(e.ravel(), weight.ravel(), total.shape[1])
            lang, piece = np.nonzero(total[:, : table.size])
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(piece), pa.array(total[lang, piece])], ["lang", "piece", "n"])

        found = words.mapInArrow(expect, "lang long, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        count = np.full(p.shape, SMOOTH)
        count[found["lang"].to_numpy(int), found["piece"].to_numpy(int)] += found["n"].to_numpy(float)
        p = count / count.sum(1, keepdims=True)
    scratch.drop(words)
    total = np.array([prior[x] for x in langs], float)
    return langs, p, np.log(total / total.sum())


def predict(docs: DataFrame, trained: tuple[list[str], np.ndarray, np.ndarray], model: str, columns: list[str]) -> DataFrame:
    """`columns` of every row with lang_pred and score (the posterior probability of lang_pred) from its whole text."""
    langs, p, prior = trained
    box = docs.sparkSession.sparkContext.broadcast(with_extra(p))
    kept = docs.select(*columns, F.col("text").alias("__text"))

    def run(batches):
        lattice, known, logs = Lattice(model), {}, np.zeros((0, len(langs)))
        for batch in (part for whole in batches for part in slices(whole, len(columns))):
            tokens = [words_of(x or "") for x in batch.column(len(columns)).to_pylist()]
            if len(known) > REMEMBER:
                known, logs = {}, np.zeros((0, len(langs)))
            new = [w for w in dict.fromkeys(w for t in tokens for w in t) if w not in known] if langs else []
            if new:
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                logs = np.concatenate([logs, word_logs(lattice, new, box.value)])
            best, score = [], []
            for t in tokens:
                if not t or not langs:
                    best.append("und")
                    score.append(0.0)
                    continue
                x = logs[[known[w] for w in t]].sum(0) + prior
                x = np.exp(x - x.max())
                best.append(langs[int(x.argmax())])
                score.append(float(x.max() / x.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best, pa.string()), pa.array(score, pa.float64())], [*columns, "lang_pred", "score"])

    return kept.mapInArrow(run, schema_of(kept.select(*columns), "lang_pred string, score double"))


def identify(docs: DataFrame, model: str, columns: list[str] | None = None, folds: int = 5) -> DataFrame:
    """Language of every whole text: `columns` (doc_id), held_out, lang_pred, score.

    docs: doc_id, text, lang; other columns are not read unless named. Learns from text and lang of the rows
    whose id bucket of `folds` is not 0. A text without letters (or null) gives `und` and 0; so does every
    text if no language is known. Equally likely languages: the first by name. Every row gives a row, repeated rows and missing ids (bucket 0) included.
    """
    columns = columns or ["doc_id"]
    held = id_bucket("doc_id", folds) == 0
    trained = train(docs.where(~held).select("lang", "text"), model)
    found = predict(docs.withColumn("held_out", held), trained, model, [*columns, "held_out"])
    return found.select(*columns, "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, model: str, least: float = 0.5) -> DataFrame:
    """Documents whose language is recognised: not `und`, and likelier than all others together (score >= `least`).

    Columns and kept rows stay as they are.
    """
    found = identify(packed(docs), model, ["row", "text"])
    return unpacked(found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)), docs.columns)
