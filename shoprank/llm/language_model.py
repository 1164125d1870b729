"""Language-model scores: a hashed maximum-entropy model over learned word classes, on top of word frequencies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoprank.llm.common import ODD, Scratch, id_bucket, mix, slices, word_hashes

#: classes, classes within a class, rows of the hashed feature tables, distributed updates in one pass over the corpus
OUTER, INNER, ROWS, UPDATES = 8, 8, 1 << 14, 4
BATCH, RATE = 8192, 0.08
#: most frequent words every task holds; the others' counts are joined
FREQUENT = 200_000
#: distinct words, or pairs of word and neighbour, a task adds up before it hands them on
HELD = 500_000
#: groups of neighbours on either side that tell words apart, most frequent words that the classes are centred by, counts of the
#: average word that a word's own neighbours are added to, occurrences from which on a word has a class of its own, rounds of the clustering
SIDES, CENTRED, PRIOR, LEAST, ROUNDS = 64, 2048, 8, 16, 12
END, BEGIN = np.array([0x5851F42D4C957F2D], np.uint64), np.uint64(0x14057B7EF767814F)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words and one end."""
    return np.concatenate([word_hashes(text or ""), END])


class Classes:
    """Sorted words with the class (outer * INNER + inner) each has learned; all other words share the class `rest`."""

    def __init__(self, words: np.ndarray, leaf: np.ndarray, rest: int):
        self.words, self.leaf, self.rest = words, leaf.astype(np.int64), rest

    def of(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.leaf[at], self.rest)


def leaf_of(h: np.ndarray, classes: Classes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Outer and inner class of a word; from its hash where no classes were learned."""
    top = (h >> np.uint64(58)).astype(np.int64) if classes is None else classes.of(h)
    return top // INNER, top % INNER


def context(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens and the hashes of their features: word before, the two before, and the one before that (skip)."""
    flat = np.concatenate(lists)
    one, two = np.empty_like(flat), np.empty_like(flat)
    one[1:], two[2:] = flat[:-1], flat[:-2]
    start = np.cumsum([0, *[len(x) for x in lists[:-1]]])
    one[start] = two[start] = BEGIN
    second = start[np.array([len(x) > 1 for x in lists])] + 1
    two[second] = BEGIN
    return flat, np.stack([mix(one * ODD[0]), mix(one * ODD[1] + two * ODD[2]), mix(two * ODD[3])], 1)


class Model:
    """P(word | context) = P(outer | context) P(inner | outer, context) P(word | inner), two softmaxes over hashed features."""

    def __init__(self, base: np.ndarray, classes: Classes | None = None):
        """base: frequency of each (outer, inner) class; the biases start there. classes: the words' classes, where they were learned."""
        self.base, self.word_classes = base / base.sum(), classes
        self.bias = np.log(self.base.sum(1)).astype(np.float32)
        self.bias2 = np.log(self.base / self.base.sum(1, keepdims=True)).astype(np.float32)
        self.w, self.w2 = np.zeros((ROWS, OUTER), np.float32), np.zeros((ROWS, INNER), np.float32)

    def state(self) -> tuple[np.ndarray, ...]:
        return self.base, self.w, self.w2, self.word_classes

    @classmethod
    def of(cls, state: tuple[np.ndarray, ...]) -> Model:
        """A model of its own with copies of the weights."""
        new = cls(state[0], state[3])
        new.w, new.w2 = state[1].copy(), state[2].copy()
        return new

    def rows(self, features: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(ROWS - 1)
        return (features & mask).astype(np.int64), ((features >> np.uint64(20)) + outer[:, None].astype(np.uint64) * ODD[4] & mask).astype(np.int64)

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        return z

    @staticmethod
    def summed(w: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Sum of the weight rows of each token's features; a feature at a time, which makes no array of all of them."""
        out = w[f[:, 0]]
        for k in range(1, f.shape[1]):
            out += w[f[:, k]]
        return out

    def classes(self, f: np.ndarray, f2: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.softmax(self.bias + self.summed(self.w, f)), self.softmax(self.bias2[outer] + self.summed(self.w2, f2))

    def gains(self, flat: np.ndarray, features: np.ndarray) -> np.ndarray:
        """log10 of what the context changes about each token's probability."""
        out = np.empty(len(flat))
        for at in range(0, len(flat), BATCH):
            outer, inner = leaf_of(flat[at : at + BATCH], self.word_classes)
            p, q = self.classes(*self.rows(features[at : at + BATCH], outer), outer)
            k = np.arange(len(outer))
            out[at : at + BATCH] = np.log10(p[k, outer].astype(float) * q[k, inner] / self.base[outer, inner])
        return out

    def learn(self, flat: np.ndarray, features: np.ndarray, squares: list[np.ndarray]) -> None:
        """One pass of adaptive gradient steps over the tokens."""
        for at in range(0, len(flat), BATCH):
            outer, inner = leaf_of(flat[at : at + BATCH], self.word_classes)
            f, f2 = self.rows(features[at : at + BATCH], outer)
            p, q = self.classes(f, f2, outer)
            k = np.arange(len(outer))
            p[k, outer] -= 1
            q[k, inner] -= 1
            for w, rows, g, total in ((self.w, f, p, squares[0]), (self.w2, f2, q, squares[1])):
                row = rows.ravel().astype(np.min_scalar_type(len(w) - 1))    # 16 bits, which numpy sorts by counting
                order = np.argsort(row, kind="stable")
                row = row[order]
                first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
                step = np.add.reduceat(g[order // rows.shape[1]], first, axis=0)
                row = row[first]
                total[row] += (step * step).mean(1)
                w[row] -= RATE * step / np.sqrt(total[row] + 1.0)[:, None]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the whole texts, ends left out; tasks add up before the shuffle."""
    def run(batches):
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

        for batch in (part for whole in batches for part in slices(whole, 0, 2_000_000)):
            new, n = np.unique(np.concatenate([word_hashes(t or "") for t in batch.column(0).to_pylist()]), return_counts=True)
            both, place = np.unique(np.concatenate([words, new]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n]), len(both)).astype(np.int64)
            words = both
            if len(words) > HELD:
                yield rows()
                words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield rows()

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def neighbour_counts(docs: DataFrame, box) -> DataFrame:
    """(word, side, n): how often the words of a broadcast (sorted words, their numbers) stand beside a neighbour of each group.

    Neighbours are grouped by hash: 0 to SIDES - 1 hold the word before, SIDES to 2 SIDES - 1 the word behind; a text's begin counts as
    a word. All texts are read whole, tasks add up before the shuffle.
    """
    def run(batches):
        words, number = box.value
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(keys // (2 * SIDES)), pa.array(keys % (2 * SIDES)), pa.array(counts)], ["word", "side", "n"])

        for batch in (part for whole in batches for part in slices(whole, 0, 2_000_000)):
            lists = [tokens(t) for t in batch.column(0).to_pylist()]
            flat = np.concatenate(lists)
            group = (mix(flat * ODD[5]) % np.uint64(SIDES)).astype(np.int64)
            first = np.zeros(len(flat), bool)
            first[np.cumsum([0, *[len(x) for x in lists[:-1]]])] = True
            before = np.where(first, int(BEGIN % np.uint64(SIDES)), np.roll(group, 1))
            at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
            there = words[at] == flat
            row = number[at] * (2 * SIDES)
            follows = np.flatnonzero(there[:-1] & ~first[1:])
            new, n = np.unique(np.concatenate([(row + before)[there], row[follows] + SIDES + group[follows + 1]]), return_counts=True)
            keys, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            if len(keys) > HELD:
                yield rows()
                keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield rows()

    return docs.select("text").mapInArrow(run, "word long, side long, n long").groupBy("word", "side").agg(F.sum("n").alias("n"))


def profiles(counts: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Square roots of the shares of each word's neighbours, PRIOR average neighbours added."""
    counts = counts + PRIOR * mean
    return np.sqrt(counts / counts.sum(1, keepdims=True))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)


def centred(x: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """`k` centres of the weighted rows."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=len(x) < k, p=weight / weight.sum())]
    for _ in range(ROUNDS):
        at = nearest(x, centres)
        for j in np.unique(at):
            centres[j] = np.average(x[at == j], axis=0, weights=weight[at == j])
    return centres


def class_of_profile(x: np.ndarray, outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """The class of each row: the nearest outer centre, then the nearest of its inner ones."""
    top = nearest(x, outer)
    leaf = np.zeros(len(x), np.int64)
    for j in np.unique(top):
        leaf[top == j] = j * INNER + nearest(x[top == j], inner[j])
    return leaf


def learn_classes(docs: DataFrame, scratch: Scratch, words: np.ndarray, n: np.ndarray) -> Classes | None:
    """Classes of the given words (sorted, with their counts) by the words that stand beside them in all of `docs`.

    The centres are those of the CENTRED most frequent words, OUTER of them and INNER within each; the tasks put every given
    word to the nearest. Words that are not given, or that occur fewer than LEAST times, have too few neighbours to be told
    apart: they share the class that is least frequent so far.
    """
    words, n = words[n >= LEAST], n[n >= LEAST]
    if not len(words):
        return None
    spark, number = docs.sparkSession, np.empty(len(words), np.int64)
    number[np.lexsort((words, -n))] = np.arange(len(words))
    box = spark.sparkContext.broadcast((words, number))

    def pack(batches):
        for batch in batches:
            lists = batch.column(1).to_pylist()
            counts = np.zeros((len(lists), 2 * SIDES))
            for row, entries in enumerate(lists):
                for e in entries:
                    counts[row, e["side"]] = e["n"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in counts], pa.binary())], ["word", "counts"])

    sides = neighbour_counts(docs, box).groupBy("word").agg(F.collect_list(F.struct("side", "n")).alias("sides"))
    beside = scratch.write(sides.mapInArrow(pack, "word long, counts binary"))
    top = beside.where(F.col("word") < CENTRED).toPandas().sort_values("word")                  # at most CENTRED words
    counts = np.frombuffer(b"".join(top["counts"])).reshape(-1, 2 * SIDES)
    mean = counts.sum(0) / counts.sum()
    x, weight = profiles(counts, mean), np.sort(n)[::-1][top["word"].to_numpy()].astype(float)
    outer = centred(x, weight, OUTER, 1)
    at = nearest(x, outer)
    inner = [centred(x[at == j], weight[at == j], INNER, 2 + j) if (at == j).any() else np.repeat(outer[j : j + 1], INNER, 0) for j in range(OUTER)]

    def place(batches):
        for batch in batches:
            counts = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, 2 * SIDES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(class_of_profile(profiles(counts, mean), outer, inner))], ["word", "leaf"])

    found = beside.mapInArrow(place, "word long, leaf long").toPandas()                         # one row per given word
    by_number = np.zeros(len(words), np.int64)
    by_number[found["word"]] = found["leaf"]
    leaf = by_number[number]
    box.unpersist()
    scratch.drop(beside)
    return Classes(words, leaf, int(np.bincount(leaf, n, OUTER * INNER).argmin()))


def class_masses(counts: DataFrame, classes: Classes | None) -> list[tuple[int, int, int]]:
    """(class, tokens, words) of the counted words, a row per class and task."""
    def run(batches):
        n, v = np.zeros(OUTER * INNER, np.int64), np.zeros(OUTER * INNER, np.int64)
        for batch in batches:
            outer, inner = leaf_of(batch.column(0).to_numpy().view(np.uint64), classes)
            n += np.bincount(outer * INNER + inner, batch.column(1).to_numpy(), OUTER * INNER).astype(np.int64)
            v += np.bincount(outer * INNER + inner, minlength=OUTER * INNER)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(OUTER * INNER)), pa.array(n), pa.array(v)], ["leaf", "n", "v"])

    added = counts.select("word", "n").mapInArrow(run, "leaf long, n long, v long").groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    return [tuple(r) for r in added.collect()]


def train(docs: DataFrame, model: Model, updates: int = UPDATES) -> Model:
    """One pass over the texts in `updates` parts: tasks take gradient steps from the common weights over
    their texts of a part, and the steps are averaged by tokens (added up by Spark, row by row)."""
    spark, n = docs.sparkSession, ROWS
    for k in range(updates):
        box = spark.sparkContext.broadcast(model.state())

        def run(batches, box=box):
            own, seen, squares = Model.of(box.value), 0, [np.zeros(n, np.float32), np.zeros(n, np.float32)]
            for batch in (part for whole in batches for part in slices(whole, 0, 2_000_000)):
                flat, features = context([tokens(t) for t in batch.column(0).to_pylist()])
                own.learn(flat, features, squares)
                seen += len(flat)
            if seen:
                step = np.concatenate([own.w - box.value[1], own.w2 - box.value[2]], 1).astype(float) * seen
                hit = np.flatnonzero(squares[0] + squares[1] > 0)
                hit = np.append(hit, n)                                 # the last row holds the number of tokens
                step = np.concatenate([step, np.full((1, step.shape[1]), float(seen))])
                yield pa.RecordBatch.from_arrays([pa.array(hit), *[pa.array(step[hit, c]) for c in range(step.shape[1])]], ["row", *[f"s{c}" for c in range(step.shape[1])]])

        columns = [f"s{c}" for c in range(OUTER + INNER)]
        part = docs.where(F.pmod(F.xxhash64("text"), F.lit(updates)) == k).select("text")
        added = part.mapInArrow(run, "row long, " + ", ".join(f"{c} double" for c in columns)).groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()   # at most ROWS + 1 rows
        steps = added[columns].to_numpy()
        row = added["row"].to_numpy()
        if len(row):
            total = steps[row == n][0, 0]
            keep = row < n
            model.w[row[keep]] += (steps[keep, :OUTER] / total).astype(np.float32)
            model.w2[row[keep]] += (steps[keep, OUTER:] / total).astype(np.float32)
        box.unpersist()
    return model


def _least_count(counts: DataFrame, frequent: int) -> int:
    """A count that at most `frequent` words reach, from the number of words by ranges of the count (some 200 rows)."""
    step = F.floor(F.log2("n") * 4).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least"), F.max("n").alias("most")).orderBy(F.desc("step")).collect()
    kept, least = 0, (sizes[0]["most"] + 1 if sizes else 1)
    for r in sizes:
        if kept + r["words"] > frequent:
            break
        kept, least = kept + r["words"], r["least"]
    return least


def score_texts(docs: DataFrame, held_out=None, frequent: int = FREQUENT) -> DataFrame:
    """log10 probability of every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs: doc_id, text; further columns are not read. Learns from the rows that are not held out (id bucket
    of 10 is 0; a missing id is in bucket 0). Words lie between blanks, A-Z lower-cased; a text ends with one
    end token. base_score adds log10((c + 0.1) / (N + 0.1 (V + 1))); score changes each token's probability by
    what the classes' softmaxes say about its class in its context. Classes are learned: words that stand beside the same words
    share one; words beyond the `frequent` most frequent and those seen fewer than LEAST times share one of the classes. A null or empty text is one end. Every row
    gives a row, repeated rows included. Without rows to learn from, N = V = 0 and both scores are those of
    the formula.

    Word counts are added up over all texts. The counts of at most `frequent` most frequent words go to every task; the
    counts of all other words are joined to the (row, word) pairs that need them.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    held = (id_bucket("doc_id", 10) == 0) if held_out is None else held_out
    learned = docs.where(~held).select("text")
    counts = scratch.write(word_counts(learned))
    n_docs = learned.count()
    best = counts.where(F.col("n") >= _least_count(counts, frequent)).toPandas().sort_values("word")     # at most `frequent` rows
    held_words = spark.sparkContext.broadcast((best["word"].to_numpy(np.int64), best["n"].to_numpy(np.int64)))
    # the end of a text has a class like every word
    ends = END[: int(n_docs > 0)]
    named, often = np.concatenate([best["word"].to_numpy(np.int64).view(np.uint64), ends]), np.append(best["n"].to_numpy(np.int64), [n_docs] * len(ends)).astype(np.int64)
    order = np.argsort(named)
    classes = learn_classes(learned, scratch, named[order], often[order])
    stat = class_masses(counts, classes)
    n, v = sum(x for _, x, _ in stat) + n_docs, sum(x for _, _, x in stat) + (n_docs > 0)
    below = n + 0.1 * (v + 1)
    mass = np.full(OUTER * INNER, 0.1)
    for leaf, tokens_, words_ in stat:
        mass[leaf] += tokens_ + 0.1 * words_
    end_outer, end_inner = leaf_of(END, classes)
    mass[end_outer * INNER + end_inner] += (n_docs + 0.1) * (n_docs > 0)
    model = train(learned, Model(mass.reshape(OUTER, INNER), classes))
    box = spark.sparkContext.broadcast(model.state())
    end = n_docs

    def run(batches):
        (words, freq), learned_model = held_words.value, Model.of(box.value)
        for batch in (part for whole in batches for part in slices(whole, 1, 2_000_000)):
            lists = [tokens(t) for t in batch.column(1).to_pylist()]
            size = np.array([len(x) for x in lists])
            flat, features = context(lists)
            last = np.cumsum(size) - 1
            first = last - size + 1
            gain = np.add.reduceat(learned_model.gains(flat, features), first)
            w = flat.view(np.int64)
            at = np.minimum(np.searchsorted(words, w), max(0, len(words) - 1))
            there = words[at] == w if len(words) else np.zeros(len(w), bool)
            count = np.where(there, freq[at] if len(words) else 0, 0)
            there[last], count[last] = True, end
            base = np.where(there, np.log10((count + 0.1) / below), 0.0)
            doc = np.repeat(np.arange(len(lists)), size)
            rare = ~there
            # (row, word) once with how often it occurs
            order = np.lexsort((w[rare], doc[rare]))
            rw, rd = w[rare][order], doc[rare][order]
            new = np.flatnonzero(np.concatenate([[True], (rw[1:] != rw[:-1]) | (rd[1:] != rd[:-1])])) if len(rw) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(rw)))
            offsets = pa.array(np.searchsorted(rd[new], np.arange(len(lists) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(size), pa.array(np.add.reduceat((count > 0).astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(gain),
                 pa.ListArray.from_arrays(offsets, pa.array(rw[new])), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))],
                ["doc_id", "held_out", "n_tokens", "known", "base", "gain", "rare", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, gain double, rare array<long>, times array<long>")
    seen = scratch.write(seen.withColumn("row", F.monotonically_increasing_id()))
    pairs = seen.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = pairs.join(counts, "word").select("row", "times", "n")
    more = found.groupBy("row").agg(F.sum("times").alias("known_more"), F.sum(F.col("times") * F.log10((F.col("n") + 0.1) / (0 + 0.1))).alias("base_more"))
    unseen = F.aggregate("times", F.lit(0).cast("long"), lambda acc, x: acc + x) * F.log10(F.lit(0.1) / F.lit(below))
    out = seen.withColumn("unseen", unseen).drop("rare", "times").join(more, "row", "left")
    base = F.col("base") + F.col("unseen") + F.coalesce("base_more", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known_more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                      base.alias("base_score"), (base + F.col("gain")).alias("score"))
