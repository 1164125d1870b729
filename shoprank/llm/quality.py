"""Quality from positive and unlabelled texts, by the non-negative unbiased risk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoprank.llm.common import id_bucket, schema_of, slices, word_hashes

#: rows the classifier is fitted on at most
POSITIVES, UNLABELLED = 4_000, 8_000
EPOCHS, BATCH, RATE, DECAY = 80, 1024, 0.01, 1e-3

#: classes of bytes: letters, digits and blanks by kind, every other ASCII character on its own
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[10], _CLASS[32] = 5, 6
_OTHER = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS[_OTHER] = 7 + np.arange(len(_OTHER))
N_CLASS = 7 + len(_OTHER)
N_FEATURES = N_CLASS * N_CLASS + 8


def features(text: str | None) -> np.ndarray:
    """Counts of neighbouring byte classes per character, and how words repeat."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    c = _CLASS[raw]
    pairs = np.bincount(c[:-1] * N_CLASS + c[1:], minlength=N_CLASS * N_CLASS) if len(c) > 1 else np.zeros(N_CLASS * N_CLASS)
    words = word_hashes(text or "")
    n = max(1, len(words))
    lines = max(1, (text or "").count("\n"))
    distinct = len(np.unique(words)) / n
    again = float((words[1:] == words[:-1]).sum()) / n
    every = np.array([np.log1p(len(raw)), np.log1p(n), len(raw) / n / 10, distinct, again * 10, np.sqrt(again), np.log1p(lines), n / lines / 100])
    return np.concatenate([np.sqrt(pairs / max(1, len(c))), every]).astype(np.float32)


def _matrix(docs: DataFrame) -> np.ndarray:
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 0)):
            yield pa.RecordBatch.from_arrays([pa.array([features(t).tobytes() for t in batch.column(0).to_pylist()], pa.binary())], ["x"])

    rows = docs.select("text").mapInArrow(run, "x binary").collect()
    out = np.empty((len(rows), N_FEATURES), np.float32)
    for k, r in enumerate(rows):
        out[k] = np.frombuffer(r["x"], np.float32)
    return out


def statistics(docs: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and scale of every feature over all rows; a feature that never varies has an infinite scale."""
    def run(batches):
        n, total, squares, least, most = 0, np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.full(N_FEATURES, np.inf), np.full(N_FEATURES, -np.inf)
        for batch in (part for whole in batches for part in slices(whole, 0)):
            for t in batch.column(0).to_pylist():
                x = features(t).astype(float)
                n, total, squares = n + 1, total + x, squares + x * x
                np.minimum(least, x, out=least)
                np.maximum(most, x, out=most)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_FEATURES)), pa.array(np.full(N_FEATURES, n)), *map(pa.array, (total, squares, least, most))], ["k", "n", "total", "squares", "least", "most"])

    sums = docs.select("text").mapInArrow(run, "k long, n long, total double, squares double, least double, most double").groupBy("k").agg(
        *[F.sum(c).alias(c) for c in ("n", "total", "squares")], F.min("least").alias("least"), F.max("most").alias("most")).toPandas().sort_values("k")   # a row per feature
    if not len(sums):
        return None
    n, total, squares, least, most = (sums[c].to_numpy(float) for c in ("n", "total", "squares", "least", "most"))
    mean = total / n
    scale = np.sqrt(np.maximum(squares / n - mean * mean, 0))
    return mean.astype(np.float32), np.where((least < most) & (scale > 0), scale, np.inf).astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = 7,
        stats: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, scale, weights, intercept) that minimise prior R_p+ + max(0, R_u- - prior R_p-) with logistic loss.

    Where the bracket is negative in a batch, the step climbs it instead (the non-negative correction).
    stats: mean and scale of the features; without them those of `unlabelled`.
    """
    if stats is None:
        mean, scale = unlabelled.mean(0, dtype=float).astype(np.float32), unlabelled.std(0, dtype=float).astype(np.float32)
        stats = mean, np.where(scale < 1e-4, np.float32(np.inf), scale)
    mean, scale = stats
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    rng, w, m, v, t = np.random.default_rng(seed), np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1), 0
    w[-1] = np.log(prior / (1 - prior))
    steps = max(1, len(u) // BATCH)
    for epoch in range(epochs):
        order = rng.permutation(len(u))
        for s in range(steps):
            ub, pb = u[order[s::steps]], p[rng.integers(0, len(p), min(len(p), BATCH))]
            fu, fp = _sigmoid(ub @ w[:-1] + w[-1]), _sigmoid(pb @ w[:-1] + w[-1])
            negative = -np.log(1 - fu + 1e-12).mean() + prior * np.log(1 - fp + 1e-12).mean()

            def grad(x, r):
                return np.append(x.T @ r, r.sum()) / len(x)

            g_neg = grad(ub, fu) - prior * grad(pb, fp)
            g = prior * grad(pb, fp - 1) + g_neg if negative >= 0 else -g_neg
            g[:-1] += DECAY * w[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - RATE * (1 - epoch / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return mean, scale, w[:-1], float(w[-1])


def score_quality(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """Quality of every whole text: `columns` (doc_id), held_out, score (0 to 1), predicted (score >= 0.7).

    docs: doc_id, text; labels: doc_id, quality; further columns are not read. Held out are rows whose id
    bucket of 4 is 2; a missing id counts as bucket 0. Trusted positives are labelled 1; the unlabelled texts
    are taken from all others that are not held out, whatever their label. The class prior is the share of 1
    among the labels of rows not held out. The fit takes at most `positives` and `unlabelled` rows, those with
    the smallest hash of their id; the features are scaled by their statistics over all rows not held out; the scores cover every row. Without positives or unlabelled rows the score
    is the prior (0.5 without labels). Null and empty texts are scored as empty; repeated rows stay.
    """
    columns = columns or ["doc_id"]
    known = labels.where(F.col("quality").isNotNull() & (id_bucket("doc_id", 4) != 2)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    prior = float(np.clip(0.5 if share is None else share, 0.01, 0.99))
    pick = F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit"))
    good = known.where("quality = 1").select("doc_id").distinct()
    chosen = good.orderBy(pick, "doc_id").limit(positives).select("doc_id")
    web = docs.where(id_bucket("doc_id", 4) != 2).select("doc_id")
    others = web.join(chosen, "doc_id", "left_anti").orderBy(pick, "doc_id").limit(unlabelled).select("doc_id")

    def texts(ids: DataFrame) -> DataFrame:
        return docs.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id", "left_semi")   # at most `positives` or `unlabelled` ids

    p, u = _matrix(texts(chosen)), _matrix(texts(others))
    model = fit(p, u, prior, stats=statistics(docs.where(id_bucket("doc_id", 4) != 2))) if len(p) and len(u) else (np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), float(np.log(prior / (1 - prior))))
    box = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.withColumn("held_out", id_bucket("doc_id", 4) == 2).select(*columns, "held_out", "text")
    names = [*columns, "held_out"]

    def run(batches):
        mean, scale, w, b = box.value
        for batch in (part for whole in batches for part in slices(whole, len(names))):
            x = np.stack([features(t) for t in batch.column(len(names)).to_pylist()])
            score = _sigmoid(np.clip((x - mean) / scale, -8, 8) @ w + b)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= 0.7).astype(np.int32))], [*names, "score", "predicted"])

    return kept.mapInArrow(run, schema_of(kept.select(*names), "score double, predicted int"))
