"""The features are scaled by all rows that are not held out."""

import numpy as np
import pytest

from shoprank.llm import quality
from tests.llm.common import AWKWARD, bucket, documents, text


def test_statistics_cover_all_rows(spark):
    rows = [*AWKWARD, *[(100 + k, text(k, 20)) for k in range(60)], (400, "rare ~^ pair")]
    x = np.stack([quality.features(t) for _, t in rows]).astype(float)
    mean, scale = quality.statistics(documents(spark, rows).repartition(5))
    assert mean == pytest.approx(x.mean(0), abs=1e-5)
    varies = x.min(0) < x.max(0)
    assert scale[varies] == pytest.approx(x.std(0)[varies], rel=1e-3, abs=1e-5) and np.isinf(scale[~varies]).all()
    assert quality.statistics(documents(spark, [])) is None


def test_fit_is_given_statistics_beyond_its_sample(spark, monkeypatch):
    rows = [(k, text(k, 20)) for k in range(80)] + [(200 + k, "x ~^ y") for k in range(3)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    seen, fit = {}, quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a, **b: seen.update(b) or fit(*a, **b))
    assert quality.score_quality(documents(spark, rows), labels, positives=5, unlabelled=5).count() == len(rows)
    x = np.stack([quality.features(t) for i, t in rows if bucket(i, 4) != 2]).astype(float)
    assert seen["stats"][0] == pytest.approx(x.mean(0), abs=1e-5)
