"""The ranking is learnt from all pairs of all labelled rows."""

import zlib

import numpy as np
import pytest

from docweave.llm import quality


def all_pairs(x, y, m):
    """Newton steps over every pair, one by one."""
    z = (x - m["mean"]) / m["scale"]
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(d @ w))
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + quality.RIDGE * np.eye(len(w))
        w -= np.linalg.solve(hess, -(d * p[:, None]).mean(0) + quality.RIDGE * w)
    return w


def test_fit_takes_all_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6))
    x[:, 2] = 5.3  # says nothing
    s = x @ rng.normal(size=6) + rng.normal(size=500)
    y = (s > np.quantile(s, 0.3)).astype(int)
    m = quality.fit(x, y, (y == 0).mean())
    assert np.abs(m["w"] - all_pairs(x, y, m)).max() < 1e-4 and abs(m["w"][2]) < 1e-12
    s = ((x - m["mean"]) / m["scale"]) @ m["w"]
    assert (s < m["threshold"]).sum() == (y == 0).sum()


@pytest.mark.parametrize("close", [quality.CLOSE, 20])
def test_train_takes_every_labelled_row(spark, monkeypatch, close):
    monkeypatch.setattr(quality, "CLOSE", close)
    rng = np.random.default_rng(2)
    words = ["alpha", "Beta.", "gamma!", "DELTA", "12", "#%&", "of", "the"]
    rows = []
    for i in range(240):
        good = int(rng.random() < 0.7)
        odds = np.array([3, 2, 1, 1, 1, 0.3 if good else 1.2, 3, 3])
        rows.append((i, " ".join(rng.choice(words, int(rng.integers(5, 40)), p=odds / odds.sum())), good))
    rows += [(3, "a second text of a key", 1), (900, "no label", None), (901, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    m = quality.train(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    label = {}
    for i, _, y in rows:
        if y is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            label[i] = min(y, label.get(i, y))
    x = np.array([quality.features(t) for i, t, _ in rows if i in label])
    y = np.array([label[i] for i, _, _ in rows if i in label])
    assert (m["bad"], m["good"]) == ((y == 0).sum(), (y == 1).sum())
    plain = quality.fit(x, y, sum(v == 0 for v in label.values()) / len(label))
    z = (x - m["mean"]) / m["scale"]
    assert np.abs(z @ m["w"] - z @ all_pairs(x, y, m)).max() < 1e-3
    assert abs(m["threshold"] - plain["threshold"]) < 1e-5
