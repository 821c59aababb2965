"""The scores of the query against the method written out passage by passage."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from blockframe.llm import quality
from blockframe.llm.queries import QUERIES


def plain_features(data, before):
    """Shares of byte classes and of classes of byte pairs (the second byte's part is a byte) that begin in the passage, and four measures of shape."""
    n = max(1, len(data))
    single, pairs = Counter(b if b < 128 else 96 + b % 32 for b in data), Counter((x * 31 + y * 17 % 256) % 1021 for x, y in before)
    folded = Counter()
    for pair, times in pairs.items():
        folded[pair % 128] += times
    upper = sum(single[c] for c in range(65, 91))
    blank = sum(single[c] for c in (9, 10, 13, 32))
    shape = [len(pairs) / n, max(pairs.values(), default=0) / n, upper / n, (blank + 1) / n]
    return [math.sqrt(single[c] / n) for c in range(128)] + [math.sqrt(folded[c] / n) for c in range(128)] + shape, n / (n + 48)


def plain_score(model, text):
    data = (text or "").encode()
    hidden, strength = [], []
    for at in range(0, max(1, len(data)), 512):
        features, trust = plain_features(data[at : at + 512], list(zip(data[at : at + 512], data[at + 1 : at + 513])))
        x = [(f - m) / s * trust for f, m, s in zip(features, model.mean.tolist(), model.scale.tolist())]
        h = [math.tanh(sum(a * b for a, b in zip(x, column)) + b0) for column, b0 in zip(model.w.T.tolist(), model.b.tolist())]
        said = [math.tanh(sum(a * b for a, b in zip(h, column))) for column in model.v.T.tolist()]
        gate = [1 / (1 + math.exp(-sum(a * b for a, b in zip(h, column)))) for column in model.u.T.tolist()]
        hidden.append(h)
        strength.append(sum(p * q * a for p, q, a in zip(said, gate, model.a.tolist())))
    weight = [math.exp(e - max(strength)) for e in strength]
    whole = [sum(w * h[k] for w, h in zip(weight, hidden)) / sum(weight) for k in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-sum(z * c for z, c in zip(whole, model.c.tolist())) - float(model.c0[0])))


def test_scores_equal_the_method_written_out(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train_quality(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in QUERIES["op2_quality"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        wanted = plain_score(model, text)
        assert got[i].score == pytest.approx(wanted, abs=2e-4)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i].predicted == int(got[i].score >= 0.7)


@pytest.mark.parametrize("text", [None, "", "a", "ab", "x" * 512, "é" * 700, "Word and word. " * 200])
def test_score_of_odd_texts(text):
    rng = np.random.default_rng(4)
    shape = {"mean": 260, "scale": 260, "w": (260, 24), "b": 24, "v": (24, 12), "u": (24, 12), "a": 12, "c": 24, "c0": 1}
    model = quality.Attention(**{k: np.abs(rng.normal(0.5, 0.2, s)) if k == "scale" else rng.normal(0, 0.3, s) for k, s in shape.items()})
    assert quality.score_text(model, text) == pytest.approx(plain_score(model, text), abs=1e-5)
