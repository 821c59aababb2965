"""The bounded sample that the quality classifier learns from."""

from __future__ import annotations

import zlib

from blockframe.llm import quality

ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]


def test_documents_that_do_not_fit_are_passed_over(spark, monkeypatch):
    bags = []
    monkeypatch.setattr(quality, "fit_attention", lambda b, labels: bags.append((b, labels)) or "model")
    rows = [(i, "long " * 20_000 if i % 3 else "short text") for i in ids] + [(ids[0], "again and again")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 50 == 0)) for i in ids], "doc_id long, quality int")
    assert quality.train_quality(docs, labels, fit_rows=200, fit_passages=150) == "model"
    got, kinds = bags[0]
    small = [i for i in ids if i % 3 == 0]
    assert sum(map(len, got)) <= 150 and len(got) >= len(small) - 1 and set(kinds.tolist()) == {0.0, 1.0}


def test_a_label_with_large_documents_only_still_gives_a_model(spark, monkeypatch):
    bags = []
    monkeypatch.setattr(quality, "fit_attention", lambda b, labels: bags.append((b, labels)) or "model")
    docs = spark.createDataFrame([(i, "long " * 20_000 if i % 2 else "short") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    assert quality.train_quality(docs, labels, fit_passages=100) == "model"
    assert set(bags[0][1].tolist()) == {0.0, 1.0} and sum(map(len, bags[0][0])) <= 100
