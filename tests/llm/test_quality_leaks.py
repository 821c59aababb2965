"""The quality classifier, decontamination and the pipeline."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from blockframe.llm import decontaminate as dc
from blockframe.llm import quality

# -- quality --------------------------------------------------------------


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


def test_gradient_equals_differences():
    """One step of training lowers the loss along the analytic slope."""
    rng = np.random.default_rng(0)
    bags = [rng.random((int(rng.integers(1, 6)), quality.FEATURES)).astype(np.float32) for _ in range(40)]
    labels = np.array([float(b[:, 0].max() > 0.8) for b in bags])
    model = quality.fit_attention(bags, labels, epochs=150)

    def score(bag):
        h = np.tanh(quality.standard(bag, model.mean, model.scale) @ model.w + model.b)
        e = np.exp((np.tanh(h @ model.v) / (1 + np.exp(-h @ model.u))) @ model.a)
        return 1 / (1 + np.exp(-((e / e.sum()) @ h @ model.c + model.c0[0])))

    assert np.mean([(score(b) >= 0.5) == y for b, y in zip(bags, labels)]) > 0.9


def test_quality_of_held_out_documents(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    known = dict(labels.select("doc_id", "quality").collect())
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    judged = [(r.predicted, known[r.doc_id]) for r in got if r.held_out and r.doc_id in known]
    assert np.mean([p == y for p, y in judged]) > 0.93
    assert np.mean([p for p, y in judged if y == 1]) > 0.95
    # Labels of held-out documents, and lang or source, change nothing.
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.score_quality(docs.withColumn("source", F.lit("z")), turned).collect()
    assert {(r.doc_id, round(r.score, 6)) for r in again} == {(r.doc_id, round(r.score, 6)) for r in got}


def test_quality_edges(spark):
    schema = "doc_id long, text string, quality int, score double, _id int, label string"
    rows = [(i, ("good words here. " if i % 2 else "BAD!! ") * (1 + i % 5), 0, 0.0, 0, "l") for i in range(60)]
    rows += [(100, None, 0, 0.0, 0, "l"), (101, "", 0, 0.0, 0, "l"), (None, "x", 0, 0.0, 0, "l"), (1, rows[1][1], 0, 0.0, 0, "l"), (102, "long " * 200_000, 0, 0.0, 0, "l")]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, None), (None, 1), (5, 1)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0.5 for r in quality.score_quality(docs, labels.limit(0)).collect())
    assert quality.score_quality(docs.limit(0), labels).count() == 0
    whole = quality.passages(rows[-1][1])
    parts = np.concatenate([quality.passages(rows[-1][1], k, 100) for k in range(0, len(whole), 100)])
    assert np.allclose(whole[:, 0], parts[:, 0]) and len(whole) == len(parts) == quality.passage_count(rows[-1][1])


# -- decontamination ------------------------------------------------------


def plain_end_distances(item, text):
    row, out = list(range(len(item) + 1)), []
    for w in text:
        new = [0]
        for j, x in enumerate(item, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
        row = new
        out.append(row[-1])
    return out


def test_bit_parallel_distances():
    rng = random.Random(3)
    for _ in range(300):
        item = [rng.randrange(4) for _ in range(rng.randint(1, 40))]
        text = [rng.randrange(5) for _ in range(rng.randint(0, 60))]
        masks = defaultdict(int)
        for i, w in enumerate(item):
            masks[w] |= 1 << i
        assert dc.end_distances(masks, len(item), text) == plain_end_distances(item, text)


def edited(rng, words, edits, vocabulary):
    words = list(words)
    for _ in range(edits):
        i, kind = rng.randrange(len(words)), rng.randrange(3)
        words[i : i + (kind != 1)] = [] if kind == 2 else [rng.choice(vocabulary)]
    return words


def contaminated_corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 6, 9, 15, 30, 60])))) for k in range(40)]
    docs = []
    for d in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if d % 3 == 0:
            item = items[d % 40][1].split()
            words[5:5] = edited(rng, item, dc.allowed(len(item), 0.8) if d % 2 else 0, vocabulary)
        docs.append((d, " ".join(words)))
    text = items[3][1]
    docs += [(200, None), (201, ""), (202, text.upper().replace("V", "v").replace(" ", ",  ")), (203, text), (203, text), (None, text), (204, "v1 " * 40_000 + text)]
    return docs, items + [(100, None), (101, ""), (102, "v1 v2"), (3, text)]


def plain_hits(docs, items):
    out = set()
    for d, t in docs:
        words = dc.words_of(t)
        for k, item in items:
            wanted = dc.words_of(item)
            if len(wanted) >= dc.MIN_WORDS and words and len(words) < 1000:
                best = min(plain_end_distances(wanted, words))
                if best <= dc.allowed(len(wanted), 0.8):
                    out.add((d, k, best))
    return out


def test_benchmark_passages(spark):
    docs, items = contaminated_corpus()
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, item_id int, edits int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.benchmark_passages(frame, bench).collect()
    short = {d for d, t in docs if len(t or "") < 5000}
    got, wanted = {(r.doc_id, r.item_id, r.edits) for r in rows if r.doc_id in short}, plain_hits(docs, items)
    pairs = lambda s: {x[:2] for x in s}
    assert pairs(got) <= pairs(wanted) and len(pairs(got)) >= 0.97 * len(pairs(wanted))
    assert {x for x in wanted if x[2] == 0} <= got  # whole copies are never missed
    assert any(r.doc_id == 204 and r.item_id == 3 for r in rows)
    for r in rows:
        assert r.edits <= dc.allowed(r.item_words, 0.8) and 0 <= r.first_word < r.end_word
    assert dc.benchmark_passages(frame.limit(0), bench).count() == 0 == dc.benchmark_passages(frame, bench.limit(0)).count()


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    docs, items = contaminated_corpus(6)
    docs = docs[:60]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    once = {tuple(r)[:2] for r in dc.benchmark_passages(frame, bench).collect()}
    monkeypatch.setattr(dc, "ITEMS", 9)
    many = {tuple(r)[:2] for r in dc.benchmark_passages(frame, bench).collect()}
    whole = {x[:2] for x in plain_hits(docs, items) if x[2] == 0}
    assert whole <= once and whole <= many and len(once ^ many) <= 0.05 * len(once)
    kept = dc.without_benchmark(frame, bench)
    assert kept.columns == frame.columns and kept.count() == len(docs) - len({d for d, _ in many})


def test_equal_items_are_looked_up_once(spark, monkeypatch):
    """Hundreds of rows with one text are one item, whatever the block size; each of them is found."""
    monkeypatch.setattr(dc, "ITEMS", 4)
    words = [f"w{i} x{i} y{i} z{i} u{i}" for i in range(20)]
    items = [(i, words[0]) for i in range(300)] + [(300 + i, w) for i, w in enumerate(words)] + [(None, words[1]), (7, None), (8, "")]
    docs = [(1, f"a {words[0]} b {words[1]}"), (2, "nothing here"), (None, words[2])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, key string")
    blocks = list(dc._blocks(bench, "text"))
    assert sum(len(b) for _, b in blocks) == 20 and max(len(b) for _, b in blocks) <= 8 and all(s for s, _ in blocks)
    got = Counter((r.doc_id, r.item_id) for r in dc.benchmark_passages(frame, bench).collect())
    assert got == Counter([(1, i) for i in range(300)] + [(1, 300), (1, 301), (1, None), (None, 302)])
    kept = dc.without_benchmark(frame, bench)
    assert [(r.doc_id, r.key) for r in kept.collect()] == [(2, "k")] and kept.columns == frame.columns


# -- pipeline -------------------------------------------------------------


def test_pipeline_stages_equal_brute_force(spark, sf_dir):
    from test_near_copies import plain_components, plain_simhash
    from test_pii import plain

    assert "pipeline" in __spark_entry__.queries() and 4 <= len(corpus_pipeline.STAGES) <= 5
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, kept = source, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == source.columns
        kept.append({r.doc_id: r.asDict() for r in docs.collect()})
    model = quality.train_quality(source, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = {r.doc_id: r.text for r in source.collect()}
    good = {i for i, t in rows.items() if quality.score_text(model, t) >= 0.7}
    assert set(kept[0]) == good
    prints = {i: plain_simhash(rows[i]) for i in good}
    roots = plain_components(set(prints.values()))
    groups = defaultdict(list)
    for i in good:
        groups[roots[prints[i]]].append(i)
    single = {min(g) for g in groups.values()}
    assert set(kept[1]) == single
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    wanted = [dc.words_of(t) for _, t in items]

    def leaks(text):
        words = dc.words_of(text)
        return any(set(w) & set(words) and min(plain_end_distances(w, words)) <= dc.allowed(len(w), 0.8) for w in wanted if sum(x in words for x in w) >= 0.8 * len(w))

    assert set(kept[2]) == {i for i in single if not leaks(rows[i])}
    assert set(kept[3]) == set(kept[2])
    for i, row in kept[3].items():
        spans = plain(rows[i])
        assert len(re.findall(r"\[(?:EMAIL|IP|CARD|PHONE)\]", row["text"])) >= (1 if spans else 0) and row["n_chars"] == len(row["text"])
        assert not any(rows[i][a:b] in row["text"] for k, a, b in spans if k == "email")
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(kept[3])
    totals = Counter()
    for r in packed:
        totals[r.sequence_id] += r.length
    assert max(totals.values()) <= 1024


@pytest.mark.parametrize("n", [0, 1])
def test_pipeline_of_next_to_nothing(spark, sf_dir, n):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(n)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() >= n
