"""Fingerprints against sets of paragraphs."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from blockframe.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, block int, key string, base string, h int, digests string, after int, own int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", "b", 4, "d", 2, 3) for i, t in rows], SCHEMA)


def units(text):
    return set(re.findall(fp.PARAGRAPH.replace("++", "+").replace("}+", "}").replace("*+", "*"), text))


def signed_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def wanted(docs):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, signed_hash(d[1] or ""), (d[1] or "").encode()))
    out = []
    for n, (i, t) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]

        def near(a, b):
            return 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))

        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(near(units(t), units(edited)), 9), round(near(units(t), units(after)), 9)))
    return Counter(out)


def got(df):
    rows = df.collect()
    for r in rows:
        n, cells = r.fingerprint.split(":")
        assert len(cells) == 16 * fp.CELLS and re.fullmatch("[0-9a-f]+", cells)
    return rows, Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows)


def odd_documents():
    rng = random.Random(6)
    sentence = lambda: " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(3, 20))) + rng.choice(". |.\n|! ".split("|"))
    rows = [(i * 7 % 50, "".join(sentence() for _ in range(rng.randint(0, 60)))) for i in range(50)]
    rows += [(100, None), (101, ""), (102, "x"), (103, "same. " * 40), (104, rows[4][1]), (5, rows[5][1]), (5, "other text."), (None, "a. b"), (None, None)]
    rows += [(105, "".join(sentence() for _ in range(400))), (106, "y" * 4000), (2**60 + 1, "\U0001f600 four. " * 9)]
    return rows


def test_fingerprints(spark):
    docs = odd_documents()
    rows, found = got(fp.fingerprint_documents(frame(spark, docs)))
    assert found == wanted(docs)
    by_text = {}
    for r in rows:
        by_text.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    texts = dict((i, t) for i, t in docs if i is not None)
    assert [r.fingerprint for r in rows if r.doc_id == 104] == [r.fingerprint for r in rows if r.doc_id == 4 * 7 % 50 and r.n_chars == len(texts[104])]


def test_edges(spark):
    for docs in ([], [(1, "one. two.")], [(1, None)], [(None, "a"), (None, "a"), (3, "b" * 300)]):
        assert got(fp.fingerprint_documents(frame(spark, docs)))[1] == wanted(docs)


def test_small_corpus(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.collect()]
    rows, found = got(fp.fingerprint_documents(table))
    assert found == wanted(docs)
    assert sum(r.near_edited for r in rows) > 4 * sum(r.near_next for r in rows)


def test_peeling_recovers_the_digests_that_differ(spark):
    df = spark.createDataFrame([("a. " * 30 + "b. " * 30, "a. " * 30 + "c. " * 30), ("", "")], "x string, y string")
    df = df.select(fp.digests(F.col("x")).alias("dx"), fp.digests(F.col("y")).alias("dy"))
    df = df.select("dx", "dy", F.expr(fp.items("dx")).alias("ix"), F.expr(fp.items("dy")).alias("iy"))
    for r in df.select("dx", "dy", fp.recovered("ix", "iy").alias("found")).collect():
        assert sorted(r.found) == sorted(set(r.dx) ^ set(r.dy))
    # More than the first sketch holds: larger ones follow.
    many = spark.createDataFrame([("".join(f"{i:060d}." for i in range(n)), "".join(f"{i:060d}." for i in range(5, n + m))) for n, m in ((90, 4), (700, 20), (4, 300))], "x string, y string")
    many = many.select(fp.digests(F.col("x")).alias("dx"), fp.digests(F.col("y")).alias("dy"))
    many = many.select("dx", "dy", F.expr(fp.items("dx")).alias("ix"), F.expr(fp.items("dy")).alias("iy"))
    for r in many.select("dx", "dy", fp.recovered("ix", "iy").alias("found")).collect():
        assert sorted(r.found) == sorted(set(r.dx) ^ set(r.dy))


def test_ids_that_many_rows_share(spark):
    """A third of the rows without an id, a third with one id; several blocks each."""
    rng = random.Random(9)
    text = lambda: " ".join(str(rng.randint(0, 99)) for _ in range(rng.randint(0, 12))) + "."
    docs = [(None, text()) for _ in range(60)] + [(7, text()) for _ in range(60)] + [(i, text()) for i in range(60)] + [(7, "same. " * 30)] * 20
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        frame_ = frame(spark, docs)
        assert got(fp.fingerprint_documents(frame_))[1] == wanted(docs)
        rows = frame_.select(F.coalesce("doc_id", F.lit(fp.LEAST)).alias("key"), F.xxhash64("text").alias("h"), "text")
        blocks = fp.blocks_of_neighbours(rows, 1, len(docs)).groupBy("base", "sub").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(blocks) > 13 and max(r["count"] for r in blocks) < 50
