"""Ranked lexical search against counting by hand."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from blockframe.llm import lexical
from blockframe.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def wanted(docs, items, top=10):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, length = len(counted), sum(sum(c.values()) for _, c in counted)
    held = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 25 + 75 * sum(c.values()) * n_docs // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms_of(text) if c[t]
            )
            scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:top])]
    return Counter(out)


def got(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def frames(spark, docs, items):
    """With extra columns whose names the operator uses inside."""
    d = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in docs], "doc_id long, text string, key string, score int, term int")
    b = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in items], "item_id long, text string, key string, block int, terms int")
    return d, b


def odd_tables(seed=12):
    rng = random.Random(seed)
    words = ["a", "A", "ab", "abc", "é", "É", "été", "x1", "12", "naïve", "日本", " ", "w"] + [f"t{i}" for i in range(30)]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "-", "\n", ". ", "_", "\x00", "'"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " .-"), (None, docs[3][1]), (None, docs[4][1]), (5, docs[5][1]), (5, docs[6][1]), (103, text(9000)), (104, "Ab" * 4000)]
    docs += [(200 + i, "twin words here") for i in range(15)]
    items = [(i, text(rng.randint(1, 12))) for i in range(20)] + [(50, None), (51, ""), (52, "?!"), (53, "nowhere"), (54, "twin a words"), (0, "twin"), (None, "words"), (7, "words")]
    return docs, items + [(55, items[2][1]), (2, items[2][1])]


@pytest.mark.parametrize("block", [4096, 3])
def test_ranking(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block)
    docs, items = odd_tables()
    assert got(lexical.rank_documents(*frames(spark, docs, items))) == wanted(docs, items)
    if block == 3:
        assert got(lexical.rank_documents(*frames(spark, docs, items), top=2)) == wanted(docs, items, 2)


def test_empty_tables(spark):
    docs, items = odd_tables()
    for d, b in (([], items), (docs, []), ([], []), ([(1, None)], items), (docs, [(1, None)])):
        assert lexical.rank_documents(*frames(spark, d, b)).count() == 0


def test_scan_counts_whole_terms_only():
    scan = lexical.TermScan(["a", "ab", "é", "a1"])
    line = lexical.guarded("a A ab,aab é éa a1 a\x00a _a_".encode())
    assert lexical.term_count(line) == 10
    assert dict(zip(*[x.tolist() for x in scan.frequencies(line)])) == {0: 5, 1: 1, 2: 1, 3: 1}


def test_whole_tables_and_sql(spark, sf_dir):
    read = lambda name, i: [(r[i], r.text) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]
    found = got(QUERIES["op12_lexical"](spark, sf_dir))
    assert found == wanted(read("documents", "doc_id"), read("benchmark", "item_id"))
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        rows = db.sql(f"SELECT item_id, rank, doc_id, score FROM ({lexical.RANK_SQL})").fetchall()
    assert found == Counter(rows)
