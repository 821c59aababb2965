"""Spelling variants against comparing all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb

from blockframe.llm import spelling
from blockframe.llm.queries import QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def edits(word, letters):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        yield word[:i] + word[i + 1 :]
        yield from (word[:i] + c + word[i + 1 :] for c in letters)


def wanted(docs):
    counts = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    letters = {c for w in words for c in w}
    near = {}
    for w in words:
        if len(w) < 100:
            near[w] = {e for e in edits(w, letters) if e in words and e != w}
        else:
            near[w] = {e for e in words if one_edit(w, e)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda e: (-words[e], e), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return Counter(rows)


def got(df):
    return Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def frame(spark, rows):
    """With extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], "doc_id long, text string, word string, node string, pos int, n int")


def odd_documents(seed=11):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(150)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababab", "ÿÿÿÿÿÿ", "ÿÿÿÿÿÿÿ", "÷×÷×÷×"]
    words = bases + [b[: rng.randrange(len(b))] + rng.choice("abéz") + b[rng.randrange(len(b)) :] for b in bases]
    many = [w for w in words for _ in range(rng.choice([1, 2, 5, 6, 30, 160]))]
    rng.shuffle(many)
    rows = [(i, rng.choice([" ", ", ", "1", "-"]).join(w if rng.random() < 0.8 else w.upper() for w in many[i * 40 : i * 40 + 40])) for i in range(len(many) // 40)]
    long = "".join(rng.choice("abc") for _ in range(5000))
    rows += [(900 + i, long) for i in range(40)] + [(960 + i, long[:2500] + long[2501:]) for i in range(6)] + [(980 + i, long + "a") for i in range(6)]
    rows += [(None, "nameless nameless nameless"), (None, "nameless nameless"), (1000, None), (1001, ""), (1002, "short word"), (7, rows[7][1]), (7, rows[7][1])]
    return rows + [(1003, "chainaa " * 1250 + "chainab " * 250 + "chaincb " * 50 + "chaincbd " * 10 + "tieone tietwo " * 8 + "tieono " * 8)]


def test_variants(spark):
    docs = odd_documents()
    rows = wanted(docs)
    assert sum(r[1] is not None and r[1] != r[2] for r in rows) >= 2 and any(r[2] == "chainaa" and r[0] == "chaincbd" for r in rows)
    assert got(spelling.spelling_variants(frame(spark, docs))) == rows


def test_empty(spark):
    for docs in ([], [(1, None)], [(1, "rareword")], [(1, "single " * 5)]):
        assert got(spelling.spelling_variants(frame(spark, docs))) == wanted(docs)


def test_pairs_come_once(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abÿ") for _ in range(rng.randint(1, 7))) for _ in range(300)})
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    pairs = Counter((r.word, r.other) for r in spelling.near_words(table).collect())
    assert pairs == Counter((a, b) for a in words for b in words if one_edit(a, b))


def test_whole_table_and_sql(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = got(QUERIES["op11_spelling"](spark, sf_dir))
    assert found == wanted(docs) and len(found) > 100
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        rows = db.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({spelling.VARIANTS_SQL})").fetchall()
    assert found == Counter(rows)
