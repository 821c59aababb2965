"""Personal data against a plain search, and contexts that are learned."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from blockframe.llm import pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SCHEMA = "doc_id long, text string, digest string, kind string, start int, found string, spans string, nth int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "d", "k", 1, "f", "s", 2) for i, t in rows], SCHEMA)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {
        "email": True,
        "ip": kind != "ip" or all(int(p) <= 255 for p in found.split(".")),
        "card": 16 <= len(digits) <= 19 and luhn(digits),
        "phone": 8 <= len(digits) <= 15,
    }[kind]


def plain(text):
    return [(k, m.start(), m.end()) for k, form in FORMS.items() for m in re.finditer(form, text or "") if valid(k, m.group())]


def row(i, text):
    spans = plain(text)
    line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return (i, *(sum(k == s[0] for s in spans) for k in FORMS), hashlib.sha256(line.encode()).hexdigest())


def odd_documents():
    rng = random.Random(8)
    parts = ["a@b.c", "a@b", "@", ".", "x.y+z@q-1.co.uk", "1.2.3.4", "256.1.1.1", "001.02.3.255", "1.2.3.4.5", "+1 (988) 555-2485", "+12", "+1234567", "+49 30 1234567890123456",
             "4041894974608795", "4041 8949 7460 8795", "4041-8949-7460-8796", "123", " ", "\n", "é", "\U0001f600", "-", "_x@d.e", "--", "+", "(", "9"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(500, 540)]
    rows += [(600, None), (601, ""), (602, "no such thing"), (None, "a@b.cd"), (3, rows[3][1])]
    rows += [(603, "1" * 30000), (604, "a" * 30000 + "@"), (605, "1 " * 20000), (606, "x" * 50000 + " a@b.c " + "1." * 5000), (607, "+1 2 3" * 3000)]
    return rows


def test_base_spans_equal_a_plain_search(spark):
    docs = odd_documents()
    rows = pii.find_personal_data(frame(spark, docs)).collect()
    assert Counter(tuple(r)[:6] for r in rows) == Counter(row(i, t) for i, t in docs)
    for r in rows:
        texts = [t for i, t in docs if i == r.doc_id]
        assert any({f"{k}:{a}:{b}" for k, a, b in plain(t)} <= set(r.spans.split(",")) | ({""} - {""}) for t in texts)
    assert pii.find_personal_data(frame(spark, [])).count() == 0


def test_base_spans_of_the_small_corpus(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.collect()]
    rows = pii.find_personal_data(table).collect()
    assert Counter(tuple(r)[:6] for r in rows) == Counter(row(i, t) for i, t in docs)


def test_contexts_find_unseen_identifiers(spark):
    card = "4041894974608795"
    docs = [(i, f"pay {'abcdefg'[i]} to my card number {card[:-2]}{i}5 now") for i in range(7)]  # hardly any is valid
    docs += [(10 + i, f"please write to me at user{i}@mail.example.org today") for i in range(6)]
    docs += [(20, "please write to me at someone#77123 today"), (21, "please write to me at once today"), (22, "of course 123456 times")]
    rows = {r.doc_id: r for r in pii.find_personal_data(frame(spark, docs)).collect()}
    text = dict(docs)[20]
    start = text.index("someone#77123")
    assert rows[20].spans == f"email:{start}:{start + 13}" and rows[20].n_email == 0
    assert rows[21].spans == "" and rows[22].spans == ""
    assert all(rows[10 + i].n_email == 1 for i in range(6))


def test_masks(spark):
    docs = frame(spark, [(1, "é a@b.cd, 1.2.3.4 end"), (2, "+4041894974608795")])
    found = pii.listed(docs)
    joined = docs.join(found, pii.digest_of(F.col("text")) == F.col("of_text")).select("doc_id", pii.masked(F.col("text"), found["spans"]).alias("m"))
    assert {r.doc_id: r.m for r in joined.collect()} == {1: "é [EMAIL], [IP] end", 2: "+[CARD]"}
