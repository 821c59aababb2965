"""Byte-level BPE against the rank library, and exact round trips."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from blockframe.llm import byte_bpe
from blockframe.llm.queries import QUERIES, RANKS

SCHEMA = "doc_id long, text string, ids string, starts int, ends int, decoded string, n_tokens string"


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "d", "n") for i, t in rows], SCHEMA)


def wanted(plain, docs):
    rows = []
    for i, t in docs:
        ids = plain.encode_ordinary(t or "")
        rows.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(rows)


def got(df):
    return Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())


def odd_documents():
    rng = random.Random(13)
    rows = [(1, None), (2, ""), (3, " "), (4, "\n\n \n"), (5, "<|endoftext|> a<|endoftext|>"), (None, "null id"), (7, "twice"), (7, "twice")]
    rows += [(8, "don't I'LL 've'd ''s"), (9, "naïve café 東京都 𝔘𝔫𝔦 👩‍👩‍👧 \u0000\u0085  ᠎﻿ x"), (10, "ᵃ٣Ⅷ½ 12,5")]
    rows += [(11, "a" * 5000), (12, "- " * 2000), (13, " " * 3000 + "x"), (14, "日本" * 3000), (15, "word " * 90_000)]
    signs = [*"ab cd\n\t.,-=!1'é€𝄞", "  ", "\r\n", "tion", "ing "]
    return rows + [(100 + i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 400)))) for i in range(60)]


def test_encoding_equals_the_rank_library(spark, plain):
    docs = odd_documents()
    assert got(byte_bpe.encode_and_decode(frame(spark, docs), RANKS)) == wanted(plain, docs)
    assert byte_bpe.encode_and_decode(frame(spark, []), RANKS).count() == 0


def test_chunks_do_not_change_the_ids(plain, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK", 7)
    monkeypatch.setattr(byte_bpe, "SLAB", 50)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 300)
    own = byte_bpe.ByteCoder(RANKS)
    texts = [t or "" for _, t in odd_documents() if len(t or "") < 10_000]
    assert [i.tolist() for i in own.encode(texts)] == [plain.encode_ordinary(t) for t in texts]
    assert all("".join(byte_bpe.chunks(t)) == t for t in texts)


def test_repeated_parts_merge_as_by_rank(plain):
    """Tokens that a part of them can be shifted along: where the order of equal ranks could matter."""
    own, rng = byte_bpe.ByteCoder(RANKS), random.Random(2)
    ranks = {t: i for i, t in enumerate(own.tokens)}
    splits = {t: [(t[:i], t[i:]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks] for t in ranks}
    shifted = [(a, b, d) for pairs in splits.values() for a, b in pairs for c, d in pairs if b == c]
    assert len(shifted) > 100
    texts = []
    for a, b, d in shifted:
        unit = (a + b + d).decode("utf-8", "replace")
        texts += [unit * rng.randint(1, 9) + rng.choice("x .1é") + unit[: rng.randint(1, len(unit))] * rng.randint(1, 70), unit]
    assert [i.tolist() for i in own.encode(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_every_character(plain):
    own = byte_bpe.ByteCoder(RANKS)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["\n".join(f"a{chr(c)}b {chr(c)}1 {chr(c)}{chr(c)}  {chr(c)}." for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    assert [i.tolist() for i in own.encode(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_places_and_split_characters(spark, plain):
    docs = [(i, t) for i, t in odd_documents() if len(t or "") < 500]
    texts = dict(docs)
    split = 0
    for r in byte_bpe.encode_documents(frame(spark, docs), RANKS).collect():
        text = texts[r.doc_id] or ""
        at = 0
        for k, a, b in zip(r.ids, r.starts, r.ends):
            token = plain.decode_single_token_bytes(k)
            assert token in text[a:b].encode() and len(text[:a].encode()) <= at
            at += len(token)
            assert len(text[:b].encode()) >= at
            split += token != text[a:b].encode()
        assert at == len(text.encode())
    assert split > 5


def test_decoding_keeps_other_columns(spark, plain):
    whole = plain.encode_ordinary("ein 👩 x")
    rows = [(1, whole, "a"), (2, [], "b"), (3, None, None), (4, whole[:2], "c")]
    table = spark.createDataFrame(rows, "doc_id long, ids array<int>, `odd name` string")
    back = byte_bpe.decode_documents(table, RANKS)
    assert back.columns == [*table.columns, "decoded"]
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in back.collect()} == {1: "ein 👩 x".encode(), 2: b"", 3: None, 4: plain.decode_bytes(whole[:2])}


def test_whole_table(spark, plain, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(QUERIES["op13_byte_bpe"](spark, sf_dir)) == wanted(plain, docs)
