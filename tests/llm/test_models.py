"""The hidden Markov model and packing against brute force and exact invariants."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from blockframe.llm import hmm, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, row long, word string, c int, rank int, length int, piece int, codes string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w", 2, 3, 4, 5, "c") for i, t in rows], SCHEMA)


def odd_documents():
    rng = random.Random(4)
    words = [f"W{i}" for i in range(30)] + ["the", "The", "of"] * 5
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 200)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "é É x"), (None, "the of the"), (5, rows[5][1]), (2**60 + 1, "w1")]
    rows += [(104, "ab " * 5000), (105, "a  b   c \n d\n e" * 40), (106, "x" * 5000), (107, "the <|endoftext|> of")]
    return rows


# -- hidden Markov model ------------------------------------------------------


def random_model(rng, states, symbols):
    rows = lambda *shape: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(shape) + 0.05)
    return hmm.Model(rows(states), rows(states), rows(states, states), rows(states, symbols))


def paths(model, start, seen):
    """Probability of every state path of a short sequence."""
    for path in itertools.product(range(len(model.start)), repeat=len(seen)):
        p = start[path[0]] * model.emit[path[0], seen[0]]
        for a, b, o in zip(path, path[1:], seen[1:]):
            p *= model.move[a, b] * model.emit[b, o]
        yield path, p


def test_forward_and_counts_equal_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    model = random_model(rng, 3, 4)
    sequences = [rng.integers(0, 4, n) for n in (1, 5, 2, 4)]
    lengths = np.array([len(s) for s in sequences])
    symbols, opening = np.concatenate(sequences), np.array([True, False, True, False])
    got = hmm.forward(model, symbols, lengths)
    for s, g in zip(sequences, got):
        assert math.isclose(g, math.log10(sum(p for _, p in paths(model, model.start, s))), rel_tol=1e-9)
    counts, log10 = hmm.expected_counts(model, symbols, np.cumsum(lengths) - lengths, lengths, opening)
    wanted, total = hmm.Model(*(np.zeros_like(x) for x in model)), 0.0
    for s, first in zip(sequences, opening):
        all_paths = list(paths(model, model.start if first else model.later, s))
        mass = sum(p for _, p in all_paths)
        total += math.log10(mass)
        for path, p in all_paths:
            (wanted.start if first else wanted.later)[path[0]] += p / mass
            for a, b in zip(path, path[1:]):
                wanted.move[a, b] += p / mass
            for k, o in zip(path, s):
                wanted.emit[k, o] += p / mass
    assert math.isclose(total, log10, rel_tol=1e-9)
    for a, b in zip(counts, wanted):
        assert np.allclose(a, b)
    assert np.allclose(hmm.flat(hmm.unflat(hmm.flat(model), 3, 4)), hmm.flat(model))


def plain_base(docs):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    split = lambda t: (t or "").encode().lower().split() + [b""]
    counts = Counter(w for i, t in docs if not held(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in docs:
        words = split(t)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        out.append((i, held(i), len(words), sum(w in counts for w in words), n, round(base, 6)))
    return Counter(out)


def test_scores(spark, monkeypatch):
    docs = odd_documents()
    got = hmm.score_documents(frame(spark, docs), states=3, rounds=2).collect()
    as_rows = lambda rows: Counter((*r[:5], round(r[5], 6)) for r in rows)
    assert as_rows(got) == plain_base(docs)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    same = defaultdict(set)
    for r in got:
        same[r.doc_id, r.n_tokens].add(round(r.score, 9))
    assert all(len(x) == 1 for x in same.values())
    # With next to no frequent token, nearly all go through the join.
    monkeypatch.setattr(hmm, "HEAVY", 10)
    rare = hmm.score_documents(frame(spark, docs), states=3, rounds=1).collect()
    assert as_rows(rare) == plain_base(docs)
    assert hmm.score_documents(frame(spark, []), states=2, rounds=1).count() == 0


def test_model_learns_and_is_a_distribution(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = hmm.score_documents(docs, rounds=0).filter("held_out").groupBy().sum("score", "base_score").first()
    after = hmm.score_documents(docs, rounds=4).filter("held_out").groupBy().sum("score", "base_score").first()
    assert after[0] > before[0] and after[0] > after[1]


# -- packing ------------------------------------------------------------------


def test_encoder_equals_the_tokenizer():
    rng = random.Random(9)
    parts = [" ", "  ", "\n", " \n", "a", "Bé", "\t", " ", "\x1c", "\x85", "1", "23", "'s", "!!", "　", "<|endoftext|>", "日本"]
    encode = packing.Encoder(PATH)
    assert encode.fast is not None
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert encode.encode(text) == encode.plain(text)
        text = "".join(chr(rng.choice([rng.randrange(0x250), 32, 10, rng.randrange(128)])) for _ in range(12))
        assert encode.encode(text) == encode.plain(text)
    for code in range(0x250):
        text = f"a{chr(code)}b {chr(code)}{chr(code)} 1{chr(code)}"
        assert encode.encode(text) == encode.plain(text)


def best_fit_decreasing(lengths, capacity):
    import bisect

    rooms, opened = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        opened += at == len(rooms)
        room = (rooms.pop(at) if at < len(rooms) else capacity) - n
        bisect.insort(rooms, room)
    return opened


def test_plans_are_whole_and_tight():
    rng = random.Random(1)
    cases = [[rng.randint(1, 1024) for _ in range(n)] for n in (0, 1, 10, 300, 4000)]
    cases += [[700] * 500 + [324] * 400 + [400] * 9, [1] * 3000, [1024] * 4 + [513] * 7 + [512] * 9, [300] * 1000 + [20] * 50]
    for lengths in cases:
        seen, held = Counter(), defaultdict(list)
        for length, rank, number, first, offset in packing.plan_packing(Counter(lengths)):
            for i in range(number):
                seen[length, rank + i] += 1
                held[first + i].append((offset, length))
        counts = Counter(lengths)
        assert seen == Counter((n, i) for n, k in counts.items() for i in range(k))
        for places in held.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 1024
        assert len(held) <= best_fit_decreasing(lengths, 1024) * 1.005 + 1


def test_packing(spark):
    docs = odd_documents()
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    wanted = Counter()
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        at, stop, piece = 0, (len(ids) - 1) % 64 + 1, 0
        while at < len(ids):
            wanted[i, piece, at, stop - at, zlib.crc32(np.array(ids[at:stop], dtype="<u4").tobytes())] += 1
            at, stop, piece = stop, stop + 64, piece + 1
    got = packing.pack_documents(frame(spark, docs), PATH, capacity=64).collect()
    assert Counter(tuple(r)[:5] for r in got) == wanted
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(held) <= best_fit_decreasing([r.length for r in got], 64) * 1.01 + 1
    assert packing.pack_documents(frame(spark, []), PATH).count() == 0
