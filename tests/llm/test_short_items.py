"""Short benchmark items: every copy within the edits allowed is found."""

from __future__ import annotations

import random

import pytest
from test_quality_leaks import edited, plain_end_distances

from blockframe.llm import decontaminate as dc


@pytest.mark.parametrize("n", [1, 2, 4, 5, 8, 12, 14])
def test_short_items_are_always_found(n):
    rng = random.Random(n)
    words = [f"v{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k in range(40)]
    texts, wanted = [], []
    for k, item in items * 5:
        copy = edited(rng, item.split(), dc.allowed(n, 0.8), words)
        text = [rng.choice(words) for _ in range(20)] + copy + [rng.choice(words) for _ in range(20)]
        texts.append(" ".join(text))
        codes = [w.encode() for w in text]
        wanted.append({(i, best) for i, t in items if (best := min(plain_end_distances(dc.words_of(t), codes))) <= dc.allowed(n, 0.8)})
    finder = dc.Finder(items)
    assert [{(h[0], h[3]) for h in found} for found in finder.find(texts)] == wanted


def test_lengths_that_walks_do_not_reach_are_looked_up(monkeypatch):
    rng = random.Random(2)
    words = [f"v{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(16 if k < 5 else 59))) for k in range(60)]
    finder = dc.Finder(items, recall=1.1)  # never reached
    assert finder.exact.all()
    copies = [" ".join(edited(rng, t.split(), dc.allowed(len(t.split()), 0.8), words)) for _, t in items]
    assert all(any(h[0] == k for h in found) for (k, _), found in zip(items, finder.find(copies)))


def test_no_items_and_no_words():
    assert dc.Finder([]).find(["a b", None]) == [[], []]
    assert dc.Finder([(1, ""), (2, None), (3, "One two")]).find(["x one, two", "two one"]) == [[(3, 1, 3, 0, 2)], []]
