"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edit distance."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockframe.llm.common import cut_lineage, text_or_empty

#: Words of an item below which it matches nothing, and below which it is looked up by its pieces instead of walks.
MIN_WORDS, WALKED = 1, 15
#: Least words of the classes of lengths whose recall is measured, and trials of each.
CLASSES, TRIALS = (15, 20, 30, 60), 100
#: Coordinates of the embedding that are sampled from, and how many are sampled.
REACH, SAMPLED = 8, 4
#: Words between the places of an item from which its windows are embedded.
STRIDE = 4
#: Items and bytes of their texts sent to the tasks at a time.
ITEMS, ITEM_BYTES = 20_000, 32 << 20
#: Cells of the table of items by words; more are looked up by search.
TABLE = 1 << 25
MARKS = b".,;:!?()[]{}\"'"


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words (A-Z) at ASCII white space, without punctuation marks."""
    return (text or "").encode().lower().translate(None, MARKS).split()


def allowed(n: int, similarity: float) -> int:
    """Edits that an item of ``n`` words may have."""
    return math.floor(n * (1 - similarity) + 1e-9)


def end_distances(masks: dict[int, int], n: int, text: Sequence[int]) -> list[int]:
    """Least edit distance of the whole item to a run ending after each word of ``text`` (bit-parallel)."""
    full, last = (1 << n) - 1, 1 << n - 1
    plus, minus, score, out = full, 0, n, []
    for word in text:
        equal = masks.get(word, 0)
        x = equal | minus
        diagonal = ((x & plus) + plus ^ plus) | x
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        score += (up & last > 0) - (down & last > 0)
        up = up << 1 & full
        down = down << 1 & full
        minus = up & diagonal
        plus = down | ~(diagonal | up) & full
        out.append(score)
    return out


class Finder:
    """Finds items in texts.

    ``repeats`` random walks embed every window: a step puts out the word it
    stands on and moves on by a random bit of word and step, so an edit changes
    few coordinates.  For each walk ``SAMPLED`` coordinates are sampled (the
    first always, the others of the first ``REACH``); windows that agree with
    an item's there are candidates.  The samples of all items form a trie, so a
    window is walked only as long as some item still agrees.  ``repeats`` is
    chosen so that items with the most edits allowed are met with probability
    ``recall`` in each class of lengths, as measured on edited items.  Items of
    fewer than ``WALKED`` words, and those of classes that 32 walks do not bring
    to ``recall``, are looked up exactly: cut into one piece more than edits
    allowed, of which one always stands whole.
    """

    def __init__(self, items: Sequence[tuple[object, str | None]], similarity: float = 0.8, recall: float = 0.99, seed: int = 11) -> None:
        self.similarity, self.codes = similarity, {}
        self.ids, self.items = [], []
        for item, text in items:
            words = words_of(text)
            if len(words) >= MIN_WORDS:
                self.ids.append(item)
                self.items.append(np.array([self.codes.setdefault(w, len(self.codes) + 1) for w in words], dtype=np.int32))
        self.size = len(self.codes) + 1
        self.lengths = np.array([len(x) for x in self.items], dtype=np.int64)
        self.edits = np.array([allowed(len(x), similarity) for x in self.items], dtype=np.int64)
        self.held = np.unique(np.concatenate([k * self.size + x.astype(np.int64) for k, x in enumerate(self.items)] or [np.zeros(1, np.int64)]))
        self.table = None  # of the words each item has, where that is small
        if len(self.items) * self.size <= TABLE:
            self.table = np.zeros(len(self.items) * self.size + 1, dtype=bool)
            self.table[self.held] = bool(self.items)
        self.masks = []
        for item in self.items:
            masks: dict[int, int] = defaultdict(int)
            for i, w in enumerate(item.tolist()):
                masks[w] |= 1 << i
            self.masks.append(dict(masks))
        rng = np.random.default_rng(seed)
        self.walks: list = []
        self.exact, self.pieces = self.lengths < WALKED, []
        while not self.exact.all():
            self.walks.append(self._walk(rng))
            if len(self.walks) in (2, 4, 8, 16, 24, 32):
                short = self._below(recall, np.random.default_rng(seed + 1))
                if not short.any():
                    break
                if len(self.walks) == 32:
                    self.exact = self.exact | short
                    break
        self.pieces = self._cut()

    def _cut(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Levels of a trie of the pieces of ``exact`` items: keys, children, and the pieces that end at each node."""
        tables: list[dict[int, dict[int, int]]] = []
        ends: list[dict[int, list[tuple[int, int]]]] = []
        for k in np.flatnonzero(self.exact).tolist():
            bounds = np.linspace(0, self.lengths[k], int(self.edits[k]) + 2).astype(int).tolist()
            for a, b in zip(bounds, bounds[1:]):
                node = 0
                for level, word in enumerate(self.items[k][a:b].tolist()):
                    if level == len(tables):
                        tables.append({})
                        ends.append(defaultdict(list))
                    node = tables[level].setdefault(node * self.size + word, len(tables[level]) + 1)
                ends[b - a - 1][node].append((k, a))
        out = []
        for table, at in zip(tables, ends):
            keys = np.array(sorted(table), dtype=np.int64)
            children = np.array([table[x] for x in keys.tolist()], dtype=np.int64)
            counts = np.array([len(at.get(n, ())) for n in range(len(table) + 1)], dtype=np.int64)
            listed = np.array([x for n in range(len(table) + 1) for x in at.get(n, ())], dtype=np.int64).reshape(-1, 2)
            out.append((keys, children, counts, listed))
        return out

    def _walk(self, rng: np.random.Generator) -> tuple[np.ndarray, list[tuple]]:
        bits = rng.integers(0, 2, (REACH, self.size), dtype=np.int8)
        coordinates = np.sort(rng.choice(np.arange(1, REACH), SAMPLED - 1, replace=False))
        tables = [defaultdict(dict) for _ in range(SAMPLED)]
        leaves: dict[int, list[tuple[int, int]]] = defaultdict(list)
        numbers = [1] * SAMPLED
        for k, item in enumerate(self.items):
            if self.exact[k]:
                continue
            for offset in sorted({*range(0, len(item) - REACH + 1, STRIDE), len(item) - REACH}):
                at, node = offset, 0
                for step in range(int(coordinates[-1]) + 1):
                    level = 0 if step == 0 else 1 + int(np.searchsorted(coordinates, step))
                    if step == 0 or step in coordinates:
                        below = tables[level][node]
                        word = int(item[at])
                        if word not in below:
                            below[word] = numbers[level]
                            numbers[level] += 1
                        node = below[word]
                    at += int(bits[step, item[at]])
                leaves[node].append((k, offset))
        levels = []
        for level in range(SAMPLED):
            keys = [(node * self.size + word, child) for node, below in tables[level].items() for word, child in below.items()]
            keys.sort()
            levels.append((np.array([a for a, _ in keys], dtype=np.int64), np.array([b for _, b in keys], dtype=np.int64)))
        ends = [x for node in range(1, numbers[-1]) for x in leaves[node]]
        counts = np.array([0, *(len(leaves[node]) for node in range(1, numbers[-1]))], dtype=np.int64)
        return bits, [(coordinates, levels, counts, np.array(ends, dtype=np.int64).reshape(-1, 2))]

    def candidates(self, text: np.ndarray) -> np.ndarray:
        """(item, window's place in the text, window's place in the item) of all windows and pieces that agree with an item's."""
        found = [np.zeros((0, 3), dtype=np.int64)]
        padded = np.concatenate([text, np.zeros(REACH, dtype=text.dtype)])
        known = np.flatnonzero(text)
        for bits, made in self.walks:
            for coordinates, levels, counts, ends in made:
                if not len(ends):
                    continue
                first, children = levels[0]
                at = np.full(self.size, 0, dtype=np.int64)
                at[first] = children
                node = at[text[known]]
                starts, node = known[node > 0], node[node > 0]
                place, level = starts.copy(), 1
                for step in range(int(coordinates[-1]) + 1):
                    if step in coordinates:
                        keys, children = levels[level]
                        wanted = node * self.size + padded[place]
                        k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                        same = (keys[k] == wanted) & (padded[place] > 0)
                        starts, place, node, level = starts[same], place[same], children[k[same]], level + 1
                    place = place + bits[step, padded[place]]
                times = counts[node]
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                leaf = ends[np.repeat((np.cumsum(counts) - counts)[node], times) + nth]
                found.append(np.column_stack([leaf[:, 0], np.repeat(starts, times), leaf[:, 1]]))
        starts, node = known, np.zeros(len(known), dtype=np.int64)
        for step, (keys, children, counts, ends) in enumerate(self.pieces):
            words = padded[starts + step]
            wanted = node * self.size + words
            k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            same = (keys[k] == wanted) & (words > 0)
            starts, node = starts[same], children[k[same]]
            times = counts[node]
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            leaf = ends[np.repeat((np.cumsum(counts) - counts)[node], times) + nth]
            found.append(np.column_stack([leaf[:, 0], np.repeat(starts, times), leaf[:, 1]]))
        item, place, offset = np.concatenate(found).T
        longest = int(self.lengths.max(initial=0)) + 1
        once = np.unique((place * (len(self.items) + 1) + item) * longest + offset)
        rest, offset = once // longest, once % longest
        return np.column_stack([rest % (len(self.items) + 1), rest // (len(self.items) + 1), offset])

    def _below(self, recall: float, rng: np.random.Generator) -> np.ndarray:
        """Walked items of classes of lengths that are met too seldom after the most edits allowed (random replacements, insertions, losses)."""
        below = np.zeros(len(self.items), dtype=bool)
        for low, high in zip(CLASSES, [*CLASSES[1:], 1 << 62]):
            there = (self.lengths >= low) & (self.lengths < high) & ~self.exact
            members = rng.permutation(np.flatnonzero(there))
            if not len(members):
                continue
            met = 0
            for k in np.resize(members, TRIALS).tolist():
                words = self.items[k].tolist()
                for _ in range(allowed(len(words), self.similarity)):
                    i, kind = int(rng.integers(len(words))), int(rng.integers(3))
                    words[i : i + (kind != 1)] = [] if kind == 2 else [int(rng.integers(self.size))]
                met += bool((self.candidates(np.array(words or [0], dtype=np.int32))[:, 0] == k).any())
            if met / TRIALS < recall:
                below |= there
        return below

    def coded(self, words: list[bytes]) -> np.ndarray:
        code = self.codes.get
        return np.fromiter(map(code, words, repeat(0)), dtype=np.int32, count=len(words))

    def find(self, texts: Sequence[str | None]) -> list[list[tuple[object, int, int, int, int]]]:
        """Of each text, the items it holds: (item, first word, word after the last, edits, words of the item)."""
        parts = [self.coded(words_of(t)) for t in texts]
        gap = np.zeros(REACH, dtype=np.int32)
        laid = np.concatenate([x for p in parts for x in (p, gap)]) if parts else gap
        starts = np.cumsum([0, *[len(p) + REACH for p in parts]])
        k, place, offset = self.candidates(laid).T
        doc = np.searchsorted(starts, place, side="right") - 1
        n, edits = self.lengths[k], self.edits[k]
        low = np.maximum(place - offset - edits, starts[doc])
        high = np.minimum(place - offset + n + edits, starts[doc + 1] - REACH)
        enough = np.zeros(len(k), dtype=bool)  # of the item's words stand there
        for a in range(0, len(k), 8192):
            c = slice(a, a + 8192)
            at = low[c, None] + np.arange((high[c] - low[c]).max())
            words = np.where(at < high[c, None], laid[np.minimum(at, len(laid) - 1)], 0)
            keys = k[c, None] * self.size + words
            if self.table is None:
                there = self.held[np.minimum(np.searchsorted(self.held, keys), len(self.held) - 1)] == keys
            else:
                there = self.table[keys]
            enough[c] = (there & (words > 0)).sum(1) >= (n - edits)[c]
        by_pair: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
        for d, i, x, y in zip(doc[enough].tolist(), k[enough].tolist(), (low - starts[doc])[enough].tolist(), (high - starts[doc])[enough].tolist()):
            by_pair[d, i].add((x, y))
        out: list[list] = [[] for _ in parts]
        for (doc, k), places in sorted(by_pair.items()):
            item, text = self.items[k], parts[doc]
            n, edits = len(item), int(self.edits[k])
            best, done = None, -1
            for a, b in sorted(places):
                if b <= done:
                    continue
                done = b
                for i, distance in enumerate(end_distances(self.masks[k], n, text[a:b].tolist())):
                    if distance <= edits and (best is None or distance < best[0]):
                        best = (distance, a + i + 1)
            if best:
                out[doc].append((self.ids[k], self._first(k, text, best), best[1], best[0], n))
        return out

    def _first(self, k: int, text: np.ndarray, best: tuple[int, int]) -> int:
        """Where the match that ends at ``best`` begins: the shortest such run."""
        item = self.items[k][::-1].tolist()
        distance, end = best
        if not distance:
            return end - len(item)
        back = text[max(0, end - len(item) - distance) : end][::-1].tolist()
        row = list(range(len(item) + 1))
        for i, w in enumerate(back, 1):
            new = [i]
            for j, x in enumerate(item, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
            row = new
            if row[-1] == distance:
                return end - i
        return end - len(back)


def _blocks(benchmark: DataFrame, text_col: str) -> Iterator[tuple[bool, list[tuple[str, str]]]]:
    """Whether there are several blocks, and the distinct texts ``(key, text)`` of each, by their MD5.

    Equal texts are one item.  A block has ``ITEMS`` texts and ``ITEM_BYTES``,
    twice as much at most or a single text: their numbers are counted before
    anything is gathered, and the blocks doubled until all are.
    """
    texts = cut_lineage(_keyed(benchmark, text_col).select("key", "text").filter("text <> ''").dropDuplicates(["key"]), "items")
    size = F.octet_length("text").cast("long")
    whole = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    blocks = max(-(-whole.n // ITEMS), -(-whole.bytes // ITEM_BYTES), 1)
    while True:
        dealt = texts.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
        counts = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
        if not counts.filter((F.col("n") > 1) & ((F.col("n") > 2 * ITEMS) | (F.col("bytes") > 2 * ITEM_BYTES))).head(1):
            break
        blocks *= 2
    for b in range(blocks):
        yield blocks > 1, sorted((r.key, r.text) for r in dealt.filter(F.col("block") == b).collect())


def _keyed(benchmark: DataFrame, text_col: str, *columns: Column) -> DataFrame:
    text = text_or_empty(benchmark[text_col])
    return benchmark.select(*columns, F.md5(text).alias("key"), text.alias("text"))


def benchmark_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = 0.8,
    recall: float = 0.99,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """Benchmark items that documents hold, with at most ``1 - similarity`` of their words edited.

    Words are compared in lower case and without punctuation marks.  Items go
    to the tasks in blocks, equal texts once; documents are not shuffled, but
    read once for each block.  Of several blocks only one is with the tasks at
    a time, and its results are stored.  Null and
    empty texts hold nothing; items without words match nothing, and those of
    fewer than five allow no edit; repeated rows give repeated rows.

    Returns one row for each document and item: ``(doc_id, item_id,
    first_word, end_word, edits, item_words)``, of the place with the fewest
    edits.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(docs[id_col].cast("string").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    schema = "doc_id string, key string, first_word long, end_word long, edits int, item_words int"
    out = None
    for several, block in _blocks(benchmark, "text"):
        finder = context.broadcast(Finder(block, similarity, recall))

        def search(batches: Iterator[pd.DataFrame], finder=finder) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for a in range(0, len(batch), 500):
                    part = batch.iloc[a : a + 500]
                    hits = [(d, *h) for d, found in zip(part["doc_id"], finder.value.find(part["text"].tolist())) for h in found]
                    yield pd.DataFrame(hits, columns=["doc_id", "key", "first_word", "end_word", "edits", "item_words"])

        found = rows.mapInPandas(search, schema)
        if several:
            found = cut_lineage(found, "passages")
            finder.destroy()
        out = found if out is None else out.union(found)
    named = _keyed(benchmark, "text", benchmark[item_col].alias("item_id")).select("item_id", F.col("key").alias("_key"))
    return out.join(named, F.col("key") == F.col("_key")).select(
        F.col("doc_id").cast(docs.schema[id_col].dataType), "item_id", "first_word", "end_word", "edits", "item_words"
    )


def _holds(finder: Broadcast, text: Column) -> Column:
    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found: list[bool] = []
            for a in range(0, len(batch), 500):
                found += [bool(x) for x in finder.value.find(batch.iloc[a : a + 500].tolist())]
            yield pd.Series(found, dtype=bool)

    return holds(text)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.99, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose text holds no benchmark item; see ``benchmark_passages``.

    Of several blocks of items each passes over what the ones before left, a
    stored table, and only one is with the tasks at a time.
    """
    context = benchmark.sparkSession.sparkContext
    for several, block in _blocks(benchmark, "text"):
        finder = context.broadcast(Finder(block, similarity, recall))
        docs = docs.filter(~_holds(finder, docs[text_col]))
        if several:
            docs = cut_lineage(docs, "clean")
            finder.destroy()
    return docs
