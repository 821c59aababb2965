"""Sequences of bounded length packed by linear grouping and few-size configurations."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockframe.llm.common import cut_lineage, number_within, text_or_empty

#: Groups of equal cardinality that large lengths are rounded up within: few enough that most are rounded.
GROUPS = 512
#: Lengths of at most this part of a sequence are small.
SMALL_PART = 8


class Encoder:
    """Token ids of texts, little-endian with 32 bits each, as a tokenizer file gives them.

    Texts of Latin characters go through a faster library with the file's own
    vocabulary, where that is a byte-level one in order of its merges; both
    give the same ids there.  Special strings are ordinary text.
    """

    _latin = re.compile("[^\x00-\u024f]")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.fast = self._fast(path)

    @staticmethod
    def _fast(path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        own, merges = parts["model"].get("vocab"), parts["model"].get("merges")
        if parts["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            return None
        if not merges or any(own["".join(m if isinstance(m, list) else m.split(" "))] != 256 + k for k, m in enumerate(merges)):
            return None
        # Visible bytes stand for themselves, the others for 256 and on.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in token): i for token, i in own.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.fast is None or not text.isascii() and self._latin.search(text):
            return self.plain(text)
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for a Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``(doc_id, piece, start, length, ids_crc32)``.

    A document is its text's ids and ``end_id``.  Only a longer one is cut, so
    that all its pieces but the first are full.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer).encode, int(end_id).to_bytes(4, "little")
        for batch in batches:
            docs, numbers, starts, lengths, sums = [], [], [], [], []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = memoryview(encode(text) + end)
                total = len(ids) // 4
                at, stop = 0, (total - 1) % capacity + 1
                number = 0
                while at < total:
                    docs.append(doc)
                    numbers.append(number)
                    starts.append(at)
                    lengths.append(stop - at)
                    sums.append(zlib.crc32(ids[4 * at : 4 * stop]))
                    at, stop, number = stop, stop + capacity, number + 1
            yield pd.DataFrame({
                "doc_id": pd.array(docs, dtype="string"), "piece": np.array(numbers, dtype=np.int32),
                "start": np.array(starts, dtype=np.int64), "length": np.array(lengths, dtype=np.int64), "ids_crc32": np.array(sums, dtype=np.int64),
            })

    # As strings, since pandas would make null and whole numbers floats.
    rows = docs.select(docs[id_col].cast("string").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    cut = rows.mapInPandas(pieces, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return cut.withColumn("doc_id", F.col("doc_id").cast("long"))


def fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each of the ascending ``sizes`` fill ``capacity`` best, the largest one that is left among them."""
    top = max(k for k, n in enumerate(left) if n)
    held = [0] * len(sizes)
    held[top] = 1
    room, reach, steps = capacity - sizes[top], 1, []
    mask = (1 << room + 1) - 1
    for k, size in enumerate(sizes):
        for _ in range(min(left[k] - held[k], room // size)):
            steps.append((k, reach))
            reach |= reach << size & mask
    at = reach.bit_length() - 1
    for k, before in reversed(steps):
        if at >= sizes[k] and before >> (at - sizes[k]) & 1:
            held[k] += 1
            at -= sizes[k]
    return held


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """Numbers of sequences and how many of each size they hold, using up ``demand``.

    Around the largest size left, the configuration that fills a sequence best
    is found by dynamic programming over the sums that the sizes left can
    reach, with the larger sizes preferred, and is used as often as they
    last.  Every step exhausts a size, unless a few items are left of it.
    """
    live, left, out = sorted(range(len(sizes)), key=lambda k: sizes[k]), list(demand), []
    while live := [k for k in live if left[k]]:
        best = fullest([sizes[k] for k in live], [left[k] for k in live], capacity)
        times = min(left[k] // h for k, h in zip(live, best) if h)
        held = [0] * len(sizes)
        for k, h in zip(live, best):
            held[k] = h
            left[k] -= times * h
        out.append((times, held))
    return out


def plan_packing(counts: dict[int, int], capacity: int = 1024, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Places ``(length, first rank, number, first sequence, offset)`` for all items, from their number by length.

    Items of equal length are interchangeable and ranked from 0.  Item
    ``first rank + i`` goes to ``first sequence + i``.  Large lengths are
    sorted, split into groups of equal cardinality and rounded up to the
    longest of the group; the configurations of these few sizes are optimised;
    the items of a group take its places, longest first; the small ones go,
    longest first, where they fit best.  The plan's size
    depends on ``capacity`` and ``groups``, not on the number of items.
    """
    left, rank, places, sequences = dict(counts), dict.fromkeys(counts, 0), [], 0
    spaces: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free room: (first sequence, number)

    def place(length: int, number: int, first: int, offset: int) -> None:
        places.append((length, rank[length], number, first, offset))
        rank[length] += number
        left[length] -= number

    large = sorted((n for n in counts if capacity // SMALL_PART < n < capacity and counts[n]), reverse=True)
    total = sum(counts[n] for n in large)
    share = max(1, -(-total // groups))
    runs: list[list[list[int]]] = []  # of each group: [length, number]
    seen = 0
    for n in large:
        rest = counts[n]
        while rest:
            if seen % share == 0:
                runs.append([])
            taken = min(rest, share - seen % share)
            runs[-1].append([n, taken])
            seen, rest = seen + taken, rest - taken
    merged: dict[int, list[list[int]]] = {}
    for group in runs:
        merged.setdefault(group[0][0], []).extend(group)
    sizes = list(merged)
    for times, held in configurations(sizes, [sum(k for _, k in merged[s]) for s in sizes], capacity):
        while times:
            used = [(merged[s], h) for s, h in zip(sizes, held) if h]
            same = min([times, *(r[0][1] // h for r, h in used)])
            step, offset = max(1, same), 0
            for r, h in used:
                for _ in range(h):
                    length = r[0][0]
                    place(length, step, sequences, offset)
                    offset += length
                    r[0][1] -= step
                    if not r[0][1]:
                        r.pop(0)
            spaces[capacity - offset].append((sequences, step))
            sequences += step
            times -= step

    for length in sorted(left, reverse=True):
        room = length
        while left[length] and room <= capacity:
            if not spaces[room]:
                room += 1
                continue
            first, number = spaces[room].pop()
            taken = min(number, left[length])
            place(length, taken, first, capacity - room)
            if taken < number:
                spaces[room].append((first + taken, number - taken))
            spaces[room - length].append((first, taken))
            if room - length >= length:
                room -= length
        fill = capacity // length
        for number, each in ((left[length] // fill, fill), (1, left[length] % fill)):
            if number and each:
                for k in range(each):
                    place(length, number, sequences, k * length)
                spaces[capacity - each * length].append((sequences, number))
                sequences += number
    return places


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 2,
    groups: int = GROUPS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` ids.

    ``tokenizer`` is the path of a tokenizer file on every machine.  Documents
    are tokenized once; only piece lengths move on.  The number of pieces by
    length (at most ``capacity`` numbers, at any input size) makes the plan,
    whose size does not grow with the input either and which is broadcast.
    Pieces of one length are ranked in blocks, so a length that a third of
    them share is not one task.

    Returns ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``.
    Null text is empty: a piece of the end id alone.  Ids are integers and may
    be null or repeated; other columns are not read; an empty table gives no
    rows.
    """
    spark = docs.sparkSession
    pieces = cut_lineage(cut_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = spark.createDataFrame(
        plan_packing(counts, capacity, groups), "plan_length long, first_rank long, number long, first_sequence long, offset long"
    )
    ranked = number_within(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "rank")
    inside = (
        (F.col("length") == F.col("plan_length"))
        & (F.col("rank") >= F.col("first_rank"))
        & (F.col("rank") < F.col("first_rank") + F.col("number"))
    )
    return ranked.join(F.broadcast(plan), inside).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
        "offset",
    )
