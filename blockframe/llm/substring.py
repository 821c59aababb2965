"""Removal of word passages that were seen earlier, behind a count-min prefilter."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockframe.llm.common import shuffle_partitions, text_or_empty

#: Text bytes of a chunk (a group of documents) and of a block of the sketch, on average.
CHUNK_BYTES, BLOCK_BYTES = 3 << 20, 8 << 20
#: Words whose hashes a Python worker remembers.
KNOWN_WORDS = 300_000
#: Odd multipliers of the two window hashes.  Fixed values.
STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """128-bit hashes of words; at most ``KNOWN_WORDS`` are remembered."""

    def __missing__(self, word: bytes) -> bytes:
        digest = xxhash.xxh3_128_digest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = digest
        return digest


_words = _Words()


def window_hashes(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every run of ``window`` words."""
    both = np.frombuffer(b"".join(map(_words.__getitem__, words)), dtype="<u8").reshape(-1, 2)
    out = []
    for column, step in enumerate(STEPS):
        one, length, power = np.ascontiguousarray(both[:, column]), 1, step
        total, done = None, 0  # of the first ``done`` words of each window
        rest = window
        while rest:
            if rest & 1:
                if total is None:
                    total = one
                else:  # the words done so far stand before this run
                    shifted = one[done:]
                    total = total[: len(shifted)] * np.uint64(pow(step, length, 1 << 64)) + shifted
                done += length
            rest >>= 1
            if rest:
                one = one[: len(one) - length] * np.uint64(power) + one[length:]
                length, power = 2 * length, power * power % (1 << 64)
        out.append(total[: len(words) - window + 1])
    return out[0], out[1]


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted whole numbers as compressed differences."""
    steps = np.diff(values, prepend=values[:1]) if len(values) else values
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(steps) or int(steps.max()) <= np.iinfo(k).max)
    planes = steps.astype(kind).view(np.uint8).reshape(len(steps), int(kind[2:])).T
    first = int(values[0]) if len(values) else 0
    body = np.ascontiguousarray(planes).tobytes()
    return first.to_bytes(8, "little") + kind.encode()[1:] + len(steps).to_bytes(8, "little") + zstandard.ZstdCompressor(1).compress(body)


def unpack_sorted(data: bytes) -> np.ndarray:
    kind, count = f"<{data[8:10].decode()}", int.from_bytes(data[10:18], "little")
    body = zstandard.ZstdDecompressor().decompress(data[18:], max_output_size=max(1, count * int(kind[2:])))
    planes = np.frombuffer(body, dtype=np.uint8).reshape(int(kind[2:]), count).T
    steps = np.ascontiguousarray(planes).view(kind).ravel().astype(np.uint64)
    return np.cumsum(steps, dtype=np.uint64) + np.uint64(int.from_bytes(data[:8], "little"))


class _Chunk:
    """Documents of a chunk in order, with the hashes of all their windows."""

    def __init__(self, rows: pd.DataFrame, window: int, hashes: bool = True) -> None:
        found = sorted((i is not None, int(i or 0), t) for i, t in zip(rows["doc_id"].tolist(), rows["text"].tolist()))
        self.texts = [t for _, _, t in found]
        self.ids = [i if named else None for named, i, _ in found]
        firsts, seconds, counts = [], [], []
        self.words = None if hashes else [t.encode().split() for t in self.texts]
        for t in self.texts if hashes else ():
            words = t.encode().split()
            counts.append(max(0, len(words) - window + 1))
            if counts[-1]:
                a, b = window_hashes(words, window)
                firsts.append(a)
                seconds.append(b)
        if self.words is not None:
            counts = [max(0, len(w) - window + 1) for w in self.words]
        self.starts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])  # of each document among the windows
        empty = np.zeros(0, dtype=np.uint64)
        self.first = np.concatenate(firsts or [empty])
        self.second = np.concatenate(seconds or [empty])


def remove_repeats(
    docs: DataFrame, window: int = 20, depth: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that starts earlier elsewhere.

    Earlier is a smaller id, or the same document and an earlier start; null
    ids come first.  Windows are judged on the input.  Rows that agree in id,
    or have none, are ordered by the chunk that a hash of id and text deals
    them to, and within a chunk by text.

    Documents are dealt by id and text into chunks.  Every chunk counts its windows in
    the cells of a count-min sketch with ``depth`` rows; a chunk's sketch
    travels as the sorted cells it touched, cut into blocks.  The sketches are
    merged block by block, and each chunk is told which of its cells hold two
    windows or more.  Only windows whose cells all do are sent on, once for
    each chunk, and grouped exactly by a 128-bit hash; every other window is
    unique, as the sketch never counts too low.  The width of the sketch and
    the numbers of chunks and blocks grow with the text, so no task holds more
    than a chunk or a block; a passage in every document is sent once for a
    chunk.  All three steps read the documents from one shuffle.

    Returns ``(doc_id, n_words, n_removed, kept_sha256, kept)``; ``kept`` is
    the text that stays.  Null text has no word.  Ids are integers.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 1
    chunks, parts = -(-size // CHUNK_BYTES), shuffle_partitions(spark)
    blocks = max(parts, -(-size // BLOCK_BYTES))
    width = 1 << max(16, (size - 1).bit_length())  # about six cells for a window
    block_width = -(-width // blocks)
    bucket_width = -(-(1 << 64) // blocks)
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))
    # Ids go to Python as strings, since pandas would make null and whole numbers floats.
    dealt = rows.select(key.alias("chunk"), F.col("doc_id").cast("string"), "text").repartition(max(parts, -(-size // (64 << 20))), "chunk")

    def cells(first: np.ndarray, row: int) -> np.ndarray:
        turned = first * np.uint64(STEPS[row % 2] + 2 * row) if row else first
        return turned >> np.uint64(65 - width.bit_length())

    def sketch(chunk: tuple, group: pd.DataFrame) -> pd.DataFrame:
        first, out = _Chunk(group, window).first, []
        for row in range(depth if len(first) else 0):
            touched = np.sort(cells(first, row))
            at = touched // np.uint64(block_width)
            cuts = np.flatnonzero(np.diff(at, prepend=at[:1] + np.uint64(1)))
            for a, b in zip(cuts, [*cuts[1:], len(at)]):
                out.append((chunk[0], row * blocks + int(at[a]), pack_sorted(touched[a:b])))
        return pd.DataFrame(out, columns=["chunk", "block", "cells"])

    def merge(block: tuple, group: pd.DataFrame) -> pd.DataFrame:
        base = np.uint64(int(block[0]) % blocks * block_width)
        sent = [(unpack_sorted(c) - base).astype(np.int64) for c in group["cells"]]
        counts = np.zeros(block_width, dtype=np.uint8)
        for touched in sent:
            once, times = np.unique(touched, return_counts=True)
            counts[once] = np.minimum(2, counts[once] + np.minimum(2, times))
        many = [np.packbits(counts[touched] >= 2).tobytes() for touched in sent]
        return pd.DataFrame({"chunk": group["chunk"], "block": block[0], "n": [len(t) for t in sent], "many": many})

    def suspects(chunk: tuple, group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        own, columns = _Chunk(group, window), ["chunk", "bucket", "first", "second", "place", "sure", "ids", "starts"]
        maybe, told = np.ones(len(own.first), dtype=bool), told.sort_values("block")
        for row in range(depth if len(own.first) else 0):
            bits = [
                np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=int(n))
                for m, n in zip(*(told.loc[told["block"] // blocks == row, c] for c in ("many", "n")))
            ]
            held = np.zeros(len(own.first), dtype=bool)
            held[np.argsort(cells(own.first, row), kind="stable")] = np.concatenate(bits)
            maybe &= held
        places = np.flatnonzero(maybe)
        order = places[np.lexsort((places, own.second[places], own.first[places]))]
        first, second = own.first[order], own.second[order]
        again = np.zeros(len(order), dtype=bool)  # an earlier one stands in this chunk
        again[1:] = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        at, out = first // np.uint64(bucket_width), []
        cuts = np.flatnonzero(np.diff(at, prepend=at[:1] + np.uint64(1)))
        ids = np.array([np.iinfo(np.int64).min if i is None else i for i in own.ids], dtype=np.int64)
        for a, b in zip(cuts, [*cuts[1:], len(at)]):
            new, fresh = order[a:b][~again[a:b]], ~again[a:b]
            used = np.unique(np.searchsorted(own.starts, new, side="right") - 1)
            out.append(
                (chunk[0], int(at[a]), pack_sorted(first[a:b][fresh]), second[a:b][fresh].tobytes(), new.astype("<u4").tobytes(),
                 order[a:b][again[a:b]].astype("<u4").tobytes(), ids[used].tobytes(), own.starts[used].tobytes())
            )
        return pd.DataFrame(out, columns=columns)

    def decide(bucket: tuple, group: pd.DataFrame) -> pd.DataFrame:
        firsts, seconds, places, ids, senders = [], [], [], [], []
        for n, m in enumerate(group.itertuples()):
            firsts.append(unpack_sorted(m.first))
            seconds.append(np.frombuffer(m.second, dtype=np.uint64))
            places.append(np.frombuffer(m.place, dtype="<u4"))
            doc = np.searchsorted(np.frombuffer(m.starts, dtype=np.int64), places[-1], side="right") - 1
            ids.append(np.frombuffer(m.ids, dtype=np.int64)[doc])
            senders.append(np.full(len(doc), n))
        numbers = group["chunk"].to_numpy()
        first, second, doc, sender = map(np.concatenate, (firsts, seconds, ids, senders))
        order = np.lexsort((numbers[sender], doc, second, first))
        later = np.zeros(len(order), dtype=bool)
        f, s = first[order], second[order]
        later[1:] = (f[1:] == f[:-1]) & (s[1:] == s[:-1])
        lost = np.zeros(len(order), dtype=bool)
        lost[order] = later
        out, at = [], 0
        for place, sure in zip(places, group["sure"]):
            out.append(place[lost[at : at + len(place)]].tobytes() + sure)
            at += len(place)
        return pd.DataFrame({"chunk": numbers, "covered": out})

    def cut(chunk: tuple, group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        own, out = _Chunk(group, window, hashes=False), []
        covered = np.sort(np.frombuffer(b"".join(told["covered"]), dtype="<u4").astype(np.int64))
        edges = np.searchsorted(covered, own.starts)
        for n, words in enumerate(own.words):
            kept = words
            if edges[n] < edges[n + 1]:
                change = np.zeros(len(words) + 1, dtype=np.int64)
                starts = covered[edges[n] : edges[n + 1]] - own.starts[n]
                np.add.at(change, starts, 1)
                np.add.at(change, starts + window, -1)
                kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
            text = b" ".join(kept)
            out.append((own.ids[n], len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode()))
        frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
        return frame.astype({"doc_id": "Int64"})  # whole numbers with nulls

    by_chunk = dealt.groupBy("chunk")
    touched = by_chunk.applyInPandas(sketch, "chunk long, block long, cells binary")
    many = touched.groupBy("block").applyInPandas(merge, "chunk long, block long, n long, many binary")
    message = "chunk long, bucket long, first binary, second binary, place binary, sure binary, ids binary, starts binary"
    sent = by_chunk.cogroup(many.groupBy("chunk")).applyInPandas(suspects, message)
    covered = sent.groupBy("bucket").applyInPandas(decide, "chunk long, covered binary")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return by_chunk.cogroup(covered.groupBy("chunk")).applyInPandas(cut, out)
