"""Byte-level BPE by a rank file: ids with their places in the text, and back to bytes."""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from blockframe.llm.common import text_or_empty

#: Code points encoded at a time, and the length beyond which a text is encoded in chunks.
SLAB, CHUNK = 1 << 20, 1 << 18
#: Code points of the pieces whose ids a task remembers; then it begins anew.
REMEMBERED = 1 << 22
#: A chunk may end before a blank or line end that follows a visible character: no match of the pattern goes across.
CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85])[ \n]")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: visible Latin-1 ones for themselves, the others from code point 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every pair of tokens that makes a token, lowest rank of the whole first, then of the left part."""
    pairs = []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = token[:i], token[i:]
            if left in ranks and right in ranks:
                pairs.append((rank, ranks[left], left, right))
    return [(left, right) for _, _, left, right in sorted(pairs)]


class ByteCoder:
    """Ids of texts and bytes of ids, for a file with a base64 token and its rank in each line.

    The ``tokenizers`` library gets the ranks as merges over the characters
    that stand for bytes.  A piece that is a token itself is taken whole, as
    the rank form of the method does.  Texts are cut into the pattern's matches,
    which are encoded separately, and most of which recur, so each is encoded
    once and remembered within the task, up to ``REMEMBERED`` code points.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel units
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        shown = byte_characters()
        spell = lambda token: "".join(map(shown.__getitem__, token))
        vocabulary = {spell(token): rank for token, rank in ranks.items()}
        merges = [(spell(a), spell(b)) for a, b in merges_of(ranks)]
        self.tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces = regex.compile(PATTERN).findall
        self._forget()
        # Decoding goes through the reversed byte table.
        byte_of = {c: b for b, c in shown.items()}
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for spelled, rank in vocabulary.items():
            self.tokens[rank] = bytes(map(byte_of.__getitem__, spelled))
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.flat, self.first, self.count = array("i"), array("q"), array("q")

    def _learn(self, lists: list[list[str]]) -> None:
        """Encode the pieces that are not known yet, each once."""
        fresh = set().union(*lists).difference(self.known)
        if self.held > REMEMBERED:
            self._forget()
            fresh = set().union(*lists)
        line = list(fresh)
        for piece, encoding in zip(line, self.tokenizer.encode_batch_fast(line, add_special_tokens=False)):
            ids = encoding.ids
            self.known[piece] = len(self.first)
            self.first.append(len(self.flat))
            self.count.append(len(ids))
            self.flat.extend(ids)
            self.held += len(piece)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: the pattern's matches are encoded separately, equal ones once, and laid in a row."""
        parts = [list(chunks(text)) for text in texts]
        flat_parts = [part for chunked in parts for part in chunked]
        found: list[np.ndarray] = []
        for a, b in _slabs([len(part) for part in flat_parts], SLAB):
            lists = [self.pieces(part) for part in flat_parts[a:b]]
            self._learn(lists)
            flat, first, count = (np.array(x, dtype=np.int64) for x in (self.flat, self.first, self.count))
            for line in lists:
                numbers = np.fromiter(map(self.known.__getitem__, line), dtype=np.int64, count=len(line))
                lengths = count[numbers]
                ends = np.cumsum(lengths)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[numbers] - ends + lengths, lengths)
                found.append(flat[at].astype(np.int32))
        bounds = np.cumsum([0, *map(len, parts)])
        return [found[a] if b - a == 1 else np.concatenate(found[a:b]) for a, b in zip(bounds, bounds[1:])]

    def places(self, data: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First code point of each token and the one behind its last; a character split between tokens belongs to each."""
        character = np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        return character[starts].astype(np.int32), (character[ends - 1] + 1).astype(np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def chunks(text: str) -> Iterator[str]:
    """The text in pieces of about ``CHUNK`` code points, cut only where no match of the pattern goes across."""
    start = 0
    while len(text) - start > CHUNK:
        cut = CUT.search(text, start + CHUNK)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


@lru_cache(maxsize=2)
def coder(path: str) -> ByteCoder:
    return ByteCoder(path)


def _slabs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *arrays]).astype(np.int32)))


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text and the code points that each token covers.

    Null text is empty, an empty text has no ids.  Repeated rows and null ids
    keep their rows; other columns are not read; an empty table gives no rows.
    Texts are encoded some at a time, long ones in chunks, and leave the task
    in batches of about a million code points, one text at least.  A character
    whose bytes are split between tokens counts in each of their spans.

    Returns ``(doc_id, ids, starts, ends)``; starts and ends are code points, end exclusive.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).cast("binary").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks_path)
        for batch in batches:
            data = batch.column("text")
            sizes = pa.compute.binary_length(data).to_pylist()
            for a, b in _slabs(sizes, SLAB):
                raw = data.slice(a, b - a).to_pylist()
                ids = own.encode([x.decode("utf-8", "replace") for x in raw])
                spans = [own.places(x, i) for x, i in zip(raw, ids)]
                arrays = [batch.column("doc_id").slice(a, b - a), _lists(ids), _lists([s for s, _ in spans]), _lists([e for _, e in spans])]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "starts", "ends"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(encode, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded`` (the bytes of the ids, null for null) to a table.

    A character split between tokens comes out whole, since tokens are joined
    as bytes; ids that do not end on a character give the bytes they have.  An
    id that the file does not hold is an error.  A column ``decoded`` is replaced.
    """
    table = encoded.drop("decoded")
    schema = StructType([*table.schema.fields, StructField("decoded", BinaryType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks_path)
        for batch in batches:
            ids = batch.column(ids_col)
            numbers, ends, missing = np.asarray(ids.values), np.asarray(ids.offsets), np.asarray(ids.is_null())
            for a, b in _slabs(np.diff(ends).tolist(), SLAB):
                part = batch.slice(a, b - a)
                out = [None if missing[i] else own.decode(numbers[ends[i] : ends[i + 1]].tolist()) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    return table.mapInArrow(decode, schema)


def encode_and_decode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids of every text and of the bytes they decode to.

    ``n_split`` counts tokens that begin inside a character.  Edge cases are
    those of ``encode_documents``.

    Returns ``(doc_id, n_tokens, ids_sha256, decoded_sha256, n_split)``.
    """
    encoded = encode_documents(docs, ranks_path, id_col, text_col)
    shared = "size(filter(sequence(1, size(ids) - 1), i -> starts[i] < ends[i - 1]))"
    digests = encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.expr(f"cast(if(size(ids) < 2, 0, {shared}) as long)").alias("n_split"),
        "ids",
    )
    back = decode_documents(digests, ranks_path)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")
