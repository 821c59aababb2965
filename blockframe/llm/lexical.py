"""Ranked lexical search by one automaton over the query terms: documents are scanned, not indexed."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockframe.llm.common import cut_lineage, lower_ascii, text_or_empty

#: A term: a run of characters other than ASCII controls, blanks and signs.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes and number of items whose terms make one automaton, on average.
BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 4096
#: Saturation 1.2 in tenths of a mean, length share 75 of 100, as fixed integers.
LENGTH_SHARE, SATURATION, UNIT = 75, 8, 1_000_000_000
#: Parts that a task's best are ranked in before all are.
PARTS = 32

_BLANK = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def guarded(data: bytes) -> bytes:
    """UTF-8 with A-Z lower-cased and a blank for every byte that is in no term, and one at both ends."""
    return b" " + data.translate(_BLANK) + b" "


def term_count(line: bytes) -> int:
    held = np.frombuffer(line, dtype=np.uint8) != 32
    return int(np.count_nonzero(held[1:] & ~held[:-1]))


class TermScan:
    """Occurrences of the terms in guarded text, found by one automaton over ' term ' for every term.

    The blank on both sides keeps parts of longer terms out; neighbours share it.
    """

    def __init__(self, terms: list[str]) -> None:
        import ahocorasick

        self.size = len(terms)
        self.automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            self.automaton.add_word(f" {term} ", i)
        if terms:
            self.automaton.make_automaton()

    def frequencies(self, line: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the terms that occur, and how often."""
        if not self.size:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        found = np.fromiter((i for _, i in self.automaton.iter(line.decode("utf-8", "replace"))), dtype=np.int64)
        return np.unique(found, return_counts=True)


def weight(documents: int, held: int) -> int:
    """Weight of a term that ``held`` of the documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * held + 1)))


class Ranking:
    """The best documents seen so far for each item of a block."""

    def __init__(self, items: list[list[tuple[int, int]]], weights: list[int], totals: tuple[int, int], top: int) -> None:
        self.documents, self.length = totals
        self.weights, self.top = np.array(weights, dtype=np.int64), top
        # What the automaton puts out, a term, maps to the items that hold it and how often.
        rows = sorted((term, item, n) for item, terms in enumerate(items) for term, n in terms)
        self.item = np.array([r[1] for r in rows], dtype=np.int64)
        self.times = np.array([r[2] for r in rows], dtype=np.int64)
        self.starts = np.searchsorted(np.array([r[0] for r in rows], dtype=np.int64), np.arange(len(weights) + 1))
        self.best: list[list[tuple]] = [[] for _ in items]
        self.least = np.ones(len(items), dtype=np.int64)

    def add(self, doc_id: int | None, n_terms: int, terms: np.ndarray, times: np.ndarray) -> None:
        if not len(terms):
            return
        m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n_terms * self.documents) // self.length
        gains = self.weights[terms] * ((UNIT * times) // (1000 * times + SATURATION * m))
        first, counts = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1]) + np.repeat(first - ends + counts, counts)
        scores = np.zeros(len(self.best), dtype=np.int64)
        np.add.at(scores, self.item[at], np.repeat(gains, counts) * self.times[at])
        for item in np.flatnonzero(scores >= self.least).tolist():
            # The smaller id is better, no id is worst.
            entry = (int(scores[item]), doc_id is not None, -(doc_id or 0))
            held = self.best[item]
            if len(held) < self.top:
                heapq.heappush(held, entry)
            elif entry > held[0]:
                heapq.heapreplace(held, entry)
            if len(held) == self.top:
                self.least[item] = max(1, held[0][0])

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for item, held in enumerate(self.best):
            for score, named, doc_id in held:
                yield item, -doc_id if named else None, score


def sorted_terms(text: Column) -> Column:
    """The terms of a text with repeats, in order and with blanks between; what the score of an item depends on."""
    return F.array_join(F.array_sort(F.regexp_extract_all(lower_ascii(text_or_empty(text)), F.lit(TERM), F.lit(0))), " ")


def in_blocks(lists: DataFrame) -> tuple[DataFrame, int]:
    """Deal the distinct ``(key, terms)`` into ``block``s: about ``BLOCK_ITEMS`` lists or ``BLOCK_BYTES``, twice as much at most or a single list."""
    size = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("terms").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-size[0] // BLOCK_ITEMS), -(-size[1] // BLOCK_BYTES))
    while True:
        dealt = lists.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
        counts = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("terms").cast("long")).alias("bytes"))
        if not counts.filter((F.col("n") > 1) & ((F.col("n") > 2 * BLOCK_ITEMS) | (F.col("bytes") > 2 * BLOCK_BYTES))).head(1):
            return dealt, blocks
        blocks *= 2


def statistics(rows: DataFrame, terms: list[str]) -> tuple[int, int, list[int]]:
    """Documents with a term, terms in all of them, and for each of ``terms`` the documents that hold it."""
    sent = rows.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = TermScan(sent.value)
        held, documents, length = np.zeros(scan.size, dtype=np.int64), 0, 0
        for batch in batches:
            for data in batch.column("text"):
                line = guarded(data.as_py())
                n = term_count(line)
                documents, length = documents + (n > 0), length + n
                held[scan.frequencies(line)[0]] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[documents, length], held[some]]))], ["term", "n"]
        )

    found = rows.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r.term: r.n for r in found.collect()}  # two more than there are terms in the block at most
    sent.unpersist()
    return counts.get(-2, 0), counts.get(-1, 0), [counts.get(i, 0) for i in range(len(terms))]


def block_ranking(rows: DataFrame, lists: list[str], top: int) -> DataFrame:
    """``(item, doc_id, score)``: for each list of the block the best documents of every task."""
    counted = [Counter(x.split(" ")) for x in lists]
    terms = sorted({t for words in counted for t in words})
    number = {t: i for i, t in enumerate(terms)}
    items = [[(number[t], n) for t, n in words.items()] for words in counted]
    documents, length, held = statistics(rows, terms)
    weights = [weight(documents, n) for n in held]
    sent = rows.sparkSession.sparkContext.broadcast((terms, items, weights))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, items, weights = sent.value
        scan, ranking = TermScan(terms), Ranking(items, weights, (documents, length), top)
        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                line = guarded(data.as_py())
                ranking.add(doc_id, term_count(line), *scan.frequencies(line))
        columns = list(zip(*ranking.rows())) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return rows.mapInArrow(rank, "item long, doc_id long, score long")


def rank_documents(
    docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The ``top`` documents with the highest score above 0 for every item.

    Terms are runs of letters and digits (all from U+0080 on count), with A-Z
    lower-cased.  A score sums, over the item's terms with repeats, weight
    times saturated frequency, in whole numbers.  Equal scores are ranked by
    ascending id, null ids last; each row of the documents is a document and
    each row of the items an item, repeated or not; items with equal terms are
    ranked once.  Null and empty texts have no term: such documents are in no
    result, such items have none.  Ids of documents are integers; other columns
    are not read; an empty table gives no rows.

    The terms of a block of items go out as an automaton, at most twice
    ``BLOCK_BYTES`` or one item's; the documents are read twice for each block,
    for the counts and for the scores, and do not move.  A task keeps the best
    of its own documents; ranks are given to these.

    Returns ``(item_id, rank, doc_id, score)``.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).cast("binary").alias("text"))
    asked = items.select(items[item_col].alias("item_id"), sorted_terms(items[item_text_col]).alias("terms")).filter("terms <> ''")
    asked = cut_lineage(asked.withColumn("key", F.sha2("terms", 256)), "items")
    dealt, blocks = in_blocks(asked.select("key", "terms").dropDuplicates(["key"]))
    found = None
    for block in range(blocks):
        # Bounded by in_blocks.
        held = sorted((r.key, r.terms) for r in dealt.filter(F.col("block") == block).select("key", "terms").collect())
        if held:
            keys = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(held)], "item long, key string")
            best = cut_lineage(block_ranking(rows, [t for _, t in held], top).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))), "best")
            best = best.join(F.broadcast(keys), "item").select("key", "doc_id", "score", "part")
            found = best if found is None else found.union(best)
    if found is None:
        found = spark.createDataFrame([], "key string, doc_id long, score long, part int")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for by in (["key", "part"], ["key"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    return asked.join(found, "key").select("item_id", "rank", F.col("doc_id").cast(docs.schema[id_col].dataType), "score")


#: The same by joins of terms.
RANK_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM lengths),
frequencies AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM frequencies, totals GROUP BY term),
gains AS (
  SELECT f.doc_id, f.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // length))) AS gain
  FROM frequencies f JOIN weights USING (term) JOIN lengths USING (doc_id), totals),
scores AS (SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM asked JOIN gains USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
