"""SimHash near-duplicates: fingerprints linked through sharded BK-trees."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockframe.llm.common import connected_components, cut_lineage, free_names, text_or_empty

#: Fingerprints a tree holds at most; larger shards are dealt into finer ones.
TREE_SIZE = 256
#: Shingles whose bits are added up at a time.
SLAB = 1 << 16


def simhash(text: str | None, words_in_shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text; 0 where it has no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= words_in_shingle:
        hashes = [digest(line, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-words_in_shingle].tolist()]
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, (ends[words_in_shingle - 1 :] - 1).tolist())]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), SLAB):
        slab = np.frombuffer(b"".join(hashes[at : at + SLAB]), dtype=np.uint8).reshape(-1, 8)
        ones += np.unpackbits(slab, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


class BKTree:
    """A tree of integers; each child hangs on the edge of its Hamming distance to its parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        values, children = self.values, self.children
        if values:
            node = 0
            while True:
                distance = (values[node] ^ value).bit_count()
                below = children[node].get(distance)
                if below is None:
                    children[node][distance] = len(values)
                    break
                node = below
        values.append(value)
        children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the values at most ``radius`` away: only edges within the radius of the node's own distance are followed."""
        found, waiting = [], [0] if self.values else []
        while waiting:
            node = waiting.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            waiting += [child for edge, child in self.children[node].items() if -radius <= edge - distance <= radius]
        return found


def forest_links(values: Iterable[int], radius: int) -> list[tuple[int, int]]:
    """Links among distinct values that connect all within ``radius``: at most one less than there are values."""
    tree, leader, links = BKTree(), [], []

    def top(i: int) -> int:
        while leader[i] != i:
            leader[i] = leader[leader[i]]
            i = leader[i]
        return i

    for i, value in enumerate(values):
        near = tree.within(value & (1 << 64) - 1, radius)
        tree.add(value & (1 << 64) - 1)
        leader.append(i)
        for j in near:
            if (other := top(j)) != (own := top(i)):
                leader[own] = other
                links.append((i, j))
    return links


def blocks_of(bits: list[int], parts: int) -> list[list[int]]:
    return [b.tolist() for b in np.array_split(np.array(bits), parts)]


def linked_fingerprints(prints: DataFrame, radius: int = 3, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints at most ``radius`` bits apart.

    ``prints`` has distinct longs in ``fingerprint`` and is a stored table.  Two
    of them that differ in at most ``radius`` bits agree in one of ``radius + 1``
    blocks of bits, so every fingerprint goes into one shard for each block.
    A shard of more than ``tree_size`` is dealt again by blocks of the bits it
    does not yet share; as the shared bits grow, its size is bounded at last by
    the values the other bits can take.  Each shard has its own BK-tree, built
    and searched where the shard's fingerprints are.
    """
    spark = prints.sparkSession
    paths = {0: list(range(64))}  # path -> bits its shards do not share yet
    dealt, links = prints.withColumn("path", F.col("fingerprint").bitwiseAND(F.lit(0)).cast("int")), None
    while True:
        finer, masks = {}, []
        for path, free in paths.items():
            for part, block in enumerate(blocks_of(free, radius + 1)):
                new = path * (radius + 1) + part + 1
                finer[new] = [b for b in free if b not in block]
                mask = sum(1 << b for b in range(64) if b not in finer[new])
                masks.append((path, new, mask - (1 << 64) if mask >> 63 else mask))
        book = F.broadcast(spark.createDataFrame(masks, "of int, new int, mask long"))
        shards = dealt.join(book, F.col("path") == F.col("of")).select(
            "fingerprint", F.col("new").alias("path"), F.col("fingerprint").bitwiseAND(F.col("mask")).alias("shared")
        )
        sizes = shards.groupBy("path", "shared").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        last = min(len(free) for free in finer.values()) <= tree_size.bit_length()
        held = cut_lineage(shards.join(sizes, ["path", "shared"]), "shards")
        small = held if last else held.filter(F.col("size") <= tree_size)
        groups = small.groupBy("path", "shared").agg(F.collect_list("fingerprint").alias("members")).select("members")

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for members in batch["members"]:
                    values = sorted(members.tolist())
                    out += [(values[i], values[j]) for i, j in forest_links(values, radius)]
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        found = cut_lineage(groups.mapInPandas(search, "a long, b long"), "links")
        links = found if links is None else links.union(found)
        if last:
            return links
        dealt = held.filter(F.col("size") > tree_size).select("fingerprint", "path")
        crowded = {r.path for r in dealt.select("path").distinct().collect()}  # at most as many as there are paths
        if not crowded:
            return links
        paths = {p: free for p, free in finer.items() if p in crowded}


def fingerprints(text: Column, words_in_shingle: int = 3) -> Column:
    """Fingerprint of a text column."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([simhash(t, words_in_shingle) for t in batch], dtype="int64")

    return of(text)


def components(rows: DataFrame, radius: int = 3) -> DataFrame:
    """``(print, root, component_id)`` of every fingerprint in the stored table ``rows (doc_id, fingerprint)``.

    ``root`` names the component; ``component_id`` is its smallest id.
    """
    prints = cut_lineage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = connected_components(linked_fingerprints(prints.select("fingerprint"), radius))
    rooted = prints.join(roots, prints["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    parts = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return cut_lineage(rooted.join(parts, "root").select(F.col("fingerprint").alias("print"), "root", "component_id"), "named")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3, radius: int = 3
) -> DataFrame:
    """Fingerprint and component of every document.

    Texts are lower-cased (A-Z) and cut at ASCII white space.  Null and empty
    texts have fingerprint zero and are linked like any other.  Equal
    fingerprints are one node, so copies never form pairs.  ``component_id`` is
    the smallest id reachable over links of at most ``radius`` bits, null where
    all ids of a component are null.  Repeated rows keep their rows; other
    columns are not read; an empty table gives no rows.

    Returns ``(doc_id, fingerprint, component_id)``.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), fingerprints(docs[text_col], words_in_shingle).alias("fingerprint"))
    rows = cut_lineage(rows, "simhash")
    named = components(rows, radius)
    return rows.join(named, rows["fingerprint"] == named["print"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3, radius: int = 3
) -> DataFrame:
    """The rows of ``docs``, with all columns, that stay: of each component the one with the smallest id.

    Null ids come last; of rows with that id the one with the smallest hash of
    its text stays, and of equal rows any one.  Columns of any name are kept.
    """
    text = text_or_empty(docs[text_col])
    digest = F.unhex(F.sha2(text, 256))
    group, least, mark, nth = free_names(docs, "group", "least", "mark", "nth")
    rows = cut_lineage(
        docs.select(
            docs[id_col].alias("doc_id"), digest.alias("digest"), fingerprints(docs[text_col], words_in_shingle).alias("fingerprint")
        ),
        "simhash",
    )
    named = components(rows, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")).alias("first")
    chosen = rows.join(named, rows["fingerprint"] == named["print"]).groupBy("root").agg(first)
    chosen = chosen.select(F.col("root").alias(group), F.col("first.doc_id").alias(least), F.col("first.digest").alias(mark))
    kept = docs.join(chosen, (digest == F.col(mark)) & docs[id_col].eqNullSafe(F.col(least)))
    # Only repeated rows are left in a group.
    line = Window.partitionBy(group).orderBy(mark)
    return kept.withColumn(nth, F.row_number().over(line)).filter(F.col(nth) == 1).drop(nth, group, least, mark)
