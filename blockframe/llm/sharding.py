"""Balanced shards of documents by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockframe.llm.common import cut_lineage, number_within, text_or_empty

#: A group of at least this share of one shard's bytes is placed on its own at
#: the top level; there are at most ``shards * OWN_PLACE`` of them.
OWN_PLACE = 2048
#: Hash buckets of the other groups, and groups a bucket holds at most on average.
BUCKETS, BUCKET_GROUPS = 1024, 200_000


def differencing(weights: Sequence[int], parts: int) -> list[int]:
    """The part (0 to ``parts`` - 1) of each weight, by the largest differencing method.

    Every weight starts as a partial partition with one filled part.  The two
    partial partitions of the largest spread are combined again and again, the
    largest part of one with the smallest of the other.  Parts are numbered by
    falling sum; ties are broken by position, so the result is fixed.
    """
    owner = list(range(len(weights)))  # of each set, the set it went into
    heap = [(-w, i, [(w, i)] + [(0, -1)] * (parts - 1)) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, first, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = []
        for (x, p), (y, q) in zip(a, reversed(b)):
            if p >= 0 and q >= 0:
                owner[q] = p
            merged.append((x + y, p if p >= 0 else q))
        merged.sort(key=lambda s: (-s[0], s[1]))
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], first, merged))
    part_of = {p: i for i, (_, p) in enumerate(heap[0][2])} if heap else {}

    def root(i: int) -> int:
        path = []
        while owner[i] != i:
            path.append(i)
            i = owner[i]
        for p in path:
            owner[p] = i
        return i

    return [part_of[root(i)] for i in range(len(weights))]


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every document into one of ``shards`` shards of nearly equal bytes.

    Documents of equal text are an indivisible group.  A document weighs the
    bytes of its text plus one; null text counts as empty text and shares its
    group.  Groups are summed before they move.  Those large enough to matter
    for the balance (at most ``shards * OWN_PLACE``, at any input size) go to
    the top level singly.  The others are dealt by hash into buckets; each
    bucket is differenced in its own task, and its parts go to the top level as
    items.  The top level, bounded by buckets, is differenced once.  A group
    larger than a shard's fair share stays whole, so its shard is that large.

    Returns ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``;
    ``slot`` numbers the documents of a shard from 0.  Null and repeated ids
    keep their rows.  Other columns of ``docs`` are not read.  An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    text = text_or_empty(docs[text_col])
    rows = cut_lineage(
        docs.select(
            docs[id_col].alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "shard-rows",
    )
    groups = cut_lineage(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-groups")
    total, count = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(BUCKETS, -(-count // BUCKET_GROUPS))
    own = F.col("bytes") * F.lit(shards * OWN_PLACE) >= F.lit(total)

    def difference(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bytes", "digest"], ascending=False)
        group["part"] = differencing(group["bytes"].tolist(), shards)
        return group[["digest", "bytes", "bucket", "part"]]

    dealt = groups.filter(~own).withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    parts = cut_lineage(
        dealt.groupBy("bucket").applyInPandas(difference, "digest binary, bytes long, bucket long, part int"), "shard-parts"
    )

    # The top level: a bounded list of (weight, what).
    items = [(r.bytes, (bytes(r.digest),)) for r in groups.filter(own).collect()]
    items += [(r.bytes, (r.bucket, r.part)) for r in parts.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes")).collect()]
    items.sort(key=lambda x: (-x[0], str(x[1])))
    placed = list(zip([what for _, what in items], differencing([w for w, _ in items], shards)))
    large = spark.createDataFrame([(bytearray(k[0]), s) for k, s in placed if len(k) == 1], "own_digest binary, shard int")
    small = spark.createDataFrame([(*k, s) for k, s in placed if len(k) == 2], "bucket long, part int, shard int")

    in_large = rows["digest"] == large["own_digest"]
    of_large = rows.join(F.broadcast(large), in_large).drop("own_digest")
    of_small = rows.join(F.broadcast(large), in_large, "left_anti").join(
        parts.join(F.broadcast(small), ["bucket", "part"]).select("digest", "shard"), "digest"
    )
    chosen = cut_lineage(of_large.unionByName(of_small).drop("digest"), "shards")
    numbered = number_within(chosen, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
