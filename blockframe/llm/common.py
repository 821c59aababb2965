"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockframe.session import cut_lineage

__all__ = [
    "connected_components",
    "cut_lineage",
    "free_names",
    "lower_ascii",
    "number_within",
    "shuffle_partitions",
    "table",
    "text_or_empty",
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, behind as many underscores as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def number_within(df: DataFrame, by: list[str], order: list[str], name: str, blocks: int | None = None) -> DataFrame:
    """Number the rows of each ``by`` group from 0 without gaps.

    A group may hold most of the rows: it is dealt into ``blocks`` by a hash of
    the ``order`` columns, each block is numbered on its own and starts where
    the counts of the blocks before it end.  ``df`` is read twice, so it should
    be a stored table.  Rows equal in all ``order`` columns are numbered in any
    order.
    """
    blocks = blocks or 4 * shuffle_partitions(df.sparkSession)
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = dealt.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)],
        F.col("_block").alias("_start_block"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
    )
    same = F.col("_block") == F.col("_start_block")
    for i, c in enumerate(by):
        same = same & (F.col(c) == F.col(f"_by_{i}"))
    inside = Window.partitionBy(*by, "_block").orderBy(*order)
    return (
        dealt.join(starts, same)
        .withColumn(name, (F.col("_start") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_block", "_start_block", "_start", *[f"_by_{i}" for i in range(len(by))])
    )


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest reachable node of every node named in ``edges (a, b)``.

    Alternating large-star and small-star rounds: every round is two
    aggregations and two joins over the edges, each round's edges are written
    to the shared folder, and the number of rounds grows with the logarithm of
    the longest chain.  No neighbour list is ever gathered.
    Returns ``(node, root)``; a node without edges is not listed.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select("b", "a")) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        both = both.toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("v_min")).select(F.col("u").alias("k"), F.least("u", "v_min").alias("m"))
        joined = both.join(least, F.col("u") == F.col("k"))
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def digest(pairs: DataFrame):
        return pairs.agg(
            F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.bit_xor(F.xxhash64("b", "a"))
        ).first()

    pairs = cut_lineage(edges.select("a", "b").filter("a <> b").distinct(), name)
    known = digest(pairs)
    while known[0]:
        pairs = cut_lineage(star(star(pairs, True), False), name)
        now = digest(pairs)
        if now == known:
            break
        known = now
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
