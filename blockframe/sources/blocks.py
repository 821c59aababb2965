"""Reading and writing block graphs.

A result file holds one JSON array, which no reader can split, so the
parallelism of the first read is one task per file.  Convert once with
``save_dataset`` and work from the columnar copy afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .schema import BLOCK, RESPONSE

_PAGE_STRIDE = 1 << 32

#: What tells blocks apart, the most telling part first.
BLOCK_KEY = ["block_key", "source", "Id"]


def decode_documents(documents: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Turn rows ``(source, value)`` with a JSON array in ``value`` into blocks.

    ``pos`` is the place of the block in its array.  A malformed document stops
    the job; with ``mode='PERMISSIVE'`` it gives no rows instead.
    """
    blocks = F.from_json("value", T.ArrayType(BLOCK), {"mode": mode})
    return documents.select("source", F.posexplode(blocks).alias("pos", "block")).select(
        "source", F.col("pos").cast("long").alias("pos"), "block.*"
    )


def _plain(path: str) -> Column:
    """A file metadata path without URI escapes (a plus sign is not one)."""
    return F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B")))


def name_documents(files: DataFrame, pattern: str | None = None) -> DataFrame:
    """Whole text files as ``(source, value)``.

    The source is the file name, or group 1 of ``pattern`` found in the path
    when each document has a folder of its own.
    """
    if pattern is None:
        source = _plain("_metadata.file_name")
    else:
        source = F.regexp_extract(_plain("_metadata.file_path"), pattern, 1)
    return files.select(source.alias("source"), "value")


def read_blocks(
    spark: SparkSession, paths, mode: str = "FAILFAST", pattern: str | None = None
) -> DataFrame:
    """Read files that each hold one JSON array of blocks, tagged by document name."""
    files = spark.read.text(paths, wholetext=True)
    return decode_documents(name_documents(files, pattern), mode)


def decode_responses(responses: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Turn rows ``(source, page_no, value)``, one response each, into blocks.

    ``pos`` orders blocks by response and then by place in the response.
    """
    decoded = F.from_json("value", RESPONSE, {"mode": mode})
    return (
        responses.select("source", "page_no", decoded.alias("r"))
        .select(
            "source",
            "page_no",
            F.col("r.DocumentMetadata.Pages").alias("document_pages"),
            F.posexplode("r.Blocks").alias("place", "block"),
        )
        .select(
            "source",
            (F.col("page_no") * F.lit(_PAGE_STRIDE) + F.col("place")).alias("pos"),
            "document_pages",
            "block.*",
        )
    )


def read_block_pages(
    spark: SparkSession,
    paths,
    pattern: str = r"([^/]*?)[-_./]?(\d+)(?:\.json)?$",
    mode: str = "FAILFAST",
) -> DataFrame:
    """Read results delivered as numbered responses, in response order.

    ``pattern`` takes the document name (group 1) and the number (group 2) from
    the path, so both ``doc-1.json, doc-2.json`` and ``doc/1, doc/2`` work.
    """
    path = _plain("_metadata.file_path")
    files = spark.read.text(paths, wholetext=True).select(
        F.regexp_extract(path, pattern, 1).alias("source"),
        F.regexp_extract(path, pattern, 2).cast("long").alias("page_no"),
        "value",
    )
    return decode_responses(files, mode)


def block_key(source: str | Column, block_id: str | Column) -> Column:
    """A hash of both parts of a block's key.

    As the first column to sort by it tells rows apart at once; ids and source
    names mostly begin alike.
    """
    return F.xxhash64(source, block_id)


def dedupe_blocks(blocks: DataFrame, keep: str = "last") -> DataFrame:
    """One block per ``(source, Id)``: the last one of the document, or the first.

    The ``row_number() = 1`` filter becomes a group limit before the shuffle, so
    a heavily repeated id sends one row per task.
    """
    order: Column = F.col("pos").desc() if keep == "last" else F.col("pos").asc()
    window = Window.partitionBy(*BLOCK_KEY).orderBy(order)
    keyed = blocks.withColumn("block_key", block_key("source", "Id"))
    ranked = keyed.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")
    return ranked if "block_key" in blocks.columns else ranked.drop("block_key")


def store_blocks(blocks: DataFrame, dedupe: bool = True, keep: str = "last") -> DataFrame:
    """The blocks as a table in the shared folder, in buckets of ``BLOCK_KEY``.

    Lookups by id join such a table without shuffling it, and repeated ids are
    removed once for all of them.  The table has one more column,
    ``block_key``, and as many buckets as shuffles have partitions.
    """
    spark = blocks.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if dedupe:
        held = dedupe_blocks(blocks.withColumn("block_key", block_key("source", "Id")), keep)
    else:
        held = blocks.withColumn("block_key", block_key("source", "Id")).repartition(buckets, *BLOCK_KEY)
    path = scratch_path(spark, "blocks")
    name = f"blocks_{path.rpartition('-')[2]}"
    held.write.bucketBy(buckets, *BLOCK_KEY).options(path=path, compression="zstd").saveAsTable(name)
    return spark.table(name)


def save_blocks(
    blocks: DataFrame, path: str, mode: str = "errorifexists", compression: str = "gzip", rows_per_file: int = 1_000_000
) -> None:
    """Write blocks as JSON lines, in compressed files of at most ``rows_per_file`` lines.

    The names of the fields make up most of the text and compress to a few
    bytes a block.  A compressed file cannot be split, so its length is bounded
    and a reader has about one task per file.
    """
    blocks.write.mode(mode).options(compression=compression, maxRecordsPerFile=rows_per_file).json(path)


def load_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Read blocks written by :func:`save_blocks`."""
    schema = T.StructType(
        [T.StructField("source", T.StringType()), T.StructField("pos", T.LongType())]
        + BLOCK.fields
    )
    return spark.read.schema(schema).json(path)
