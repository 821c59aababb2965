"""From a block graph to cells.

All joins are equi-joins on ``(source, block id)``, so the keys are close to
unique and one very large document spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import relation_rank
from ..functions.geometry import box_columns
from ..functions.text import join_words
from ..session import cut_lineage
from ..sources.blocks import BLOCK_KEY, block_key, store_blocks

# Types whose words ``cell_words`` does not list; a table may still list such a block.
_NOT_ASKED = ("PAGE", "LINE", "WORD", "TABLE")

_REL_STRIDE = 1 << 32

CELL_COLUMNS = [
    "cell_id", "cell_type", "entity_type", "cell_words", "cell_content",
    "cell_width", "cell_height", "cell_left", "cell_top",
    "row_index", "column_index", "row_span", "column_span",
    "table_id", "table_type", "table_width", "table_height", "table_left", "table_top",
    "table_page", "source",
]


def blocks_of_type(blocks: DataFrame, *types: str) -> DataFrame:
    return blocks.filter(F.col("BlockType").isin(*types))


def cells_of_type(cells: DataFrame, *types: str) -> DataFrame:
    return cells.filter(F.col("cell_type").isin(*types))


def first_entity(entity_types="EntityTypes"):
    """First entity type, null for an absent or empty list."""
    return F.try_element_at(F.col(entity_types), F.lit(1))


def block_edges(blocks: DataFrame, *carry: str) -> DataFrame:
    """One row per child id of a block, with relation type and position.

    ``carry`` names columns of the parent to keep; nothing has to be joined back.

    Lists are exploded with their empty ones, which then go: for the other form
    Spark asks for their sizes below, where lists that are computed are made twice.
    """
    relations = blocks.select(
        "source",
        F.col("Id").alias("parent_id"),
        *carry,
        F.posexplode_outer("Relationships").alias("rel_pos", "rel"),
    )
    ids = relations.select(
        "source",
        "parent_id",
        *carry,
        "rel_pos",
        F.col("rel.Type").alias("rel_type"),
        F.posexplode_outer("rel.Ids").alias("id_pos", "child_id"),
    )
    return ids.filter("id_pos is not null")


def _cell_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.filter(~F.col("BlockType").isin(*_NOT_ASKED))


def _stored(blocks: DataFrame, dedupe: bool) -> DataFrame:
    return store_blocks(blocks) if dedupe else blocks


def _cell_parts(blocks: DataFrame) -> DataFrame:
    """The columns that cells are made of; outlines, queries and confidences need not be stored."""
    names = ["source", "pos", "Id", "BlockType", "Text", "SelectionStatus", "Page", "EntityTypes", "RowIndex", "ColumnIndex", "RowSpan", "ColumnSpan"]
    box = F.when(F.col("Geometry").isNotNull(), F.struct(F.col("Geometry.BoundingBox"))).alias("Geometry")
    return blocks.select(*[c for c in names if c in blocks.columns], box, "Relationships")


def looked_up(ids: DataFrame, blocks: DataFrame, *columns: Column | str) -> DataFrame:
    """Join ``ids (source, Id, ...)`` with the blocks of these ids, of which ``columns`` are kept.

    Only the ids are shuffled where the blocks are a table of ``store_blocks``;
    otherwise both sides are, without the hash, which does not compress.
    """
    if "block_key" not in blocks.columns:
        return ids.join(blocks.select("Id", "source", *columns), ["Id", "source"])
    # The hash of an id is made where it is compared, and does not travel with the id.
    found = blocks.select("block_key", F.col("source").alias("_source"), F.col("Id").alias("_Id"), *columns)
    same = (F.col("block_key") == block_key("source", "Id")) & (F.col("source") == F.col("_source")) & (F.col("Id") == F.col("_Id"))
    return ids.join(found, same).drop("block_key", "_source", "_Id")


def table_cells(blocks: DataFrame, dedupe: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Cells of every table: one row per table, relation and known cell id.

    ``carry`` names columns of the cell's block to keep.

    ``rel_rank`` and ``pos`` keep the order in which a table lists its cells:
    relation type in fixed order, then place in the id lists.  With ``dedupe``
    the blocks are stored and the last block of an id counts.
    """
    blocks = _stored(blocks, dedupe)
    box = F.col("Geometry.BoundingBox")
    tables = blocks_of_type(blocks, "TABLE").select(
        "*",
        first_entity().alias("table_type"),
        *box_columns(box, "table"),
        F.col("Page").alias("table_page"),
    )
    edges = (
        block_edges(
            tables, "table_type", "table_width", "table_height", "table_left", "table_top", "table_page"
        )
        .withColumn("rel_rank", relation_rank("rel_type"))
        .filter("rel_rank is not null")
        .withColumnsRenamed({"parent_id": "table_id", "child_id": "Id", "rel_type": "cell_type"})
        .withColumn("pos", F.col("rel_pos") * F.lit(_REL_STRIDE) + F.col("id_pos"))
        .drop("rel_pos", "id_pos")
    )
    # Any block can be listed, so the listed ids alone say which are cells.
    cells = looked_up(
        edges,
        blocks,
        *carry,
        first_entity().alias("entity_type"),
        *box_columns(box, "cell"),
        F.col("RowIndex").alias("row_index"),
        F.col("ColumnIndex").alias("column_index"),
        F.coalesce("RowSpan", F.lit(1)).alias("row_span"),
        F.coalesce("ColumnSpan", F.lit(1)).alias("column_span"),
    )
    return cells.withColumnRenamed("Id", "cell_id")


def _word_text(include_selection: bool) -> Column:
    return F.coalesce("Text", "SelectionStatus") if include_selection else F.col("Text")


def _ordered_words() -> Column:
    """The texts of a group in the order in which its block lists them."""
    return F.sort_array(F.collect_list("_word")).getField("text").alias("cell_words")


def _placed(found: DataFrame) -> DataFrame:
    """Texts with their places, as one column made ahead of the grouping, which would make it anew row by row."""
    return found.withColumn("_word", F.struct("rel_pos", "id_pos", "text")).drop("rel_pos", "id_pos", "text")


def cell_words(
    blocks: DataFrame, include_selection: bool = False, dedupe: bool = False
) -> DataFrame:
    """Ordered word list of each block that can be a cell and has words.

    Child ids without a block or without text are dropped.  With
    ``include_selection`` a selection element gives its status as a word.
    """
    blocks = _stored(blocks, dedupe)  # first: the last copy of a word may have no text
    text = _word_text(include_selection)
    edges = block_edges(_cell_blocks(blocks)).filter("rel_type = 'CHILD'").withColumnRenamed("child_id", "Id")
    found = looked_up(edges, blocks.filter(text.isNotNull()), text.alias("text")).drop("Id", "rel_type")
    # Most blocks list one or two words: combining them before the shuffle would save nothing.
    words = _placed(found.repartition("parent_id", "source")).groupBy("parent_id", "source").agg(_ordered_words())
    return words.select("source", F.col("parent_id").alias("cell_id"), "cell_words")


def cells_from_blocks(
    blocks: DataFrame, include_selection: bool = False, dedupe: bool = True
) -> DataFrame:
    """The cells dataset of a block graph.

    With ``dedupe`` the blocks are first stored in buckets by id, which the
    lookups of cells and of words then join without a shuffle of the blocks; of
    repeated ids the last block counts, with its relations and its text or lack
    of it.  Give ``dedupe=False`` for a table of ``store_blocks``, or when ids
    are known to be unique per source and the blocks cheap to read again.
    """
    if dedupe:
        blocks = store_blocks(_cell_parts(blocks))
    # Used twice, and numbered: words come back by a number, not by three names.
    cells = cut_lineage(table_cells(blocks, carry=["Relationships"]).withColumn("_cell", F.monotonically_increasing_id()), "cells")
    relations = cells.select("_cell", "source", F.posexplode("Relationships").alias("rel_pos", "rel")).filter("rel.Type = 'CHILD'")
    listed = relations.select("_cell", "source", "rel_pos", F.posexplode("rel.Ids").alias("id_pos", "Id"))
    text = _word_text(include_selection)
    found = looked_up(listed, blocks.filter(text.isNotNull()), text.alias("text")).select("_cell", "rel_pos", "id_pos", "text")
    words = _placed(found.repartition("_cell")).groupBy("_cell").agg(_ordered_words())
    return (
        cells.join(words, "_cell", "left")
        .withColumn("cell_words", F.coalesce("cell_words", F.array().cast("array<string>")))
        .withColumn("cell_content", join_words("cell_words"))
        .select(*CELL_COLUMNS, "rel_rank", "pos")
    )


def normalize_indices(cells: DataFrame) -> DataFrame:
    """Absent indices become 0 and absent spans 1, all as int."""
    return cells.withColumns(
        {
            name: F.coalesce(F.col(name).cast("int"), F.lit(default))
            for name, default in (
                ("row_index", 0), ("column_index", 0), ("row_span", 1), ("column_span", 1)
            )
        }
    )


def cell_geometry(blocks: DataFrame) -> DataFrame:
    """Id, page, grid position and box of every cell block."""
    return blocks_of_type(blocks, "CELL", "MERGED_CELL").select(
        "source",
        F.col("Id").alias("cell_id"),
        F.col("Page").alias("page"),
        F.col("RowIndex").alias("row_index"),
        F.col("ColumnIndex").alias("column_index"),
        *box_columns(F.col("Geometry.BoundingBox"), "cell"),
    )


def block_report(blocks: DataFrame) -> DataFrame:
    """One readable row per block; fields that do not apply to its type are null."""
    kind = F.col("BlockType")
    is_cell = kind == "CELL"
    box = F.col("Geometry.BoundingBox")
    return blocks.select(
        "source",
        F.col("Id").alias("block_id"),
        kind.alias("block_type"),
        F.array_join("EntityTypes", ", ").alias("entity_types"),
        F.col("Text").alias("text"),
        F.when((kind != "PAGE") & F.col("Confidence").isNotNull(), F.format_string("%.2f%%", F.col("Confidence"))).alias("confidence"),
        F.col("Page").alias("page"),
        F.when(is_cell, F.col("ColumnIndex")).alias("column_index"),
        F.when(is_cell, F.col("RowIndex")).alias("row_index"),
        F.when(is_cell, F.col("ColumnSpan")).alias("column_span"),
        F.when(is_cell, F.col("RowSpan")).alias("row_span"),
        F.when(is_cell, F.to_json("Relationships")).alias("relationships"),
        *box_columns(box, "box"),
        F.to_json("Geometry.Polygon").alias("polygon"),
        F.when(
            kind == "SELECTION_ELEMENT",
            F.when(F.col("SelectionStatus") == "SELECTED", "Selected").otherwise("Not selected"),
        ).alias("selection"),
        F.when(kind == "QUERY", F.to_json("Query")).alias("query"),
        F.when(kind == "QUERY_RESULT", F.col("Text")).alias("answer"),
    )
