"""One row per table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import TABLE_KEY

# Groups are sorted by their keys; the first bytes of table ids tell them apart better than source names.
_SORTED_KEY = ["table_id", "source"]
_MAXIMA = ["table_width", "table_height", "table_left", "table_top", "table_page", "table_type"]
_COUNTS = {
    "child_count": "CHILD",
    "merged_cell_count": "MERGED_CELL",
    "table_title_count": "TABLE_TITLE",
    "table_footer_count": "TABLE_FOOTER",
}


def _order(cells: DataFrame) -> list[str]:
    return ["column_index", *[c for c in ("rel_rank", "pos", "cell_id") if c in cells.columns]]


def table_counts(cells: DataFrame, grid_size: str = "max") -> DataFrame:
    """Geometry, size and cell counts of each table.

    Everything is combined before the shuffle, so table size does not matter.
    ``grid_size='distinct'`` counts distinct indices instead of taking the largest.
    """
    if grid_size not in ("max", "distinct"):
        raise ValueError("grid_size must be 'max' or 'distinct'")
    # The first level groups by the text column ``table_type`` as well: it is
    # the only maximum that hash aggregation cannot update in place, and it has
    # one value per table, so the second level sees about one row per table.
    numbers = [c for c in _MAXIMA if c != "table_type"]
    by_type = cells.groupBy(*TABLE_KEY, "table_type").agg(
        *[F.max(c).alias(c) for c in numbers],
        F.count("cell_words").alias("cell_count"),
        F.max("row_index").alias("row_count"),
        F.max("column_index").alias("column_count"),
        *[F.count_if(F.col("cell_type") == t).alias(n) for n, t in _COUNTS.items()],
    )
    counts = by_type.groupBy(*TABLE_KEY).agg(
        *[F.max(c).alias(c) for c in _MAXIMA],
        F.sum("cell_count").alias("cell_count"),
        F.max("row_count").alias("row_count"),
        F.max("column_count").alias("column_count"),
        *[F.sum(n).alias(n) for n in _COUNTS],
    )
    if grid_size == "max":
        return counts
    distinct = cells.groupBy(*TABLE_KEY).agg(
        F.count_distinct("row_index").cast("int").alias("row_count"),
        F.count_distinct("column_index").cast("int").alias("column_count"),
    )
    return (
        counts.drop("row_count", "column_count").join(distinct, TABLE_KEY).select(*counts.columns)
    )


def table_content(cells: DataFrame) -> DataFrame:
    """Per table the rows, in each row the cells, in each cell the words.

    All cell types take part, so titles and footers form row 0 and merged cells
    add an empty list.
    """
    return _nest(cells, {"content": F.struct(*_order(cells), F.col("cell_words").alias("v"))})


def table_entities(cells: DataFrame) -> DataFrame:
    """Same shape for the CHILD cells, holding entity types (``'normal'`` when absent)."""
    entity = F.coalesce(F.nullif(F.col("entity_type"), F.lit("")), F.lit("normal"))
    child = cells.filter("cell_type = 'CHILD'")
    return _nest(child, {"entities": F.struct(*_order(cells), entity.alias("v"))})


def _nest(cells: DataFrame, entries: dict) -> DataFrame:
    """Two grouping levels over one shuffle by table.

    The result holds a whole table per row, so a table always fits one task.
    """
    by_row = (
        cells.repartition(*TABLE_KEY)
        .groupBy(*_SORTED_KEY, "row_index")
        .agg(*[F.sort_array(F.collect_list(e)).alias(n) for n, e in entries.items()])
    )
    by_table = by_row.groupBy(*_SORTED_KEY).agg(
        *[
            F.sort_array(F.collect_list(F.struct("row_index", F.col(f"{n}.v").alias("v")))).alias(n)
            for n in entries
        ]
    )
    return by_table.select(*TABLE_KEY, *[F.col(f"{n}.v").alias(n) for n in entries])


def summarize_tables(cells: DataFrame, content: bool = True, grid_size: str = "max") -> DataFrame:
    """One row per table with geometry, counts and, on request, nested content.

    Expects normalised indices.  With ``content`` all of it is computed over one
    shuffle by table; without, only small partial results are shuffled.
    """
    if not content:
        return table_counts(cells, grid_size)
    if grid_size == "distinct":
        return table_counts(cells, grid_size).join(
            summarize_tables(cells).select(*TABLE_KEY, "content", "entities"), TABLE_KEY
        )
    order = _order(cells)
    entity = F.coalesce(F.nullif(F.col("entity_type"), F.lit("")), F.lit("normal"))
    is_child = F.col("cell_type") == "CHILD"
    by_row = (
        cells.repartition(*TABLE_KEY)
        .groupBy(*_SORTED_KEY, "row_index")
        .agg(
            *[F.max(c).alias(c) for c in _MAXIMA],
            F.count("cell_words").alias("cell_count"),
            F.max("column_index").alias("column_count"),
            *[F.count_if(F.col("cell_type") == t).alias(n) for n, t in _COUNTS.items()],
            F.sort_array(F.collect_list(F.struct(*order, F.col("cell_words").alias("v")))).alias("content"),
            F.sort_array(
                F.collect_list(F.when(is_child, F.struct(*order, entity.alias("v"))))
            ).alias("entities"),
        )
    )
    row = F.col("row_index")
    by_table = by_row.groupBy(*_SORTED_KEY).agg(
        *[F.max(c).alias(c) for c in _MAXIMA],
        F.sum("cell_count").alias("cell_count"),
        F.max(row).alias("row_count"),
        F.max("column_count").alias("column_count"),
        *[F.sum(n).alias(n) for n in _COUNTS],
        F.sort_array(F.collect_list(F.struct(row, F.col("content.v").alias("v")))).alias("content"),
        F.sort_array(
            F.collect_list(
                F.when(F.size("entities") > 0, F.struct(row, F.col("entities.v").alias("v")))
            )
        ).alias("entities"),
    )
    others = [c for c in by_table.columns if c not in TABLE_KEY]
    return by_table.select(*TABLE_KEY, *others).withColumns({"content": F.col("content.v"), "entities": F.col("entities.v")})
