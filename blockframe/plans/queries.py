"""One query per operator over the supplied tables, each with its reference SQL.

``QUERIES`` maps a name to a function of session and data folder, ``ORACLES``
the same name to SQL with equal results.  Nested values are joined to text and
doubles rounded, so that rows can be compared between engines.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.ml.feature import ElementwiseProduct, IndexToString, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fn
from .. import operators as op
from .. import sources as src
from .. import streaming
from ..session import cut_lineage, scratch_path
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_PLAIN = {name: name for name in fx.TABLE_NAMES}
GRID = f"grid as ({fx.GRID_SQL.format(**_PLAIN)})"
TITLES = f"titles as ({fx.TITLES_SQL.format(**_PLAIN)})"
MERGED = f"merged as ({fx.MERGED_SQL.format(**_PLAIN)})"

KEY = ["source", "table_id"]


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def _bar(column: str):
    return F.array_join(column, "|").alias(column)


def _rounded(column: str, alias: str | None = None):
    return F.round(F.col(column).cast("double"), 6).alias(alias or column)


def _long(column: str):
    return F.col(column).cast("bigint").alias(column)


def _nested(column: str):
    """Rows by ' / ', cells by ' | ', words by blank."""
    return F.array_join(
        F.transform(column, lambda r: F.array_join(F.transform(r, lambda c: F.array_join(c, " ")), " | ")),
        " / ",
    ).alias(column)


# -- neighbour context --------------------------------------------------------

_TXT = "case when cell_content = '' then 'empty' else cell_content end"

_SIDES = {
    "above": ("column_index", "row_index", "<"),
    "left": ("row_index", "column_index", "<"),
    "below": ("column_index", "row_index", ">"),
    "right": ("row_index", "column_index", ">"),
}


def _side_sql(side: str) -> str:
    line, axis, compare = _SIDES[side]
    return (
        f"select a.source, a.table_id, a.cell_id, "
        f"coalesce(string_agg(b.txt, '|' order by b.{axis}), '') as words_{side} "
        f"from g a left join g b on a.source = b.source and a.table_id = b.table_id "
        f"and a.{line} = b.{line} and b.{axis} {compare} a.{axis} "
        f"group by a.source, a.table_id, a.cell_id"
    )


_TEXTS = f"with {GRID}, g as (select *, {_TXT} as txt from grid) "


def _context_query(side: str):
    @query(f"words_{side}", _TEXTS + _side_sql(side))
    def run(spark, sf_dir):
        cells = fx.grid_cells(spark, sf_dir).select(*KEY, "cell_id", "cell_type", "cell_words", "row_index", "column_index")
        return getattr(op, f"words_{side}")(cells).select(*KEY, "cell_id", _bar(f"words_{side}"))

    return run


for _side in _SIDES:
    _context_query(_side)

_ALL_SIDES_SQL = (
    f"with {GRID}, g as (select *, {_TXT} as txt from grid), "
    + ", ".join(f"x_{s} as ({_side_sql(s)})" for s in _SIDES)
    + " select source, table_id, cell_id, words_above, words_left, words_below, words_right from x_above "
    + " ".join(f"join x_{s} using (source, table_id, cell_id)" for s in ("left", "below", "right"))
)


@query("neighbour_words", _ALL_SIDES_SQL)
def _(spark, sf_dir):
    cells = fx.grid_cells(spark, sf_dir).select(*KEY, "cell_id", "cell_type", "cell_words", "row_index", "column_index")
    return op.neighbour_words(cells).select(*KEY, "cell_id", *[_bar(f"words_{s}") for s in _SIDES])


@query("neighbour_words_large_tables", _ALL_SIDES_SQL)
def _(spark, sf_dir):
    """Same rows with every table above 20 cells sent through the split plan."""
    cells = fx.grid_cells(spark, sf_dir).select(*KEY, "cell_id", "cell_type", "cell_words", "row_index", "column_index")
    return op.neighbour_words(cells, hot_rows=20).select(
        *KEY, "cell_id", *[_bar(f"words_{s}") for s in _SIDES]
    )


# -- titles -------------------------------------------------------------------

_BEST = (
    f"with {TITLES}, r as (select *, rank() over (partition by source, layout_title_page "
    "order by layout_title_confidence desc) as rk, row_number() over (partition by source, "
    "layout_title_page order by layout_title_confidence desc, layout_title_id) as rn from titles) "
)
_TITLE_COLUMNS = "source, layout_title_id, layout_title_page, layout_title_confidence, layout_title_text"


@query("best_titles", _BEST + f"select {_TITLE_COLUMNS} from r where rk = 1")
def _(spark, sf_dir):
    return op.best_titles(fx.titles(spark, sf_dir))


@query("best_titles_first", _BEST + f"select {_TITLE_COLUMNS} from r where rn = 1")
def _(spark, sf_dir):
    return op.best_titles(fx.titles(spark, sf_dir), ties="first")


@query(
    "mark_best_titles",
    f"with {TITLES} select layout_title_id, max(layout_title_confidence) over (partition by source, "
    "layout_title_page) as max_confidence_per_page, case when layout_title_confidence = "
    "max(layout_title_confidence) over (partition by source, layout_title_page) then 1 else 0 end "
    "as is_max_confidence from titles",
)
def _(spark, sf_dir):
    return op.mark_best_titles(fx.titles(spark, sf_dir)).select(
        "layout_title_id", "max_confidence_per_page", F.col("is_max_confidence").cast("int").alias("is_max_confidence")
    )


_TABLES = (
    "t as (select source, table_id, max(table_page) as table_page, count(*) as cell_count, "
    "max(row_index) as row_count, max(column_index) as column_count from grid group by source, table_id)"
)
_ATTACH = (
    _BEST.rstrip().rstrip(")")
    + f"), {GRID}, {_TABLES} select t.source, t.table_id, t.table_page, r.layout_title_text from t "
    "left join r on r.source = t.source and r.layout_title_page = t.table_page and "
)


@query("attach_page_title", _ATTACH + "r.rk = 1")
def _(spark, sf_dir):
    tables = op.table_counts(fx.grid_cells(spark, sf_dir))
    return op.attach_page_title(tables, fx.titles(spark, sf_dir)).select(*KEY, "table_page", "layout_title_text")


@query("attach_page_title_first", _ATTACH + "r.rn = 1")
def _(spark, sf_dir):
    tables = op.table_counts(fx.grid_cells(spark, sf_dir))
    return op.attach_page_title(tables, fx.titles(spark, sf_dir), ties="first").select(
        *KEY, "table_page", "layout_title_text"
    )


# -- tables -------------------------------------------------------------------

_ALL_CELLS = (
    f"{GRID}, {MERGED}, cells as (select source, table_id, 'CHILD' as cell_type, row_index, column_index, "
    "cell_content, entity_type, table_page, table_type, table_width, table_height, table_left, table_top, 0 as rel_rank, "
    "row_index * 4 + column_index as pos from grid "
    "union all select source, table_id, 'MERGED_CELL', row_index, column_index, '', null, null, null, null, null, null, null, 1, "
    "case when cell_id like 'm1%' then 0 else 1 end from merged)"
)
_COUNTS = (
    "count(*) as cell_count, {rows} as row_count, {columns} as column_count, "
    "count(*) filter (where cell_type = 'CHILD') as child_count, "
    "count(*) filter (where cell_type = 'MERGED_CELL') as merged_cell_count, "
    "cast(0 as bigint) as table_title_count, cast(0 as bigint) as table_footer_count, "
    "round(max(table_width), 6) as table_width, round(max(table_height), 6) as table_height, "
    "round(max(table_left), 6) as table_left, round(max(table_top), 6) as table_top, "
    "max(table_page) as table_page, max(table_type) as table_type"
)
_COUNT_COLUMNS = [
    "cell_count", "row_count", "column_count", "child_count", "merged_cell_count",
    "table_title_count", "table_footer_count", "table_page", "table_type",
]
_SIZES = ["table_width", "table_height", "table_left", "table_top"]


@query(
    "table_counts",
    f"with {_ALL_CELLS} select source, table_id, "
    + _COUNTS.format(rows="max(row_index)", columns="max(column_index)")
    + " from cells group by source, table_id",
)
def _(spark, sf_dir):
    return op.table_counts(fx.grid_with_merged(spark, sf_dir)).select(
        *KEY, *_COUNT_COLUMNS, *[_rounded(c) for c in _SIZES]
    )


@query(
    "table_counts_distinct",
    f"with {_ALL_CELLS} select source, table_id, "
    + _COUNTS.format(
        rows="cast(count(distinct row_index) as int)", columns="cast(count(distinct column_index) as int)"
    )
    + " from cells group by source, table_id",
)
def _(spark, sf_dir):
    return op.table_counts(fx.grid_with_merged(spark, sf_dir), grid_size="distinct").select(
        *KEY, *_COUNT_COLUMNS, *[_rounded(c) for c in _SIZES]
    )


_CONTENT_SQL = (
    "crow as (select source, table_id, row_index, string_agg(cell_content, ' | ' order by column_index, "
    "rel_rank, pos) as r from cells group by source, table_id, row_index), "
    "cont as (select source, table_id, string_agg(r, ' / ' order by row_index) as content from crow "
    "group by source, table_id)"
)
_ENTITIES_SQL = (
    "erow as (select source, table_id, row_index, string_agg(coalesce(nullif(entity_type, ''), 'normal'), ' | ' "
    "order by column_index, rel_rank, pos) as r from cells where cell_type = 'CHILD' "
    "group by source, table_id, row_index), "
    "ent as (select source, table_id, string_agg(r, ' / ' order by row_index) as entities from erow "
    "group by source, table_id)"
)


def _entities(column="entities"):
    return F.array_join(F.transform(column, lambda r: F.array_join(r, " | ")), " / ").alias(column)


@query("table_content", f"with {_ALL_CELLS}, {_CONTENT_SQL} select * from cont")
def _(spark, sf_dir):
    return op.table_content(fx.grid_with_merged(spark, sf_dir)).select(*KEY, _nested("content"))


@query("table_entities", f"with {_ALL_CELLS}, {_ENTITIES_SQL} select * from ent")
def _(spark, sf_dir):
    return op.table_entities(fx.grid_with_merged(spark, sf_dir)).select(*KEY, _entities())


@query(
    "summarize_tables",
    f"with {_ALL_CELLS}, {_CONTENT_SQL}, {_ENTITIES_SQL}, n as (select source, table_id, "
    + _COUNTS.format(rows="max(row_index)", columns="max(column_index)")
    + " from cells group by source, table_id) select n.*, content, coalesce(entities, '') as entities from n "
    "join cont using (source, table_id) left join ent using (source, table_id)",
)
def _(spark, sf_dir):
    return op.summarize_tables(fx.grid_with_merged(spark, sf_dir)).select(
        *KEY, *_COUNT_COLUMNS, *[_rounded(c) for c in _SIZES], _nested("content"), _entities()
    )


# -- merged cells -------------------------------------------------------------

_GRID_ONCE = (
    f"{GRID}, {MERGED}, ".replace("grid as (", "grid as materialized (", 1).replace("merged as (", "merged as materialized (", 1)
    + "squares as materialized (select source, table_id, parent, row_index, unnest(range(column_index, column_index + column_span)) as column_index from "
    "(select source, table_id, cell_id as parent, column_index, column_span, unnest(range(row_index, row_index + row_span)) as row_index from merged))"
)
_HITS = (
    "h1 as materialized (select g.source, g.table_id, g.cell_id, s.parent, g.cell_content, g.row_index, g.column_index "
    "from grid g join squares s using (source, table_id, row_index, column_index) where s.parent like 'm1%'), "
    "t1 as materialized (select source, table_id, parent, trim(coalesce(string_agg(cell_content, ' ' order by column_index, row_index) "
    "filter (where cell_content <> ''), '')) as txt from h1 group by source, table_id, parent), "
    "s1 as materialized (select g.*, case when t1.txt <> '' then t1.txt else g.cell_content end as text1, "
    "case when t1.txt <> '' then t1.parent end as parent1 from grid g left join h1 using (source, table_id, cell_id) "
    "left join t1 on t1.source = h1.source and t1.table_id = h1.table_id and t1.parent = h1.parent)"
)
_DISJOINT_SQL = (
    f"with {_GRID_ONCE}, {_HITS} select source, table_id, cell_id, text1 as cell_content, "
    "coalesce(parent1, 'None') as merged_parent_cell_id, case when parent1 is null then 0 else 1 end as has_merged_parent "
    "from s1 union all select source, table_id, cell_id, '', 'None', 0 from merged where cell_id like 'm1%'"
)
_OVERLAY_SQL = (
    f"with {_GRID_ONCE}, {_HITS}, "
    "h2 as materialized (select g.source, g.table_id, g.cell_id, g.row_index, g.column_index, g.text1, s.parent "
    "from s1 g join squares s using (source, table_id, row_index, column_index) where s.parent like 'm2%'), "
    "t2 as materialized (select source, table_id, parent, trim(coalesce(string_agg(text1, ' ' order by column_index, row_index) "
    "filter (where text1 <> ''), '')) as txt from h2 group by source, table_id, parent) "
    "select s1.source, s1.table_id, s1.cell_id, case when t2.txt <> '' then t2.txt else s1.text1 end as cell_content, "
    "coalesce(case when t2.txt <> '' then t2.parent end, s1.parent1, 'None') as merged_parent_cell_id, "
    "case when t2.txt <> '' or s1.parent1 is not null then 1 else 0 end as has_merged_parent "
    "from s1 left join h2 using (source, table_id, cell_id) "
    "left join t2 on t2.source = h2.source and t2.table_id = h2.table_id and t2.parent = h2.parent "
    "union all select source, table_id, cell_id, '', 'None', 0 from merged"
)
_OVERLAID = [*KEY, "cell_id", "cell_content", "merged_parent_cell_id", "has_merged_parent"]


@query("overlay_merged_cells", _OVERLAY_SQL)
def _(spark, sf_dir):
    return op.overlay_merged_cells(fx.grid_with_merged(spark, sf_dir)).select(*_OVERLAID)


@query("overlay_merged_cells_waves", _OVERLAY_SQL)
def _(spark, sf_dir):
    """Same rows with merged cells that share no square aggregated, the others replayed in visiting order."""
    return op.overlay_merged_cells(fx.grid_with_merged(spark, sf_dir), replay_all=False).select(*_OVERLAID)


@query("overlay_disjoint_merged_cells", _DISJOINT_SQL)
def _(spark, sf_dir):
    cells = fx.grid_with_merged(spark, sf_dir, overlapping=False)
    return op.overlay_merged_cells(cells, overlaps=False).select(*_OVERLAID)


@query(
    "merged_text",
    f"with {GRID}, {MERGED} select g.source, g.table_id, m.cell_id, trim(coalesce(string_agg(g.cell_content, ' ' "
    "order by g.column_index, g.row_index) filter (where g.cell_content <> ''), '')) as merged_content, "
    "count(*) as covered_cells from grid g join merged m on m.source = g.source and m.table_id = g.table_id "
    "and g.row_index between m.row_index and m.row_index + m.row_span - 1 "
    "and g.column_index between m.column_index and m.column_index + m.column_span - 1 "
    "group by g.source, g.table_id, m.cell_id",
)
def _(spark, sf_dir):
    pairs = cut_lineage(op.covered_cells(fx.grid_with_merged(spark, sf_dir)), "pairs")  # read for the texts and for their sizes
    texts = op.merged_text(pairs)
    sizes = pairs.groupBy(*KEY, "_merged").agg(F.count(F.lit(1)).alias("covered_cells"))
    return texts.join(sizes, [*KEY, "_merged"]).select(
        *KEY, F.col("_merged.cell_id").alias("cell_id"), F.col("_text").alias("merged_content"), "covered_cells"
    )


# -- block graphs -------------------------------------------------------------

_CAPTIONS = (
    "caps as (select concat('src', cast(o_custkey % 20 as varchar)) as source, "
    "concat('t', cast(o_orderkey as varchar)) as table_id, concat('tt', cast(o_orderkey as varchar)) as cell_id, "
    "'TABLE_TITLE' as cell_type, o_orderpriority as cell_content, cast(o_orderkey % 50 as int) as table_page "
    "from orders where o_orderstatus = 'O' union all "
    "select concat('src', cast(o_custkey % 20 as varchar)), concat('t', cast(o_orderkey as varchar)), "
    "concat('tf', cast(o_orderkey as varchar)), 'TABLE_FOOTER', o_orderstatus, cast(o_orderkey % 50 as int) "
    "from orders where o_orderpriority = '5-LOW')"
)
_ATTRIBUTES = (
    "attrs as (select source, table_id, max(table_page) as table_page, max(table_type) as table_type, "
    "max(table_width) as table_width from grid group by source, table_id)"
)
_BLOCK_CELLS_SQL = (
    f"with {GRID}, {MERGED}, {_CAPTIONS}, {_ATTRIBUTES}, u as ("
    "select source, table_id, cell_id, 'CHILD' as cell_type, entity_type, cell_content, row_index, column_index, "
    "1 as row_span, 1 as column_span, round(cast((column_index - 1) * 0.2 as double), 6) as cell_left from grid union all "
    "select source, table_id, cell_id, 'MERGED_CELL', null, '', row_index, column_index, row_span, column_span, null from merged union all "
    "select source, table_id, cell_id, cell_type, null, cell_content, 0, 0, 1, 1, null from caps) "
    "select u.*, a.table_page, a.table_type, round(a.table_width, 6) as table_width "
    "from u join attrs a using (source, table_id)"
)
# Every block of the graph: place in its document, type, text, page and grid position.
_ALL_BLOCKS = (
    f"{GRID}, {MERGED}, {_CAPTIONS}, {_ATTRIBUTES}, {TITLES}, "
    "cell_words as (select source, table_id, cell_id, table_page, row_index * 4 + column_index as p, string_split(cell_content, ' ') as l, "
    "unnest(range(1, 1 + len(string_split(cell_content, ' ')))) as i from grid where cell_content <> ''), "
    "blocks as (select source, table_id as document, cast(row_index * 4 + column_index as bigint) as pos, cell_id as block_id, 'CELL' as block_type, "
    "cast(null as varchar) as text, table_page as page, row_index, column_index, 1 as row_span, 1 as column_span, entity_type, 99.5 as confidence from grid union all "
    "select source, table_id, 1048576 + p * 8 + i - 1, concat(cell_id, '_w', cast(i - 1 as varchar)), 'WORD', l[i], table_page, null, null, null, null, null, 98.25 from cell_words union all "
    "select source, table_id, 1073741824 + case when cell_id like 'm1%' then 0 else 1 end, cell_id, 'MERGED_CELL', null, cast(cast(substr(table_id, 2) as bigint) % 50 as int), "
    "row_index, column_index, row_span, column_span, null, null from merged union all "
    "select source, table_id, -1, table_id, 'TABLE', null, table_page, null, null, null, null, table_type, null from attrs union all "
    "select source, table_id, 2147483648 + case when cell_type = 'TABLE_TITLE' then 0 else 2 end, cell_id, cell_type, null, table_page, null, null, null, null, null, null from caps union all "
    "select source, table_id, 2147483648 + case when cell_type = 'TABLE_TITLE' then 1 else 3 end, concat(cell_id, '_w0'), 'WORD', cell_content, table_page, null, null, null, null, null, null from caps union all "
    "select source, layout_title_id, 0, layout_title_id, 'LAYOUT_TITLE', null, layout_title_page, null, null, null, null, null, layout_title_confidence from titles union all "
    "select source, layout_title_id, 1, concat('line_', layout_title_id), 'LINE', layout_title_text, layout_title_page, null, null, null, null, null, null from titles)"
)
_BLOCK_CELL_COLUMNS = [
    "source", "table_id", "cell_id", "cell_type", "entity_type", "cell_content", "row_index",
    "column_index", "row_span", "column_span", "table_page", "table_type",
]


def _graph(spark, sf_dir, layout=True) -> DataFrame:
    return fx.block_graph(spark, sf_dir, layout).drop("document")


@query("cells_from_blocks", _BLOCK_CELLS_SQL)
def _(spark, sf_dir):
    cells = op.normalize_indices(op.cells_from_blocks(_graph(spark, sf_dir)))
    return cells.select(*_BLOCK_CELL_COLUMNS, _rounded("cell_left"), _rounded("table_width"))


@query(
    "table_cells",
    f"with {GRID}, {MERGED}, {_CAPTIONS}, {_ATTRIBUTES}, u as (select source, table_id, cell_id, 'CHILD' as cell_type, "
    "0 as rel_rank from grid union all select source, table_id, cell_id, 'MERGED_CELL', 1 from merged union all "
    "select source, table_id, cell_id, cell_type, case when cell_type = 'TABLE_FOOTER' then 2 else 3 end from caps) "
    "select u.* from u join attrs using (source, table_id)",
)
def _(spark, sf_dir):
    return op.table_cells(_graph(spark, sf_dir)).select(*KEY, "cell_id", "cell_type", "rel_rank")


@query(
    "cell_words",
    f"with {GRID}, {_CAPTIONS}, {TITLES} select source, cell_id, cell_content as words from grid where cell_content <> '' "
    "union all select source, cell_id, cell_content from caps "
    "union all select source, layout_title_id, layout_title_text from titles where layout_title_text is not null",
)
def _(spark, sf_dir):
    """Of every block that can be a cell; layout titles have words too."""
    return op.cell_words(_graph(spark, sf_dir)).select(
        "source", "cell_id", fn.join_words("cell_words").alias("words")
    )


@query(
    "cells_of_type",
    f"with {MERGED} select source, table_id, cell_id, row_span, column_span from merged",
)
def _(spark, sf_dir):
    cells = op.cells_of_type(fx.grid_with_merged(spark, sf_dir), "MERGED_CELL")
    return cells.select(*KEY, "cell_id", "row_span", "column_span")


_WORDS_SQL = (
    "words as (select source, concat(cell_id, '_w', cast(i - 1 as varchar)) as block_id, l[i] as text from "
    "(select source, cell_id, string_split(cell_content, ' ') as l, unnest(range(1, 1 + len(string_split(cell_content, ' ')))) as i "
    "from grid where cell_content <> ''))"
)


def _with_earlier_copies(blocks: DataFrame) -> DataFrame:
    """Each block after an earlier copy with another text, both made from one reading of the blocks."""
    copies = F.array(
        F.struct(F.lit("stale").alias("text"), (F.col("pos") - F.lit(1 << 40)).alias("pos")),
        F.struct(F.col("Text").alias("text"), "pos"),
    )
    both = blocks.withColumn("_copy", F.explode(copies))
    return both.withColumns({"Text": F.col("_copy.text"), "pos": F.col("_copy.pos")}).drop("_copy")


@query("dedupe_blocks", f"with {_ALL_BLOCKS} select source, block_id, text from blocks")
def _(spark, sf_dir):
    """Every block has an earlier copy with another text; the later one wins, also without text."""
    return src.dedupe_blocks(_with_earlier_copies(_graph(spark, sf_dir))).select(
        "source", F.col("Id").alias("block_id"), F.col("Text").alias("text")
    )


@query(
    "layout_titles",
    f"with {TITLES} select {_TITLE_COLUMNS} from titles",
)
def _(spark, sf_dir):
    titles = op.layout_titles(_graph(spark, sf_dir))
    return titles.select(
        "source", "layout_title_id", "layout_title_page", "layout_title_confidence", "layout_title_text"
    )


@query(
    "blocks_of_type",
    f"with {GRID} select source, cell_id as block_id, row_index, column_index, coalesce(entity_type, 'none') as entity_type from grid",
)
def _(spark, sf_dir):
    cells = op.blocks_of_type(_graph(spark, sf_dir), "CELL")
    return cells.select(
        "source",
        F.col("Id").alias("block_id"),
        F.col("RowIndex").alias("row_index"),
        F.col("ColumnIndex").alias("column_index"),
        F.coalesce(op.first_entity(), F.lit("none")).alias("entity_type"),
    )


@query(
    "cell_geometry",
    f"with {GRID}, {MERGED} select source, cell_id, table_page as page, row_index, column_index, "
    "round(cast((column_index - 1) * 0.2 as double), 6) as cell_left, round(cast((row_index % 40) * 0.02 as double), 6) as cell_top from grid union all "
    "select source, cell_id, cast(cast(substr(table_id, 2) as bigint) % 50 as int), row_index, column_index, null, null from merged",
)
def _(spark, sf_dir):
    cells = op.cell_geometry(_graph(spark, sf_dir))
    return cells.select("source", "cell_id", "page", "row_index", "column_index", _rounded("cell_left"), _rounded("cell_top"))


def _question_blocks(spark, sf_dir) -> DataFrame:
    """Questions with their answers, from the parts, and ticked boxes with an outline, from the suppliers."""
    parts, suppliers = fx.table(spark, sf_dir, "part"), fx.table(spark, sf_dir, "supplier")
    key, supplier = F.col("p_partkey").cast("string"), F.col("s_suppkey")
    corner = F.struct(F.lit(0.5).alias("X"), F.lit(1.0).alias("Y"))
    outline = F.struct(F.lit(None).cast("struct<Width:double,Height:double,Left:double,Top:double>").alias("BoundingBox"), F.array(corner).alias("Polygon"))
    asked = F.struct(F.col("p_name").alias("Text"), F.lit(None).cast("string").alias("Alias"))
    ticked = F.when(supplier % 2 == 0, "SELECTED").otherwise("NOT_SELECTED")
    place = [F.lit("parts").alias("source"), F.lit(0).cast("long").alias("pos")]
    questions = parts.select(*place, *fx._block("QUERY", F.concat(F.lit("q"), key), F.lit(1), Query=asked))
    answers = parts.select(*place, *fx._block("QUERY_RESULT", F.concat(F.lit("a"), key), F.lit(1), Text=F.col("p_type"), Confidence=F.lit(50.0)))
    boxes = suppliers.select(*place, *fx._block("SELECTION_ELEMENT", F.concat(F.lit("s"), supplier.cast("string")), F.lit(1), SelectionStatus=ticked, Geometry=outline))
    return questions.unionByName(answers).unionByName(boxes)


@query(
    "block_report",
    f"with {_ALL_BLOCKS} select source, block_id, block_type, coalesce(printf('%.2f%%', confidence), '') as confidence, coalesce(entity_type, '') as entity_types, "
    "coalesce(text, '') as text, page, case when block_type = 'CELL' then row_index end as row_index, case when block_type = 'CELL' then column_index end as column_index, "
    "case when block_type = 'CELL' then row_span end as row_span, case when block_type = 'CELL' then column_span end as column_span, "
    "'' as polygon, '' as selection, '' as query, '' as answer from blocks union all "
    "select 'parts', concat('q', cast(p_partkey as varchar)), 'QUERY', '', '', '', 1, null, null, null, null, '', '', concat('{\"Text\":\"', p_name, '\"}'), '' from part union all "
    "select 'parts', concat('a', cast(p_partkey as varchar)), 'QUERY_RESULT', '50.00%', '', p_type, 1, null, null, null, null, '', '', '', p_type from part union all "
    "select 'parts', concat('s', cast(s_suppkey as varchar)), 'SELECTION_ELEMENT', '', '', '', 1, null, null, null, null, '[{\"X\":0.5,\"Y\":1.0}]', "
    "case when s_suppkey % 2 = 0 then 'Selected' else 'Not selected' end, '', '' from supplier",
)
def _(spark, sf_dir):
    """All blocks of the graph, with questions, answers and ticked boxes."""
    report = op.block_report(_graph(spark, sf_dir).unionByName(_question_blocks(spark, sf_dir)))
    texts = ("confidence", "entity_types", "text", "polygon", "selection", "query", "answer")
    return report.select(
        "source", "block_id", "block_type", "page", "row_index", "column_index", "row_span", "column_span",
        *[F.coalesce(c, F.lit("")).alias(c) for c in texts],
    )


# Blocks that a task sorts at once, in memory.
BLOCKS_PER_TASK = 500_000


def _block_tasks(spark, sf_dir) -> int:
    """Partitions for the block graph, by the rows it is made from: a line item gives about ten blocks, a document two."""
    lines, documents = (fx.table(spark, sf_dir, n).count() for n in ("lineitem", "documents"))
    return max(1, -(-(10 * lines + 2 * documents) // BLOCKS_PER_TASK))


def _json_documents(spark, sf_dir) -> DataFrame:
    """One JSON array per table and per layout title of the block graph, as result files hold them."""
    graph = fx.block_graph(spark, sf_dir)
    block = F.struct(*[c for c in graph.columns if c not in ("source", "document", "pos")])
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col("Id").alias("_id"), block.alias("block"))))
    return (
        graph.groupBy("source", "document")
        .agg(ordered.alias("b"))
        .select(F.concat_ws("-", "source", "document").alias("source"), F.to_json(F.col("b.block")).alias("value"))
    )


@query("decode_documents", _BLOCK_CELLS_SQL.replace("select u.*", "select u.* replace (concat(source, '-', table_id) as source)"))
def _(spark, sf_dir):
    """Blocks to JSON arrays, one per document, and back to cells."""
    blocks = src.store_blocks(src.decode_documents(_json_documents(spark, sf_dir)), dedupe=False)
    cells = op.normalize_indices(op.cells_from_blocks(blocks, dedupe=False))
    return cells.select(*_BLOCK_CELL_COLUMNS, _rounded("cell_left"), _rounded("table_width"))


@query(
    "decode_responses",
    f"with {_ALL_BLOCKS} select concat(source, '-', document) as source, block_id, "
    "cast(row_number() over (partition by source, document order by pos) as bigint) as place, cast(9 as int) as document_pages from blocks",
)
def _(spark, sf_dir):
    """Documents cut into numbered responses of six blocks; order is restored."""
    graph = fx.block_graph(spark, sf_dir)
    block = F.struct(*[c for c in graph.columns if c not in ("source", "document", "pos")])
    place = F.row_number().over(Window.partitionBy("source", "document").orderBy("pos")) - 1
    tasks = _block_tasks(spark, sf_dir)
    pages = (
        graph.select("source", "document", "pos", block.alias("block"))
        .repartition(tasks, "source", "document")
        .withColumn("page_no", F.floor(place / 6))
        .groupBy("source", "document", "page_no")
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.col("block.Id").alias("_id"), "block"))).alias("b"))
        .select(
            F.concat_ws("-", "source", "document").alias("source"),
            "page_no",
            F.to_json(
                F.struct(
                    F.col("b.block").alias("Blocks"),
                    F.struct(F.lit(9).alias("Pages")).alias("DocumentMetadata"),
                )
            ).alias("value"),
        )
    )
    order = Window.partitionBy("source").orderBy("pos")
    decoded = src.decode_responses(pages).select("source", "pos", F.col("Id").alias("block_id"), "document_pages")
    return decoded.repartition(tasks, "source").select("source", "block_id", F.row_number().over(order).cast("bigint").alias("place"), "document_pages")


@query("save_and_load_blocks", f"with {_ALL_BLOCKS} select source, block_id, block_type, coalesce(text, '') as text, page, row_index, column_span from blocks")
def _(spark, sf_dir):
    path = scratch_path(spark, "blocks")
    src.save_blocks(_graph(spark, sf_dir), path)
    return src.load_blocks(spark, path).select(
        "source", F.col("Id").alias("block_id"), F.col("BlockType").alias("block_type"), F.coalesce("Text", F.lit("")).alias("text"),
        F.col("Page").alias("page"), F.col("RowIndex").alias("row_index"), F.col("ColumnSpan").alias("column_span"),
    )


_ALL_WORDS_SQL = f"with {GRID}, {_WORDS_SQL}, {_CAPTIONS} select * from words union all select source, concat(cell_id, '_w0'), cell_content from caps"


@query("dedupe_all_words", _ALL_WORDS_SQL)
def _(spark, sf_dir):
    """As ``dedupe_blocks``, with the words of table titles and footers."""
    blocks = op.blocks_of_type(_graph(spark, sf_dir, False), "WORD")
    return src.dedupe_blocks(_with_earlier_copies(blocks)).select(
        "source", F.col("Id").alias("block_id"), F.col("Text").alias("text")
    )


@query("save_and_load_all_words", _ALL_WORDS_SQL)
def _(spark, sf_dir):
    """As ``save_and_load_blocks``, with the words of table titles and footers."""
    path = scratch_path(spark, "blocks")
    src.save_blocks(op.blocks_of_type(_graph(spark, sf_dir, False), "WORD"), path)
    return src.load_blocks(spark, path).select(
        "source", F.col("Id").alias("block_id"), F.col("Text").alias("text")
    )


_ROUND_TRIP_SQL = (
    f"with {GRID} select source, table_id, cell_id, cell_content, coalesce(entity_type, 'none') as entity_type, "
    "case when cell_content = '' then 0 else len(string_split(cell_content, ' ')) end as word_count, row_index, "
    "round(cast((column_index - 1) * 0.2 as double), 6) as cell_left from grid"
)


def _round_trip(cells: DataFrame) -> DataFrame:
    return cells.select(
        *KEY, "cell_id", F.coalesce("cell_content", F.lit("")).alias("cell_content"),
        F.coalesce(F.nullif("entity_type", F.lit("")), F.lit("none")).alias("entity_type"),
        F.size("cell_words").cast("bigint").alias("word_count"), "row_index", _rounded("cell_left"),
    )


@query("write_and_read_csv", _ROUND_TRIP_SQL)
def _(spark, sf_dir):
    path = scratch_path(spark, "csv")
    src.write_csv(fx.grid_cells(spark, sf_dir).select(*src.CELLS.fieldNames()), path)
    return _round_trip(src.read_cells(spark, path))


@query("save_and_load_dataset", _ROUND_TRIP_SQL)
def _(spark, sf_dir):
    path = scratch_path(spark, "dataset")
    src.save_dataset(fx.grid_cells(spark, sf_dir), path)
    return _round_trip(src.load_dataset(spark, path))


@query(
    "concat_datasets",
    f"with {GRID}, {MERGED} select source, table_id, cell_id, table_page from grid union all "
    "select source, table_id, cell_id, null from merged",
)
def _(spark, sf_dir):
    cells = src.concat_datasets(
        fx.grid_cells(spark, sf_dir).select(*KEY, "cell_id", "table_page"),
        fx.merged_cells(spark, sf_dir).select(*KEY, "cell_id"),
    )
    return cells


# -- files --------------------------------------------------------------------


def _large_documents(spark, sf_dir, per_document: int) -> DataFrame:
    """The block graph in documents of about ``per_document`` tables and titles, by ``source`` and ``name``."""
    name = F.pmod(F.xxhash64("document"), F.lit(_documents_a_source(spark, sf_dir, per_document))).cast("string")
    return fx.block_graph(spark, sf_dir).withColumn("name", name).drop("document")


@query("read_blocks", _BLOCK_CELLS_SQL)
def _(spark, sf_dir):
    """Documents written as files of one JSON array each, read back by their path."""
    folder = scratch_path(spark, "files")
    graph = _large_documents(spark, sf_dir, 500)
    block = F.struct(*[c for c in graph.columns if c not in ("source", "name", "pos")])
    arrays = graph.groupBy("source", "name").agg(F.collect_list(block).alias("b")).select("source", "name", F.to_json("b").alias("value"))
    arrays.write.partitionBy("source", "name").text(folder, compression="gzip")
    blocks = src.read_blocks(spark, f"{folder}/*/*", pattern=r"source=([^/]+)/")
    cells = op.normalize_indices(op.cells_from_blocks(blocks))
    return cells.select(*_BLOCK_CELL_COLUMNS, _rounded("cell_left"), _rounded("table_width"))


@query(
    "read_block_pages",
    f"with {_ALL_BLOCKS} select source, block_id, block_type, coalesce(text, '') as text, cast(row_number() over (partition by source order by block_id) as bigint) as place from blocks",
)
def _(spark, sf_dir):
    """Responses in files numbered by their path; twelve and more sort by number, not by name."""
    folder = scratch_path(spark, "pages")
    graph = fx.block_graph(spark, sf_dir).drop("document")
    # Blocks in order of their ids, at most 4,000 in a response.
    order = Window.partitionBy("source").orderBy("Id")
    numbered = graph.withColumn("page_no", F.floor((F.row_number().over(order) - 1) / 4000) + 1)
    block = F.struct(*[c for c in graph.columns if c not in ("source", "pos")])
    pages = numbered.groupBy("source", "page_no").agg(F.array_sort(F.collect_list(F.struct("Id", block.alias("block")))).getField("block").alias("Blocks"))
    pages.select(F.to_json(F.struct("Blocks")).alias("value"), "source", "page_no").write.partitionBy("source", "page_no").text(folder, compression="gzip")
    blocks = src.read_block_pages(spark, f"{folder}/*/*", pattern=r"source=([^/]+)/page_no=(\d+)/")
    place = F.row_number().over(Window.partitionBy("source").orderBy("pos")).cast("bigint")
    return blocks.select(
        "source", F.col("Id").alias("block_id"), F.col("BlockType").alias("block_type"), F.coalesce("Text", F.lit("")).alias("text"), place.alias("place")
    )


@query(
    "read_tables",
    f"with {_ALL_CELLS}, {_CONTENT_SQL}, {_ENTITIES_SQL}, n as (select source, table_id, "
    + _COUNTS.format(rows="max(row_index)", columns="max(column_index)")
    + " from cells group by source, table_id) select n.*, content, coalesce(entities, '') as entities from n "
    "join cont using (source, table_id) left join ent using (source, table_id)",
)
def _(spark, sf_dir):
    """Table summaries written as CSV, nested lists as text, and read back."""
    path = scratch_path(spark, "tables")
    src.write_csv(op.summarize_tables(fx.grid_with_merged(spark, sf_dir)).select(*src.TABLES.fieldNames()), path)
    return src.read_tables(spark, path).select(
        *KEY, *_COUNT_COLUMNS, *[_rounded(c) for c in _SIZES], _nested("content"), _entities()
    )


_TICKED = "case when cast(cell_content as int) % 2 = 0 then 'SELECTED' else 'NOT_SELECTED' end"


@query(
    "cell_words_with_selection",
    f"with {GRID}, {_CAPTIONS}, {TITLES} select source, cell_id, case when column_index = 3 then {_TICKED} else cell_content end as words "
    "from grid where cell_content <> '' union all select source, cell_id, cell_content from caps "
    "union all select source, layout_title_id, layout_title_text from titles where layout_title_text is not null",
)
def _(spark, sf_dir):
    """The numbers of the third column as boxes that are ticked if even; the status counts as a word."""
    graph = _graph(spark, sf_dir)
    box = (F.col("BlockType") == "WORD") & F.col("Id").rlike("^c[0-9]+_[0-9]+_3_w")
    status = F.when(F.col("Text").try_cast("int") % 2 == 0, "SELECTED").otherwise("NOT_SELECTED")
    ticked = graph.withColumns(
        {
            "SelectionStatus": F.when(box, status),
            "Text": F.when(~box, F.col("Text")),
            "BlockType": F.when(box, "SELECTION_ELEMENT").otherwise(F.col("BlockType")),
        }
    )
    return op.cell_words(ticked, include_selection=True).select("source", "cell_id", fn.join_words("cell_words").alias("words"))


@query(
    "layout_titles_all_relations",
    f"with {TITLES}, t as (select *, cast(substr(layout_title_id, 3) as bigint) as n from titles) "
    "select source, layout_title_id, concat_ws(' ', layout_title_text, concat('more', cast(n as varchar)), case when n % 2 = 0 then concat('word', cast(n as varchar)) end) as every_text, "
    "concat_ws(' ', layout_title_text, concat('more', cast(n as varchar))) as line_text, layout_title_text as first_text from t",
)
def _(spark, sf_dir):
    """Titles with a second relation, to a line and, for every second one, a word."""
    titles = fx.titles(spark, sf_dir).withColumn("n", F.substring("layout_title_id", 3, 20))
    more, word = F.concat(F.lit("more"), "n"), F.concat(F.lit("word"), "n")
    even = F.col("n").cast("bigint") % 2 == 0
    first = fx._relation("CHILD", F.array(F.concat(F.lit("line_"), "layout_title_id")))
    other = fx._relation("OTHER", F.array(F.concat(F.lit("m"), "n"), F.concat(F.lit("v"), "n")))
    place = ["source", F.lit(0).cast("long").alias("pos")]
    owner = titles.select(*place, *fx._block("LAYOUT_TITLE", F.col("layout_title_id"), F.lit(1), Relationships=F.array(first, other)))
    lines = titles.select(*place, *fx._block("LINE", F.concat(F.lit("line_"), "layout_title_id"), F.lit(1), Text=F.col("layout_title_text")))
    lines = lines.unionByName(titles.select(*place, *fx._block("LINE", F.concat(F.lit("m"), "n"), F.lit(1), Text=more)))
    blocks = owner.unionByName(lines).unionByName(titles.filter(even).select(*place, *fx._block("WORD", F.concat(F.lit("v"), "n"), F.lit(1), Text=word)))
    key = ["source", "layout_title_id"]
    parts = {"every_text": {"all_relations": True}, "line_text": {"all_relations": True, "line_only": True}, "first_text": {}}
    out = None
    for name, options in parts.items():
        found = op.layout_titles(blocks, **options).select(*key, F.col("layout_title_text").alias(name))
        out = found if out is None else out.join(found, key)
    return out


@query(
    "schema_diff",
    "with a as (select column_name from duckdb_columns() where table_name = 'orders'), b as (select column_name from duckdb_columns() where table_name = 'lineitem') "
    "select column_name, 'left_only' as side from a where column_name not in (select column_name from b) union "
    "select column_name, 'right_only' from b where column_name not in (select column_name from a)",
)
def _(spark, sf_dir):
    return op.schema_diff(fx.table(spark, sf_dir, "orders"), fx.table(spark, sf_dir, "lineitem"))


_SIDES_WITH_MERGED = (
    _ALL_SIDES_SQL.replace(f"with {GRID},", f"with {GRID}, {MERGED},", 1)
    + " union all select source, table_id, cell_id, null, null, null, null from merged"
)


@query("neighbour_words_of_all_cells", _SIDES_WITH_MERGED)
def _(spark, sf_dir):
    """Merged cells get no lists, and their texts are in none."""
    cells = fx.grid_with_merged(spark, sf_dir).select(*KEY, "cell_id", "cell_type", "cell_words", "row_index", "column_index", "rel_rank", "pos")
    return op.neighbour_words(cells).select(*KEY, "cell_id", *[_bar(f"words_{s}") for s in _SIDES])


# -- shape --------------------------------------------------------------------


@query(
    "normalize_indices",
    f"with {GRID} select cell_id, case when row_index = 1 then 0 else row_index end as row_index, "
    "case when column_index = 4 then 0 else column_index end as column_index, "
    "case when row_index = 2 then 1 else row_index end as row_span, 1 as column_span from grid",
)
def _(spark, sf_dir):
    row, column = F.col("row_index").cast("double"), F.col("column_index").cast("double")
    holes = fx.grid_cells(spark, sf_dir).select(
        "cell_id",
        F.when(row != 1, row).alias("row_index"),
        F.when(column != 4, column).alias("column_index"),
        F.when(row != 2, row).alias("row_span"),
        F.lit(None).cast("double").alias("column_span"),
    )
    return op.normalize_indices(holes)


@query(
    "fill_missing",
    f"with {GRID} select cell_id, coalesce(entity_type, '') as entity_type, coalesce(table_type, '') as table_type, row_index from grid",
)
def _(spark, sf_dir):
    return op.fill_missing(fx.grid_cells(spark, sf_dir).select("cell_id", "entity_type", "table_type", "row_index"))


@query(
    "features_by_prefix",
    f"with {GRID} select cell_id, row_index, table_page, round(table_width, 6) as table_width, "
    "round(table_left, 6) as table_left from grid",
)
def _(spark, sf_dir):
    cells = op.drop_columns(fx.grid_cells(spark, sf_dir), "table_id", "table_type", "table_height", "table_top", "not_there")
    chosen = op.features_by_prefix(cells, ["row_index"], ["table_"], keep=["cell_id"])
    return chosen.select("cell_id", "row_index", "table_page", _rounded("table_width"), _rounded("table_left"))


@query(
    "table_predictions",
    f"with {_ALL_CELLS}, k as (select source, table_id, max(table_page) as table_page, "
    "case when max(row_index) > 4 then 'BIGRID' else 'KVP' end as table_class from cells group by source, table_id), "
    "r as (select source, table_id, row_index, string_agg(cell_content, ' ' order by column_index, rel_rank, pos) "
    "filter (where cell_content <> '') as x from cells group by source, table_id, row_index) "
    "select k.source, k.table_id, k.table_page, k.table_class, coalesce(string_agg(x, ' ' order by row_index), '') as table_content "
    "from k join r using (source, table_id) group by k.source, k.table_id, k.table_page, k.table_class",
)
def _(spark, sf_dir):
    tables = op.summarize_tables(fx.grid_with_merged(spark, sf_dir)).withColumn("table_class", _class())
    return op.table_predictions(tables).select(*KEY, "table_page", "table_class", "table_content")


@query(
    "cell_predictions",
    f"with {GRID} select cell_id, cell_content, source, table_page, case when row_index = 1 then 'key' else 'value' end as cell_role, "
    "round(cast((column_index - 1) * 0.2 as double), 6) as cell_left, round(cast((row_index % 40) * 0.02 as double), 6) as cell_top, "
    "cast(0.2 as double) as cell_width, cast(0.02 as double) as cell_height from grid",
)
def _(spark, sf_dir):
    cells = fx.grid_cells(spark, sf_dir).withColumn("role", F.when(F.col("row_index") == 1, "key").otherwise("value"))
    out = op.cell_predictions(cells, "role")
    return out.withColumns({c: F.round(c, 6) for c in ("cell_left", "cell_top", "cell_width", "cell_height")})


@query("in_cell_order", f"with {GRID} select table_id, column_index, row_index, cell_id from grid")
def _(spark, sf_dir):
    return op.in_cell_order(fx.grid_cells(spark, sf_dir)).select("table_id", "column_index", "row_index", "cell_id")


@query("in_page_order", f"with {TITLES} select source, layout_title_page as table_page, layout_title_id from titles")
def _(spark, sf_dir):
    rows = fx.titles(spark, sf_dir).withColumnRenamed("layout_title_page", "table_page")
    return op.in_page_order(rows).select("source", "table_page", "layout_title_id")


@query(
    "preview",
    f"with {GRID} select table_id, column_index, row_index, cell_id from grid order by table_id, column_index, row_index limit 5",
)
def _(spark, sf_dir):
    cells = op.in_cell_order(fx.grid_cells(spark, sf_dir))
    return op.preview(cells, 5).select("table_id", "column_index", "row_index", "cell_id")


# -- joins --------------------------------------------------------------------


def _class():
    return F.when(F.col("row_count") > 4, "BIGRID").otherwise("KVP")


@query(
    "attach_table_class",
    f"with {GRID}, {_TABLES} select g.source, g.table_id, g.cell_id, case when t.row_count > 4 then 'BIGRID' else 'KVP' end as table_class, "
    "t.row_count as table_rows, t.column_count as table_columns, t.cell_count as table_cells "
    "from grid g left join t on t.source = g.source and t.table_id = g.table_id",
)
def _(spark, sf_dir):
    cells = fx.grid_cells(spark, sf_dir)
    tables = op.table_counts(cells).withColumn("table_class", _class())
    return op.attach_table_class(cells, tables).select(
        *KEY, "cell_id", "table_class", "table_rows", "table_columns", "table_cells"
    )


@query(
    "attach_tags",
    "select d.doc_id, d.source, l.quality as cell_role from documents d left join labels l on l.doc_id = d.doc_id",
)
def _(spark, sf_dir):
    tags = fx.table(spark, sf_dir, "labels").withColumnRenamed("quality", "cell_role")
    return op.attach_tags(fx.table(spark, sf_dir, "documents").select("doc_id", "source"), tags, on="doc_id")


@query(
    "cells_of_tables",
    f"with {GRID}, t as (select source, table_id from grid group by source, table_id having max(row_index) > 4) "
    "select g.source, g.table_id, g.cell_id, g.cell_content from t join grid g on g.source = t.source and g.table_id = t.table_id",
)
def _(spark, sf_dir):
    cells = fx.grid_cells(spark, sf_dir)
    tables = op.table_counts(cells).filter("row_count > 4").select(*KEY)
    return op.cells_of_tables(tables, cells).select(*KEY, "cell_id", "cell_content")


@query(
    "unmatched",
    "select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)",
)
def _(spark, sf_dir):
    documents = fx.table(spark, sf_dir, "documents").select("doc_id", "source")
    return op.unmatched(documents, fx.table(spark, sf_dir, "labels"), "doc_id")


# -- text ---------------------------------------------------------------------

_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
_STOP = ["and", "de", "in", "la", "that", "the", "to", "un"]
_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in _STOP) + "]"
_TOKS = f"toks as (select doc_id, unnest({_TOK}) as term from documents)"
_TOKS_KEPT = f"toks as (select doc_id, term from (select doc_id, unnest({_TOK}) as term from documents) where not list_contains({_STOP_SQL}, term))"
_STATS = "stats as (select term, count(*) as term_count, count(distinct doc_id) as document_count from toks group by term)"
_VOCABULARY = (
    "top as (select * from stats order by term_count desc, term limit {k}), "
    "vocab as (select cast(row_number() over (order by term) - 1 as int) as term_index, term, term_count, document_count, "
    "ln((1.0 + (select count(*) from documents)) / (1.0 + document_count)) + 1 as idf from top)"
)
_WEIGHTS = (
    "tf as (select doc_id, term, count(*) as n from toks group by doc_id, term), "
    "raw as (select doc_id, term, n * idf as x from tf join vocab using (term)), "
    "norm as (select doc_id, sqrt(sum(x * x)) as size from raw group by doc_id)"
)


@query("tokenize", f"select doc_id, array_to_string({_TOK}, ' ') as tokens, cast(len({_TOK}) as bigint) as token_count from documents")
def _(spark, sf_dir):
    documents = fx.table(spark, sf_dir, "documents").select("doc_id", fn.tokenize("text").alias("t"))
    return documents.select(
        "doc_id", fn.join_words("t").alias("tokens"), F.size("t").cast("bigint").alias("token_count")
    )


@query(
    "remove_stop_words",
    f"select doc_id, array_to_string(list_filter({_TOK}, lambda t: not list_contains({_STOP_SQL}, t)), ' ') as tokens from documents",
)
def _(spark, sf_dir):
    documents = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    return op.tokens(documents, "text", stop_words=_STOP).select("doc_id", fn.join_words("tokens").alias("tokens"))


@query("corpus_stats", f"with {_TOKS}, {_STATS} select * from stats")
def _(spark, sf_dir):
    return op.corpus_stats(fx.table(spark, sf_dir, "documents"), "text")


@query("top_terms", f"with {_TOKS}, {_STATS} select * from stats order by term_count desc, term limit 1000")
def _(spark, sf_dir):
    return op.top_terms(op.corpus_stats(fx.table(spark, sf_dir, "documents"), "text"), 1000)


@query(
    "fit_tfidf",
    f"with {_TOKS_KEPT}, {_STATS}, {_VOCABULARY.format(k=50)} select term_index, term, term_count, document_count, round(idf, 6) as idf from vocab",
)
def _(spark, sf_dir):
    vocabulary = op.fit_tfidf(fx.table(spark, sf_dir, "documents"), "text", 50, _STOP)
    return vocabulary.withColumn("idf", F.round("idf", 6))


@query(
    "transform_tfidf",
    f"with {_TOKS}, {_STATS}, {_VOCABULARY.format(k=1000)}, {_WEIGHTS} select doc_id, term, round(x / size, 6) as weight from raw join norm using (doc_id)",
)
def _(spark, sf_dir):
    documents = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = op.fit_tfidf(documents, "text", 1000)
    vectors = op.transform_tfidf(documents, vocabulary, "text")
    return op.weights_long(vectors, vocabulary, "doc_id").withColumn("weight", F.round("weight", 6))


@query(
    "transform_tfidf_weighted",
    f"with {_TOKS_KEPT}, {_STATS}, {_VOCABULARY.format(k=50)}, {_WEIGHTS} select doc_id, term, round(0.2 * x / size, 6) as weight from raw join norm using (doc_id)",
)
def _(spark, sf_dir):
    documents = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = op.fit_tfidf(documents, "text", 50, _STOP)
    vectors = op.transform_tfidf(documents, vocabulary, "text", weight=0.2, stop_words=_STOP)
    return op.weights_long(vectors, vocabulary, "doc_id").withColumn("weight", F.round("weight", 6))


_SOME_TEXTS = "given as (select doc_id, case when doc_id % 5 = 0 then null else text end as text from documents)"


@query(
    "transform_tfidf_missing_texts",
    f"with {_SOME_TEXTS}, {_TOKS.replace('from documents', 'from given')}, {_STATS}, {_VOCABULARY.format(k=50)}, {_WEIGHTS} "
    "select given.doc_id, raw.term, round(x / size, 6) as weight from given left join raw using (doc_id) left join norm using (doc_id)",
)
def _(spark, sf_dir):
    """Every fifth text is missing: it counts as a document and has no weights."""
    documents = fx.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("text"))
    vocabulary = op.fit_tfidf(documents, "text", 50)
    vectors = op.transform_tfidf(documents, vocabulary, "text")
    weights = op.weights_long(vectors, vocabulary, "doc_id").withColumn("weight", F.round("weight", 6))
    return documents.select("doc_id").join(weights, "doc_id", "left")


@query(
    "label_encode_many",
    "select o_orderkey, dense_rank() over (order by cast(o_orderkey as varchar)) - 1 as key_code, cast(dense_rank() over (order by o_orderpriority) - 1 as int) as priority_code from orders"
)
def _(spark, sf_dir):
    """More values than are looked up row by row, beside a column with few."""
    orders = fx.table(spark, sf_dir, "orders")
    codes = op.label_codes(orders, "o_orderkey").select(F.col("value").cast("long").alias("o_orderkey"), F.col("code").alias("key_code"))
    return op.label_encode(orders, "o_orderpriority", "priority_code").join(codes, "o_orderkey").select("o_orderkey", "key_code", "priority_code")


@query(
    "pca_variances",
    "with x as (select vec_id, generate_subscripts(embedding, 1) as i, cast(unnest(embedding) as double) as v from embeddings), "
    "c as (select vec_id, i, v - avg(v) over (partition by i) as v from x) "
    "select count(*) as vectors, round(sum(s), 4) as total_length from (select vec_id, sum(v * v) as s from c group by vec_id)",
)
def _(spark, sf_dir):
    """All components of the centred vectors: their variances add up to that of the vectors."""
    vectors = fx.table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector("embedding").alias("v"))
    centred = op.fit_scaler(vectors, "v", "centred", with_std=False).transform(vectors)
    reduced = op.fit_pca(centred, "centred", "pca", variance=1.0).transform(centred)
    length = F.aggregate(vector_to_array("pca"), F.lit(0.0), lambda t, x: t + x * x)
    return reduced.agg(F.count(F.lit(1)).alias("vectors"), F.round(F.sum(length), 4).alias("total_length"))


@query(
    "flatten_content",
    f"with {_ALL_CELLS}, r as (select source, table_id, row_index, string_agg(cell_content, ' ' order by column_index, rel_rank, pos) "
    "filter (where cell_content <> '') as x from cells where cell_type = 'CHILD' group by source, table_id, row_index), "
    "c as (select source, table_id, string_agg(x, ' ' order by row_index) as t from r group by source, table_id) "
    "select source, table_id, case when cast(substr(table_id, 2) as bigint) % 3 = 0 then concat('[[not closed ', t) else t end as text from c",
)
def _(spark, sf_dir):
    """Content as single-quoted text, every third table's text being unreadable."""
    tables = op.table_content(fx.grid_cells(spark, sf_dir))
    quoted = F.translate(F.to_json("content"), '"', "'")
    broken = F.concat(F.lit("[[not closed "), fn.content_text("content"))
    text = F.when(F.substring("table_id", 2, 20).cast("bigint") % 3 == 0, broken).otherwise(quoted)
    return tables.select(*KEY, text.alias("c")).select(*KEY, fn.flatten_content("c").alias("text"))


@query(
    "text_functions",
    f"with {GRID} select cell_id, concat(source, '.json') as name, concat(source, '.pdf') as pdf, "
    "case when cell_content = '' then 0 else 1 end as has_content, "
    "case when cell_content = '' then 'empty' else cell_content end as marked, "
    "concat_ws(' ', nullif(cell_content, ''), table_id) as joined, "
    "concat(cell_content, ' ', coalesce(entity_type, ''), ' ', table_id) as combined from grid",
)
def _(spark, sf_dir):
    cells = fx.grid_cells(spark, sf_dir)
    path = F.concat(F.lit("/in/ready/"), F.col("source"), F.lit(".json"))
    return cells.select(
        "cell_id",
        fn.base_name(path).alias("name"),
        fn.pdf_name(fn.base_name(path)).alias("pdf"),
        fn.has_content("cell_content").alias("has_content"),
        fn.words_or_marker("cell_words").alias("marked"),
        fn.join_non_empty(F.array("cell_content", F.lit(""), "table_id")).alias("joined"),
        fn.concat_text("cell_content", "entity_type", "table_id").alias("combined"),
    )


@query(
    "type_codes",
    f"with {GRID}, {MERGED} select cell_id, 0 as cell_type_code, case when entity_type = 'COLUMN_HEADER' then 1 else 0 end as entity_type_code from grid "
    "union all select cell_id, 1, 0 from merged",
)
def _(spark, sf_dir):
    return fx.grid_with_merged(spark, sf_dir).select(
        "cell_id",
        fn.cell_type_code("cell_type").alias("cell_type_code"),
        fn.entity_type_code("entity_type").alias("entity_type_code"),
    )


# -- encoders -----------------------------------------------------------------


@query(
    "one_hot",
    f"with {GRID}, t as (select source, table_id, max(table_type) as table_type from grid group by source, table_id) "
    "select source, table_id, case when table_type = 'SEMI_STRUCTURED_TABLE' then 1 else 0 end as \"table_type_SEMI_STRUCTURED_TABLE\", "
    "case when table_type = 'STRUCTURED_TABLE' then 1 else 0 end as \"table_type_STRUCTURED_TABLE\", "
    "case when table_type is null then 1 else 0 end as \"table_type_None\" from t",
)
def _(spark, sf_dir):
    tables = op.table_counts(fx.grid_cells(spark, sf_dir)).select(*KEY, "table_type")
    return op.one_hot(tables, "table_type", op.categories(tables, "table_type")).drop("table_type")


@query(
    "label_encode",
    "select p_partkey, cast(dense_rank() over (order by p_type) - 1 as int) as p_type_encoded from part",
)
def _(spark, sf_dir):
    return op.label_encode(fx.table(spark, sf_dir, "part"), "p_type").select("p_partkey", "p_type_encoded")


def _grid_tables(spark, sf_dir):
    return op.table_entities(fx.grid_cells(spark, sf_dir))


_CODES_SQL = (
    f"with {GRID}, c as (select source, table_id, row_index, column_index, "
    "case when entity_type = 'COLUMN_HEADER' then 1 else 2 end as code from grid)"
)


@query(
    "encode_entities",
    f"{_CODES_SQL}, r as (select source, table_id, row_index, string_agg(cast(code as varchar), ' ' order by column_index) as x "
    "from c group by source, table_id, row_index) select source, table_id, string_agg(x, ' / ' order by row_index) as entities_int "
    "from r group by source, table_id",
)
def _(spark, sf_dir):
    tables = cut_lineage(_grid_tables(spark, sf_dir), "tables")  # read to find the codes and to write them
    coded = op.encode_entities(tables, op.entity_codes(tables))
    text = F.array_join(
        F.transform("entities_int", lambda r: F.array_join(F.transform(r, lambda e: e.cast("string")), " ")), " / "
    )
    return coded.select(*KEY, text.alias("entities_int"))


@query("entity_categories", f"with {GRID} select distinct coalesce(entity_type, 'normal') as entity from grid")
def _(spark, sf_dir):
    return op.entity_categories(_grid_tables(spark, sf_dir))


@query(
    "grid_extent",
    f"with {GRID} select cast(max(row_index) as int) as height, cast(max(column_index) as int) as width from grid",
)
def _(spark, sf_dir):
    return op.grid_extent(_grid_tables(spark, sf_dir), "entities")


@query(
    "pad_and_flatten_grid",
    f"{_CODES_SQL}, size as (select max(row_index) as h, max(column_index) as w from c), "
    "t as (select distinct source, table_id from c), "
    "places as (select source, table_id, r, k from t, size, unnest(range(1, h + 1)) as a(r), unnest(range(1, w + 1)) as b(k)) "
    "select p.source, p.table_id, string_agg(cast(coalesce(c.code, 0) as varchar), ' ' order by r, k) as flat "
    "from places p left join c on c.source = p.source and c.table_id = p.table_id and c.row_index = r and c.column_index = k "
    "group by p.source, p.table_id",
)
def _(spark, sf_dir):
    tables = cut_lineage(_grid_tables(spark, sf_dir), "tables")  # read to find the codes and to write them
    coded = op.encode_entities(tables, op.entity_codes(tables))
    flat = op.padded_grid(coded, "entities_int", "flat", flat=True)
    return flat.select(*KEY, F.array_join(F.transform("flat", lambda e: e.cast("string")), " ").alias("flat"))


_SCALED_SQL = (
    "select o_orderkey, round((o_totalprice - avg(o_totalprice) over ()) / stddev_pop(o_totalprice) over (), 6) as price, "
    "round((o_custkey - avg(o_custkey) over ()) / stddev_pop(o_custkey) over (), 6) as customer, "
    "cast(0 as double) as constant from orders"
)


def _numbers(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"), F.lit(7).alias("constant")
    )


@query("standard_scale", _SCALED_SQL)
def _(spark, sf_dir):
    numbers = _numbers(spark, sf_dir)
    scaled = op.standard_scale(numbers, op.fit_scaling(numbers, ["price", "customer", "constant"]))
    return scaled.select("o_orderkey", *[_rounded(c) for c in ("price", "customer", "constant")])


@query("assemble_and_scale", _SCALED_SQL)
def _(spark, sf_dir):
    wide = op.assemble(_numbers(spark, sf_dir), ["price", "customer", "constant"])
    values = vector_to_array("scaled")
    scaled = op.fit_scaler(wide, "features", "scaled").transform(wide)
    return scaled.select(
        "o_orderkey",
        *[F.round(values[i] + 0.0, 6).alias(c) for i, c in enumerate(("price", "customer", "constant"))],
    )


@query(
    "pca_all_components",
    "select o_orderkey, round(pow((o_totalprice - avg(o_totalprice) over ()) / stddev_pop(o_totalprice) over (), 2) + "
    "pow((o_custkey - avg(o_custkey) over ()) / stddev_pop(o_custkey) over (), 2), 6) as squared_length from orders",
)
def _(spark, sf_dir):
    """Keeping every component is a rotation, so lengths stay as they were."""
    reduced = op.pca(_numbers(spark, sf_dir), ["price", "customer"], k=2, scale=True)
    values = vector_to_array("pca")
    return reduced.select("o_orderkey", F.round(values[0] * values[0] + values[1] * values[1], 6).alias("squared_length"))


@query("pca_by_variance")
def _(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector("embedding").alias("v"))
    reduced = op.fit_pca(vectors, "v", "pca", variance=0.95).transform(vectors)
    return reduced.select("vec_id", F.size(vector_to_array("pca")).alias("components"))


# -- quality ------------------------------------------------------------------

_PROFILE = [
    ("o_orderkey", "bigint", True), ("o_custkey", "bigint", True), ("o_totalprice", "double", True),
    ("o_orderstatus", "string", False), ("urgent", "string", False),
]


@query(
    "dataset_profile",
    "with o as (select o_orderkey, o_custkey, o_totalprice, o_orderstatus, "
    "case when o_orderpriority = '1-URGENT' then 'yes' end as urgent from orders) "
    + " union all ".join(
        f"select '{c}' as column_name, '{t}' as data_type, count(*) as row_count, count(*) - count({c}) as null_count, "
        + (f"cast(min({c}) as double) as min_value, cast(max({c}) as double) as max_value from o" if n
           else "cast(null as double) as min_value, cast(null as double) as max_value from o")
        for c, t, n in _PROFILE
    ),
)
def _(spark, sf_dir):
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", "yes").alias("urgent")
    orders = fx.table(spark, sf_dir, "orders")
    return op.dataset_profile(orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", urgent))


@query(
    "columns_with_nulls",
    f"with {GRID} select 'entity_type' as column_name from grid having count(*) > count(entity_type) "
    "union all select 'table_type' from grid having count(*) > count(table_type)",
)
def _(spark, sf_dir):
    return op.columns_with_nulls(fx.grid_cells(spark, sf_dir))


@query(
    "confusion_counts",
    "select cast(quality as varchar) as label, cast(toxic as varchar) as prediction, count(*) as n from labels group by 1, 2",
)
def _(spark, sf_dir):
    return op.confusion_counts(fx.table(spark, sf_dir, "labels"), "quality", "toxic")


def _report_sql(label: str, prediction: str, source: str) -> str:
    return (
        f"with p as (select {label} as y, {prediction} as z from {source}), "
        "c as (select y as class from p union select z from p), "
        "m as (select class, (select count(*) from p where y = class and z = class) as tp, "
        "(select count(*) from p where z = class) as pp, (select count(*) from p where y = class) as support from c), "
        "s as (select class, case when pp = 0 then 0.0 else tp / pp end as p, case when support = 0 then 0.0 else tp / support end as r, "
        "case when pp + support = 0 then 0.0 else 2.0 * tp / (pp + support) end as f, support, tp from m), "
        "u as (select cast(class as varchar) as class, p, r, f, support from s union all "
        "select 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) from s union all "
        "select 'macro avg', avg(p), avg(r), avg(f), sum(support) from s union all "
        "select 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) from s) "
        "select class, round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1_score, cast(support as bigint) as support from u"
    )


def _report(df, label, prediction):
    measures = ("precision", "recall", "f1_score")
    return op.classification_report(df, label, prediction).withColumns({m: F.round(m, 6) for m in measures})


@query("classification_report", _report_sql("quality", "toxic", "labels"))
def _(spark, sf_dir):
    return _report(fx.table(spark, sf_dir, "labels"), "quality", "toxic")


@query(
    "classification_report_classes",
    _report_sql("o_orderpriority", "case when o_orderkey % 3 = 0 then '2-HIGH' when o_orderkey % 7 = 0 then 'other' else o_orderpriority end", "orders"),
)
def _(spark, sf_dir):
    key = F.col("o_orderkey")
    guess = F.when(key % 3 == 0, "2-HIGH").when(key % 7 == 0, "other").otherwise(F.col("o_orderpriority"))
    return _report(fx.table(spark, sf_dir, "orders").withColumn("guess", guess), "o_orderpriority", "guess")


@query(
    "hash_split",
    "select doc_id, case when cast(concat('0x', substr(md5(cast(doc_id as varchar)), 1, 8)) as bigint) % 100 < 75 "
    "then 'train' else 'test' end as part from documents",
)
def _(spark, sf_dir):
    train, test = op.hash_split(fx.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "best_k",
    "select p_size as best_k, round(avg(p_retailprice), 6) as silhouette from part group by p_size "
    "order by avg(p_retailprice) desc, p_size limit 1",
)
def _(spark, sf_dir):
    """The choice itself, on scores made from the parts table."""
    scores = fx.table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("k")).agg(F.avg("p_retailprice").alias("silhouette"))
    return op.best_k(scores).withColumn("silhouette", F.round("silhouette", 6))


# -- annotation ---------------------------------------------------------------

_BOX_SQL = (
    "round(cast({l} * 612.0 as double), 6) as abs_left, round(cast({t} * 792.0 as double), 6) as abs_top, "
    "round(cast({l} * 612.0 + {w} * 612.0 as double), 6) as abs_right, "
    "round(cast({t} * 792.0 + {h} * 792.0 as double), 6) as abs_bottom"
)


def _colours_sql(column: str, mapping: dict, default=None) -> str:
    parts = []
    for i, name in enumerate(("red", "green", "blue")):
        arms = " ".join(f"when '{k}' then {v[i]}" for k, v in mapping.items())
        other = "" if default is None else f" else {default[i]}"
        parts.append(f"cast(case {column} {arms}{other} end as double) as {name}")
    return ", ".join(parts)


_CLASSES = (
    "k as (select source, table_id, max(table_page) as table_page, max(table_left) as l, max(table_top) as t, max(table_width) as w, "
    "max(table_height) as h, case when max(row_index) > 6 then 'BIGRID_STACKED' when max(row_index) > 4 then 'BIGRID' "
    "when max(row_index) > 2 then 'KVP' else 'OTHER' end as table_class from grid group by source, table_id)"
)
_BOX_COLUMNS = ["abs_left", "abs_top", "abs_right", "abs_bottom", "red", "green", "blue"]


def _classed_tables(cells):
    rows = F.col("row_count")
    table_class = F.when(rows > 6, "BIGRID_STACKED").when(rows > 4, "BIGRID").when(rows > 2, "KVP").otherwise("OTHER")
    return op.table_counts(cells).withColumn("table_class", table_class)


@query(
    "annotate_tables",
    f"with {GRID}, {_CLASSES} select table_id, table_class, source, table_page, {_BOX_SQL.format(l='l', t='t', w='w', h='h')}, "
    f"{_colours_sql('table_class', fn.TABLE_COLOURS, (0.5, 0.5, 0.5))}, 2 as line_width from k where table_page between 1 and 40",
)
def _(spark, sf_dir):
    cells = fx.grid_cells(spark, sf_dir)
    boxes = op.annotate_tables(_classed_tables(cells), fx.page_sizes(cells))
    return boxes.select("table_id", "table_class", "source", "table_page", "line_width", *[_rounded(c) for c in _BOX_COLUMNS])


@query(
    "rejected_pages",
    f"with {GRID}, {_CLASSES} select source, table_id, table_page from k where not (table_page between 1 and 40)",
)
def _(spark, sf_dir):
    cells = fx.grid_cells(spark, sf_dir)
    return op.rejected_pages(_classed_tables(cells), fx.page_sizes(cells)).select(*KEY, "table_page")


_ROLE_SQL = (
    "case when row_index = 1 and column_index = 1 then 'title' when row_index = 1 then 'key' when column_index = 1 then 'y1' "
    "when cell_content = '' then 'empty' when column_index = 3 then 'comment' else 'value' end"
)
_CELL_BOX = _BOX_SQL.format(l="((column_index - 1) * 0.2)", t="((row_index % 40) * 0.02)", w="0.2", h="0.02")


def _roles(cells):
    return cells.withColumn("cell_role", F.expr(_ROLE_SQL))


@query(
    "annotate_cells",
    f"with {GRID}, c as (select *, {_ROLE_SQL} as cell_role from grid) select cell_id, cell_role, source, table_page, {_CELL_BOX}, "
    f"{_colours_sql('cell_role', fn.CELL_COLOURS)}, 1 as line_width from c where table_page between 1 and 40 and cell_role <> 'comment'",
)
def _(spark, sf_dir):
    cells = _roles(fx.grid_cells(spark, sf_dir))
    boxes = op.annotate_cells(cells, fx.page_sizes(cells))
    return boxes.select("cell_id", "cell_role", "source", "table_page", "line_width", *[_rounded(c) for c in _BOX_COLUMNS])


@query(
    "annotate_tagged_cells",
    f"with {GRID}, c as (select *, {_ROLE_SQL} as cell_role from grid), t as (select source, table_id from grid group by source, table_id "
    f"having max(row_index) > 4) select table_id, cell_id, cell_role, source, table_page, {_CELL_BOX}, "
    f"{_colours_sql('cell_role', fn.TAGGED_CELL_COLOURS, (0.75, 0.75, 0.75))}, 1 as line_width from c join t using (source, table_id) "
    "where table_page between 1 and 40",
)
def _(spark, sf_dir):
    cells = _roles(fx.grid_cells(spark, sf_dir))
    tables = op.table_counts(cells).filter("row_count > 4")
    boxes = op.annotate_tagged_cells(tables, cells, fx.page_sizes(cells))
    return boxes.select("table_id", "cell_id", "cell_role", "source", "table_page", "line_width", *[_rounded(c) for c in _BOX_COLUMNS])


# -- streaming ----------------------------------------------------------------


@query(
    "match_notifications",
    "select event_id, case when event_id % 7 = 0 then null else concat('job', cast(user_id as varchar)) end as job_id, "
    "case when event_id % 7 = 0 then null else event_type end as status, "
    "case when event_id % 7 <> 0 and user_id % 3 = 0 then 1 else 0 end as matched from events",
)
def _(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    job = F.concat(F.lit("job"), F.col("user_id").cast("string"))
    message = F.to_json(F.struct(job.alias("JobId"), F.col("event_type").alias("Status")))
    body = F.when(F.col("event_id") % 7 == 0, "not json").otherwise(F.to_json(F.struct(message.alias("Message"))))
    jobs = events.filter("user_id % 3 = 0").select(job.alias("job_id"))
    ours, others = streaming.match_notifications(events.select("event_id", body.alias("Body")), jobs)
    return (
        ours.withColumn("matched", F.lit(1))
        .unionByName(others.withColumn("matched", F.lit(0)))
        .select("event_id", "job_id", "status", "matched")
    )


_FIRST_SQL = "select distinct case when event_id % 7 = 0 then null else concat('job', cast(user_id as varchar)) end as job_id from events"


@query("first_notifications", _FIRST_SQL)
def _(spark, sf_dir):
    """Notifications taken in as a stream, every seventh unreadable; every job is reported once."""
    return _first_notifications(spark, fx.table(spark, sf_dir, "events"))


def _first_notifications(spark, events: DataFrame) -> DataFrame:
    arrived, sink, progress = (scratch_path(spark, n) for n in ("notifications", "first", "progress"))
    message = F.to_json(
        F.struct(F.concat(F.lit("job"), F.col("user_id").cast("string")).alias("JobId"), F.col("event_type").alias("Status"))
    )
    body = F.when(F.col("event_id") % 7 == 0, "not json").otherwise(F.to_json(F.struct(message.alias("Message"))))
    messages = events.select(F.lit("2024-01-01").cast("timestamp").alias("sent"), body.alias("Body"))
    src.save_dataset(messages, arrived)
    stream = streaming.decode_notifications(spark.readStream.schema(messages.schema).parquet(arrived))
    first = streaming.first_notifications(stream, "sent")
    writer = first.select("job_id").writeStream.format("parquet").option("path", sink).option("checkpointLocation", progress)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("job_id string").parquet(sink)


@query("first_notifications_of_all", _FIRST_SQL)
def _(spark, sf_dir):
    """All events on a stream, every seventh unreadable; the unreadable ones have one null id."""
    return _first_notifications(spark, fx.table(spark, sf_dir, "events"))


def _documents_a_source(spark, sf_dir, per_document: int) -> int:
    """Documents into which to deal each source's tables and titles, for about ``per_document`` of them in each."""
    tables = fx.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).cast("string").alias("source"))
    items = tables.unionByName(fx.table(spark, sf_dir, "documents").select("source"))
    found = items.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.regexp_replace("source", "^src", "")).alias("sources")).first()
    return max(1, -(-found.n // (per_document * max(1, found.sources))))


@query("stream_blocks", _BLOCK_CELLS_SQL)
def _(spark, sf_dir):
    """Documents written as files, taken in as a stream, cells read from the sink."""
    folder, sink, progress = (scratch_path(spark, n) for n in ("incoming", "cells", "progress"))
    graph = _large_documents(spark, sf_dir, 500)
    block = F.struct(*[c for c in graph.columns if c not in ("source", "name", "pos")])
    # About 500 tables a document, so a document stays a bounded group and a batch has more than its fixed cost to do.
    (
        graph.groupBy("source", F.concat_ws("-", "source", "name").alias("name"))
        .agg(F.collect_list(block).alias("b"))
        .select("source", "name", F.to_json("b").alias("value"))
        .write.partitionBy("source", "name")
        .text(folder, compression="gzip")
    )
    blocks = streaming.stream_blocks(spark, f"{folder}/*/*", files_per_batch=200, pattern=r"source=([^/]+)/")
    streaming.write_stream(blocks, sink, progress, available_now=True).awaitTermination()
    cells = spark.read.parquet(sink)
    return cells.select(*_BLOCK_CELL_COLUMNS, _rounded("cell_left"), _rounded("table_width"))


@query("stream_responses", _BLOCK_CELLS_SQL)
def _(spark, sf_dir):
    """Documents cut into numbered responses, which arrive in three micro-batches in any order; cells read from the sink."""
    folder, sink, progress = (scratch_path(spark, n) for n in ("responses", "cells", "progress"))
    graph = fx.block_graph(spark, sf_dir, layout=False)
    number = F.floor(F.substring("document", 2, 20).cast("bigint") / 500)
    # At most 500 tables a document; its blocks are dealt to twelve responses.
    graph = graph.withColumn("source", F.concat_ws("-", "source", number)).drop("document")
    block = F.struct(*[c for c in graph.columns if c not in ("source", "pos")])
    page_no = F.pmod(F.xxhash64("Id"), F.lit(12)) + 1
    pages = graph.groupBy("source", page_no.alias("page_no")).agg(F.collect_list(block).alias("Blocks"))
    numbers = Window.partitionBy("source").orderBy("page_no")
    pages = pages.withColumns({"token": F.lead("page_no").over(numbers).cast("string"), "page_no": F.row_number().over(numbers)})
    responses = cut_lineage(pages.select("source", "page_no", F.to_json(F.struct("Blocks", F.col("token").alias("NextToken"))).alias("value")), "pages")
    for turn in range(3):
        arrived = responses.filter(F.pmod(F.xxhash64("page_no", "source"), F.lit(3)) == turn)
        arrived.withColumn("arrived", F.lit(f"2024-01-01 00:0{turn}:00").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("source string, page_no int, value string, arrived timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    streaming.write_stream(streaming.stream_responses(stream), sink, progress, available_now=True).awaitTermination()
    cells = spark.read.parquet(sink).withColumn("source", F.substring_index("source", "-", 1))
    return cells.select(*_BLOCK_CELL_COLUMNS, _rounded("cell_left"), _rounded("table_width"))


@query(
    "follow_jobs",
    "select concat('job', cast(event_id as varchar)) as job_id, case when event_id % 6 = 0 then event_type end as status, "
    "case when event_id % 6 = 0 then strftime(ts + interval 1 hour, '%Y-%m-%d %H:%M:%S.%f') end as sent_at from events where event_id % 3 = 0",
)
def _(spark, sf_dir):
    """Jobs and notifications as two streams: one job in two is answered in time, one in three of the others too late."""
    asked_path, told_path, sink, progress = (scratch_path(spark, n) for n in ("jobs", "told", "followed", "progress"))
    events = fx.table(spark, sf_dir, "events").filter("event_id % 3 = 0")
    job = F.concat(F.lit("job"), F.col("event_id").cast("string")).alias("job_id")
    late = F.when(F.col("event_id") % 6 == 0, F.expr("interval 1 hour")).otherwise(F.expr("interval 3 days"))
    jobs = events.select(job, F.col("ts").cast("timestamp").alias("submitted"))
    told = events.filter("event_id % 6 = 0 or event_id % 9 = 0").select(job, F.col("event_type").alias("status"), (F.col("ts").cast("timestamp") + late).alias("sent"))
    clock = spark.sql("select 'clock' as job_id, 'tick' as status, timestamp'2030-01-01' as at")  # lets all jobs expire
    cuts = ["2000-01-01", "2024-01-11", "2024-01-21", "2029-01-01"]
    for begin, end in zip(cuts, cuts[1:]):
        for rows, at, path in ((jobs, "submitted", asked_path), (told, "sent", told_path)):
            rows.filter((F.col(at) >= begin) & (F.col(at) < end)).coalesce(1).write.mode("append").parquet(path)
    clock.select("job_id", F.col("at").alias("submitted")).write.mode("append").parquet(asked_path)
    clock.select("job_id", "status", F.col("at").alias("sent")).write.mode("append").parquet(told_path)

    def stream(rows, path):
        return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)

    followed = streaming.follow_jobs(stream(jobs, asked_path), stream(told, told_path))
    writer = followed.select("job_id", "status", F.date_format("sent", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("sent_at")).writeStream.format("parquet").option("path", sink)
    writer.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("job_id string, status string, sent_at string").parquet(sink).filter("job_id <> 'clock'")


# -- whole plans and learning -------------------------------------------------


@query(
    "prepare_documents",
    _BEST.rstrip()
    + f", {GRID}, {MERGED}, {_CAPTIONS}, u as (select source, table_id, 'CHILD' as cell_type, row_index, column_index from grid union all "
    "select source, table_id, 'MERGED_CELL', row_index, column_index from merged union all select source, table_id, cell_type, 0, 0 from caps), "
    "n as (select source, table_id, count(*) as cell_count, count(*) filter (where cell_type = 'CHILD') as child_count, "
    "count(*) filter (where cell_type = 'MERGED_CELL') as merged_cell_count, count(*) filter (where cell_type = 'TABLE_TITLE') as table_title_count, "
    "count(*) filter (where cell_type = 'TABLE_FOOTER') as table_footer_count, max(row_index) as row_count, max(column_index) as column_count "
    "from u group by source, table_id), a as (select source, table_id, max(table_page) as table_page from grid group by source, table_id) "
    "select n.*, a.table_page, r.layout_title_text from n join a using (source, table_id) "
    "left join r on r.source = a.source and r.layout_title_page = a.table_page and r.rn = 1",
)
def _(spark, sf_dir):
    from .documents import prepare_documents

    tables = prepare_documents(_graph(spark, sf_dir)).tables
    return tables.select(
        *KEY, "cell_count", "child_count", "merged_cell_count", "table_title_count", "table_footer_count",
        "row_count", "column_count", "table_page", "layout_title_text",
    )


def _titled_tables(spark, sf_dir):
    tables = op.summarize_tables(fx.grid_with_merged(spark, sf_dir))
    titled = op.attach_page_title(tables, fx.titles(spark, sf_dir), ties="first")
    rows = F.col("row_count")
    return titled.withColumn("table_class", F.when(rows > 6, "BIGRID_STACKED").when(rows > 3, "BIGRID").otherwise("KVP"))


# Labelled rows that the training queries fit classifiers on: all of the training split, like features and terms.
FIT_ROWS = None
# Rows that the queries which save or apply a model fit it on; what they report does not depend on what it has learnt.
STAND_IN_ROWS = 1000


def _scored_report(train, test, model, label, predict):
    """Classes with their support among the test rows, and whether the measures are shares."""
    scored = predict(test, model, output="prediction")
    report = op.classification_report(scored, label, "prediction")
    measured = F.lit(True)
    for name in ("precision", "recall", "f1_score"):
        measured = measured & F.col(name).between(0, 1)
    return report.filter("support > 0").select("class", "support", measured.alias("measured"))


def _support_sql(rows: str, label: str, train_percent: int) -> str:
    """Support by class of the rows that the hash split leaves for testing."""
    return (
        f"with {_ALL_CELLS}, p as (select {label} as y from {rows} where cast(concat('0x', substr(md5(table_id), 1, 8)) as bigint) % 100 >= {train_percent}), "
        "n as (select y as class, count(*) as support from p group by y union all select unnest(['accuracy', 'macro avg', 'weighted avg']), (select count(*) from p)) "
        "select class, support, true as measured from n"
    )


_TABLE_SUPPORT = _support_sql(
    "(select source, table_id, max(row_index) as row_count from cells group by source, table_id)",
    "case when row_count > 6 then 'BIGRID_STACKED' when row_count > 3 then 'BIGRID' else 'KVP' end", 75,
)


@query("train_table_classifier", _TABLE_SUPPORT)
def _(spark, sf_dir):
    train, test = op.hash_split(_titled_tables(spark, sf_dir), "table_id")
    model = op.train_table_classifier(train, fit_rows=FIT_ROWS)
    return _scored_report(train, test, model, "table_class", op.predict_table_class)


@query("train_table_classifier_grid", _TABLE_SUPPORT)
def _(spark, sf_dir):
    tables = _dealt(cut_lineage(_titled_tables(spark, sf_dir), "tables"))  # read by every step
    train, test = op.hash_split(tables, "table_id")
    model = op.train_table_classifier(train, variant="grid", fit_rows=FIT_ROWS)
    return _scored_report(train, test, model, "table_class", op.predict_table_class)


def _cells_with_context(spark, sf_dir):
    cells = _roles(fx.grid_cells(spark, sf_dir))
    from .documents import cell_features

    return cell_features(cells, _classed_tables(fx.grid_cells(spark, sf_dir)))


_NEAR_TERMS = (
    "near as (select a.cell_id, unnest(regexp_extract_all(lower({texts}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as term "
    "from g a join g b on a.source = b.source and a.table_id = b.table_id and {near})"
)
_AROUND = "((a.column_index = b.column_index and a.row_index <> b.row_index) or (a.row_index = b.row_index and a.column_index <> b.column_index))"


def _context_sql(own: bool) -> str:
    """TF-IDF rows of the cells' contexts by a self-join of each table."""
    around = _AROUND + (" or a.cell_id = b.cell_id" if own else "")
    texts = "case when a.cell_id = b.cell_id then b.cell_content else b.txt end" if own else "b.txt"
    near = _NEAR_TERMS.format(texts=texts, near=f"({around})")
    stats = _STATS.replace("toks", "near").replace("doc_id", "cell_id")
    vocabulary = _VOCABULARY.format(k=1000).replace("from documents", "from g")
    weights = _WEIGHTS.replace("toks", "near").replace("doc_id", "cell_id")
    return (
        f"{_TEXTS}, {near}, {stats}, {vocabulary}, {weights} "
        "select cell_id, term, round(x / size, 6) as weight from raw join norm using (cell_id)"
    )


def _context_weights(spark, sf_dir, own: str):
    cells = fx.grid_cells(spark, sf_dir).select(*KEY, "cell_id", "cell_type", "cell_words", "cell_content", "row_index", "column_index")
    cells = op.store_tables(cells)  # read by every step
    vocabulary = op.fit_context_tfidf(cells, 1000, own)
    weights = {r.term: r.idf for r in vocabulary.collect()}
    terms = list(weights)
    counted = op.ContextBags(terms=terms, own=own, outputCol="counts").transform(cells)
    weighted = ElementwiseProduct(inputCol="counts", outputCol="raw", scalingVec=Vectors.dense(list(weights.values()))).transform(counted)
    unit = Normalizer(inputCol="raw", outputCol="tfidf", p=2.0).transform(weighted)
    return op.weights_long(unit, vocabulary, "cell_id").withColumn("weight", F.round("weight", 6))


@query("context_weights", _context_sql(False))
def _(spark, sf_dir):
    """Weights of the terms around each cell, from bags of columns and rows."""
    return _context_weights(spark, sf_dir, "")


@query("context_weights_all_text", _context_sql(True))
def _(spark, sf_dir):
    return _context_weights(spark, sf_dir, "cell_content")


def _cells_with_class(spark, sf_dir):
    """Cells without neighbour lists; their contexts are added up from bags."""
    return op.attach_table_class(_roles(fx.grid_cells(spark, sf_dir)), _classed_tables(fx.grid_cells(spark, sf_dir)))


def _stored_cells_with_class(spark, sf_dir):
    """The columns of the cells that roles are learnt from, stored: training and scoring read them several times."""
    read = [*KEY, "cell_id", "cell_type", "row_index", "column_index", "cell_words", "cell_content", "table_class", "cell_role"]
    return op.store_tables(_cells_with_class(spark, sf_dir).select(*read))


@query("train_cell_classifier", _support_sql("grid", _ROLE_SQL, 75))
def _(spark, sf_dir):
    train, test = op.hash_split(_cells_with_context(spark, sf_dir), "table_id")
    model = op.train_cell_classifier(train, fit_rows=FIT_ROWS)
    return _scored_report(train, test, model, "cell_role", op.predict_cell_role)


@query("train_cell_role_svm", _support_sql("grid", _ROLE_SQL, 80))
def _(spark, sf_dir):
    train, test = op.hash_split(_stored_cells_with_class(spark, sf_dir), "table_id", 80)
    model = op.train_cell_role_svm(train, fit_rows=FIT_ROWS)
    return _scored_report(train, test, model, "cell_role", op.predict_cell_role)


@query("train_cell_role_svm_all_text", _support_sql("grid", _ROLE_SQL, 80))
def _(spark, sf_dir):
    train, test = op.hash_split(_stored_cells_with_class(spark, sf_dir), "table_id", 80)
    model = op.train_cell_role_svm(train, text="all", fit_rows=FIT_ROWS)
    return _scored_report(train, test, model, "cell_role", op.predict_cell_role)


@query(
    "reload_models",
    f"with {_ALL_CELLS} select 'tables' as model, count(*) as scored, cast(0 as bigint) as differing from (select distinct source, table_id from cells) "
    "union all select 'cells', count(*), 0 from cells where cell_type = 'CHILD'",
)
def _(spark, sf_dir):
    """Scores before a model is saved and after it is loaded again: none differ."""
    tables = cut_lineage(_titled_tables(spark, sf_dir), "tables")
    cells = cut_lineage(_roles(_cells_with_size(spark, sf_dir)), "cells")
    kinds = (
        ("tables", tables, op.train_table_classifier(tables, trees=10, depth=8, fit_rows=STAND_IN_ROWS), op.predict_table_class, ["source", "table_id"]),
        ("cells", cells, op.train_cell_classifier(cells, trees=10, depth=8, fit_rows=STAND_IN_ROWS), op.predict_cell_role, ["source", "cell_id"]),
    )
    out = None
    for name, rows, model, predict, key in kinds:
        path = scratch_path(spark, "model")
        op.save_model(model, path)
        scored = predict(predict(rows, model, output="before"), op.load_model(path), output="after")
        row = _pairs_that_differ(scored, key, _labels(model)).select(F.lit(name).alias("model"), "scored", "differing")
        out = row if out is None else out.unionByName(row)
    return out


def _labels(model) -> list[str]:
    return next(s for s in reversed(model.stages) if isinstance(s, IndexToString)).getLabels()


def _pairs_that_differ(scored: DataFrame, key: list[str], labels: list[str]) -> DataFrame:
    """Over all pairs of a row scored before and one scored after under the same key: how many, and how many differ.

    A key's pairs are the square of its rows, those that agree the sum over labels of rows before times rows after.
    """
    known = functools.reduce(Column.__and__, [F.col(c).isNotNull() for c in key])
    held = lambda side, label: F.count(F.when(F.col(side) == label, 1))
    counts = [held(side, label).alias(f"{side}_{i}") for side in ("before", "after") for i, label in enumerate(labels)]
    keyed = scored.filter(known).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *counts)
    alike = functools.reduce(Column.__add__, [F.col(f"before_{i}") * F.col(f"after_{i}") for i in range(len(labels))])
    pairs = F.col("n") * F.col("n")
    return keyed.agg(F.coalesce(F.sum(pairs), F.lit(0)).alias("scored"), F.coalesce(F.sum(pairs - alike), F.lit(0)).alias("differing"))


def _cells_with_size(spark, sf_dir) -> DataFrame:
    """Cells with the class and size of their table."""
    return op.attach_table_class(fx.grid_cells(spark, sf_dir), _classed_tables(fx.grid_cells(spark, sf_dir)))


@query(
    "score_documents",
    f"with {GRID}, {_CLASSES}, b as (select source, table_id, table_page, {_BOX_SQL.format(l='l', t='t', w='w', h='h')} from k where table_page between 1 and 40) "
    "select b.*, n.cells from b join (select source, table_id, count(*) as cells from grid group by source, table_id) n using (source, table_id)",
)
def _(spark, sf_dir):
    """From blocks to boxes: documents prepared, tables and cells scored, the boxes of both drawn up; one row for each table with a box."""
    from .documents import prepare_documents, score_cells, score_tables

    documents = prepare_documents(_graph(spark, sf_dir))
    rows = F.col("row_count")
    tables = documents.tables.withColumn("table_class", F.when(rows > 6, "BIGRID_STACKED").when(rows > 3, "BIGRID").otherwise("KVP"))
    table_model = op.train_table_classifier(tables, trees=10, depth=8, fit_rows=STAND_IN_ROWS)
    tagged = _roles(op.attach_table_class(documents.cells.filter("cell_type = 'CHILD'"), tables))
    cell_model = op.train_cell_classifier(tagged, trees=10, depth=8, fit_rows=STAND_IN_ROWS)
    sizes = fx.page_sizes(documents.cells.select("source", "table_page"))
    boxes = op.annotate_tables(score_tables(documents, table_model), sizes)
    scored = score_cells(documents, table_model, cell_model).filter("cell_type = 'CHILD' and cell_role is not null")
    counts = scored.groupBy(*KEY).agg(F.count(F.lit(1)).alias("cells"))
    places = ["abs_left", "abs_top", "abs_right", "abs_bottom"]
    return boxes.join(counts, KEY).select(*KEY, "table_page", *[_rounded(c) for c in places], "cells")


# Tables with their titles' texts that a task holds; stored, equal texts take next to no room, so file sizes do not tell.
TABLES_PER_TASK = 20_000


def _dealt(tables: DataFrame) -> DataFrame:
    """The rows of a stored table in partitions of about ``TABLES_PER_TASK``, which adaptive execution does not merge.

    Where its files lie in as many partitions already, they stay as they are.
    """
    tasks = -(-tables.count() // TABLES_PER_TASK)
    return tables if tasks <= tables.rdd.getNumPartitions() else tables.repartition(tasks, *KEY)


@query("cluster_tables")
def _(spark, sf_dir):
    clustered, _ = op.cluster_tables(_titled_tables(spark, sf_dir), stop_words=_STOP)
    return clustered.select(*KEY, "cluster_weighted")


@query("silhouette_scores")
def _(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings").select(array_to_vector("embedding").alias("features"))
    return op.silhouette_scores(vectors)


def _silhouette_sql(cluster: str, name: str) -> str:
    """The silhouette of the clusters that an expression gives, from per-cluster sums."""
    return (
        f"select '{name}' as clusters, silhouette from ("
        f"with e as (select vec_id, {cluster} as label, embedding from embeddings), "
        "x as (select vec_id, label, cast(unnest(embedding) as double) as v, generate_subscripts(embedding, 1) as i from e where label is not null), "
        "s as (select label, i, sum(v) as total from x group by label, i), q as (select label, sum(v * v) as squares from x group by label), "
        "n as (select label, count(*) as n from e where label is not null group by label), "
        "p as (select vec_id, label, sum(v * v) as own from x group by vec_id, label), "
        "d as (select x.vec_id, s.label as other, sum(x.v * s.total) as dot from x join s using (i) group by x.vec_id, s.label), "
        "m as (select p.vec_id, p.label, d.other, n.n, p.own + q.squares / n.n - 2 * d.dot / n.n as far from p join d using (vec_id) "
        "join q on q.label = d.other join n on n.label = d.other), "
        "ab as (select vec_id, max(case when label = other then n end) as n, max(case when label = other and n > 1 then far * n / (n - 1) end) as a, "
        "min(case when label <> other then far end) as b from m group by vec_id) "
        "select round(avg(case when n = 1 then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from ab)"
    )


@query(
    "silhouettes_of_assignments",
    " union all ".join(_silhouette_sql(c, n) for n, c in (("label", "label"), ("fifths", "vec_id % 5"), ("some", "case when vec_id % 3 > 0 then vec_id % 7 end"))),
)
def _(spark, sf_dir):
    """Several given assignments of the same vectors, scored in one scan."""
    number = F.col("vec_id").cast("int")
    vectors = fx.table(spark, sf_dir, "embeddings").select(
        array_to_vector("embedding").alias("features"),
        F.col("label"),
        (number % 5).alias("fifths"),
        F.when(number % 3 > 0, number % 7).alias("some"),
    )
    return op.silhouettes(vectors, ["label", "fifths", "some"]).withColumn("silhouette", F.round("silhouette", 6))


@query("silhouette_scores_of_tables")
def _(spark, sf_dir):
    """The choice of the number of clusters on the features that tables are clustered by."""
    tables = _dealt(cut_lineage(_titled_tables(spark, sf_dir), "tables"))
    features = op.cluster_features(tables, stop_words=_STOP).transform(tables).select("features")
    return op.silhouette_scores(features)


@query(
    "silhouette_of_labels",
    "with x as (select vec_id, label, cast(unnest(embedding) as double) as v, generate_subscripts(embedding, 1) as i from embeddings "
    "where label is not null), "
    "s as (select label, i, sum(v) as total from x group by label, i), q as (select label, sum(v * v) as squares from x group by label), "
    "n as (select label, count(*) as n from embeddings where label is not null group by label), "
    "p as (select vec_id, label, sum(v * v) as own from x group by vec_id, label), "
    "d as (select x.vec_id, s.label as other, sum(x.v * s.total) as dot from x join s using (i) group by x.vec_id, s.label), "
    "m as (select p.vec_id, p.label, d.other, n.n, p.own + q.squares / n.n - 2 * d.dot / n.n as far from p join d using (vec_id) "
    "join q on q.label = d.other join n on n.label = d.other), "
    "ab as (select vec_id, max(case when label = other then n end) as n, max(case when label = other and n > 1 then far * n / (n - 1) end) as a, "
    "min(case when label <> other then far end) as b from m group by vec_id) "
    "select round(avg(case when n = 1 then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from ab",
)
def _(spark, sf_dir):
    """The silhouette of given clusters: the labels of the vectors."""
    vectors = fx.table(spark, sf_dir, "embeddings").filter("label is not null")
    clustered = vectors.select(array_to_vector("embedding").alias("features"), F.col("label").cast("int").alias("cluster"))
    return spark.createDataFrame([(round(op.silhouette(clustered), 6),)], "silhouette double")
