"""What a plan makes once, and what it does not carry through a shuffle."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from blockframe.operators import block_edges, cell_words, neighbour_words, summarize_tables
from blockframe.plans import queries
from blockframe.sources.schema import BLOCK


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def blocks(spark):
    rows = [
        ("s", 0, "c1", "CELL", None, [("CHILD", ["w2", "w1", "gone"]), ("OTHER", [])]),
        ("s", 1, "c2", "CELL", None, []),
        ("s", 2, "c3", "CELL", None, None),
        ("s", 3, "w1", "WORD", "one", None),
        ("s", 4, "w2", "WORD", "two", None),
    ]
    schema = "source string, pos long, Id string, BlockType string, Text string, Relationships array<struct<Type:string,Ids:array<string>>>"
    given = spark.createDataFrame(rows, schema)
    return given.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in BLOCK.fields if f.name not in given.columns])


def test_lists_of_edges_are_not_made_for_their_size(blocks):
    made = blocks.withColumn("Relationships", F.transform("Relationships", lambda r: r))
    edges = block_edges(made)
    assert "size(" not in _plan(edges)
    found = {(r.parent_id, r.rel_pos, r.id_pos, r.child_id) for r in edges.collect()}
    assert found == {("c1", 0, 0, "w2"), ("c1", 0, 1, "w1"), ("c1", 0, 2, "gone")}


def test_words_of_blocks_that_are_not_stored_are_shuffled_without_a_hash(blocks):
    words = cell_words(blocks)
    assert "xxhash64" not in _plan(words)
    assert [(r.cell_id, r.cell_words) for r in words.collect()] == [("c1", ["two", "one"])]


def test_earlier_copies_come_from_one_reading(spark, blocks):
    both = queries._with_earlier_copies(blocks)
    assert "Union" not in _plan(both)
    assert {(r.Text, r.pos) for r in both.filter("Id = 'w1'").collect()} == {("one", 3), ("stale", 3 - (1 << 40))}


def test_lists_of_columns_join_last(spark):
    cells = spark.range(60).select(
        F.lit("s").alias("source"), F.lit("t").alias("table_id"), F.lit("CHILD").alias("cell_type"), F.col("id").cast("string").alias("cell_id"),
        F.array(F.col("id").cast("string")).alias("cell_words"), (F.col("id") / 2).cast("int").alias("row_index"), (F.col("id") % 2).cast("int").alias("column_index"),
    )
    near = neighbour_words(cells, hot_rows=20)
    assert "column_index" in [line for line in _plan(near).splitlines() if "Join LeftOuter" in line][0]
    row = near.filter("cell_id = '5'").first()
    assert (row.words_above, row.words_left, row.words_right) == (["1", "3"], ["4"], [])


def test_table_contents_are_sorted_without_a_comparator(spark):
    cells = spark.createDataFrame(
        [("s", "t", "CHILD", "b", None, ["x"], 1, 2), ("s", "t", "CHILD", "a", "HEAD", ["y"], 1, 1)],
        "source string, table_id string, cell_type string, cell_id string, entity_type string, cell_words array<string>, row_index int, column_index int",
    )
    numbers = ("table_width", "table_height", "table_left", "table_top", "table_page")
    tables = summarize_tables(cells.withColumns({**{c: F.lit(1) for c in numbers}, "table_type": F.lit("T")}))
    assert "array_sort" not in _plan(tables)
    assert [(r.content, r.entities) for r in tables.collect()] == [([[["y"], ["x"]]], [["HEAD", "normal"]])]
