"""Blocks stored once in buckets: what the plans of the block joins hold, and keys that repeat."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from blockframe import operators as op
from blockframe import sources as src
from blockframe.plans import fixtures as fx


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def graph(spark, sf_dir):
    return fx.block_graph(spark, sf_dir).drop("document")


def test_repeated_ids_are_removed_once(spark, graph, monkeypatch):
    stored = []
    keep = src.blocks.dedupe_blocks
    monkeypatch.setattr(src.blocks, "dedupe_blocks", lambda *a: stored.append(1) or keep(*a))
    cells = op.cells_from_blocks(graph)
    assert stored == [1]
    assert "row_number" not in plan(cells) and "Window" not in plan(cells)


def test_stored_blocks_are_not_shuffled(spark, graph, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        blocks = src.store_blocks(graph)
        text = executed(op.table_cells(blocks).select("cell_id", "row_index"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = text.split("== Initial Plan ==")[0]
    # One exchange, of the ids that tables list; the blocks come from their buckets.
    assert final.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in final


def test_ids_listed_often_and_ids_that_repeat(spark):
    relation = "array<struct<Type:string,Ids:array<string>>>"
    box = "struct<BoundingBox:struct<Width:double,Height:double,Left:double,Top:double>>"
    rows = [("s", 0, "t", "TABLE", None, [("CHILD", ["c"] * 500 + ["d", None, "gone"])], None, None)]
    rows += [("s", 1, "c", "CELL", None, [("CHILD", ["w"] * 3 + ["v"])], 1, 1), ("s", 2, "d", "CELL", None, None, 2, 1)]
    rows += [("s", 3 + i, "w", "WORD", f"copy{i}", None, None, None) for i in range(300)] + [("s", 400, "v", "WORD", "", None, None, None)]
    rows += [(None, 0, "t", "TABLE", None, [("CHILD", ["c"])], None, None), ("s", 5, None, "WORD", "nameless", None, None, None)]
    blocks = spark.createDataFrame(
        rows, f"source string, pos long, Id string, BlockType string, Text string, Relationships {relation}, RowIndex int, ColumnIndex int"
    ).withColumns({"Geometry": F.lit(None).cast(box), "Page": F.lit(1), "EntityTypes": F.lit(None).cast("array<string>"), "RowSpan": F.lit(None).cast("int"), "ColumnSpan": F.lit(None).cast("int")})
    cells = op.cells_from_blocks(blocks).groupBy("cell_id", "cell_words").count().collect()
    assert {(r.cell_id, tuple(r.cell_words), r["count"]) for r in cells} == {("c", ("copy299", "copy299", "copy299", ""), 500), ("d", (), 1)}
    assert op.cells_from_blocks(blocks.limit(0)).count() == 0


def test_table_has_the_blocks_and_one_column_more(spark, graph):
    stored = src.store_blocks(graph, dedupe=False)
    assert stored.columns == [*graph.columns, "block_key"]
    names = ["source", "Id", "pos", "BlockType", "Text", "Page"]
    assert stored.select(*names).exceptAll(graph.select(*names)).isEmpty() and stored.count() == graph.count()
