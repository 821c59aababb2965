"""What operators write and shuffle: compressed files, bounded partitions, narrow stored blocks."""

from __future__ import annotations

import gzip
import re

from pyspark.sql import functions as F

from blockframe import operators as op
from blockframe import sources as src
from blockframe import streaming
from blockframe.operators.extract import looked_up
from blockframe.plans import fixtures as fx
from blockframe.plans import queries
from blockframe.sources.schema import BLOCK


def _blocks(spark, ids):
    return spark.createDataFrame([("s", i, f"b{i}", "WORD", f"text {i}") for i in ids], "source string, pos long, Id string, BlockType string, Text string")


def test_saved_blocks_are_compressed_in_bounded_files(spark, tmp_path):
    blocks = _blocks(spark, range(95)).coalesce(1)
    src.save_blocks(blocks, str(tmp_path / "saved"), rows_per_file=10)
    files = list((tmp_path / "saved").glob("*.json.gz"))
    assert len(files) == 10 and max(len(gzip.open(f).readlines()) for f in files) == 10
    loaded = src.load_blocks(spark, str(tmp_path / "saved")).select(*blocks.columns)
    assert sorted(map(tuple, loaded.collect())) == sorted(map(tuple, blocks.collect()))


def test_partitions_of_the_grid_are_bounded(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(fx, "LINES_PER_TASK", 500)
    cells = fx.grid_cells(spark, sf_dir)
    largest = cells.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    total = cells.count()
    assert cells.rdd.getNumPartitions() == -(-total // 4 // 500) and largest < 2 * 4 * 500


def test_rows_of_a_tied_title_come_together(spark):
    tables = spark.createDataFrame([("s", f"t{i}", 1) for i in range(40)] + [("s", "none", 2), (None, "nowhere", 1)], "source string, table_id string, table_page int")
    titles = [("s", f"ti{i}", 1, 0.9, f"title {i}") for i in range(5)] + [("s", "low", 1, 0.1, "low")]
    titles = spark.createDataFrame(titles, "source string, layout_title_id string, layout_title_page int, layout_title_confidence double, layout_title_text string")
    rows = op.attach_page_title(tables, titles).collect()
    texts = [r.layout_title_text for r in rows if r.layout_title_text]
    assert sum(a != b for a, b in zip(texts, texts[1:])) == 4
    assert {(r.table_id, r.layout_title_text) for r in rows} == {(f"t{i}", f"title {j}") for i in range(40) for j in range(5)} | {("none", None), ("nowhere", None)}
    assert len(rows) == 202 and rows[0].asDict().keys() == {"source", "table_page", "table_id", "layout_title_text"}


def _stored(spark, monkeypatch):
    """The tables that ``store_blocks`` writes from now on."""
    tables, store = [], src.blocks.store_blocks

    def keep(*given, **options):
        tables.append(store(*given, **options))
        return tables[-1]

    monkeypatch.setattr("blockframe.operators.extract.store_blocks", keep)
    monkeypatch.setattr(src, "store_blocks", keep)
    return tables


def test_stored_blocks_hold_what_cells_are_made_of(spark, sf_dir, monkeypatch):
    tables = _stored(spark, monkeypatch)
    blocks = fx.block_graph(spark, sf_dir).drop("document")
    cells = op.cells_from_blocks(blocks)
    assert {f.name for f in BLOCK.fields} - set(tables[0].columns) == {"Confidence", "Query"}
    assert tables[0].schema["Geometry"].dataType.fieldNames() == ["BoundingBox"]
    assert cells.count() == op.cells_from_blocks(blocks, dedupe=False).count()


def test_title_texts_come_from_the_buckets(spark, sf_dir):
    stored = src.store_blocks(fx.block_graph(spark, sf_dir).drop("document"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        titles = op.layout_titles(stored)
        titles.collect()
        final = titles._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in final


def test_decoded_documents_are_stored_once(spark, sf_dir, monkeypatch):
    tables = _stored(spark, monkeypatch)
    cells = queries.QUERIES["decode_documents"](spark, sf_dir)
    assert len(tables) == 1 and "from_json" not in cells._jdf.queryExecution().optimizedPlan().toString()


def test_compressed_result_files_are_read(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write('[{"Id": "a", "BlockType": "PAGE"},\n {"Id": "b", "BlockType": "LINE"}]')
    assert [r.Id for r in src.read_blocks(spark, str(tmp_path)).orderBy("pos").collect()] == ["a", "b"]


def test_streamed_documents_have_about_500_tables(spark, sf_dir):
    assert queries._documents_a_source(spark, sf_dir, 500) == 1
    assert queries._documents_a_source(spark, "/root/testdata/sf0.1", 500) == 16


def test_cells_of_a_batch_are_made_without_keeping_it(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.persist", lambda self, *a: kept.append(1) or self)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('[{"Id": "a", "BlockType": "PAGE"}]')
    blocks = streaming.stream_blocks(spark, str(tmp_path / "in"))
    streaming.write_stream(blocks, str(tmp_path / "out"), str(tmp_path / "c1"), available_now=True).awaitTermination()
    assert not kept
    streaming.write_stream(blocks, str(tmp_path / "out2"), str(tmp_path / "c2"), transform=lambda b: b, available_now=True).awaitTermination()
    assert kept


def test_responses_are_made_in_partitions_of_bounded_size(spark, sf_dir, monkeypatch):
    """Both sorts of ``decode_responses`` are over as many partitions as the blocks ask for; the rows stay the same."""
    from blockframe.plans import queries

    few = queries.QUERIES["decode_responses"](spark, sf_dir).select("source", "block_id", "place", "document_pages")
    monkeypatch.setattr(queries, "BLOCKS_PER_TASK", 9_000)
    many = queries.QUERIES["decode_responses"](spark, sf_dir)
    tasks = queries._block_tasks(spark, sf_dir)
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert many._jdf.queryExecution().executedPlan().toString().count(f", {tasks}), REPARTITION_BY_NUM") == 2
    assert few.exceptAll(many).isEmpty() and few.count() == many.count()


def test_tables_and_pairs_read_twice_are_stored(spark, sf_dir):
    """What a query reads more than once comes from a stored copy, not from the lines again."""
    for name in ("encode_entities", "pad_and_flatten_grid", "merged_text"):
        asked = queries.QUERIES[name](spark, sf_dir)
        assert not any("lineitem" in f for f in asked.inputFiles()), name
        assert asked.count() > 0


def test_titled_tables_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """Stored tables whose titles repeat are small files of many rows; they are read in partitions of bounded rows."""
    monkeypatch.setattr(queries, "TABLES_PER_TASK", 100)
    rows = spark.range(2_000).selectExpr("'s' as source", "concat('t', id) as table_id", "repeat('long title ', 500) as layout_title_text")
    rows.coalesce(1).write.parquet(str(tmp_path / "tables"))
    stored = spark.read.parquet(str(tmp_path / "tables"))
    assert stored.rdd.getNumPartitions() == 1
    sizes = [r["count"] for r in queries._dealt(stored).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and sum(sizes) == 2_000 and max(sizes) < 200
    monkeypatch.setattr(queries, "TABLES_PER_TASK", 2_000)
    assert queries._dealt(stored) is stored


def test_csv_is_compressed_in_bounded_files(spark, tmp_path):
    rows = spark.range(95).select(F.concat(F.lit('line\n"'), F.col("id").cast("string")).alias("text"), F.array("id").alias("nested")).coalesce(1)
    src.write_csv(rows, str(tmp_path / "csv"), rows_per_file=10)
    assert len(list((tmp_path / "csv").glob("*.csv.gz"))) == 10
    assert sorted(map(tuple, src.read_csv(spark, str(tmp_path / "csv"), rows.schema).collect())) == sorted(map(tuple, rows.collect()))



def test_kinds_of_blocks_share_the_shuffles_of_the_lines(spark, sf_dir):
    """Shuffles of the lines are made once where all that is read, and how it is cut, is the same."""
    plan = fx.block_graph(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"FileScan parquet \[(l_orderkey.*?)\].*?DataFilters: (\[.*?\]), Format", re.sub(r"#\d+L?", "", plan))
    assert len(read) == 3 and len(set(read)) == 1



def test_hashes_of_ids_are_not_shuffled(spark, sf_dir):
    """Ids meet the stored blocks in their buckets, which are not shuffled either; the shuffle moves no hash."""
    blocks = src.store_blocks(fx.block_graph(spark, sf_dir).drop("document"))
    ids = spark.createDataFrame([(f"src{i % 20}", f"t{i}") for i in range(50)], "source string, Id string")
    plan = looked_up(ids, blocks.hint("merge"), "BlockType")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(xxhash64(source" in plan


def test_large_documents_hold_many_tables(spark, sf_dir):
    """Each source's tables and titles are dealt to as few documents as their number asks for."""
    documents = queries._large_documents(spark, sf_dir, 500).groupBy("source").agg(F.count_distinct("name").alias("n")).collect()
    assert {r.n for r in documents} == {1}
