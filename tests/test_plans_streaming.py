"""Whole plans, streams, and the registered queries."""

import shutil

from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from blockframe import operators as op
from blockframe import plans, sources, streaming
from blockframe.plans import queries as q
from blockframe.session import scratch_path

CELL = ["source", "table_id", "cell_id", "cell_type", "cell_content", "row_index", "column_index"]


def test_entry_and_registry(spark):
    rows = entry_module.entry(spark)
    assert rows.columns[:3] == ["source", "table_id", "cell_id"] and rows.count() == 24_000
    names, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(names) and len(oracles) >= 75


def test_documents_are_prepared_and_scored(spark, data):
    blocks = sources.read_blocks(spark, [data("overlap"), data("ties"), data("titlefooter")])
    documents = plans.prepare_documents(blocks)
    tables = {r.source: r for r in documents.tables.collect()}
    assert tables["ties.json"].layout_title_text == "First title"
    assert tables["overlap.json"].layout_title_text is None
    labelled = documents.tables.withColumn("table_class", F.when(F.col("row_count") > 1, "BIGRID").otherwise("KVP"))
    table_model = op.train_table_classifier(labelled, trees=3, depth=3)
    featured = plans.cell_features(documents.cells, labelled).withColumn(
        "cell_role", F.when(F.col("row_index") == 1, "key").otherwise("value")
    )
    cell_model = op.train_cell_classifier(featured, trees=3, depth=3)
    scored = plans.score_cells(documents, table_model, cell_model)
    assert scored.count() == documents.cells.count()
    boxes = op.cell_predictions(scored)
    assert {r.cell_role for r in boxes.select("cell_role").distinct().collect()} <= {"key", "value"}
    context = {r.cell_id: r.words_above for r in featured.filter("source = 'overlap.json'").collect()}
    assert context["c21"] == ["a"] and context["c11"] == [] and context["m1"] is None


def test_stream_equals_batch_and_takes_new_files(spark, data, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    sink, progress = scratch_path(spark, "sink"), scratch_path(spark, "progress")
    names = ["overlap", "selection", "dangling", "titlefooter"]

    def run():
        blocks = streaming.stream_blocks(spark, str(folder), files_per_batch=1)
        streaming.write_stream(blocks, sink, progress, available_now=True).awaitTermination()

    for name in names[:2]:
        shutil.copy(data(name), folder)
    run()
    for name in names[2:]:
        shutil.copy(data(name), folder)
    run()
    streamed = spark.read.parquet(sink)
    batch = streaming.batch_cells(sources.read_blocks(spark, [data(n) for n in names]))
    assert sorted(streamed.select(*CELL).collect()) == sorted(batch.select(*CELL).collect())
    assert streamed.select("batch").distinct().count() == 4


def test_notifications(spark):
    body = '{"Message": "{\\"JobId\\": \\"j1\\", \\"Status\\": \\"SUCCEEDED\\"}"}'
    messages = spark.createDataFrame([(1, body), (2, body.replace("j1", "j2")), (3, "junk")], "n int, Body string")
    ours, others = streaming.match_notifications(messages, spark.createDataFrame([("j1",), ("j1",)], "job_id string"))
    assert [(r.n, r.status) for r in ours.collect()] == [(1, "SUCCEEDED")]
    assert sorted(r.n for r in others.collect()) == [2, 3]


def test_repeated_notifications_on_a_stream(spark, tmp_path):
    rows = [(1, "j1", 0), (2, "j1", 60), (3, "j2", 90)]
    df = spark.createDataFrame(rows, "n int, job_id string, s long").withColumn("at", F.timestamp_seconds("s"))
    path = str(tmp_path / "events")
    df.coalesce(1).write.parquet(path)
    stream = streaming.first_notifications(spark.readStream.schema(df.schema).parquet(path), "at")
    writer = stream.writeStream.format("memory").queryName("first_jobs").trigger(availableNow=True)
    writer.option("checkpointLocation", str(tmp_path / "progress")).start().awaitTermination()
    assert sorted(r.job_id for r in spark.table("first_jobs").collect()) == ["j1", "j2"]


def test_graph_round_trip_gives_the_grid(spark, sf_dir):
    from blockframe.plans import fixtures as fx

    blocks = fx.block_graph(spark, sf_dir, layout=False).drop("document")
    cells = op.normalize_indices(op.cells_from_blocks(blocks, dedupe=False)).filter("cell_type = 'CHILD'")
    columns = [*q.KEY, "cell_id", "cell_content", "row_index", "column_index", "entity_type", "cell_words"]
    grid = fx.grid_cells(spark, sf_dir).select(*columns)
    assert cells.select(*columns).exceptAll(grid).isEmpty() and cells.count() == grid.count()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from blockframe import session

    conf = SimpleNamespace(get=lambda key, default=None: default)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        with pytest.raises(ValueError):
            session.shared_folder(SimpleNamespace(conf=conf, sparkContext=context))


def test_shared_folder_follows_the_setting(spark):
    from blockframe import session

    folder = session.shared_folder(spark)
    assert folder == session.shared_folder(spark) and folder
    named = {"spark.checkpoint.dir": "/shared/stages"}

    class Conf:
        def get(self, key, default=None):
            return named.get(key, default)

    class Session:
        conf = Conf()

    assert session.scratch_path(Session(), "x").startswith("/shared/stages/x-")


def test_queries_over_all_words_and_events(spark, sf_dir):
    """Words of table titles and footers, and unreadable notifications, are in."""
    from blockframe.plans import queries as q

    for name in ("dedupe_all_words", "save_and_load_all_words"):
        ids = [r.block_id for r in q.QUERIES[name](spark, sf_dir).select("block_id").collect()]
        assert len(ids) == len(set(ids)) and any(i.startswith("tt") for i in ids) and any(i.startswith("tf") for i in ids)
    jobs = [r.job_id for r in q.QUERIES["first_notifications_of_all"](spark, sf_dir).collect()]
    assert None in jobs and len(jobs) == len(set(jobs))
