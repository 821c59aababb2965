"""Streams with state: documents in parts, and jobs that wait for their notification."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from blockframe import sources as src
from blockframe import streaming
from blockframe.session import scratch_path

START = datetime(2024, 1, 1)


def run(spark, batches, schema, query):
    """Feed one file for each micro-batch; gives the rows in the order of batches."""
    folder, sink, progress = (scratch_path(spark, n) for n in ("in", "out", "progress"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = query(stream)
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink).collect()


def response(number, last, ids):
    value = {"Blocks": [{"Id": i, "BlockType": "WORD", "Text": i} for i in ids], "DocumentMetadata": {"Pages": 1}}
    return json.dumps(value if number == last else value | {"NextToken": str(number + 1)})


SCHEMA = "source string, page_no long, value string, arrived timestamp"


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_document_in_parts(spark):
    r = lambda doc, n, last, minutes: (doc, n, response(n, last, [f"{doc}{n}x", f"{doc}{n}y"]), at(minutes))
    batches = [
        [r("a", 3, 3, 0), r("b", 1, 1, 0), r("c", 1, 3, 0), (None, 1, response(1, 1, ["n"]), at(0)), ("e", None, response(1, 1, ["m"]), at(0))],
        [r("a", 1, 3, 5), r("b", 1, 1, 5), r("d", 2, 2, 5)],
        [r("a", 2, 3, 9), r("a", 3, 3, 9), r("c", 1, 3, 9)],
        [r("d", 1, 2, 12), r("a", 2, 3, 12)],
        [r("z", 1, 1, 500)],
        [r("z", 1, 1, 501)],
    ]
    got = run(spark, batches, SCHEMA, lambda s: streaming.complete_responses(s, wait_seconds=3600, delay="1 minute"))
    found = sorted((r.source or "", r.page_no or 0, r.complete) for r in got)
    assert found == [("", 1, False), ("a", 1, True), ("a", 2, True), ("a", 3, True), ("b", 1, True), ("c", 1, False), ("d", 1, True), ("d", 2, True), ("e", 0, False), ("z", 1, True)]
    assert next(r.value for r in got if r.source == "a" and r.page_no == 2) == response(2, 3, ["a2x", "a2y"])


def test_blocks_equal_the_batch_result(spark):
    docs = {d: [(n, response(n, last, [f"{d}-{n}-{i}" for i in range(3)])) for n in range(1, last + 1)] for d, last in (("p", 4), ("q", 1), ("r", 7))}
    rows = [(d, n, v, at(n)) for d, parts in docs.items() for n, v in parts]
    batches = [rows[i::3] for i in range(3)]
    got = run(spark, batches, SCHEMA, lambda s: streaming.stream_responses(s).select("source", "pos", "Id", "document_pages"))
    whole = src.decode_responses(spark.createDataFrame(rows, SCHEMA)).select("source", "pos", "Id", "document_pages").collect()
    assert sorted(got) == sorted(whole) and len(whole) == 36


def test_jobs_and_notifications(spark):
    """Answered, answered twice, late, never; without id or time."""
    jobs = [[("j1", at(0)), ("j2", at(1)), ("j3", at(2)), ("j4", at(3)), (None, at(3)), ("j5", None)], [("j6", at(60))], [("clock", at(10_000))]]
    told = [[("j1", "OK", at(5)), ("j6", "EARLY", at(6))], [("j2", "A", at(20)), ("j2", "B", at(29)), ("j3", "LATE", at(50)), (None, "X", at(50))], [("clock", "T", at(10_000))]]
    paths = [scratch_path(spark, n) for n in ("jobs", "told")]
    schemas = ["job_id string, submitted timestamp", "job_id string, status string, sent timestamp"]
    for batches, schema, path in zip((jobs, told), schemas, paths):
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    left, right = (spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(p) for s, p in zip(schemas, paths))
    sink, progress = (scratch_path(spark, n) for n in ("followed", "progress"))
    out = streaming.follow_jobs(left, right, wait="30 minutes", delay="1 minute")
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    got = {(r.job_id, r.status) for r in spark.read.schema(out.schema).parquet(sink).collect()}
    assert got - {("clock", "T")} == {("j1", "OK"), ("j2", "A"), ("j2", "B"), ("j3", None), ("j4", None), ("j6", None)}


def test_table_cells_from_parts(spark):
    blocks = [{"Id": "t", "BlockType": "TABLE", "Relationships": [{"Type": "CHILD", "Ids": ["c"]}]}, {"Id": "c", "BlockType": "CELL", "RowIndex": 1, "ColumnIndex": 1, "Relationships": [{"Type": "CHILD", "Ids": ["w"]}]}, {"Id": "w", "BlockType": "WORD", "Text": "hello"}]
    parts = [json.dumps({"Blocks": [b]} | ({"NextToken": "x"} if i < 2 else {})) for i, b in enumerate(blocks)]
    folder, sink, progress = (scratch_path(spark, n) for n in ("in", "cells", "progress"))
    for i in (2, 0, 1):
        spark.createDataFrame([("doc", i + 1, parts[i], at(i))], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = streaming.stream_responses(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder))
    streaming.write_stream(stream, sink, progress, available_now=True).awaitTermination()
    cells = spark.read.parquet(sink).collect()
    assert [(r.table_id, r.cell_id, r.cell_content) for r in cells] == [("t", "c", "hello")]
