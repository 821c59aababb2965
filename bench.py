"""Headline queries on one machine; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (data folder), ``BENCH_CPUS`` (threads).
Cells, blocks and documents are written once as datasets of several files before
the clock starts, as the extraction stage would leave them; ``context_end_to_end`` includes building the cells.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from blockframe import operators as op
from blockframe import sources as src
from blockframe.plans import fixtures as fx
from blockframe.session import configure

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)


def session() -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("blockframe-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
        .config("spark.sql.files.maxPartitionBytes", "16m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    folder = tempfile.mkdtemp(prefix="blockframe-bench-")
    try:
        paths = {n: f"{folder}/{n}" for n in ("cells", "merged", "blocks", "documents")}
        cells = fx.grid_cells(spark, SF_DIR)
        src.save_dataset(cells.repartition(2 * int(CPUS)), paths["cells"])
        merged = fx.merged_cells(spark, SF_DIR)
        src.save_dataset(src.concat_datasets(cells, merged).repartition(2 * int(CPUS)), paths["merged"])
        graph = fx.block_graph(spark, SF_DIR).drop("document")
        src.save_dataset(graph.repartition(2 * int(CPUS)), paths["blocks"])
        cells = src.load_dataset(spark, paths["cells"])
        with_merged = src.load_dataset(spark, paths["merged"])
        blocks = src.load_dataset(spark, paths["blocks"])
        src.save_dataset(fx.table(spark, SF_DIR, "documents").repartition(2 * int(CPUS)), paths["documents"])
        documents = src.load_dataset(spark, paths["documents"])
        titles = fx.titles(spark, SF_DIR)
        rows = cells.count()

        def tfidf():
            vocabulary = op.fit_tfidf(documents, "text", 1000)
            run(op.transform_tfidf(documents, vocabulary, "text").select("doc_id", "tfidf"))

        work = {
            "neighbour_words": lambda: run(op.neighbour_words(cells)),
            "words_above": lambda: run(op.words_above(cells)),
            "context_end_to_end": lambda: run(op.neighbour_words(fx.grid_cells(spark, SF_DIR))),
            "table_counts": lambda: run(op.table_counts(cells)),
            "summarize_tables": lambda: run(op.summarize_tables(cells)),
            "overlay_merged_cells": lambda: run(op.overlay_merged_cells(with_merged)),
            "attach_page_title": lambda: run(op.attach_page_title(op.table_counts(cells), titles)),
            "cells_from_blocks": lambda: run(op.cells_from_blocks(blocks)),
            "corpus_stats": lambda: run(op.corpus_stats(documents, "text")),
            "tfidf_1000": tfidf,
        }
        # One untimed pass over a query warms the engine up.
        run(op.words_left(cells))
        seconds = {}
        for name, query in work.items():
            start = time.perf_counter()
            query()
            seconds[name] = round(time.perf_counter() - start, 3)
        print(
            json.dumps(
                {
                    "metric": "total wall time of headline queries",
                    "value": round(sum(seconds.values()), 3),
                    "unit": "sec",
                    "queries": seconds,
                    "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                    "cpus": int(CPUS),
                    "cells": rows,
                    "context_cells_per_second": round(rows / seconds["neighbour_words"]),
                }
            ),
            flush=True,
        )
    finally:
        spark.stop()
        shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
