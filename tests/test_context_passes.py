"""Contexts as bags: one shuffle by table, whole tables across batches, large tables apart."""

from __future__ import annotations

import random
import sys

from pyspark.sql import functions as F

from blockframe import operators as op

SCHEMA = "source string, table_id string, cell_id string, cell_type string, row_index int, column_index int, cell_words array<string>, cell_content string"


def some_cells(spark, sizes=(40, 15, 90, 1, 12)):
    rng = random.Random(3)
    rows = []
    for t, size in enumerate(sizes):
        for i in range(size):
            words = rng.choices(["Ab", "cd", "ef", "x", "empty"], k=rng.randint(0, 4))
            place = rng.choice([None, 0, 1, 2, 3, 3]), rng.choice([None, 1, 2, 3])
            source, table = rng.choice([("s", f"t{t}")] * 9 + [(None, f"t{t}"), ("s", None)])
            rows.append((source, table, f"c{t}_{i}", rng.choice(["CHILD"] * 5 + ["MERGED_CELL", None]), *place, words, " ".join(words) or None))
    return spark.createDataFrame(rows, SCHEMA)


def texts_around(cells, own):
    """Term counts of each cell's context by comparing all cells of a table, and of its own text."""
    rows = cells.collect()
    out = {}
    for a in rows:
        near = []
        if a.cell_type == "CHILD" and a.source is not None and a.table_id is not None:
            at = lambda r: (r.row_index or 0, r.column_index or 0)
            for b in rows:
                if b.cell_type == "CHILD" and (a.source, a.table_id) == (b.source, b.table_id):
                    near += [b.cell_words or ["empty"]] * sum(x == y for x, y in zip(at(a), at(b))) if at(a) != at(b) else []
        words = [w.lower() for ws in near for w in ws] + ((a.cell_content or "").lower().split() if own else [])
        out[a.cell_id] = {w: words.count(w) for w in set(words) if len(w) > 1}
    return out


def check_all(cells, own):
    wanted = texts_around(cells, own)
    vocabulary = op.fit_context_tfidf(cells, 10, own).orderBy("term_index").collect()
    terms = [r.term for r in vocabulary]
    assert {r.term: r.term_count for r in vocabulary} == {t: sum(w.get(t, 0) for w in wanted.values()) for t in terms}
    assert {r.term: r.document_count for r in vocabulary} == {t: sum(t in w for w in wanted.values()) for t in terms}
    got = op.ContextBags(terms=terms, own=own, outputCol="v").transform(cells).collect()
    assert {r.cell_id: {terms[i]: int(x) for i, x in zip(r.v.indices.tolist(), r.v.values.tolist())} for r in got} == wanted
    assert len(got) == cells.count()


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_contexts_take_one_shuffle(spark):
    bagged = op.ContextBags(terms=["cd"], outputCol="v").transform(some_cells(spark))
    assert exchanges(bagged) == 1


def test_contexts_across_batches_and_keyless_cells(spark):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check_all(some_cells(spark), "")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_contexts_with_own_text(spark):
    check_all(some_cells(spark), "cell_content")
    bagged = op.ContextBags(terms=["cd"], own="cell_content", outputCol="v").transform(some_cells(spark))
    assert exchanges(bagged) == 1


def test_contexts_of_large_tables(spark, monkeypatch):
    monkeypatch.setattr(sys.modules["blockframe.operators.context_bags"], "HOT_ROWS", 30)
    for own in ("", "cell_content"):
        check_all(some_cells(spark), own)


def test_long_weights_of_dense_and_sparse_vectors(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(1, Vectors.sparse(4, [1, 3], [0.5, 0.0])), (2, Vectors.dense([0.0, 2.0, 0.0, 1.0])), (3, Vectors.sparse(4, [], []))]
    vectors = spark.createDataFrame(rows, ["id", "tfidf"])
    vocabulary = spark.createDataFrame([(i, t) for i, t in enumerate("abcd")], "term_index int, term string")
    got = op.weights_long(vectors, vocabulary, "id")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "b", 0.5), (2, "b", 2.0), (2, "d", 1.0)]
    assert "vector_to_array" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.filter(F.col("weight").isNull()).isEmpty()


def test_stored_tables_are_read_without_a_shuffle(spark):
    """Fitting and scoring go over stored tables as they lie; the bags are those of the cells as given."""
    cells = some_cells(spark)
    stored = op.store_tables(cells)
    given, kept = op.fit_context_tfidf(cells, 5, "cell_content"), op.fit_context_tfidf(stored, 5, "cell_content")
    assert sorted(given.collect()) == sorted(kept.collect())
    terms = [r.term for r in given.orderBy("term_index").collect()]
    bags = [op.ContextBags(terms=terms, own="cell_content", outputCol="n").transform(rows) for rows in (cells, stored)]
    found = [{r.cell_id: r.n for r in b.select("cell_id", "n").collect()} for b in bags]
    assert found[0] == found[1] and len(found[0]) == cells.count()
    plan = bags[1]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
