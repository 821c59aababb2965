"""Scores compared without a join, and what training keeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockframe import operators as op
from blockframe.operators import learn
from blockframe.plans import queries as q


def test_pairs_that_differ_equal_a_join(spark):
    rows = [("s", "a", "x", "x"), ("s", "a", "x", "y"), ("s", "b", "y", "x"), ("t", "a", "y", "y"), (None, "a", "x", "y"), ("s", None, "x", "x")]
    scored = spark.createDataFrame(rows, "source string, id string, before string, after string")
    key = ["source", "id"]
    joined = scored.drop("after").join(scored.drop("before"), key)
    wanted = joined.agg(F.count(F.lit(1)), F.count(F.when(F.col("before") != F.col("after"), 1))).first()
    found = q._pairs_that_differ(scored, key, ["x", "y"])
    assert tuple(found.first()) == tuple(wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert tuple(q._pairs_that_differ(scored.limit(0), key, ["x", "y"]).first()) == (0, 0)


def test_training_keeps_only_what_it_reads(spark, monkeypatch):
    kept = []
    begin = learn._Stages.__init__

    def noted(self, *given):
        begin(self, *given)
        kept.append(set(self.rows.columns))

    monkeypatch.setattr(learn._Stages, "__init__", noted)
    names = ["source", "table_id", "cell_id", "cell_type", "entity_type", "cell_content", "table_class", *learn.CELL_BASE]
    rows = spark.range(60).select(
        *[(F.lit("s") if n == "source" else F.concat(F.lit(n), (F.col("id") % 20).cast("string")) if n in ("table_id",) else
           F.concat(F.lit("c"), F.col("id").cast("string")) if n == "cell_id" else F.lit("CHILD") if n == "cell_type" else
           F.lit("word") if n in ("cell_content", "table_class") else F.lit(1) if n == "column_index" else F.lit(None).cast("string") if n == "entity_type" else
           (F.col("id") % 7).cast("int")).alias(n) for n in names],
        F.array(F.lit("word"), F.lit("other")).alias("cell_words"),
        F.array(F.lit("long list")).alias("words_above"),
        F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("cell_role"),
    )
    op.train_cell_classifier(rows, trees=2, depth=2, fit_rows=30)
    op.train_cell_role_svm(rows, k=5, iterations=2, fit_rows=30)
    assert all("words_above" not in columns for columns in kept)
    assert "table_width" not in kept[1] and "cell_width" not in kept[1]
