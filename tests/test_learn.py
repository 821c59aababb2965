"""Training, scoring, persistence and clustering, with floors on quality."""

import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from blockframe import operators as op
from blockframe.operators.shape import TABLE_NUMBERS
from blockframe.plans import fixtures as fx
from blockframe.plans import queries as q
from blockframe.session import scratch_path


def accuracy(scored, label, prediction):
    return op.classification_report(scored, label, prediction).filter("class = 'accuracy'").first().f1_score


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    df = q._titled_tables(spark, sf_dir).persist()
    df.count()
    return df


@pytest.mark.parametrize("variant", ["pca", "grid"])
def test_table_classifier_learns_and_reloads(spark, tables, variant):
    train, test = op.hash_split(tables, "table_id")
    model = op.train_table_classifier(train, variant=variant, trees=8, depth=6)
    scored = op.predict_table_class(test, model, output="guess")
    assert set(scored.columns) == {*tables.columns, "guess"}
    majority = tables.groupBy("table_class").count().agg(F.max("count") / F.sum("count")).first()[0]
    assert accuracy(scored, "table_class", "guess") > majority + 0.2
    path = scratch_path(spark, "model")
    op.save_model(model, path)
    again = op.predict_table_class(test.drop("table_class"), op.load_model(path), output="guess")
    assert again.select("table_id", "guess").exceptAll(scored.select("table_id", "guess")).isEmpty()


def test_sparse_grid_equals_flattened_padding(spark, tables):
    rows = tables.filter("row_count > 3").limit(50).persist()
    codes, extent = op.entity_codes(rows), op.grid_extent(rows, "entities").first()
    padded = op.padded_grid(op.encode_entities(rows, codes), "entities_int", "flat", tuple(extent), flat=True)
    from blockframe.operators.learn import _Stages

    with _Stages(rows) as stages:
        grid = stages.entity_grid()
        got = {r.table_id: [int(x) for x in r.v] for r in stages.df.select("table_id", vector_to_array(grid).alias("v")).collect()}
    assert got == {r.table_id: r.flat for r in padded.select("table_id", "flat").collect()}


def text_cells(spark, sf_dir):
    """Documents as cells: their text is the context and their language the role."""
    documents = fx.table(spark, sf_dir, "documents")
    words = F.split("text", " ")
    return documents.select(
        F.col("doc_id").alias("cell_id"),
        F.col("lang").alias("cell_role"),
        F.col("text").alias("cell_content"),
        words.alias("words_above"),
        *[F.array().cast("array<string>").alias(f"words_{s}") for s in ("left", "below", "right")],
        F.when(F.col("doc_id") % 2 == 0, "KVP").alias("table_class"),
        F.lit("CHILD").alias("cell_type"),
        F.lit(None).cast("string").alias("entity_type"),
        *[F.lit(1.0).alias(c) for c in ("cell_width", "cell_height", "cell_left", "cell_top")],
        *[
            F.lit(1).alias(c)
            for c in ("row_index", "column_index", "row_span", "column_span", "table_rows", "table_columns", "table_cells")
        ],
    )


@pytest.mark.parametrize("text", ["context", "all"])
def test_role_svm_learns_and_reloads(spark, sf_dir, text):
    train, test = op.hash_split(text_cells(spark, sf_dir), "cell_id", 80)
    model = op.train_cell_role_svm(train, text=text, k=200, iterations=10)
    scored = op.predict_cell_role(test, model, output="guess")
    assert accuracy(scored, "cell_role", "guess") > 0.85
    path = scratch_path(spark, "svm")
    op.save_model(model, path)
    again = op.predict_cell_role(test, op.load_model(path), output="guess")
    assert again.select("cell_id", "guess").exceptAll(scored.select("cell_id", "guess")).isEmpty()


def test_cell_forest_learns(spark, sf_dir):
    train, test = op.hash_split(text_cells(spark, sf_dir), "cell_id")
    vocabulary = op.fit_tfidf(train, "cell_content", 50)
    model = op.train_cell_classifier(train, content_vocabulary=vocabulary, trees=10, depth=8)
    assert accuracy(op.predict_cell_role(test, model, output="guess"), "cell_role", "guess") > 0.85


def test_clusters(spark, tables):
    clustered, model = op.cluster_tables(tables, k=4, k_terms=20)
    assert clustered.count() == tables.count()
    assert {r[0] for r in clustered.select("cluster_weighted").distinct().collect()} == set(range(4))
    again = model.transform(tables).select("table_id", "cluster_weighted")
    assert again.exceptAll(clustered.select("table_id", "cluster_weighted")).isEmpty()


def test_choice_of_k_finds_separate_groups(spark):
    points = spark.range(300).select(
        array_to_vector(
            F.array((F.col("id") % 3 * 100).cast("double"), (F.col("id") % 7).cast("double"))
        ).alias("features")
    )
    assert op.choose_k(points, range(2, 5)) == 3


def flat(model):
    return [x for s in model.stages for x in (flat(s) if hasattr(s, "stages") else [s])]


def test_features_are_fitted_on_all_rows(spark, tables):
    """A bound on the classifier's rows leaves every feature stage as fitted on all rows."""
    whole, bounded = (flat(op.train_table_classifier(tables, variant="grid", trees=1, depth=2, fit_rows=n)) for n in (None, 10))
    words = lambda m: [s.vocabulary for s in m if hasattr(s, "vocabulary")]
    assert words(bounded) == words(whole) and len(words(whole)) == 1
    grids = lambda m: [s.extractParamMap() for s in m if type(s).__name__ == "SparseCodes"]
    assert [sorted((p.name, v) for p, v in g.items()) for g in grids(bounded)] == [sorted((p.name, v) for p, v in g.items()) for g in grids(whole)]
    scales = lambda m: [x for s in m if hasattr(s, "mean") for x in s.mean]
    assert scales(bounded) == pytest.approx(scales(whole)) and scales(whole)


@pytest.mark.parametrize(
    "name",
    ["train_table_classifier", "train_table_classifier_grid", "train_cell_classifier", "train_cell_role_svm", "train_cell_role_svm_all_text"],
)
def test_queries_hand_the_whole_split_to_the_trainer(spark, sf_dir, monkeypatch, name):
    class Seen(Exception):
        pass

    def trainer(rows, **options):
        raise Seen(rows.count(), options["fit_rows"])

    for each in ("train_table_classifier", "train_cell_classifier", "train_cell_role_svm"):
        monkeypatch.setattr(op, each, trainer)
    with pytest.raises(Seen) as seen:
        q.QUERIES[name](spark, sf_dir)
    whole = q._titled_tables(spark, sf_dir) if "table" in name else fx.grid_cells(spark, sf_dir)
    train, _ = op.hash_split(whole, "table_id", 80 if "svm" in name else 75)
    assert seen.value.args == (train.count(), q.FIT_ROWS)


@pytest.mark.parametrize("name", ["train_table_classifier_grid", "train_cell_classifier", "train_cell_role_svm", "train_cell_role_svm_all_text"])
def test_classifiers_are_fitted_on_the_whole_split(spark, sf_dir, monkeypatch, name):
    class Seen(Exception):
        pass

    class Counter:
        def fit(self, rows, *_):
            raise Seen(rows.count())

    from blockframe.operators import learn

    monkeypatch.setattr(learn, "_forest", lambda *_: Counter())
    monkeypatch.setattr(learn.OneAgainstRest, "fit", Counter.fit)
    with pytest.raises(Seen) as seen:
        q.QUERIES[name](spark, sf_dir)
    whole = q._titled_tables(spark, sf_dir) if "table" in name else fx.grid_cells(spark, sf_dir)
    rows = op.hash_split(whole, "table_id", 80 if "svm" in name else 75)[0].count()
    assert rows > 1000 and seen.value.args == (rows,)


def test_entity_grid_of_a_tall_table(spark):
    """One table of 50,000 rows: as many features as asked for, those found in most tables first."""
    tall = spark.range(1).select(F.lit("t0").alias("table_id"), F.expr("transform(sequence(1, 50000), i -> array('a', if(i % 2 = 0, 'b', 'a')))").alias("entities"))
    small = spark.createDataFrame([("t1", [["a"], [None, "b"]]), ("t2", [["b", "a"]]), ("t3", []), ("t4", None)], "table_id string, entities array<array<string>>")
    from blockframe.operators.learn import _Stages

    with _Stages(tall.unionByName(small)) as stages:
        grid = stages.entity_grid(positions=6)
        rows = {r.table_id: r[grid] for r in stages.df.select("table_id", grid).collect()}
        places = stages.stages[0].getOrDefault("positions")
    assert places == [0, 1, 2, 3, 4, 5]  # two columns, the first three rows
    assert rows["t0"].toArray().tolist() == [1, 1, 1, 2, 1, 1]
    assert rows["t1"].toArray().tolist() == [1, 0, 0, 2, 0, 0] and rows["t2"].toArray().tolist() == [2, 1, 0, 0, 0, 0]
    assert rows["t3"].numNonzeros() == rows["t4"].numNonzeros() == 0


def test_every_position_of_the_entity_grid_is_a_feature(spark):
    """Clusters see all of a tall table, not the positions found in most tables only."""
    tall = spark.range(1).select(F.lit("t0").alias("table_id"), F.expr("transform(sequence(1, 6000), i -> array('a', if(i % 2 = 0, 'b', 'a')))").alias("entities"))
    small = spark.createDataFrame([("t1", [["a"], [None, "b"]])], "table_id string, entities array<array<string>>")
    numbers = {c: F.length("table_id") for c in TABLE_NUMBERS}
    texts = {"table_type": F.lit("x"), "layout_title_text": F.lit("some title"), "content": F.array(F.array(F.array(F.lit("word"))))}
    rows = tall.unionByName(small).withColumns({**numbers, **texts})
    features = op.cluster_features(rows)
    grid = next(s for s in flat(features) if type(s).__name__ == "SparseCodes")
    assert len(grid.getOrDefault("positions")) == 12_000
    tall_row = grid.transform(rows.filter("table_id = 't0'")).first()["_grid"]
    assert tall_row.numNonzeros() == 12_000 and tall_row[11_999] == 2


def test_class_outside_the_sample_can_be_predicted(spark):
    rows = [(i, "common", "alpha beta") for i in range(400)] + [(1000 + i, "odd", "gamma delta") for i in range(3)] + [(2000 + i, "rare", "omega psi") for i in range(3)]
    cells = spark.createDataFrame(rows, "cell_id long, cell_role string, cell_content string").withColumns(
        {"table_class": F.lit("KVP"), **{f"words_{s}": F.split("cell_content", " ") for s in ("above", "left", "below", "right")}}
    )
    model = op.train_cell_role_svm(cells, k=20, iterations=10, fit_rows=30, fit_keys=["cell_id"])
    margins = next(s for s in flat(model) if type(s).__name__ == "HighestMargin")
    assert len(margins.getInputCols()) == 3
    guesses = op.predict_cell_role(cells, model, "guess").groupBy("cell_role", "guess").count().collect()
    assert {(r.cell_role, r.guess) for r in guesses} == {("common", "common"), ("odd", "odd"), ("rare", "rare")}


def plain_contexts(rows):
    """Term counts of each cell's context by comparing all cells of its table."""
    from collections import Counter

    out = {}
    for table, i, kind, r, c, words in rows:
        near = Counter()
        for other, _, k, r2, c2, w in rows:
            if kind == k == "CHILD" and table == other and ((c or 0) == (c2 or 0)) != ((r or 0) == (r2 or 0)):
                near.update(t for t in " ".join(w or ["empty"]).lower().split() if len(t) > 1)
        out[i] = dict(near)
    return out


def test_context_bags_equal_the_neighbour_texts(spark):
    import random

    rng = random.Random(8)
    rows = [(f"t{t}", f"c{t}_{i}", rng.choice(["CHILD"] * 5 + ["MERGED_CELL"]), rng.choice([None, 0, 1, 2, 3, 3]), rng.choice([None, 1, 2, 3]), rng.choices(["Ab", "cd", "ef", "x", "empty"], k=rng.randint(0, 4))) for t in range(5) for i in range(25)]
    rows += [("alone", "one", "CHILD", 1, 1, ["cd"]), ("none", "two", "TABLE_TITLE", 0, 0, ["cd"])]
    cells = spark.createDataFrame([("s", *r) for r in rows], "source string, table_id string, cell_id string, cell_type string, row_index int, column_index int, cell_words array<string>")
    vocabulary = op.fit_context_tfidf(cells, 10).orderBy("term_index").collect()
    terms = [r.term for r in vocabulary]
    wanted = plain_contexts(rows)
    assert {r.term: r.term_count for r in vocabulary} == {t: sum(w.get(t, 0) for w in wanted.values()) for t in terms}
    assert {r.term: r.document_count for r in vocabulary} == {t: sum(t in w for w in wanted.values()) for t in terms}
    assert set(terms) == {t for w in wanted.values() for t in w}
    got = op.ContextBags(terms=terms, outputCol="v").transform(cells).collect()
    assert {r.cell_id: {terms[i]: int(x) for i, x in zip(r.v.indices.tolist(), r.v.values.tolist())} for r in got} == wanted
    # Fewer terms, and the counts through the neighbour lists.
    lists = op.neighbour_words(cells).select("cell_id", F.concat_ws(" ", *[F.array_join(f"words_{s}", " ") for s in ("above", "left", "below", "right")]).alias("text"))
    texts = {r.cell_id: r.text for r in lists.collect()}
    fewer = op.ContextBags(terms=["cd", "ab"], outputCol="v").transform(cells).collect()
    assert {r.cell_id: r.v.toArray().tolist() for r in fewer} == {i: [float(texts[i].lower().split().count(t)) for t in ("cd", "ab")] for i in texts}
    assert op.ContextBags(terms=["cd"], outputCol="v").transform(cells.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["context", "all"])
def test_role_svm_from_bags_learns_and_reloads(spark, sf_dir, text):
    cells = q._cells_with_class(spark, sf_dir)
    train, test = op.hash_split(cells, "table_id", 80)
    model = op.train_cell_role_svm(train, text=text, k=100, iterations=10, fit_rows=300)
    scored = op.predict_cell_role(test, model, output="guess")
    assert set(scored.columns) == {*cells.columns, "guess"} and scored.count() == test.count()
    path = scratch_path(spark, "svm")
    op.save_model(model, path)
    again = op.predict_cell_role(test, op.load_model(path), output="guess")
    assert again.select("cell_id", "guess").exceptAll(scored.select("cell_id", "guess")).isEmpty()
    majority = cells.groupBy("cell_role").count().agg(F.max("count") / F.sum("count")).first()[0]
    assert accuracy(scored, "cell_role", "guess") > majority + (0.15 if text == "all" else 0.05)


def test_scores_together_equal_scores_one_by_one(spark, tables):
    features = op.cluster_features(tables, k_terms=20).transform(tables).select("features").persist()
    assigned = features
    for k in range(2, 15):
        assigned = op.kmeans(features, k, output=f"c{k}").transform(assigned)
    assigned = assigned.persist()
    together = {r.clusters: r.silhouette for r in op.silhouettes(assigned, [f"c{k}" for k in range(2, 15)]).collect()}
    assert len(together) == 13
    for k in range(2, 15):
        assert together[f"c{k}"] == pytest.approx(op.silhouette(assigned.withColumnRenamed(f"c{k}", "cluster")), abs=1e-9)


def test_silhouettes_of_odd_assignments(spark):
    """A cluster of one row, rows without a number, equal rows, one cluster only, no row."""
    points = [(0.0, 0.0, 1, 5, None), (0.0, 0.0, 1, 5, 1), (10.0, 0.0, 2, 5, 2), (10.0, 1.0, 2, 5, 2), (50.0, 50.0, 3, 5, None)]
    df = spark.createDataFrame(points, "x double, y double, a int, b int, c int").withColumn("features", array_to_vector(F.array("x", "y")))
    got = {r.clusters: r.silhouette for r in op.silhouettes(df, ["a", "b", "c"]).collect()}
    assert got["b"] is None
    for name in ("a", "c"):
        some = df.filter(F.col(name).isNotNull()).withColumn("cluster", F.col(name))
        assert got[name] == pytest.approx(op.silhouette(some))
    assert [r.silhouette for r in op.silhouettes(df.limit(0), ["a"]).collect()] == [None]
