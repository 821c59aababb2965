"""Text, encoders, quality and dataset round trips."""

import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from blockframe import functions as fn
from blockframe import operators as op
from blockframe import sources as src
from blockframe.session import scratch_path


def one(df, column):
    return df.select(column.alias("x")).first().x


def test_tokens_and_stop_words(spark):
    df = spark.createDataFrame([("The Straße a B2 ist_gut, élan! x",), (None,)], "text string")
    assert [r.t for r in df.select(fn.tokenize("text").alias("t")).collect()] == [
        ["the", "straße", "b2", "ist_gut", "élan"], None,
    ]
    kept = op.tokens(df.limit(1), "text", stop_words=["the", "b2"]).first().tokens
    assert kept == ["straße", "ist_gut", "élan"]
    assert one(df.limit(1).select(F.split("text", " ").alias("w")), fn.remove_stop_words(F.lit(["a", "b"]), ["a"])) == ["b"]
    assert len(op.english_stop_words()) > 100


def test_tfidf_formula(spark):
    df = spark.createDataFrame([(0, "aa aa bb"), (1, "bb cc"), (2, ""), (3, None), (4, "zz")], "id int, text string")
    vocabulary = op.fit_tfidf(df, "text", k=3)
    rows = vocabulary.orderBy("term_index").collect()
    assert [r.term for r in rows] == ["aa", "bb", "cc"]  # zz loses the tie with cc
    idf = {r.term: r.idf for r in rows}
    assert idf["bb"] == pytest.approx(math.log(6 / 3) + 1) and idf["aa"] == pytest.approx(math.log(6 / 2) + 1)
    weights = {
        (r.id, r.term): r.weight
        for r in op.weights_long(op.transform_tfidf(df, vocabulary, "text"), vocabulary, "id").collect()
    }
    size = math.hypot(2 * idf["aa"], idf["bb"])
    assert weights[(0, "aa")] == pytest.approx(2 * idf["aa"] / size)
    assert {i for i, _ in weights} == {0, 1}
    wide = op.vector_columns(op.transform_tfidf(df, vocabulary, "text"), "tfidf", "text_tfidf_", 3)
    assert wide.filter("id = 0").first().text_tfidf_0 == pytest.approx(weights[(0, "aa")])


def test_lengths_are_zero_or_one(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    vectors = op.transform_tfidf(documents, op.fit_tfidf(documents, "text", 20), "text")
    lengths = vectors.select(
        F.aggregate(vector_to_array("tfidf"), F.lit(0.0), lambda a, x: a + x * x).alias("n")
    )
    assert lengths.filter("abs(n - 1) > 1e-9 and n != 0").isEmpty()


def test_text_helpers(spark):
    df = spark.range(1)
    assert one(df, fn.words_or_marker(F.array().cast("array<string>"))) == "empty"
    assert one(df, fn.words_or_marker(F.array(F.lit("a"), F.lit(None)))) == "a empty"
    assert one(df, fn.join_non_empty(F.array(F.lit(""), F.lit(" a"), F.lit(None), F.lit("b ")))) == "a b"
    assert one(df, fn.has_content(F.lit("  \t"))) == 0 and one(df, fn.has_content(F.lit(" x"))) == 1
    assert one(df, fn.pdf_name(F.lit("a.b.json"))) == "a.b.pdf"
    assert one(df, fn.flatten_content(F.lit("[[['a', 'b'], ['c']], [['d']]]"))) == "a b c d"
    assert one(df, fn.flatten_content(F.lit("[[['it's'"))) == "[[['it's'"
    assert one(df, fn.concat_text(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))) == "a  b"
    assert one(df, fn.parse_nested(F.lit("[['x'],['y','z']]"), "array<array<string>>")) == [["x"], ["y", "z"]]


def test_encoders(spark):
    df = spark.createDataFrame(
        [(1, "b", [["x", "y"]]), (2, "a", [["y"], ["z"]]), (3, None, [])],
        "id int, kind string, entities array<array<string>>",
    )
    assert op.categories(df, "kind") == ["a", "b", None]
    coded = op.one_hot(df, "kind", ["a", "b"]).orderBy("id").collect()
    assert [(r.kind_a, r.kind_b) for r in coded] == [(0, 1), (1, 0), (0, 0)]
    with pytest.raises(ValueError):
        op.categories(df, "id", most=2)
    codes = op.entity_codes(df)
    assert codes == {"x": 1, "y": 2, "z": 3}
    ints = op.encode_entities(df, codes)
    assert tuple(op.grid_extent(ints, "entities_int").first()) == (2, 2)
    flat = op.padded_grid(ints, "entities_int", "flat", flat=True).orderBy("id")
    assert [r.flat for r in flat.collect()] == [[1, 2, 0, 0], [2, 0, 3, 0], [0, 0, 0, 0]]
    labels = op.label_encode(df.filter("kind is not null"), "kind").orderBy("id").collect()
    assert [r.kind_encoded for r in labels] == [1, 0]


def test_scaling_uses_population_deviation_and_keeps_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    scaled = op.standard_scale(df, op.fit_scaling(df, ["x", "c"])).collect()
    assert [(r.x, r.c) for r in scaled] == [(-1.0, 0.0), (1.0, 0.0)]
    wide = op.assemble(df, ["x", "c"])
    vectors = op.fit_scaler(wide, "features", "s").transform(wide).select(vector_to_array("s").alias("v")).collect()
    assert [r.v for r in vectors] == [pytest.approx([-1.0, 0.0]), pytest.approx([1.0, 0.0])]


def test_pca_picks_components_by_variance(spark):
    df = spark.range(200).select(
        F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), (F.col("id") % 2 * 0.001).alias("c")
    )
    reduced = op.pca(df, ["a", "b", "c"], k=None, variance=0.95).select(F.size(vector_to_array("pca")).alias("n"))
    assert reduced.first().n == 1
    assert op.pca(df, ["a", "b", "c"], k=2).select(F.size(vector_to_array("pca")).alias("n")).first().n == 2


def test_report_against_known_numbers(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]
    df = spark.createDataFrame(pairs, "y string, z string")
    report = {r["class"]: r for r in op.classification_report(df, "y", "z").collect()}
    assert report["a"].precision == 0.75 and report["a"].recall == 0.75 and report["a"].support == 4
    assert report["c"].precision == 0.0 and report["c"].recall == 0.0 and report["c"].f1_score == 0.0
    assert report["accuracy"].f1_score == pytest.approx(5 / 7)
    assert report["macro avg"].recall == pytest.approx((0.75 + 1 + 0) / 3)
    assert report["weighted avg"].recall == pytest.approx((0.75 * 4 + 1 * 2) / 7)


def test_profile_and_schema_difference(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "n int, s string")
    b = spark.createDataFrame([(1, 2)], "n int, m int")
    profile = {r.column_name: r for r in op.dataset_profile(a).collect()}
    assert (profile["n"].min_value, profile["n"].max_value, profile["s"].null_count) == (1.0, 2.0, 1)
    assert [r.column_name for r in op.columns_with_nulls(a).collect()] == ["s"]
    assert {(r.column_name, r.side) for r in op.schema_diff(a, b).collect()} == {("s", "left_only"), ("m", "right_only")}


def test_splits_are_disjoint_and_complete(spark):
    train, test = op.hash_split(spark.range(2000).withColumnRenamed("id", "key"), "key")
    assert train.count() + test.count() == 2000 and train.join(test, "key").isEmpty()
    assert 0.70 < train.count() / 2000 < 0.80


def test_csv_keeps_awkward_text_and_nesting(spark, tmp_path):
    rows = [("c1", ['say "hi", now', "line\nbreak"], 'a "b", c\nd', None), ("c2", [], "", "x")]
    df = spark.createDataFrame(rows, "cell_id string, cell_words array<string>, cell_content string, entity_type string")
    src.write_csv(df, str(tmp_path / "csv"))
    back = src.read_csv(spark, str(tmp_path / "csv"), df.schema).orderBy("cell_id").collect()
    assert back[0].cell_words == rows[0][1] and back[0].cell_content == rows[0][2] and back[0].entity_type is None
    assert back[1].cell_words == [] and back[1].entity_type == "x"


def test_datasets_stack_and_reload(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([(2, 9)], "n int, m int")
    path = scratch_path(spark, "stacked")
    src.save_dataset(src.concat_datasets(a, b), path, partition_by=["n"])
    got = {(r.n, r.s, r.m) for r in src.load_dataset(spark, path).collect()}
    assert got == {(1, "x", None), (2, None, 9)}


def test_boxes_and_rejected_pages(spark):
    tables = spark.createDataFrame(
        [("s", "t1", 1, 0.1, 0.2, 0.5, 0.25, "KVP"), ("s", "t2", 9, 0.1, 0.2, 0.5, 0.25, "KVP"), ("s", "t3", 0, 0.0, 0.0, 1.0, 1.0, "?")],
        "source string, table_id string, table_page int, table_left double, table_top double, table_width double, table_height double, table_class string",
    )
    pages = spark.createDataFrame([("s", p, 100.0, 200.0, 3) for p in (0, 1, 2, 3, 9)], "source string, table_page int, page_width double, page_height double, page_count int")
    box = op.annotate_tables(tables, pages).first()
    assert (box.abs_left, box.abs_top, box.abs_right, box.abs_bottom) == pytest.approx((10, 40, 60, 90))
    assert (box.red, box.green, box.blue, box.line_width) == (1.0, 0.0, 1.0, 2)
    assert {r.table_id for r in op.rejected_pages(tables, pages).collect()} == {"t2", "t3"}


def test_fill_and_feature_columns(spark):
    df = spark.createDataFrame([(None, None, None, None)], "s string, n int, f boolean, l array<string>")
    assert tuple(op.fill_missing(df).first()) == ("", 0, False, [])
    assert op.feature_columns(df, ["n"], ["s", "l"]) == ["n", "s", "l"]
    assert op.drop_columns(df, "s", "absent").columns == ["n", "f", "l"]


def test_best_k_prefers_the_lower_k_on_ties(spark):
    scores = spark.createDataFrame([(2, 0.5), (3, 0.7), (4, 0.7), (5, None)], "k int, silhouette double")
    assert op.best_k(scores).first().best_k == 3


def test_codes_of_many_values(spark):
    """Distributed numbering equals the rank of the text, with nulls behind and a value on a third of the rows."""
    from blockframe.operators import encode

    names = F.when(F.col("id") % 3 == 0, "often").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("v"), (F.col("id") * 7919 % 6007).cast("string")))
    df = spark.range(6000).select("id", names.alias("kind"))
    values = sorted({r.kind for r in df.collect() if r.kind is not None})
    codes = op.label_codes(df, "kind").collect()
    assert sorted((r.code, r.value) for r in codes) == list(enumerate(values))
    few = {r.id: r.kind_encoded for r in op.label_encode(df, "kind").collect()}
    most, encode.MOST_CATEGORIES = encode.MOST_CATEGORIES, 100
    try:
        many = {r.id: r.kind_encoded for r in op.label_encode(df, "kind").collect()}
    finally:
        encode.MOST_CATEGORIES = most
    assert many == few and set(few.values()) == set(range(len(values) + 1))
    assert op.label_codes(df.limit(0), "kind").count() == 0


def test_padding_of_large_grids_is_refused(spark):
    df = spark.range(1).select(F.expr("transform(sequence(1, 60000), i -> array(1, 2))").alias("grid"))
    with pytest.raises(ValueError):
        op.padded_grid(df, "grid", "padded")
    assert len(op.padded_grid(df, "grid", "padded", extent=(60_000, 1)).first().padded) == 60_000
