"""Training and scoring of table and cell classifiers.

A trained model is one ``PipelineModel`` that starts from the plain dataset and
ends with the predicted label, so training and scoring cannot drift apart, and
the standard ML persistence saves all of it.  Categories, vocabularies and
scales are inside; scoring is row-local and needs no shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.feature import (
    ElementwiseProduct,
    IndexToString,
    Normalizer,
    SQLTransformer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import CELL_TYPE_CODES, ENTITY_TYPE_CODES
from ..session import cut_lineage
from .context_bags import APART, ContextBags, SparseCodes, fit_context_tfidf
from .encode import categories, entity_codes, fit_pca, fit_scaler
from .shape import TABLE_NUMBERS
from .skew import TABLE_KEY
from .text_features import MODEL_TERMS, drop_stage, fit_tfidf, tfidf_model

CELL_BASE = [
    "cell_width", "cell_height", "cell_left", "cell_top", "row_index", "column_index",
    "row_span", "column_span", "table_rows", "table_columns", "table_cells",
]

_CONTENT = "array_join(flatten(flatten(content)), ' ')"

_CONTEXTS = ("words_above", "words_left", "words_below", "words_right")


def hash_split(
    df: DataFrame, key: str, train_percent: int = 75, salt: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key: stable, disjoint, no shuffle."""
    marked = df.withColumn("_bucket", split_bucket(key, salt))
    train = marked.filter(F.col("_bucket") < train_percent).drop("_bucket")
    test = marked.filter(F.col("_bucket") >= train_percent).drop("_bucket")
    return train, test


def split_bucket(key: str, salt: str = ""):
    """Bucket 0..99 of a key."""
    digest = F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100


def fit_sample(train: DataFrame, rows: int, *keys: str, label: str | None = None, classes: int = 1) -> DataFrame:
    """At most ``rows`` labelled rows to fit on, the first by a hash of ``keys``.

    A model's fit needs many passes; this bounds them.  Scoring is not bounded.
    With ``label`` every one of the ``classes`` first gets its share of half the
    rows, so that a rare class is learnt too.
    """
    order = [F.xxhash64(*keys), *keys]
    first = train.orderBy(*order).limit(rows)
    if label is None:
        return first
    share = max(1, rows // (2 * max(classes, 1)))
    # Both parts are limited within their tasks before they move.
    nth = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    of_class = train.withColumn("_nth", nth).filter(F.col("_nth") <= share).withColumn("_nth", F.lit(0))
    both = of_class.unionByName(first.withColumn("_nth", F.lit(1)))
    copy = F.row_number().over(Window.partitionBy(*keys).orderBy("_nth"))
    return both.withColumn("_copy", copy).filter("_copy = 1").orderBy("_nth", *order).limit(rows).drop("_nth", "_copy")


def save_model(model: PipelineModel, path: str, overwrite: bool = False) -> None:
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# -- feature stages -----------------------------------------------------------


def _quoted(value) -> str:
    return "null" if value is None else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _code_sql(column: str, codes: dict[str, int]) -> str:
    arms = " ".join(f"when {_quoted(k)} then {v}" for k, v in codes.items())
    return f"case {column} {arms} else 0 end" if arms else "0"


class _Stages:
    """Feature stages fitted one after the other on the same rows.

    Every stage reads the rows once more, so they are kept while training lasts:
    of the columns those in ``read``, if it is given.
    """

    def __init__(self, df: DataFrame, read: Iterable[str] | None = None):
        if read is not None:
            read = set(read)
            df = df.select(*[c for c in df.columns if c in read])
        self.kept = list(df.columns)
        self.stages: list = []
        self.rows = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.df = df

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.rows.unpersist()

    def add(self, stage) -> None:
        self.stages.append(stage)
        self.df = stage.transform(self.df)

    def numbers(self, expressions: list[str]) -> str:
        """Assemble SQL number expressions into the vector ``_numbers``; null is 0."""
        names = [f"_x{i}" for i in range(len(expressions))]
        listed = ", ".join(
            f"cast(coalesce({e}, 0) as double) as {n}" for e, n in zip(expressions, names)
        )
        self.add(SQLTransformer(statement=f"select *, {listed} from __THIS__"))
        self.add(VectorAssembler(inputCols=names, outputCol="_numbers"))
        return "_numbers"

    def scaled(self, vector: str, with_std: bool = True) -> str:
        self.add(fit_scaler(self.df, vector, "_scaled", with_std))
        return "_scaled"

    def reduced(self, vector: str, **options) -> str:
        self.add(fit_pca(self.df, vector, "_reduced", **options))
        return "_reduced"

    def text(self, expression: str, output: str, vocabulary=None, k=MODEL_TERMS, weight=1.0, stop_words=()) -> str:
        """TF-IDF of a text expression under a saved vocabulary, or one fitted here."""
        self.add(SQLTransformer(statement=f"select *, {expression} as {output}_text from __THIS__"))
        if vocabulary is None:
            vocabulary = fit_tfidf(self.df, f"{output}_text", k, stop_words)
        self.add(tfidf_model(vocabulary, f"{output}_text", output, weight, stop_words))
        return output

    def entity_grid(self, output: str = "_grid", positions: int | None = None) -> str:
        """Entity codes at the positions that hold one, as a sparse vector.

        The same numbers as flattening the padded grid, without the positions
        that are empty in every table.  All others are features, unless the
        caller asks for ``positions`` of them: those found in most tables, the
        first of equal ones.  Positions that do not occur in training are not
        features at scoring time.
        """
        codes = entity_codes(self.df)
        rows = self.df.select(F.posexplode("entities").alias("i", "_row")).select("i", F.posexplode("_row").alias("j", "_entity"))
        found = rows.filter("_entity is not null").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
        if positions is not None:
            found = found.orderBy(F.desc("n"), "i", "j").limit(positions)
        # Two numbers a position, without a row object for each.
        i, j = (c.to_numpy().astype(np.int64) for c in found.select("i", "j").toArrow().columns)
        stride = int(j.max(initial=0)) + 1
        places = np.sort(i * stride + j).tolist()
        self.add(SparseCodes(positions=places, stride=stride, values=[v for v in codes if v is not None], inputCol="entities", outputCol=output))
        return output

    def context(self, vocabulary: DataFrame, own: str, output: str) -> str:
        """TF-IDF of the cells' contexts under a vocabulary of ``fit_context_tfidf``."""
        terms = [(r.term, r.idf) for r in vocabulary.orderBy("term_index").collect()]
        counts, weighted = f"{output}_counts", f"{output}_weighted"
        self.add(ContextBags(terms=[t for t, _ in terms], own=own, outputCol=counts))
        self.add(ElementwiseProduct(inputCol=counts, outputCol=weighted, scalingVec=Vectors.dense([w for _, w in terms])))
        self.add(Normalizer(inputCol=weighted, outputCol=output, p=2.0))
        return output

    def finish(self, parts: list[str], output: str = "features") -> str:
        self.add(VectorAssembler(inputCols=parts, outputCol=output))
        # Named by what goes, not by what stays: data to score has no label.
        steps = [c for c in self.df.columns if c not in self.kept and c != output]
        self.add(drop_stage(*steps))
        return output


class HighestMargin(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Position of the two-class classifier with the highest margin.

    The one-against-rest model that ships with PySpark scores through Python
    functions row by row; this picks the winner with built-in expressions.
    """

    def _transform(self, df: DataFrame) -> DataFrame:
        margins = F.array(*[vector_to_array(c)[1] for c in self.getInputCols()])
        return df.withColumn("_margins", margins).withColumn(
            self.getOutputCol(),
            (F.array_position("_margins", F.array_max("_margins")) - 1).cast("double"),
        ).drop("_margins")


class OneAgainstRest:
    """Linear SVMs, one per class; the number of fits is the number of classes."""

    def __init__(self, iterations: int):
        self.iterations = iterations

    def fit(self, rows: DataFrame, classes: int) -> PipelineModel:
        models = []
        for i in range(classes):
            svm = LinearSVC(
                maxIter=self.iterations,
                labelCol="_is",
                featuresCol="features",
                rawPredictionCol=f"_raw_{i}",
                predictionCol=f"_vote_{i}",
            )
            models.append(svm.fit(rows.withColumn("_is", (F.col("_label") == i).cast("double"))))
        pick = HighestMargin()
        pick._set(inputCols=[f"_raw_{i}" for i in range(classes)], outputCol="_prediction")
        return PipelineModel([*models, pick])


def _fit_labels(
    stages: _Stages, classifier, label: str, output: str, fit_rows: int | None, fit_keys: Iterable[str], whole: Iterable[str] | None = None
) -> PipelineModel:
    """Fit the classifier on the assembled features and add the label decoder.

    Only the classifier is fitted on at most ``fit_rows`` rows, chosen by
    ``fit_keys``; the labels, like the features' terms and scales, come from all
    rows.  Features of the chosen rows alone are made, or of all rows that share
    the keys ``whole`` with one, where features come from other rows as well.
    """
    known = stages.df.filter(F.col(label).isNotNull())
    given = stages.rows.filter(F.col(label).isNotNull())
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(given.select(label))
    if fit_rows is not None:
        # Chosen by their keys, before any feature is made.
        keys = list(fit_keys)
        whole = list(whole or ())
        sampled = given.select(label, *dict.fromkeys([*keys, *whole]))
        chosen = cut_lineage(fit_sample(sampled, fit_rows, *keys, label=label, classes=len(indexer.labels)), "fit_rows")
        held = stages.rows
        if whole:
            owners = F.broadcast(chosen.select(*[F.col(c).alias(f"_{c}_of") for c in whole]).distinct())
            same = [F.col(c).eqNullSafe(F.col(f"_{c}_of")) for c in whole]
            held = held.join(owners, functools.reduce(Column.__and__, same), "left_semi")
        else:
            held = held.join(F.broadcast(chosen.select(*keys).distinct()), keys, "left_semi")
        known = PipelineModel(stages.stages).transform(held).filter(F.col(label).isNotNull())
        if whole:
            known = known.join(F.broadcast(chosen.select(*keys).distinct()), keys, "left_semi")
        # Few rows, read some hundred times: in few partitions.
        known = known.select("features", label).repartition(-(-fit_rows // 20_000))
    rows = known.select("features", label)
    labelled = indexer.transform(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        several = isinstance(classifier, OneAgainstRest)
        fitted = classifier.fit(labelled, len(indexer.labels)) if several else classifier.fit(labelled)
    finally:
        labelled.unpersist()
    decode = IndexToString(inputCol="_prediction", outputCol=output, labels=indexer.labels)
    added = set(fitted.transform(rows).columns) - set(rows.columns)
    return PipelineModel(
        [*stages.stages, *_flat(fitted), decode, drop_stage("features", *sorted(added))]
    )


def _flat(model) -> list:
    return model.stages if isinstance(model, PipelineModel) else [model]


def _forest(trees: int, depth: int, seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol="_label",
        featuresCol="features",
        predictionCol="_prediction",
        rawPredictionCol="_raw",
        probabilityCol="_probability",
        numTrees=trees,
        maxDepth=depth,
        seed=seed,
        cacheNodeIds=False,
    )


def _table_numbers(tables: DataFrame, table_types) -> list[str]:
    kinds = categories(tables, "table_type") if table_types is None else table_types
    return [*TABLE_NUMBERS, *[f"cast(table_type <=> {_quoted(v)} as int)" for v in kinds]]


# -- classifiers --------------------------------------------------------------


def train_table_classifier(
    tables: DataFrame,
    label: str = "table_class",
    output: str = "predicted_table_class",
    variant: str = "pca",
    content_vocabulary: DataFrame | None = None,
    title_vocabulary: DataFrame | None = None,
    table_types: list | None = None,
    variance: float = 0.95,
    trees: int = 100,
    depth: int = 30,
    seed: int = 42,
    fit_rows: int | None = None,
    fit_keys: Iterable[str] = ("source", "table_id"),
) -> PipelineModel:
    """Random forest for the class of a table.

    Vocabularies, document frequencies, scales, components, categories and the
    grid's extent come from all of ``tables``; ``fit_rows`` bounds the labelled
    rows the forest learns from, the first by a hash of ``fit_keys``.

    ``variant='pca'``: scaled numbers reduced to 95 % of their variance, with
    the TF-IDF of content and title under saved vocabularies.
    ``variant='grid'``: entity grid, TF-IDF of title and content together
    (1000 terms, fitted here), scaled numbers.
    """
    with _Stages(tables) as stages:
        if variant == "grid":
            parts = [
                stages.entity_grid(),
                stages.text(f"concat_ws(' ', layout_title_text, {_CONTENT})", "_words"),
            ]
            parts.append(stages.scaled(stages.numbers(_table_numbers(tables, table_types))))
        elif variant == "pca":
            numbers = stages.numbers(_table_numbers(tables, table_types))
            parts = [
                stages.reduced(stages.scaled(numbers), variance=variance),
                stages.text(_CONTENT, "_content", content_vocabulary, 50),
                stages.text("coalesce(layout_title_text, '')", "_title", title_vocabulary, 10),
            ]
        else:
            raise ValueError("variant must be 'pca' or 'grid'")
        stages.finish(parts)
        return _fit_labels(stages, _forest(trees, depth, seed), label, output, fit_rows, fit_keys)


def train_cell_classifier(
    cells: DataFrame,
    label: str = "cell_role",
    output: str = "predicted_cell_role",
    content_vocabulary: DataFrame | None = None,
    trees: int = 100,
    depth: int = 30,
    seed: int = 42,
    fit_rows: int | None = None,
    fit_keys: Iterable[str] = ("source", "cell_id"),
) -> PipelineModel:
    """Random forest for the role of a cell: 13 scaled numbers and content TF-IDF.

    ``fit_rows`` bounds the rows of the forest only, as for tables.
    """
    fit_keys = list(fit_keys)
    with _Stages(cells, [label, *fit_keys, *CELL_BASE, "cell_type", "entity_type", "cell_content"]) as stages:
        numbers = [
            *CELL_BASE,
            _code_sql("cell_type", CELL_TYPE_CODES),
            _code_sql("entity_type", ENTITY_TYPE_CODES),
        ]
        parts = [
            stages.scaled(stages.numbers(numbers)),
            stages.text("cell_content", "_content", content_vocabulary, 50),
        ]
        stages.finish(parts)
        return _fit_labels(stages, _forest(trees, depth, seed), label, output, fit_rows, fit_keys)


def train_cell_role_svm(
    cells: DataFrame,
    label: str = "cell_role",
    output: str = "predicted_cell_role",
    text: str = "context",
    k: int = MODEL_TERMS,
    iterations: int = 50,
    fit_rows: int | None = None,
    fit_keys: Iterable[str] = ("source", "cell_id"),
) -> PipelineModel:
    """Linear SVM for the role of a cell, one against the rest.

    Features are the TF-IDF of the neighbour texts (``text='context'``) or of
    content and neighbour texts (``'all'``), and the scaled code of the table class.
    ``fit_rows`` bounds the rows of the SVMs only, as for tables.

    Cells with the lists of ``neighbour_words`` are taken by themselves.  Cells
    without them must come as whole tables, in training and scoring: their
    contexts' term counts are added up from those of columns and rows, and no
    list is written.
    """
    if text not in ("context", "all"):
        raise ValueError("text must be 'context' or 'all'")
    fit_keys = list(fit_keys)
    lists = [f"array_join({c}, ' ')" for c in _CONTEXTS]
    texts = lists if text == "context" else ["cell_content", *lists]
    listed = set(_CONTEXTS) <= set(cells.columns)
    read = [label, *fit_keys, "table_class", *(["cell_content"] if text == "all" else [])]
    read += _CONTEXTS if listed else [*TABLE_KEY, APART, "cell_type", "cell_words", "row_index", "column_index"]
    with _Stages(cells, read) as stages:
        known = categories(stages.rows, F.coalesce("table_class", F.lit("")))
        classes = {value: code for code, value in enumerate(known)}
        number = stages.scaled(stages.numbers([_code_sql("coalesce(table_class, '')", classes)]))
        if listed:
            words = stages.text(f"concat_ws(' ', {', '.join(texts)})", "_words", k=k)
        else:
            own = "cell_content" if text == "all" else ""
            words = stages.context(fit_context_tfidf(stages.rows, k, own), own, "_words")
        stages.finish([words, number])
        return _fit_labels(stages, OneAgainstRest(iterations), label, output, fit_rows, fit_keys, None if listed else TABLE_KEY)


def predict_table_class(tables: DataFrame, model: PipelineModel, output: str = "table_class") -> DataFrame:
    """Score tables; the predicted class goes to ``output``."""
    predicted = _predicted(model)
    scored = model.transform(tables.drop(predicted))
    return scored.withColumn(output, F.col(predicted)).drop(*({predicted} - {output}))


def predict_cell_role(cells: DataFrame, model: PipelineModel, output: str = "cell_role") -> DataFrame:
    """Score cells; the predicted role goes to ``output``."""
    return predict_table_class(cells, model, output)


def _predicted(model: PipelineModel) -> str:
    return next(s.getOutputCol() for s in reversed(model.stages) if isinstance(s, IndexToString))


# -- clustering ---------------------------------------------------------------


def cluster_features(
    tables: DataFrame,
    content_weight: float = 0.20,
    k_terms: int = MODEL_TERMS,
    stop_words: Iterable[str] = (),
    components: int = 2,
) -> PipelineModel:
    """Features for clustering: two components of the centred numbers, weighted
    content TF-IDF, title TF-IDF and the entity grid."""
    with _Stages(tables) as stages:
        numbers = stages.scaled(stages.numbers(_table_numbers(tables, None)), with_std=False)
        parts = [
            stages.reduced(numbers, k=components),
            stages.text(_CONTENT, "_content", None, k_terms, content_weight, stop_words),
            stages.text("coalesce(layout_title_text, '')", "_title", None, k_terms, 1.0, stop_words),
            stages.entity_grid(),
        ]
        stages.finish(parts)
        return PipelineModel(stages.stages)
