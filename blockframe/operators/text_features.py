"""Vocabularies and TF-IDF.

A vocabulary is a DataFrame of at most ``k`` terms.  Fitting explodes each text
where it lies and combines counts before the one shuffle, by term, so no
document is collected and a term found everywhere costs one row per task.
Applying a vocabulary needs no shuffle at all: the transformer holds the ``k``
terms, and every row is handled on its own.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    SQLTransformer,
    StopWordsRemover,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN_PATTERN, tokenize

# Sizes used for table content, table titles and the notebooks' own models.
CONTENT_TERMS, TITLE_TERMS, MODEL_TERMS = 50, 10, 1000


def english_stop_words() -> list[str]:
    """Spark's English list; any other list may be given instead."""
    return StopWordsRemover.loadDefaultStopWords("english")


def tokens(df: DataFrame, text: str, output: str = "tokens", stop_words: Iterable[str] = ()) -> DataFrame:
    """Add the token list of a text column, without the stop words."""
    out = df.withColumn(output, tokenize(text))
    stop_words = sorted(set(stop_words))
    if not stop_words:
        return out
    remover = StopWordsRemover(
        inputCol=output, outputCol="_kept", stopWords=stop_words, caseSensitive=True
    )
    return remover.transform(out).drop(output).withColumnRenamed("_kept", output)


def corpus_stats(df: DataFrame, text: str, stop_words: Iterable[str] = ()) -> DataFrame:
    """``term, term_count, document_count`` over all rows; a row is a document."""
    one = lambda tf, dc: lambda t: F.struct(
        t.alias("term"), F.lit(tf).alias("tf"), F.lit(dc).alias("dc")
    )
    listed = tokens(df.select(text), text, "_tokens", stop_words)
    return (
        listed.select(
            F.explode(
                F.concat(
                    F.transform("_tokens", one(1, 0)),
                    F.transform(F.array_distinct("_tokens"), one(0, 1)),
                )
            ).alias("e")
        )
        .groupBy(F.col("e.term").alias("term"))
        .agg(F.sum("e.tf").alias("term_count"), F.sum("e.dc").alias("document_count"))
    )


def top_terms(stats: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent terms, ties in alphabetical order."""
    return stats.orderBy(F.desc("term_count"), "term").limit(k)


def fit_tfidf(
    df: DataFrame, text: str, k: int = CONTENT_TERMS, stop_words: Iterable[str] = ()
) -> DataFrame:
    """Vocabulary ``term_index, term, term_count, document_count, idf``.

    Terms are numbered alphabetically; idf is ``ln((1 + n) / (1 + df)) + 1``.
    """
    stop_words = sorted(set(stop_words))
    top = top_terms(corpus_stats(df, text, stop_words), k)
    documents = df.agg(F.count(F.lit(1)).alias("n"))
    # One row joined to k rows; the window is over those k rows only.
    idf = F.log((1 + F.col("n")) / (1 + F.col("document_count"))) + 1
    numbered = F.transform(
        F.array_sort(F.collect_list(F.struct("term", "term_count", "document_count"))),
        lambda t, i: F.struct(i.alias("term_index"), t.alias("t")),
    )
    return (
        top.agg(numbered.alias("v"))
        .withColumn("n", documents.scalar())
        .select("n", F.explode("v").alias("v"))
        .select(
            "v.term_index", "v.t.term", "v.t.term_count", "v.t.document_count", "n"
        )
        .select("term_index", "term", "term_count", "document_count", idf.alias("idf"))
    )


def tfidf_model(
    vocabulary: DataFrame, text: str, output: str, weight: float = 1.0, stop_words: Iterable[str] = ()
) -> PipelineModel:
    """Row-local transformer: tokens, counts, idf, unit length, constant weight.

    It can be saved and loaded like any pipeline.  Only the vocabulary (its size
    is the ``k`` it was fitted with) passes through the driver.
    """
    terms = vocabulary.orderBy("term_index").select("term", "idf").collect()
    if not terms:
        raise ValueError("the vocabulary is empty")
    tok, kept, tf, idf, unit = (f"_{output}_{s}" for s in ("tok", "kept", "tf", "idf", "unit"))
    pattern = TOKEN_PATTERN.replace("\\", "\\\\")
    stages = [
        SQLTransformer(
            statement=f"select *, regexp_extract_all(lower(coalesce({text}, '')), '{pattern}', 0) "
            f"as {tok} from __THIS__"
        )
    ]
    words = tok
    stop_words = sorted(set(stop_words))
    if stop_words:
        stages.append(
            StopWordsRemover(inputCol=tok, outputCol=kept, stopWords=stop_words, caseSensitive=True)
        )
        words = kept
    counter = CountVectorizerModel.from_vocabulary([t.term for t in terms], inputCol=words, outputCol=tf)
    stages += [
        counter,
        ElementwiseProduct(inputCol=tf, outputCol=idf, scalingVec=Vectors.dense([t.idf for t in terms])),
        Normalizer(inputCol=idf, outputCol=unit, p=2.0),
        ElementwiseProduct(
            inputCol=unit, outputCol=output, scalingVec=Vectors.dense([weight] * len(terms))
        ),
        drop_stage(tok, *([kept] if stop_words else []), tf, idf, unit),
    ]
    return PipelineModel(stages)


def drop_stage(*columns: str) -> SQLTransformer:
    """Pipeline stage that removes working columns."""
    return SQLTransformer(statement=f"select * except ({', '.join(columns)}) from __THIS__")


def transform_tfidf(
    df: DataFrame,
    vocabulary: DataFrame,
    text: str,
    output: str = "tfidf",
    weight: float = 1.0,
    stop_words: Iterable[str] = (),
) -> DataFrame:
    """Add the TF-IDF vector of a text column under a fitted vocabulary."""
    return tfidf_model(vocabulary, text, output, weight, stop_words).transform(df)


def weights_long(df: DataFrame, vocabulary: DataFrame, keys, vector: str = "tfidf") -> DataFrame:
    """Non-zero weights as rows ``(keys..., term, weight)``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    # Straight from the sparse form: a text holds few of the terms.
    entries = F.arrow_udf(_non_zero, "array<struct<term_index:int,weight:double>>")
    values = df.select(*keys, F.inline(entries(F.col(vector))))
    return values.join(
        F.broadcast(vocabulary.select("term_index", "term")), "term_index"
    ).select(*keys, "term", "weight")


def _non_zero(vectors: pa.Array) -> pa.Array:
    """The entries of each vector, as ML stores it (dense or sparse), that are not zero."""
    kind, _, indices, values = vectors.flatten()
    lengths = np.asarray(pc.fill_null(pc.list_value_length(values), 0))
    at, weight = np.repeat(np.arange(len(vectors)), lengths), np.asarray(values.flatten(), dtype=np.float64)
    index = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sparse = np.asarray(pc.fill_null(kind, 1)) == 0
    index[sparse[at]] = np.asarray(indices.filter(pa.array(sparse)).flatten())
    kept = weight != 0
    offsets = np.r_[0, np.cumsum(np.bincount(at[kept], minlength=len(vectors)))].astype(np.int32)
    entries = pa.StructArray.from_arrays([pa.array(index[kept].astype(np.int32)), pa.array(weight[kept])], ["term_index", "weight"])
    return pa.ListArray.from_arrays(pa.array(offsets), entries)


def vector_columns(df: DataFrame, vector: str, prefix: str, size: int) -> DataFrame:
    """One column ``<prefix><i>`` per vector entry, for exports; ``size`` is the vocabulary's."""
    values = vector_to_array(vector)
    return df.withColumns({f"{prefix}{i}": values[i] for i in range(size)})
