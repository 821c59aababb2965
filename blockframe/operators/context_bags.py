"""Term counts of the texts around each cell, by adding and taking away bags.

The texts above, left of, below and right of a cell are those of its column and
of its row without those at its own row and column.  So their term counts are
``column + row - 2 * square``, where each of the three is counted once for all
cells that share it: the work grows with the cells and with the ``k`` terms, not
with the square of a table's height, and no neighbour list is written.

Cells are shuffled once, by table, and the bags of whole tables are added up in
Arrow batches.  Tables too large for one task are answered by joins on column,
row and square instead, whose lookups can be split; the rows are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize, words_or_marker
from ..session import cut_lineage, scratch_path
from .skew import HOT_ROWS, TABLE_KEY, hot_groups, own_shuffle, split_hot
from .text_features import tokens, top_terms

# The lines a cell lies on, and its own place.
LINES = {"column": [*TABLE_KEY, "column_index"], "row": [*TABLE_KEY, "row_index"]}
SQUARE = [*TABLE_KEY, "row_index", "column_index"]

BAG = "struct<indices:array<int>,values:array<double>>"
# Rows of a batch whose bags are added up at a time; a bag has at most as many entries as there are terms.
SLAB = 1000

# Column that spreads cells which belong to no table, null for all others.
APART = "table_part"
# Cells in a bucket of ``store_tables``, so that a task sorts them in memory.
BUCKET_CELLS = 500_000


def _children(cells: DataFrame) -> DataFrame:
    """The CHILD cells' places and texts; an absent index counts as 0, as in ``neighbour_words``."""
    places = [F.coalesce(c, F.lit(0)).alias(c) for c in ("row_index", "column_index")]
    return cells.filter("cell_type = 'CHILD'").select(*TABLE_KEY, *places, words_or_marker("cell_words").alias("_text"))


def square_terms(cells: DataFrame, stop_words=()) -> DataFrame:
    """``(source, table_id, row_index, column_index, term, n)`` of the CHILD cells' texts."""
    listed = tokens(_children(cells), "_text", "_tokens", stop_words)
    return listed.select(*SQUARE, F.explode("_tokens").alias("term")).groupBy(*SQUARE, "term").agg(F.count(F.lit(1)).alias("n"))


def context_term_counts(cells: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, term_count)`` over the contexts of all CHILD cells, without forming one.

    A term of a column is in the context of all the column's cells but those at
    its own square, and so with rows.
    """
    children = _children(cells).drop("_text")
    parts = []
    for key, times in ((LINES["column"], 1), (LINES["row"], 1), (SQUARE, -2)):
        sizes = own_shuffle(children.groupBy(*key).agg(F.count(F.lit(1)).alias("_cells")), key)
        counts = terms.groupBy(*key, "term").agg(F.sum("n").alias("n"))
        parts.append(counts.join(sizes, key).select("term", (F.col("n") * F.col("_cells") * times).alias("n")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("term").agg(F.sum("n").alias("term_count")).filter("term_count > 0")


def _merged(parts: list[tuple[pa.Array, pa.Array, int]], rows: int) -> pa.StructArray:
    """Entry lists of each row added up, with the sign of their part; what comes to nothing goes."""
    at, index, count = [], [], []
    for indices, counts, times in parts:
        lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(indices), 0))
        at.append(np.repeat(np.arange(rows), lengths))
        index.append(np.asarray(indices.flatten(), dtype=np.int64))
        count.append(np.asarray(counts.flatten(), dtype=np.int64) * times)
    return _summed(np.concatenate(at), np.concatenate(index), np.concatenate(count), rows)


def _summed(at: np.ndarray, index: np.ndarray, count: np.ndarray, rows: int) -> pa.StructArray:
    """Bags of the entries ``(row, index, count)``; what comes to nothing goes."""
    order = np.lexsort((index, at))
    at, index, count = at[order], index[order], count[order]
    first = np.flatnonzero(np.r_[True, (np.diff(at) != 0) | (np.diff(index) != 0)]) if len(at) else np.empty(0, dtype=np.int64)
    total = np.add.reduceat(count, first) if len(first) else count
    at, index = at[first], index[first]
    kept = total > 0
    offsets = np.r_[0, np.cumsum(np.bincount(at[kept], minlength=rows))].astype(np.int32)
    return pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(index[kept].astype(np.int32))),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(total[kept].astype(np.float64))),
        ],
        ["indices", "values"],
    )


def _added(*lists: Column, times: tuple[int, ...]) -> Column:
    """A bag from index and count lists, alternately; null lists are empty."""

    @F.arrow_udf(BAG)
    def add(*columns: pa.Array) -> pa.Array:
        parts = []
        for start in range(0, len(columns[0]), SLAB):
            cut = [c.slice(start, SLAB) for c in columns]
            parts.append(_merged([(cut[2 * i], cut[2 * i + 1], t) for i, t in enumerate(times)], len(cut[0])))
        return pa.concat_arrays(parts) if parts else _merged([(columns[0], columns[1], 1)], 0)

    return add(*lists)


def context_bags(cells: DataFrame, vocabulary: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``(source, table_id, row_index, column_index, bag)`` for every place of a CHILD cell.

    ``vocabulary`` has ``term_index`` and ``term``, so a bag has at most as many
    entries as it has rows; ``terms`` are those of ``square_terms``, if at hand.
    """
    terms = square_terms(cells) if terms is None else terms
    known = terms.join(F.broadcast(vocabulary.select("term", "term_index")), "term")
    out = _children(cells).select(*SQUARE).distinct()
    for name, key in (*LINES.items(), ("square", SQUARE)):
        entries = known.groupBy(*key, "term_index").agg(F.sum("n").alias("n")) if name != "square" else known
        bags = entries.groupBy(*key).agg(F.collect_list(F.struct("term_index", "n")).alias(f"_{name}"))
        out = out.join(own_shuffle(bags, key), key, "left")
    lists = [F.col(f"_{name}.{part}") for name in ("column", "row", "square") for part in ("term_index", "n")]
    return out.select(*SQUARE, _added(*lists, times=(1, 1, -2)).alias("bag"))


# -- whole tables in one pass ---------------------------------------------------


def _apart(cells: DataFrame) -> DataFrame:
    """Add ``APART``: cells without source or table belong to no table and need not meet in one task."""
    keyless = F.col("source").isNull() | F.col("table_id").isNull()
    return cells.withColumn(APART, F.when(keyless, F.xxhash64("row_index", "column_index", "cell_words")))


def store_tables(cells: DataFrame) -> DataFrame:
    """The cells as a table in the shared folder, in buckets by the table they belong to.

    Every later pass over whole tables, in fitting and in scoring, reads it
    without a shuffle.  It has one more column, ``APART``.
    """
    spark = cells.sparkSession
    cells = cut_lineage(cells, "cells")  # counted, then dealt to the buckets
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-cells.count() // BUCKET_CELLS))
    path, key = scratch_path(spark, "tables"), [*TABLE_KEY, APART]
    name = f"tables_{path.rpartition('-')[2]}"
    dealt = _apart(cells).repartition(buckets, *key)
    dealt.write.bucketBy(buckets, *key).options(path=path, compression="zstd").saveAsTable(name)
    return spark.table(name)


def _in_tables(cells: DataFrame, own: str = "", stop_words=()) -> DataFrame:
    """Cells with place and tokens, the rows of a table one after the other in one partition.

    Cells without source or table belong to no table; they are spread out.
    Numbering the rows of a table brings them together, which moves none of a
    table of ``store_tables``.
    """
    keyless = F.col("source").isNull() | F.col("table_id").isNull()
    marked = cells if APART in cells.columns else _apart(cells)
    marked = marked.withColumns(
        {
            "_child": F.coalesce((F.col("cell_type") == "CHILD") & ~keyless, F.lit(False)),
            "_row": F.coalesce("row_index", F.lit(0)).cast("long"),
            "_column": F.coalesce("column_index", F.lit(0)).cast("long"),
            "_text": F.when(F.col("cell_type") == "CHILD", words_or_marker("cell_words")),
        }
    )
    # Numbered before the texts are cut up, so that a shuffle, where one is needed, and the sort move no tokens.
    marked = marked.withColumn("_nth", F.row_number().over(Window.partitionBy(*TABLE_KEY, APART).orderBy("_row")))
    marked = tokens(marked, "_text", "_tokens", stop_words).drop("_text")
    if own:
        marked = tokens(marked.withColumn("_text", F.coalesce(own, F.lit(""))), "_text", "_own", stop_words).drop("_text")
    return marked


def _firsts(rows: pa.Table) -> np.ndarray:
    """Whether a row begins a table; rows without a key stand alone."""
    first = np.ones(len(rows), dtype=bool)
    if len(rows) > 1:
        same = [pc.equal(c.slice(1), c.slice(0, len(rows) - 1)) for c in (rows.column(k).combine_chunks() for k in TABLE_KEY)]
        first[1:] = ~np.asarray(pc.fill_null(pc.and_kleene(*same), False))
    return first


def _whole_tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of the batches, cut between tables only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch])
        last = int(np.flatnonzero(_firsts(rows))[-1])
        if last:
            yield rows.slice(0, last).combine_chunks()
        held = rows.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(rows: pa.Table, name: str) -> pa.Array:
    return rows.column(name).combine_chunks()


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each entry of the lists its row, and the entries."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    return np.repeat(np.arange(len(lists)), lengths), lists.flatten()


def _numbers(*columns: np.ndarray) -> np.ndarray:
    """The same number for rows that agree in all columns."""
    order, new = np.lexsort(columns), np.zeros(len(columns[0]), dtype=bool)
    for column in columns:
        ordered = column[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def _lines(rows: pa.Table) -> list[tuple[np.ndarray, int]]:
    """For each row the number of its column, of its row and of its square, each with its sign."""
    table = np.cumsum(_firsts(rows))
    row, column = np.asarray(_column(rows, "_row")), np.asarray(_column(rows, "_column"))
    return [(_numbers(table, column), 1), (_numbers(table, row), 1), (_numbers(table, row, column), -2)]


def _term_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(term, n)`` over the contexts in the tables of the batches."""
    for rows in _whole_tables(batches):
        child = np.asarray(_column(rows, "_child"))
        at, words = _flat(_column(rows, "_tokens"))
        coded = words.dictionary_encode()
        at_child = child[at]
        at, term = at[at_child], np.asarray(coded.indices, dtype=np.int64)[at_child]
        total = np.zeros(len(coded.dictionary), dtype=np.int64)
        for line, times in _lines(rows):
            # A token counts once for each cell of its line.
            np.add.at(total, term, times * np.bincount(line[child], minlength=line.max() + 1)[line[at]])
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(kept)), pa.array(total[kept])], ["term", "n"])


def _bags_of(rows: pa.Table, terms: pa.Array, own: bool) -> Iterator[tuple[int, pa.StructArray]]:
    """``(first row, bags)`` for slabs of the rows: of the context, and of the cell's own text."""
    size = len(terms)
    child = np.asarray(_column(rows, "_child"))

    def known(name):
        at, words = _flat(_column(rows, name))
        found = pc.fill_null(pc.index_in(words, value_set=terms), -1)
        term = np.asarray(found, dtype=np.int64)
        return at[term >= 0], term[term >= 0]

    at, term = known("_tokens")
    at, term = at[child[at]], term[child[at]]
    parts = []
    for line, times in _lines(rows):
        entries, counts = np.unique(line[at] * size + term, return_counts=True)
        starts = np.searchsorted(entries, np.arange(line.max() + 2) * size)
        lengths = np.where(child, (starts[1:] - starts[:-1])[line], 0)
        parts.append((starts[line], lengths, entries % size, counts * times))
    if own:
        own_at, own_term = known("_own")
        starts = np.searchsorted(own_at, np.arange(len(rows) + 1))
        parts.append((starts[:-1], starts[1:] - starts[:-1], own_term, np.ones(len(own_term), dtype=np.int64)))
    for begin in range(0, len(rows), SLAB):
        end = min(begin + SLAB, len(rows))
        of_row, index, count = [], [], []
        for starts, lengths, entry, counts in parts:
            length = lengths[begin:end]
            of_row.append(np.repeat(np.arange(end - begin), length))
            place = np.arange(length.sum()) + np.repeat(starts[begin:end] - np.cumsum(length) + length, length)
            index.append(entry[place])
            count.append(counts[place])
        yield begin, _summed(np.concatenate(of_row), np.concatenate(index), np.concatenate(count), end - begin)


def _document_counts(terms: list[str], own: bool) -> Callable:
    """``(term_index, n)``: the cells of the tables whose bag holds the term."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = pa.array(terms, pa.string()), np.zeros(len(terms), dtype=np.int64)
        for rows in _whole_tables(batches):
            for _, bags in _bags_of(rows, known, own):
                held += np.bincount(np.asarray(bags.field("indices").flatten()), minlength=len(terms))
        kept = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), pa.array(held[kept])], ["term_index", "n"])

    return count


def _with_bag_column(terms: list[str], own: bool, columns: list[str], output: str) -> Callable:
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for rows in _whole_tables(batches):
            for begin, bags in _bags_of(rows, known, own):
                part = rows.select(columns).slice(begin, len(bags)).append_column(output, bags)
                yield from part.combine_chunks().to_batches()

    return add


def _split(cells: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``(cells of ordinary tables, cells of tables too large for one task)``, the latter absent where there are none."""
    hot = cut_lineage(hot_groups(cells, TABLE_KEY, HOT_ROWS), "hot_tables")
    return split_hot(cut_lineage(cells, "cells"), hot) if hot.head(1) else (cells, None)


def _bagged(cells: DataFrame, terms: list[str], output: str, own: str) -> DataFrame:
    """Add the bag of each cell's context, and of its text ``own``, under the terms numbered by their place."""
    ordinary, large = _split(cells)
    schema = cells.select(*cells.columns, F.lit(None).cast(BAG).alias(output)).schema
    out = _in_tables(ordinary, own).mapInArrow(_with_bag_column(terms, bool(own), cells.columns, output), schema)
    if large is None:
        return out
    vocabulary = cells.sparkSession.createDataFrame(list(enumerate(terms)), "term_index int, term string")
    return out.unionByName(_with_bags(large, vocabulary, output, own))


def _with_bags(cells: DataFrame, vocabulary: DataFrame, output: str, own: str, terms: DataFrame | None = None) -> DataFrame:
    """Add the bag of each cell's context, and of the text column ``own`` if it is named; other cells have empty contexts.

    By joins, for tables of any size.
    """
    child = F.col("cell_type") == "CHILD"
    keyed = {f"_{c}": F.when(child, F.coalesce(c, F.lit(0))) for c in ("row_index", "column_index")}
    bags = context_bags(cells, vocabulary, terms).withColumnsRenamed({c: f"_{c}" for c in ("row_index", "column_index")} | {"bag": "_bag"})
    key = [*TABLE_KEY, *keyed]
    joined = cells.withColumns(keyed).join(own_shuffle(bags, key), key, "left").drop(*keyed)
    lists, times = [F.col("_bag.indices"), F.col("_bag.values")], (1,)
    if own:
        numbers = {r.term: r.term_index for r in vocabulary.select("term", "term_index").collect()}

        @F.arrow_udf("array<int>")
        def numbered(words: pa.Array) -> pa.Array:
            return pa.array([None if w is None else [numbers[t] for t in w if t in numbers] for w in words.to_pylist()], pa.list_(pa.int32()))

        joined = joined.withColumn("_own", numbered(tokenize(F.coalesce(own, F.lit("")))))
        ones = F.transform("_own", lambda _: F.lit(1.0))
        lists, times = [*lists, F.col("_own"), ones], (1, 1)
    return joined.withColumn(output, _added(*lists, times=times)).drop("_bag", "_own")


def fit_context_tfidf(cells: DataFrame, k: int, own: str = "", stop_words=()) -> DataFrame:
    """Vocabulary of the cells' contexts, with the columns of ``fit_tfidf``.

    A document is a cell's context, with its text ``own`` if that is named;
    each row of ``cells`` is one.  Term counts come from the algebra of bags,
    document counts from the bags of the ``k`` terms chosen.  Ties at the end
    of the vocabulary are broken alphabetically.
    """
    ordinary, large = _split(cells)
    read = [*TABLE_KEY, "cell_type", "row_index", "column_index", "cell_words", *([own] if own and own not in TABLE_KEY else [])]
    read += [APART] if APART in cells.columns else []
    narrow = ordinary.select(*dict.fromkeys(read))
    counts = _in_tables(narrow, "", stop_words).mapInArrow(_term_counts, "term string, n long")
    counts = counts.groupBy("term").agg(F.sum("n").alias("term_count"))
    if large is not None:
        terms = cut_lineage(square_terms(large, stop_words), "square_terms")
        counts = counts.unionByName(context_term_counts(large, terms)).groupBy("term").agg(F.sum("term_count").alias("term_count"))
    if own:
        texts = tokens(cells.select(F.coalesce(own, F.lit("")).alias("_text")), "_text", "_tokens", stop_words)
        texts = texts.select(F.explode("_tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("term_count"))
        counts = counts.unionByName(texts).groupBy("term").agg(F.sum("term_count").alias("term_count"))
    chosen = sorted((r.term, r.term_count) for r in top_terms(counts, k).collect())  # k rows
    if not chosen:
        raise ValueError("the vocabulary is empty")
    spark = cells.sparkSession
    vocabulary = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(chosen)], "term_index int, term string, term_count long")
    counter = _document_counts([t for t, _ in chosen], bool(own))
    found = _in_tables(narrow, own, stop_words).mapInArrow(counter, "term_index int, n long")
    if large is not None:
        bags = _with_bags(large, vocabulary, "_counted", own, terms).select(F.explode("_counted.indices").alias("term_index"))
        found = found.unionByName(bags.groupBy("term_index").agg(F.count(F.lit(1)).alias("n")))
    held = {r.term_index: r.n for r in found.groupBy("term_index").agg(F.sum("n").alias("n")).collect()}
    documents = cells.count()
    idf = [float(np.log((1 + documents) / (1 + held.get(i, 0))) + 1) for i in range(len(chosen))]
    rows = [(i, t, n, held.get(i, 0), idf[i]) for i, (t, n) in enumerate(chosen)]
    return spark.createDataFrame(rows, "term_index int, term string, term_count long, document_count long, idf double")


class ContextBags(Transformer, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the sparse vector of term counts of each cell's context.

    Takes whole tables: a cell's context comes from the other rows given.  With
    ``own`` the counts of that text column are added.
    """

    terms = Param(Params._dummy(), "terms", "terms in the order of their numbers", TypeConverters.toListString)
    own = Param(Params._dummy(), "own", "text column of the cell itself, or empty", TypeConverters.toString)

    @keyword_only
    def __init__(self, terms=None, own="", outputCol=None):
        super().__init__()
        self._setDefault(own="")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, cells: DataFrame) -> DataFrame:
        terms = list(self.getOrDefault(self.terms))
        counted = _bagged(cells, terms, "_counted", self.getOrDefault(self.own))
        return counted.withColumn(self.getOutputCol(), sparse_vector("_counted", len(terms))).drop("_counted")


def sparse_vector(bag: str, size: int) -> Column:
    """The ML vector of a column ``struct<indices, values>`` with ascending indices."""

    @F.arrow_udf(VectorUDT())
    def of(indices: pa.Array, values: pa.Array) -> pa.Array:
        rows = len(indices)
        fields = [pa.array(np.zeros(rows, dtype=np.int8)), pa.array(np.full(rows, size, dtype=np.int32)), indices, values]
        return pa.StructArray.from_arrays(fields, ["type", "size", "indices", "values"])

    return of(F.col(f"{bag}.indices"), F.col(f"{bag}.values"))


class SparseCodes(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Sparse vector of a nested list of categories: at each known position the code of what is there.

    ``positions`` are the ``row * stride + column`` that count as features, in
    ascending order; others and unknown categories are left out.  Neither a
    text for each position nor the padding is written.
    """

    positions = Param(Params._dummy(), "positions", "row * stride + column of each feature", TypeConverters.toList)
    stride = Param(Params._dummy(), "stride", "more than the widest row", TypeConverters.toInt)
    values = Param(Params._dummy(), "values", "categories in the order of their codes, from 1", TypeConverters.toListString)

    @keyword_only
    def __init__(self, positions=None, stride=None, values=None, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        known = np.array(self.getOrDefault(self.positions), dtype=np.int64)
        stride, codes = self.getOrDefault(self.stride), {v: i + 1 for i, v in enumerate(self.getOrDefault(self.values))}
        size = len(known)

        @F.arrow_udf(VectorUDT())
        def of(grids: pa.Array) -> pa.Array:
            indices, values, offsets = [], [], [0]
            for grid in grids:
                place, code = [], []
                for i, row in enumerate(grid.as_py() or ()):
                    for j, value in enumerate((row or ())[:stride]):
                        if value in codes:
                            place.append(i * stride + j)
                            code.append(codes[value])
                at = np.searchsorted(known, place)
                kept = at < size
                kept[kept] = known[at[kept]] == np.array(place, dtype=np.int64)[kept]
                indices.append(at[kept])
                values.append(np.array(code, dtype=np.float64)[kept])
                offsets.append(offsets[-1] + int(kept.sum()))
            ends = pa.array(offsets, pa.int32())
            lists = [
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*indices, np.empty(0, dtype=np.int64)]).astype(np.int32))),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*values, np.empty(0)]))),
            ]
            fields = [pa.array(np.zeros(len(grids), dtype=np.int8)), pa.array(np.full(len(grids), size, dtype=np.int32)), *lists]
            return pa.StructArray.from_arrays(fields, ["type", "size", "indices", "values"])

        return df.withColumn(self.getOutputCol(), of(F.col(self.getInputCol())))
