"""Turning categories and numbers into features.

Everything that is learnt from data (categories, codes, means) is a small value
that is fitted once, kept, and applied row by row at scoring time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import (
    PCA,
    PCAModel,
    ElementwiseProduct,
    StandardScaler,
    StringIndexerModel,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.linalg import Vectors
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import lookup
from ..functions.grid import flatten_grid, grid_width, pad_grid
from ..session import cut_lineage
from .skew import own_shuffle

# A category column becomes one feature per value, so more values than this is
# taken for a mistake and refused (never cut).
MOST_CATEGORIES = 10_000
# Places that every row of a padded grid has at most.
MOST_PADDED = 100_000


def categories(df: DataFrame, column: str | Column, most: int = MOST_CATEGORIES) -> list:
    """Sorted distinct values of a category column, null last if present."""
    name = F.col(column) if isinstance(column, str) else column
    found = [r[0] for r in df.select(name.alias("v")).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} distinct values; not a category column")
    values = sorted(v for v in found if v is not None)
    return values + [None] * (len(values) < len(found))


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    """Column ``<column>_<value>`` with 1 or 0 for each of the fitted values."""
    return df.withColumns(
        {
            f"{column}_{v}": F.col(column).eqNullSafe(F.lit(v)).cast("int")
            for v in values
        }
    )


def label_encoder(df: DataFrame, column: str, output: str) -> StringIndexerModel:
    """Fitted transformer from sorted distinct values to codes from 0.

    The values pass through the driver; more than ``MOST_CATEGORIES`` are refused.
    """
    values = [v for v in categories(df, F.col(column).cast("string")) if v is not None]
    return StringIndexerModel.from_labels(values, inputCol=column, outputCol=output, handleInvalid="keep")


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """``(value, code)``: the distinct values of a column as text, numbered from 0 in ascending order.

    For any number of values: they are sorted into ranges, counted by range and
    numbered within it, behind the counts of the ranges before; no list passes
    through the driver and no task holds more than a range.
    """
    values = df.select(F.col(column).cast("string").alias("value")).filter("value is not null").distinct()
    ranged = cut_lineage(values.repartitionByRange("value").withColumn("_range", F.spark_partition_id()), "values")
    # One row for each range.
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0))
    before = Window.partitionBy("_all").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("value")) - 1
    return ranged.withColumn("_place", place).join(offsets, "_range").select("value", (F.col("_offset") + F.col("_place")).alias("code"))


def label_encode(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """Codes from 0 for the sorted distinct values, as text; null has the code behind the last.

    Up to ``MOST_CATEGORIES`` values are looked up row by row.  More are
    numbered as by ``label_codes`` and joined; there codes are long.
    """
    output = output or f"{column}_encoded"
    found = df.select(F.col(column).cast("string").alias("v")).distinct().limit(MOST_CATEGORIES + 2).count()
    if found <= MOST_CATEGORIES:
        encoded = label_encoder(df, column, output).transform(df)
        return encoded.withColumn(output, F.col(output).cast("int"))
    codes = cut_lineage(label_codes(df, column), "codes")
    behind = codes.count()
    names = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    joined = df.drop(output).join(own_shuffle(names, ["_value"]), F.col(column).cast("string") == F.col("_value"), "left")
    return joined.withColumn(output, F.coalesce("_code", F.lit(behind))).drop("_value", "_code")


def entity_categories(tables: DataFrame, column: str = "entities") -> DataFrame:
    """Distinct entity types over all tables."""
    return tables.select(F.explode(F.flatten(column)).alias("entity")).distinct()


def entity_codes(tables: DataFrame, column: str = "entities") -> dict[str, int]:
    """Codes from 1 for the sorted entity types."""
    return {v: i + 1 for i, v in enumerate(categories(entity_categories(tables, column), "entity"))}


def encode_entities(tables: DataFrame, codes: dict[str, int], column: str = "entities", output: str = "entities_int") -> DataFrame:
    """Replace entity types by codes inside the nested lists; unknown types give 0."""
    return tables.withColumn(
        output,
        F.transform(column, lambda row: F.transform(row, lambda e: lookup(e, codes, 0))),
    )


def grid_extent(tables: DataFrame, column: str) -> DataFrame:
    """Longest outer and inner list over all rows: one row ``(height, width)``."""
    return tables.agg(
        F.coalesce(F.max(F.size(column)), F.lit(0)).alias("height"),
        F.coalesce(F.max(grid_width(column)), F.lit(0)).alias("width"),
    )


def padded_grid(
    tables: DataFrame,
    column: str,
    output: str,
    extent: tuple[int, int] | None = None,
    flat: bool = False,
) -> DataFrame:
    """Pad each grid to the same height and width; ``flat`` gives one list per row.

    For exports: every row becomes as long as the tallest and widest grid asks
    for, so one of more than ``MOST_PADDED`` places is refused.  Models take the
    sparse form.  ``extent`` is a fitted (height, width); without it the data is
    measured first.
    """
    height, width = extent or grid_extent(tables, column).first()
    if height * width > MOST_PADDED:
        raise ValueError(f"{height} x {width} places a row; take the sparse form")
    grid = pad_grid(column, height, width)
    return tables.withColumn(output, flatten_grid(grid) if flat else grid)


@dataclass(frozen=True)
class Scaling:
    """Mean and population standard deviation per column."""

    mean: dict[str, float]
    std: dict[str, float]


def fit_scaling(df: DataFrame, columns) -> Scaling:
    """One aggregation over all columns."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()
    return Scaling({c: row[f"m_{c}"] or 0.0 for c in columns}, {c: row[f"s_{c}"] or 0.0 for c in columns})


def standard_scale(df: DataFrame, scaling: Scaling, suffix: str = "") -> DataFrame:
    """``(x - mean) / std``; a constant column becomes 0."""
    return df.withColumns(
        {
            f"{c}{suffix}": (F.col(c) - mean) / (scaling.std[c] or 1.0)
            for c, mean in scaling.mean.items()
        }
    )


def assemble(df: DataFrame, columns, output: str = "features") -> DataFrame:
    """Columns and vectors side by side in one vector."""
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)


def fit_scaler(df: DataFrame, vector: str, output: str, with_std: bool = True) -> PipelineModel:
    """Vector scaler by population deviation (or centring only), as a saved transformer."""
    rows = df.count()
    scaler = StandardScaler(inputCol=vector, outputCol=f"_{output}", withMean=True, withStd=with_std)
    factor = (rows / (rows - 1)) ** 0.5 if with_std and rows > 1 else 1.0
    model = scaler.fit(df)
    return PipelineModel(
        [
            model,
            ElementwiseProduct(
                inputCol=f"_{output}", outputCol=output, scalingVec=Vectors.dense([factor] * model.mean.size)
            ),
        ]
    )


def fit_pca(
    df: DataFrame, vector: str, output: str, k: int | None = None, variance: float | None = None
) -> PipelineModel:
    """Principal components of a centred vector column.

    Either a fixed ``k``, or the fewest components that explain more than
    ``variance`` of the total.
    """
    if (k is None) == (variance is None):
        raise ValueError("give either k or variance")
    if k is not None:
        return PipelineModel([PCA(k=k, inputCol=vector, outputCol=output).fit(df)])
    size = len(df.select(vector).first()[0])
    full: PCAModel = PCA(k=size, inputCol=vector, outputCol=f"_{output}").fit(df)
    total, needed = 0.0, size
    for i, share in enumerate(full.explainedVariance.toArray()):
        total += share
        if total > variance:
            needed = i + 1
            break
    cut = VectorSlicer(inputCol=f"_{output}", outputCol=output, indices=list(range(needed)))
    return PipelineModel([full, cut])


def pca(df: DataFrame, columns, output: str = "pca", k: int | None = 2, variance: float | None = None, scale: bool = False) -> DataFrame:
    """Assemble, centre (or scale) and reduce numeric columns in one go."""
    wide = assemble(df, columns, "_numbers")
    scaler = fit_scaler(wide, "_numbers", "_scaled", with_std=scale)
    scaled = scaler.transform(wide)
    reduced = fit_pca(scaled, "_scaled", output, k, variance).transform(scaled)
    return reduced.select(*df.columns, output)
