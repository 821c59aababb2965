"""Declared schemas: nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

BOX = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in ("Width", "Height", "Left", "Top")]
)

POINT = T.StructType([T.StructField("X", T.DoubleType()), T.StructField("Y", T.DoubleType())])

GEOMETRY = T.StructType(
    [
        T.StructField("BoundingBox", BOX),
        T.StructField("Polygon", T.ArrayType(POINT)),
    ]
)

RELATIONSHIP = T.StructType(
    [
        T.StructField("Type", T.StringType()),
        T.StructField("Ids", T.ArrayType(T.StringType())),
    ]
)

QUERY = T.StructType(
    [T.StructField("Text", T.StringType()), T.StructField("Alias", T.StringType())]
)

BLOCK = T.StructType(
    [
        T.StructField("Id", T.StringType()),
        T.StructField("BlockType", T.StringType()),
        T.StructField("Text", T.StringType()),
        T.StructField("Confidence", T.DoubleType()),
        T.StructField("Page", T.IntegerType()),
        T.StructField("RowIndex", T.IntegerType()),
        T.StructField("ColumnIndex", T.IntegerType()),
        T.StructField("RowSpan", T.IntegerType()),
        T.StructField("ColumnSpan", T.IntegerType()),
        T.StructField("SelectionStatus", T.StringType()),
        T.StructField("EntityTypes", T.ArrayType(T.StringType())),
        T.StructField("Geometry", GEOMETRY),
        T.StructField("Relationships", T.ArrayType(RELATIONSHIP)),
        T.StructField("Query", QUERY),
    ]
)

# One page of a result that is delivered in several numbered responses.
RESPONSE = T.StructType(
    [
        T.StructField("Blocks", T.ArrayType(BLOCK)),
        T.StructField("NextToken", T.StringType()),
        T.StructField(
            "DocumentMetadata", T.StructType([T.StructField("Pages", T.IntegerType())])
        ),
    ]
)

CELLS = T.StructType(
    [
        T.StructField("cell_id", T.StringType()),
        T.StructField("cell_type", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("cell_words", T.ArrayType(T.StringType())),
        T.StructField("cell_content", T.StringType()),
        T.StructField("cell_width", T.DoubleType()),
        T.StructField("cell_height", T.DoubleType()),
        T.StructField("cell_left", T.DoubleType()),
        T.StructField("cell_top", T.DoubleType()),
        T.StructField("row_index", T.IntegerType()),
        T.StructField("column_index", T.IntegerType()),
        T.StructField("row_span", T.IntegerType()),
        T.StructField("column_span", T.IntegerType()),
        T.StructField("table_id", T.StringType()),
        T.StructField("table_type", T.StringType()),
        T.StructField("table_width", T.DoubleType()),
        T.StructField("table_height", T.DoubleType()),
        T.StructField("table_left", T.DoubleType()),
        T.StructField("table_top", T.DoubleType()),
        T.StructField("table_page", T.IntegerType()),
        T.StructField("source", T.StringType()),
    ]
)

TABLES = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("table_id", T.StringType()),
        T.StructField("table_width", T.DoubleType()),
        T.StructField("table_height", T.DoubleType()),
        T.StructField("table_left", T.DoubleType()),
        T.StructField("table_top", T.DoubleType()),
        T.StructField("table_page", T.IntegerType()),
        T.StructField("table_type", T.StringType()),
        T.StructField("cell_count", T.LongType()),
        T.StructField("row_count", T.IntegerType()),
        T.StructField("column_count", T.IntegerType()),
        T.StructField("child_count", T.LongType()),
        T.StructField("merged_cell_count", T.LongType()),
        T.StructField("table_title_count", T.LongType()),
        T.StructField("table_footer_count", T.LongType()),
        T.StructField("content", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))),
        T.StructField("entities", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)
