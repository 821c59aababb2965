"""Cell, title, merged-cell and block datasets derived from the supplied tables.

Every order becomes a table, each of its line items a row with four columns:
column 2 holds two words, column 4 has empty cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.schema import BLOCK

# Line items in a partition of the grid; each gives four cells and about as many words.
LINES_PER_TASK = 100_000

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

GRID_SQL = """
with li as (
 select l_orderkey, l_returnflag, l_linestatus, l_quantity, l_partkey,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as row_index
 from {lineitem}),
k as (select 1 as column_index union all select 2 union all select 3 union all select 4)
select concat('t', cast(li.l_orderkey as varchar(20))) as table_id,
 concat('src', cast(o.o_custkey % 20 as varchar(20))) as source,
 cast(li.l_orderkey % 50 as int) as table_page,
 cast(li.row_index as int) as row_index, cast(k.column_index as int) as column_index,
 case when k.column_index=1 then l_returnflag when k.column_index=2 then p.p_name
      when k.column_index=3 then cast(cast(l_quantity as int) as varchar(20))
      else case when l_linestatus='O' then '' else l_linestatus end end as cell_content,
 case when li.row_index=1 then 'COLUMN_HEADER' end as entity_type,
 concat('c', cast(li.l_orderkey as varchar(20)), '_', cast(li.row_index as varchar(20)), '_',
   cast(k.column_index as varchar(20))) as cell_id,
 case when o.o_orderpriority='1-URGENT' then 'STRUCTURED_TABLE'
      when o.o_orderpriority='2-HIGH' then 'SEMI_STRUCTURED_TABLE' end as table_type,
 cast((li.l_orderkey % 9 + 1) * 0.1 as double) as table_width,
 cast((li.l_orderkey % 7 + 1) * 0.1 as double) as table_height,
 cast((li.l_orderkey % 5) * 0.05 as double) as table_left,
 cast((li.l_orderkey % 3) * 0.05 as double) as table_top
from li join {orders} o on o.o_orderkey=li.l_orderkey
 join {part} p on p.p_partkey=li.l_partkey cross join k
"""

TITLES_SQL = """
select concat('ti',cast(doc_id as varchar(20))) as layout_title_id, source,
 cast(doc_id % 50 as int) as layout_title_page,
 cast(n_chars % 10 as double) as layout_title_confidence, text as layout_title_text
from {documents}
"""

MERGED_SQL = """
select concat('m1_',cast(o_orderkey as varchar(20))) as cell_id,
 concat('src', cast(o_custkey % 20 as varchar(20))) as source,
 concat('t',cast(o_orderkey as varchar(20))) as table_id,
 1 as row_index, 1 as column_index, 2 as row_span, 1 as column_span
from {orders} where o_orderpriority='1-URGENT'
union all
select concat('m2_',cast(o_orderkey as varchar(20))),
 concat('src', cast(o_custkey % 20 as varchar(20))),
 concat('t',cast(o_orderkey as varchar(20))), 1,1,1,2
from {orders} where o_orderstatus='F'
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    sources = {n: table(spark, sf_dir, n) for n in TABLE_NAMES if "{" + n + "}" in text}
    return spark.sql(text, **sources)


def _numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their row in the table, their order and, one to a row, the names of their parts.

    Names are looked up first, as a list, so that rows are numbered before any
    is dropped or repeated.  Lines and orders then meet in partitions of a
    bounded number of lines, which adaptive execution does not merge: what
    comes after makes many rows of each.
    """
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey is not null")
    parts = max(1, -(-lines.count() // LINES_PER_TASK))
    names = table(spark, sf_dir, "part").groupBy("p_partkey").agg(F.collect_list(F.struct("p_name")).alias("names"))
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )
    numbered = (
        lines.join(names, F.col("l_partkey") == F.col("p_partkey"), "left")
        .repartition(parts, "l_orderkey")
        .withColumn("row_index", F.row_number().over(order))
        .filter("names is not null")
    )
    priority = F.col("o_orderpriority")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("src"), (F.col("o_custkey") % 20).cast("string")).alias("source"),
        F.when(priority == "1-URGENT", "STRUCTURED_TABLE").when(priority == "2-HIGH", "SEMI_STRUCTURED_TABLE").alias("table_type"),
    )
    joined = numbered.join(orders.repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.withColumn("part", F.explode("names"))


def _table_box() -> dict[str, Column]:
    """Place and size of a table by its order; the quotients are the doubles nearest to the decimals of ``GRID_SQL``."""
    key = F.col("l_orderkey")
    return {
        "table_width": (key % 9 + 1) / F.lit(10.0),
        "table_height": (key % 7 + 1) / F.lit(10.0),
        "table_left": (key % 5) / F.lit(20.0),
        "table_top": (key % 3) / F.lit(20.0),
    }


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``GRID_SQL``; what the cells of a line share is made once, before they are."""
    key, row, column = F.col("l_orderkey"), F.col("row_index"), F.col("column_index")
    lines = _numbered_lines(spark, sf_dir).withColumns(
        {
            "table_id": F.concat(F.lit("t"), key.cast("string")),
            "line_id": F.concat(F.lit("c"), key.cast("string"), F.lit("_"), row.cast("string"), F.lit("_")),
            "table_page": (key % 50).cast("int"),
            "quantity": F.col("l_quantity").cast("int").cast("string"),
            **_table_box(),
        }
    )
    cells = lines.withColumn("column_index", F.explode(F.array(*[F.lit(i) for i in range(1, 5)])))
    status = F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("l_linestatus"))
    return cells.select(
        "table_id",
        "source",
        "table_page",
        "row_index",
        "column_index",
        F.when(column == 1, F.col("l_returnflag"))
        .when(column == 2, F.col("part.p_name"))
        .when(column == 3, F.col("quantity"))
        .otherwise(status)
        .alias("cell_content"),
        F.when(row == 1, "COLUMN_HEADER").alias("entity_type"),
        F.concat("line_id", column.cast("string")).alias("cell_id"),
        "table_type",
        *_table_box(),
    )


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHILD cells with all base columns, indices normalised."""
    column, row = F.col("column_index"), F.col("row_index")
    words = F.array_remove(F.split("cell_content", " "), "")
    return _grid(spark, sf_dir).withColumns(
        {
            "cell_type": F.lit("CHILD"),
            "cell_words": words,
            "cell_width": F.lit(0.2),
            "cell_height": F.lit(0.02),
            "cell_left": (column - 1) * 0.2,
            "cell_top": (row % 40) * 0.02,
            "row_span": F.lit(1),
            "column_span": F.lit(1),
            "rel_rank": F.lit(0),
            "pos": (row * 4 + column).cast("long"),
        }
    )


def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged cells of the grid; some tables hold two that overlap at (1, 1)."""
    return _sql(spark, sf_dir, MERGED_SQL).withColumns(
        {
            "cell_type": F.lit("MERGED_CELL"),
            "cell_content": F.lit(""),
            "cell_words": F.array().cast("array<string>"),
            "rel_rank": F.lit(1),
            "pos": F.when(F.col("cell_id").startswith("m1_"), 0).otherwise(1).cast("long"),
        }
    )


def grid_with_merged(spark: SparkSession, sf_dir: str, overlapping: bool = True) -> DataFrame:
    merged = merged_cells(spark, sf_dir)
    if not overlapping:
        merged = merged.filter(F.col("cell_id").startswith("m1_"))
    return grid_cells(spark, sf_dir).unionByName(merged, allowMissingColumns=True)


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, TITLES_SQL)


def page_sizes(cells: DataFrame) -> DataFrame:
    """Width, height and page count for every page seen in the grid."""
    return cells.select("source", "table_page").distinct().withColumns(
        {
            "page_width": F.lit(612.0),
            "page_height": F.lit(792.0),
            "page_count": F.lit(40),
        }
    )


def _block(kind, block_id, page, **fields):
    """Columns of one kind of block, everything not given being null."""
    given = {"Id": block_id, "BlockType": F.lit(kind), "Page": page, **fields}
    return [
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in BLOCK.fields
    ]


def _relation(kind, ids):
    return F.struct(F.lit(kind).alias("Type"), ids.alias("Ids"))


def _geometry(prefix):
    box = F.struct(
        *[F.col(f"{prefix}_{n.lower()}").alias(n) for n in ("Width", "Height", "Left", "Top")]
    )
    return F.struct(box.alias("BoundingBox"), F.lit(None).cast("array<struct<X:double,Y:double>>").alias("Polygon"))


def block_graph(spark: SparkSession, sf_dir: str, layout: bool = True) -> DataFrame:
    """The grid as an OCR service would return it, with merged cells, titles and footers.

    Adds ``document`` (the table a block belongs to) to the block columns.
    """
    cells = grid_cells(spark, sf_dir)
    merged = merged_cells(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("src"), (F.col("o_custkey") % 20).cast("string")).alias("source"),
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("table_id"),
        (F.col("o_orderkey") % 50).cast("int").alias("table_page"),
        F.col("o_orderkey").cast("string").alias("key"),
        "o_orderstatus",
        "o_orderpriority",
    )
    page, doc = F.col("table_page"), F.col("table_id")
    word_ids = F.transform("cell_words", lambda _, i: F.concat("cell_id", F.lit("_w"), i.cast("string")))
    cell_blocks = cells.select(
        "source",
        doc.alias("document"),
        F.col("pos"),
        *_block(
            "CELL", F.col("cell_id"), page,
            Confidence=F.lit(99.5),
            RowIndex=F.col("row_index"), ColumnIndex=F.col("column_index"),
            RowSpan=F.lit(1), ColumnSpan=F.lit(1),
            EntityTypes=F.when(F.col("entity_type").isNotNull(), F.array("entity_type")),
            Geometry=_geometry("cell"),
            Relationships=F.when(
                F.size("cell_words") > 0, F.array(_relation("CHILD", word_ids))
            ),
        ),
    )
    word_blocks = cells.select(
        "source", "table_id", "table_page", "cell_id", F.col("pos").alias("p"),
        F.posexplode_outer("cell_words").alias("i", "w"),
    ).filter("i is not null").select(
        "source",
        doc.alias("document"),
        (F.lit(1 << 20) + F.col("p") * 8 + F.col("i")).alias("pos"),
        *_block(
            "WORD", F.concat("cell_id", F.lit("_w"), F.col("i").cast("string")), page,
            Text=F.col("w"), Confidence=F.lit(98.25),
        ),
    )
    merged_blocks = merged.withColumn(
        "table_page", (F.substring("table_id", 2, 20).cast("bigint") % 50).cast("int")
    ).select(
        "source",
        doc.alias("document"),
        (F.lit(1 << 30) + F.col("pos")).alias("pos"),
        *_block(
            "MERGED_CELL", F.col("cell_id"), page,
            RowIndex=F.col("row_index"), ColumnIndex=F.col("column_index"),
            RowSpan=F.col("row_span"), ColumnSpan=F.col("column_span"),
        ),
    )

    def captions(prefix, kind, rows, text, place):
        owner = F.concat(F.lit(prefix), F.col("key"))
        child = F.concat(owner, F.lit("_w0"))
        return [
            rows.select(
                "source", doc.alias("document"), F.lit((1 << 31) + place).alias("pos"),
                *_block(kind, owner, page, Relationships=F.array(_relation("CHILD", F.array(child)))),
            ),
            rows.select(
                "source", doc.alias("document"), F.lit((1 << 31) + place + 1).alias("pos"),
                *_block("WORD", child, page, Text=F.col(text)),
            ),
        ]

    titled = orders.filter("o_orderstatus = 'O'")
    footed = orders.filter("o_orderpriority = '5-LOW'")
    # Lines lie by order already, so only the numbers of a table's rows are gathered, where they are.
    rows = _numbered_lines(spark, sf_dir).groupBy("l_orderkey", "source").agg(F.collect_list("row_index").alias("rows"), F.max("table_type").alias("table_type"))
    places = F.sort_array(F.flatten(F.transform("rows", lambda r: F.sequence(r * 4 + 1, r * 4 + 4))))
    cell_ids = F.transform(
        places, lambda p: F.concat(F.lit("c"), "key", F.lit("_"), F.floor((p - 1) / 4).cast("string"), F.lit("_"), ((p - 1) % 4 + 1).cast("string"))
    )
    # Never null, and told so: the join's check for null would go down to the lines, and all kinds of blocks share their shuffles.
    table_id = F.coalesce(F.concat(F.lit("t"), F.col("l_orderkey").cast("string")), F.lit(""))
    listed = rows.select(
        "source", table_id.alias("table_id"), "rows", "table_type",
        *[c.alias(n) for n, c in _table_box().items()],
    )
    merged_ids = merged.groupBy("source", "table_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "cell_id"))).getField("cell_id").alias("merged_ids")
    )
    none = F.lit(None).cast("struct<Type:string,Ids:array<string>>")
    # Relations are listed out of order on purpose: titles first, cells last.
    relations = F.filter(
        F.array(
            F.when(
                F.col("o_orderstatus") == "O",
                _relation("TABLE_TITLE", F.array(F.concat(F.lit("tt"), "key"))),
            ).otherwise(none),
            F.when(
                F.col("o_orderpriority") == "5-LOW",
                _relation("TABLE_FOOTER", F.array(F.concat(F.lit("tf"), "key"))),
            ).otherwise(none),
            F.when(F.col("merged_ids").isNotNull(), _relation("MERGED_CELL", F.col("merged_ids"))).otherwise(none),
            _relation("CHILD", F.concat(cell_ids, F.array(F.lit("unknown-id")))),
        ),
        lambda r: r.isNotNull(),
    )
    table_blocks = (
        orders.join(listed, ["source", "table_id"])
        .join(merged_ids, ["source", "table_id"], "left")
        .select(
            "source",
            doc.alias("document"),
            F.lit(-1).cast("long").alias("pos"),
            *_block(
                "TABLE", F.col("table_id"), page,
                EntityTypes=F.when(F.col("table_type").isNotNull(), F.array("table_type")),
                Geometry=_geometry("table"),
                Relationships=relations,
            ),
        )
    )
    parts = [cell_blocks, word_blocks, merged_blocks, table_blocks]
    parts += captions("tt", "TABLE_TITLE", titled, "o_orderpriority", 0)
    parts += captions("tf", "TABLE_FOOTER", footed, "o_orderstatus", 2)
    if layout:
        parts += _layout_blocks(titles(spark, sf_dir))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _layout_blocks(rows: DataFrame) -> list[DataFrame]:
    line = F.concat(F.lit("line_"), "layout_title_id")
    page = F.col("layout_title_page")
    doc = F.col("layout_title_id").alias("document")
    other = _relation("CHILD", F.array(F.lit("second-relation")))
    return [
        rows.select(
            "source", doc, F.lit(0).cast("long").alias("pos"),
            *_block(
                "LAYOUT_TITLE", F.col("layout_title_id"), page,
                Confidence=F.col("layout_title_confidence"),
                Relationships=F.array(_relation("CHILD", F.array(line)), other),
            ),
        ),
        rows.select(
            "source", doc, F.lit(1).cast("long").alias("pos"),
            *_block("LINE", line, page, Text=F.col("layout_title_text")),
        ),
    ]
