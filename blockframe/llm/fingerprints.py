"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

Everything is SQL: digests, sketches, their difference and its peeling are
expressions over one row, and only the text of the next document moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from blockframe.llm.common import cut_lineage, shuffle_partitions, text_or_empty

#: A paragraph: at least 60 characters and on to the end of the sentence or line, at most 200.
PARAGRAPH = r"(?s).{60}[^.!?\n]{0,140}+[.!?\n]*+|.{1,60}"
#: Cells of a segment (three hashes, a third of the cells each), and rounds of peeling.
CELLS, ROUNDS = 24, 6
#: A sketch has ``4 ** r`` segments; the largest r.  Beyond, digests are compared.
LARGEST = 5
#: Differing digests that a segment is first given, as far as they can be foretold.
FILL = 8
#: Text bytes of a block of neighbouring documents.
BLOCK_BYTES = 64 << 20
LEAST = -(1 << 63)

CHECK = "(xxhash64(shiftright({0}, 24)) & 16777215L)"
PLACES = " | ".join(f"shiftleft(1L, cast({8 * k} + (shiftright(x.h, {8 * k}) & 7) as int))" for k in range(3))
#: One element of a cell array with one digest put in or taken out.
TOGGLED = "{c} ^ (p.v & -(shiftright(p.m, i) & 1L))"


def digests(text: Column) -> Column:
    """Distinct paragraph digests: 40 bits of hash and 24 bits that check them."""
    found = F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))

    def sealed(unit: Column) -> Column:
        h = F.xxhash64(unit)
        check = F.xxhash64(F.shiftright(h, 24)).bitwiseAND(F.lit(16777215))
        return h.bitwiseAND(F.lit(~16777215)).bitwiseOR(check)

    return F.array_distinct(F.transform(found, sealed))


def items(digest_column: str) -> str:
    """SQL: each digest with the mask of its cells and the bits that choose its segment."""
    hashed = f"transform({digest_column}, v -> named_struct('v', v, 'h', xxhash64(v)))"
    return f"transform({hashed}, x -> named_struct('v', x.v, 'm', {PLACES}, 'g', shiftrightunsigned(x.h, 24)))"


def cells(item_array: str) -> str:
    """SQL: the cells of a sketch segment; a cell is the exclusive-or of the digests in it."""
    return f"aggregate({item_array}, array_repeat(0L, {CELLS}), (cs, p) -> transform(cs, (c, i) -> {TOGGLED.format(c='c')}))"


def peeled(difference: str, kept: bool = False) -> str:
    """SQL: how many digests a sketch difference holds, -1 where peeling gets stuck; or the digests, null where it does."""
    pure = f"filter(s.c, y -> y <> 0L and (y & 16777215L) = {CHECK.format('y')})"
    ready = items(f"array_distinct({pure})")
    taken = f"aggregate(ps, s.c, (cs, p) -> transform(cs, (c, i) -> {TOGGLED.format(c='c')}))"
    found, more = ("cast(array() as array<bigint>)", "concat(s.n, transform(ps, p -> p.v))") if kept else ("0", "s.n + size(ps)")
    # A round that finds nothing is the last.
    step = f"element_at(transform(array({ready}), ps -> if(size(ps) = 0, named_struct('c', s.c, 'n', s.n, 'go', false), named_struct('c', {taken}, 'n', {more}, 'go', true))), 1)"
    stuck = "null" if kept else "-1"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('c', {difference}, 'n', {found}, 'go', true), (s, q) -> if(s.go, {step}, s),"
        f" s -> if(forall(s.c, y -> y = 0L), s.n, {stuck}))"
    )


def foretold(a: str, b: str) -> str:
    """SQL: the r to begin with, from the difference of a quarter of the digests and of the two sizes."""
    quarter = "transform(filter({0}, p -> (p.g & 3L) = 3L), p -> p.v)"
    sample = f"array({quarter.format(a)}, {quarter.format(b)})"
    apart = "size(array_except(z[0], z[1])) + size(array_except(z[1], z[0]))"
    least = f"greatest(4 * ({apart}), abs(size({a}) - size({b})), 1)"
    return f"element_at(transform(array({sample}), z -> least({LARGEST}, greatest(0, cast(ceil(log(4, {least} / {FILL}D)) as int)))), 1)"


def differing(a: str, b: str, kept: bool = False) -> str:
    """SQL: the digests in one of two item arrays only, from their sketches: their number, or with ``kept`` themselves.

    Sketches of ``4 ** r`` segments are subtracted and peeled, with r growing
    from the one foretold until all segments come out; null where even the
    largest do not.
    """
    part = "filter(ab, p -> (p.g & (shiftleft(1L, r) - 1L)) = j)"
    fine = "filter(pj, p -> (shiftright(p.g, r) & (shiftleft(1L, r) - 1L)) = k)"
    none, failed, lost, added = (
        ("cast(array() as array<bigint>)", "{0} is null", "cast(null as array<bigint>)", "concat({0}, {1})") if kept else ("0", "{0} < 0", "-1", "{0} + {1}")
    )
    # A cell of both sketches subtracted is the exclusive-or of the digests of both.
    segment = f"aggregate(array({peeled(cells(fine), kept)}), t2, (t3, d) -> if({failed.format('d')}, {lost}, {added.format('t3', 'd')}))"
    inner = f"aggregate(sequence(0, shiftleft(1, r) - 1), t1, (t2, k) -> if({failed.format('t2')}, {lost}, {segment}))"
    outer = f"aggregate(array({part}), t0, (t1, pj) -> {inner})"
    attempt = f"aggregate(sequence(0, shiftleft(1, r) - 1), {none}, (t0, j) -> if({failed.format('t0')}, {lost}, {outer}))"
    hopeless = f"shiftleft({CELLS}, 2 * r) < abs(size({a}) - size({b}))"
    tried = f"aggregate(sequence({foretold(a, b)}, {LARGEST}), {lost}, (n, r) -> if(not ({failed.format('n')}), n, if({hopeless}, {lost}, {attempt})))"
    found = f"element_at(transform(array(concat({a}, {b})), ab -> {tried}), 1)"
    return found if kept else f"nullif({found}, -1)"


def likeness(a: str, b: str) -> Column:
    """Shared paragraphs over the mean number of paragraphs, of two columns of items; 1 where neither has any."""
    exact = f"size(array_except({a}, {b})) + size(array_except({b}, {a}))"
    total = f"(size({a}) + size({b}))"
    return F.expr(f"if({total} = 0, 1D, 1D - coalesce({differing(a, b)}, {exact}) / cast({total} as double))")


def written(item_column: str) -> Column:
    """The fingerprint: number of digests and the cells of the smallest sketch, in hexadecimal."""
    hexed = f"transform({cells(item_column)}, c -> lpad(lower(hex(c)), 16, '0'))"
    return F.expr(f"concat(size({item_column}), ':', array_join({hexed}, ''))")


def recovered(a: str, b: str) -> Column:
    """Digests in one of two columns of items only, peeled from sketches that grow on failure; null where the largest fail."""
    return F.expr(differing(a, b, kept=True))


def blocks_of_neighbours(rows: DataFrame, size: int, count: int) -> DataFrame:
    """Add ``base`` and ``sub``: blocks of neighbouring rows in the order of key and hash.

    Keys are cut into ranges of equal counts; the cuts are a table of one row.
    A key with more than two ranges' rows, which begins a range of its own, is
    dealt by the hash of its texts, and the larger keys of that range come behind.
    """
    spark = rows.sparkSession
    blocks = max(shuffle_partitions(spark), -(-size // BLOCK_BYTES))
    cuts = rows.stat.approxQuantile("key", [i / blocks for i in range(1, blocks)], 1 / (4 * blocks)) if blocks > 1 else []
    cuts = sorted({int(c) for c in cuts})
    if not cuts:
        return rows.withColumns({"base": F.lit(0), "sub": F.lit(0)})
    wide = round(len(cuts) ** 0.5)
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    table = spark.createDataFrame([([g[0] for g in groups], groups)], "coarse array<bigint>, fine array<array<bigint>>")
    beside = rows.withColumns({"_coarse": table.select("coarse").scalar(), "_fine": table.select("fine").scalar()})
    reached = F.size(F.filter("_coarse", lambda c: c <= F.col("key")))
    inside = F.size(F.filter(F.get("_fine", F.col("_reached") - 1), lambda c: c <= F.col("key")))
    base = F.when(F.col("_reached") == 0, 0).otherwise((F.col("_reached") - 1) * wide + inside)
    based = beside.withColumn("_reached", reached).withColumn("base", base).drop("_coarse", "_fine")
    # Half as many keys as there are ranges at most.
    often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * blocks > 2 * count)
    often = often.select(F.col("key").alias("_often"), F.ceil(F.col("n") * blocks / count).cast("int").alias("pieces"))
    begun = F.broadcast(often.join(F.broadcast(spark.createDataFrame([(c, i + 1) for i, c in enumerate(cuts)], "_cut long, _of int")), F.col("_often") == F.col("_cut")).drop("_cut"))
    part = F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("pieces")), F.col("pieces") - 1).cast("int")
    sub = F.when(F.col("pieces").isNull(), 0).when(F.col("key") == F.col("_often"), part).otherwise(F.col("pieces"))
    return based.join(begun, F.col("base") == F.col("_of"), "left").withColumn("sub", sub).drop("_reached", "_often", "_of", "pieces")


def with_next(rows: DataFrame, size: int, count: int) -> DataFrame:
    """Add ``after``, the struct (text, digests) of the next row by key, hash and text; the first follows the last.

    Rows are dealt into blocks of neighbours.  The first row of each block is
    also laid behind the block before it, so each block finds its neighbours by
    itself; blocks find the next one by its number.
    """
    dealt = blocks_of_neighbours(rows, size, count)
    block = ["base", "sub"]
    heads = dealt.groupBy(*block).agg(F.min(F.struct("key", "h", "text")).getField("text").alias("text"))
    known = cut_lineage(heads, "heads")  # one row for each block
    order = known.select(*block, F.lead("sub").over(Window.partitionBy("base").orderBy("sub")).alias("then"))
    ends = known.agg(F.min("base").alias("least"), F.max("base").alias("most")).first()
    # Every range but the first holds the key that it begins with, so only the first can be absent.
    first_of = known.groupBy("base").agg(F.min("sub").alias("begin")).select(F.col("base").alias("to_base"), "begin")
    after = F.when(F.col("base") == ends.most, ends.least).otherwise(F.col("base") + 1)
    target = order.withColumn("to_base", F.when(F.col("then").isNull(), after).otherwise(F.col("base"))).join(first_of, "to_base")
    target = target.select(*block, "to_base", F.coalesce("then", "begin").alias("to_sub"))
    texts = known.select(F.col("base").alias("to_base"), F.col("sub").alias("to_sub"), "text")
    guests = target.join(texts, ["to_base", "to_sub"]).select(
        F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("h"), "text", *block,
    ).withColumn("digests", digests(F.col("text")))
    laid = dealt.unionByName(guests)
    beside = Window.partitionBy(*block).orderBy(F.col("key").asc_nulls_last(), "h", "text")
    return laid.withColumn("after", F.lead(F.struct("text", "digests")).over(beside)).filter(F.col("key").isNotNull())


def _empty(spark: SparkSession, id_type: DataType) -> DataFrame:
    names = {"n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
    return spark.range(0).select(F.lit(None).cast(id_type).alias("doc_id"), *[F.lit(None).cast(t).alias(c) for c, t in names.items()])


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likeness.

    The edited text has its last quarter of characters replaced by the first as
    many of the next document's (ascending id; nulls first; equal ids by the
    signed XXH64 of the text, seed 42, then by text; the first follows the last).  A text is a set of paragraphs; a likeness is
    1 - differing / (paragraphs of both), where the differing digests are
    peeled from the subtracted sketches, with larger sketches on failure.  Null
    text is empty; two empty texts are alike.  Ids are integers, may be null or
    repeated; other columns are not read; an empty table gives no rows.

    Returns ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next)``.
    """
    text = text_or_empty(docs[text_col])
    rows = docs.select(
        docs[id_col].cast("string").alias("doc_id"), F.coalesce(docs[id_col].cast("long"), F.lit(LEAST)).alias("key"), text.alias("text")
    )
    whole = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("size"), F.count(F.lit(1)).alias("n")).first()
    if not whole.n:
        return _empty(docs.sparkSession, docs.schema[id_col].dataType)
    keyed = rows.withColumns({"h": F.xxhash64("text"), "digests": digests(F.col("text"))})
    beside = with_next(keyed, whole.size or 1, whole.n)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = beside.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("after.text"), F.lit(1), quarter)).alias("edited"),
        F.expr(items("digests")).alias("own"),
        F.expr(items("after.digests")).alias("following"),
    )
    both = edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "following", digests(F.col("edited")).alias("changed_digests")
    ).withColumn("changed", F.expr(items("changed_digests")))
    return both.select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        written("own").alias("fingerprint"),
        written("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"),
        likeness("own", "following").alias("near_next"),
    )
