"""Spelling variants: all words walk tries, held as an edge table, with at most one edit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockframe.llm.common import cut_lineage, lower_ascii, text_or_empty

#: Shortest word, in code points, its least number of occurrences, and the divisor of hashes that delete a code point.
SHORTEST, LEAST, DIVISOR = 6, 5, 199
#: Runs of letters that are long enough.
RUN = rf"[A-Za-zÀ-ÿ]{{{SHORTEST},}}"
#: A form occurs at least so many times as often.
TIMES = 5
#: Levels broadcast: letters are 90 at most, so the tries' first nodes have at most 2 * 90, then 2 * 90 * 91 edges of each kind.
SHALLOW = 2
#: Prefixes that leave a task at a time.
SLAB = 1 << 16

_AT, _LENGTH = "substring(word, pos + 1, {0})", "length(label)"
_REST = _AT.format(_LENGTH)
#: Bits of the letters, a-z first: 63 in the first number, the others in the second.
_BIT = "(ascii({0}) - if(ascii({0}) < 128, 97, 166))"
_FOLLOWS = f"(shiftright(if({_BIT} < 63, low, high), {_BIT} % 63) & 1) = 1".format(_AT.format(1))


def counted_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(word, n)``: words of all texts after the deletions, with their occurrences."""
    owner = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    runs = docs.select(owner.alias("owner"), F.explode(F.regexp_extract_all(text_or_empty(docs[text_col]), F.lit(RUN), F.lit(0))).alias("run"))
    word = lower_ascii(F.col("run"))
    hashed = runs.select(word.alias("word"), F.crc32(F.concat("owner", F.lit(":"), word).cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    words = hashed.select(F.when(F.col("h") % DIVISOR == 0, cut).otherwise(F.col("word")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter((F.length("word") >= SHORTEST) & (F.col("n") >= LEAST))


def both_ways(words: DataFrame) -> DataFrame:
    """The words as they are (side 0) and reversed (side 1), numbered, with the characters ``must`` that a walk has to match first.

    Of two words one edit apart, the first half of either agrees or what is
    behind it does, so the edit is looked for behind the half that agrees.
    """
    half = F.floor(F.length("word") / 2).cast("int")
    numbered = words.select("word", "n", half.alias("half"), F.monotonically_increasing_id().alias("no"))
    ways = [
        numbered.select(F.lit(0).alias("side"), "no", "word", "n", "half", F.col("half").alias("must")),
        numbered.select(F.lit(1).alias("side"), "no", F.reverse("word").alias("word"), "n", "half", (F.length("word") - F.col("half")).alias("must")),
    ]
    return cut_lineage(ways[0].unionByName(ways[1]), "both_ways")


def root_of(side: int) -> int:
    return _signed(xxhash.xxh3_64_intdigest(bytes([side])))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def prefixes(ways: DataFrame) -> DataFrame:
    """``(side, no, depth, node, low, high, ends)`` for every prefix of every word.

    ``node`` is the hash of side and prefix; the character behind the prefix is
    a bit of ``low`` or ``high``, the end of the word ``ends``.
    """

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["side", "no", "depth", "node", "low", "high", "ends"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

        def packed(columns: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        columns: list[list] = [[] for _ in names]
        sides, numbers, depths, nodes, lows, highs, ends = columns
        for batch in batches:
            for side, no, word in zip(*(batch.column(c).to_pylist() for c in ("side", "no", "word"))):
                state = xxhash.xxh3_64(bytes([side]))
                for depth, letter in enumerate(word):
                    point = ord(letter)
                    bit = point - (97 if point < 128 else 166)
                    depths.append(depth)
                    nodes.append(_signed(state.intdigest()))
                    lows.append(1 << bit if bit < 63 else 0)
                    highs.append(1 << bit - 63 if bit >= 63 else 0)
                    ends.append(0)
                    state.update(letter.encode())
                    if len(depths) >= SLAB:
                        sides += [side] * (len(depths) - len(sides))
                        numbers += [no] * (len(depths) - len(numbers))
                        yield packed(columns)
                        for c in columns:
                            c.clear()
                depths.append(len(word))
                nodes.append(_signed(state.intdigest()))
                lows.append(0)
                highs.append(0)
                ends.append(1)
                sides += [side] * (len(depths) - len(sides))
                numbers += [no] * (len(depths) - len(numbers))
        if depths:
            yield packed(columns)

    schema = "side int, no long, depth int, node long, low long, high long, ends int"
    return ways.select("side", "no", "word").mapInArrow(spelled, schema)


def edge_table(ways: DataFrame) -> DataFrame:
    """The tries of the words and of the reversed words, unbranched stretches joined: one row for each edge.

    ``(level, parent, first, label, child, low, high, ends, ends_n)``: ``label``
    is the stretch of characters.  A node is a branching prefix or a word, and
    its path has ``level + 1`` edges.  An edge to a branch has the characters
    that may follow in ``low`` and ``high``; an edge to the end of a word has
    that word in ``ends``.  Where a word is a prefix of others there are both.
    """
    found = cut_lineage(prefixes(ways), "prefixes")
    bits = [F.bit_or("low").alias("low"), F.bit_or("high").alias("high")]
    nodes = found.groupBy("depth", "node").agg(*bits, F.max("ends").alias("word_end"))
    nodes = nodes.filter((F.bit_count("low") + F.bit_count("high") + F.col("word_end") > 1) | (F.col("depth") == 0))
    nodes = cut_lineage(nodes.drop("word_end"), "nodes")
    steps = found.filter("ends = 0").select("side", "no", "node", "depth")
    # The first nodes are on many words' paths; their number is bounded.
    key = ["depth", "node"]
    near = steps.filter(F.col("depth") < SHALLOW).join(F.broadcast(nodes.filter(F.col("depth") < SHALLOW)), key)
    far = steps.filter(F.col("depth") >= SHALLOW).join(nodes.filter(F.col("depth") >= SHALLOW), key)
    stop = F.struct("depth", "node", "low", "high")
    paths = near.unionByName(far).groupBy("side", "no").agg(F.sort_array(F.collect_list(stop)).alias("path"))
    each = cut_lineage(ways.select("side", "no", "word", "n").join(paths, ["side", "no"]), "paths")
    label = "substring(word, path[i - 1].depth + 1, path[i].depth - path[i - 1].depth)"
    inner = each.filter("size(path) > 1").select("word", "path", F.explode(F.expr("sequence(1, size(path) - 1)")).alias("i")).select(
        F.expr("i - 1").alias("level"), F.expr("path[i - 1].node").alias("parent"), F.expr(label).alias("label"),
        F.expr("path[i].node").alias("child"), F.expr("path[i].low").alias("low"), F.expr("path[i].high").alias("high"),
    ).distinct()
    inner = inner.withColumns({"ends": F.lit(None).cast("string"), "ends_n": F.lit(None).cast("long")})
    last = each.select("word", "n", F.size("path").alias("steps"), F.expr("path[size(path) - 1]").alias("at"))
    last = last.filter("at.depth < length(word)").select(
        F.expr("steps - 1").alias("level"), F.expr("at.node").alias("parent"), F.expr("substring(word, at.depth + 1, length(word))").alias("label"),
        F.lit(0).cast("long").alias("child"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"),
        F.col("word").alias("ends"), F.col("n").alias("ends_n"),
    )
    return cut_lineage(inner.unionByName(last).withColumn("first", F.substring("label", 1, 1)), "edges")


def outcomes() -> Column:
    """Where a word without an edit may stand behind an edge, by the characters from ``pos`` on.

    The edit, if there is one, is where the word first leaves the path, so no
    word meets another twice on one side; the first ``must`` characters agree.
    """
    ahead = "must - pos"
    free = f"({ahead} <= 0 or ({_LENGTH} > {ahead} and substring(label, 1, {ahead}) = {_AT.format(ahead)}))"
    same = f"{_REST} = label"
    replaced = f"length({_REST}) = {_LENGTH} and levenshtein(label, {_REST}, 1) = 1"
    less, more = _AT.format(f"{_LENGTH} - 1"), _AT.format(f"{_LENGTH} + 1")
    missing = f"length({less}) = {_LENGTH} - 1 and levenshtein(label, {less}, 1) = 1"
    extra = f"length({more}) = {_LENGTH} + 1 and levenshtein(label, {more}, 1) = 1"
    one = [f"if({test}, named_struct('pos', pos + {_LENGTH} + {d}, 'edits', 1), null)" for test, d in ((replaced, 0), (missing, -1), (extra, 1))]
    return F.expr(f"if({same}, array(named_struct('pos', pos + {_LENGTH}, 'edits', 0)), if({free}, array({', '.join(one)}), null))")


def near_words(words: DataFrame) -> DataFrame:
    """``(word, other, other_n)``: every ordered pair of ``words (word, n)`` that differ by exactly one edit, each once.

    States (word, position, node, edits) begin at the roots and are joined with
    the edges of one level after another.  A state that may not leave the path,
    because its edit is behind it or still to come, follows the one edge that
    begins with its next character; the others try all edges of their node.  A
    state is kept only where the node goes on, or ends, as the word does.
    """
    ways = both_ways(words)
    edges = edge_table(ways)
    deepest = edges.agg(F.max("level")).first()[0]
    root = F.when(F.col("side") == 0, root_of(0)).otherwise(root_of(1))
    states = ways.select("side", "word", "half", "must", F.lit(0).alias("pos"), root.alias("node"), F.lit(0).alias("edits"))
    own = ["side", "word", "half", "must"]
    bound = "(edits = 1 or pos < must)"
    remaining = "(length(word) - pos)"
    pairs = None
    for level in range(0 if deepest is None else deepest + 1):
        here = edges.filter(F.col("level") == level).drop("level")
        if level < SHALLOW:
            here = F.broadcast(here)
        tied = states.filter(bound).join(here, (F.col("node") == F.col("parent")) & (F.expr(_AT.format(1)) == F.col("first")))
        loose = states.filter(f"not {bound}").join(here, F.col("node") == F.col("parent"))
        target = ["child", "low", "high", "ends", "ends_n"]
        followed = tied.filter(f"edits = 1 and {_REST} = label").select(*own, F.expr(f"pos + {_LENGTH}").alias("pos"), "edits", *target)
        tried = tied.filter("edits = 0").unionByName(loose).select(*own, F.explode(outcomes()).alias("o"), *target).filter("o is not null")
        tried = tried.select(*own, F.col("o.pos").alias("pos"), F.col("o.edits").alias("edits"), *target)
        reached = followed.unionByName(tried)
        # The other side finds what agrees in its half too.
        ended = f"ends is not null and {remaining} + edits = 1 and not (side = 1 and right(word, half) = right(ends, half))"
        onward = f"ends is null and if({bound}, {remaining} > 0 and {_FOLLOWS}, true)"
        reached = reached.select("*", F.expr(ended).alias("ended"), F.expr(onward).alias("onward")).filter("ended or onward")
        reached = cut_lineage(reached, "frontier")
        found = reached.filter("ended").select("side", "word", F.col("ends").alias("other"), F.col("ends_n").alias("other_n"))
        pairs = found if pairs is None else pairs.unionByName(found)
        states = reached.filter("onward").select(*own, "pos", F.col("child").alias("node"), "edits")
    if pairs is None:
        return words.select("word", F.col("word").alias("other"), F.col("n").alias("other_n")).filter(F.lit(False))
    # Nodes are named by 64 bits: a pair that only a clash of names joined is dropped here.
    pairs = pairs.filter("levenshtein(word, other, 1) = 1")
    forth = [F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c)).alias(c) for c in ("word", "other")]
    return pairs.select(*forth, "other_n")


def last_forms(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the end of each word's chain in ``forms (word, form)``, by jumps of doubling length."""
    links = cut_lineage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while links.filter("moved").head(1):
        further = links.select(F.col("word").alias("of"), F.col("root").alias("to"))
        joined = links.join(further, F.col("root") == F.col("of"), "left")
        links = cut_lineage(joined.select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "forms")
    return links.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every frequent word with its form and the root that forms lead to.

    Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased,
    with one code point deleted where the hash of id and run says so, of at
    least ``SHORTEST`` code points and ``LEAST`` occurrences.  Words are near if
    one insertion, deletion or replacement of a code point tells them apart.
    The form is the near word of largest count (ties: first in code-point
    order) if that is ``TIMES`` the word's own, else null.  Null text has no
    word, a null id hashes as empty text; each repeated row counts; other
    columns are not read; an empty table gives no rows.  Very long words cost
    one edge, not one level, for each stretch in which no word branches off.

    Returns ``(word, form, root, n, n_near, form_n)``.
    """
    words = cut_lineage(counted_words(docs, id_col, text_col), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    near = near.withColumnRenamed("word", "of")
    joined = words.join(near, F.col("word") == F.col("of"), "left")
    often = -F.col("best.less") >= TIMES * F.col("n")
    formed = joined.select(
        "word",
        F.when(often, F.col("best.other")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, -F.col("best.less")).alias("form_n"),
    )
    formed = cut_lineage(formed, "formed")
    roots = last_forms(formed.filter("form is not null")).withColumnRenamed("word", "of")
    return formed.join(roots, F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


#: The same by words that agree after a deletion; the 256 steps of the checksum come from its polynomial.
VARIANTS_SQL = r"""
WITH RECURSIVE checksum AS (
  SELECT list(v ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents) GROUP BY doc_id, run),
bytes AS (
  SELECT run, k, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c:
    CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [(192 + (ord(c) >> 6))::BIGINT, (128 + (ord(c) & 63))::BIGINT] END)) AS b FROM runs),
hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM bytes, checksum),
cut AS (
  SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
less AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) u(i)),
near AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT less.word, words.word FROM less JOIN words ON less.rest = words.word
  UNION SELECT words.word, less.word FROM less JOIN words ON less.rest = words.word),
best AS (
  SELECT near.word, other, n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) AS place
  FROM near JOIN words ON words.word = other),
formed AS (
  SELECT words.word, words.n, coalesce(best.n_near, 0) AS n_near, CASE WHEN best.n >= 5 * words.n THEN other END AS form, CASE WHEN best.n >= 5 * words.n THEN best.n END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word AND place = 1),
chains AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT chains.word, formed.form FROM chains JOIN formed ON chains.at = formed.word WHERE formed.form IS NOT NULL)
SELECT formed.word, formed.form, chains.at AS root, formed.n, formed.n_near, formed.form_n
FROM formed JOIN chains ON chains.word = formed.word JOIN formed AS last ON last.word = chains.at AND last.form IS NULL
"""
