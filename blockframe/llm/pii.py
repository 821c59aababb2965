"""Personal data by fixed forms and by contexts learned from them.

Everything is SQL: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockframe.llm.common import cut_lineage, text_or_empty

#: The forms, in the order of report.  Fixed values: they match what
#: ``email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``,
#: ``ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``,
#: ``card [0-9]([\x20-]?[0-9])+`` and
#: ``phone \+[0-9][\x20().0-9-]+[0-9]`` match, in time linear in the text.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A word that may be an identifier: it has a digit or an at sign.
ODD_WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Marks that an identifier found by context does not begin or end with.
EDGE = r"[\[\](){}<>\"'.,;:!?]"
#: Characters of text on either side that context is taken from.
NEAR = 80


def luhn(digits: Column) -> Column:
    """Whether the last digit checks the others."""
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(turned, i, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def holds(kind: Column, found: Column) -> Column:
    """Whether a match of a form has the values the kind asks for."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    part = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    small = F.forall(part, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", small)
        .when(kind == "card", F.when(n.between(16, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(True)
    )


def occurrences(texts: DataFrame) -> DataFrame:
    """Matches of all forms and all odd words of ``texts (digest, text)``, with place and surroundings.

    A text is split at the matches; gaps and matches are laid out as rows and
    their lengths summed by a window for each text and form.
    """
    forms = [*KINDS.items(), ("word", ODD_WORD)]
    rows = []
    for kind, form in forms:
        possible = F.contains("text", F.lit("@")) if kind == "email" else F.contains("text", F.lit("+")) if kind == "phone" else F.lit(True)
        seen = F.when(possible, F.regexp_extract_all("text", F.lit(form), F.lit(0)))
        gaps = F.when(F.size(seen) > 0, F.split("text", form, -1))
        rows.append(F.struct(F.lit(kind).alias("kind"), seen.alias("seen"), gaps.alias("gaps")))
    by_form = texts.select("digest", F.explode(F.array(*rows)).alias("f")).filter(F.size("f.seen") > 0)
    laid = F.transform(
        "f.seen",
        lambda m, i: F.struct(
            i.alias("nth"),
            m.alias("found"),
            F.length(F.get("f.gaps", i)).alias("gap"),
            F.substring(F.get("f.gaps", i), -NEAR, NEAR).alias("before"),
            F.substring(F.get("f.gaps", i + 1), 1, NEAR).alias("behind"),
        ),
    )
    # Copies of a text give equal rows, which become one before they move.
    each = by_form.select("digest", "f.kind", F.explode(laid).alias("m")).select("digest", "kind", "m.*").distinct()
    line = Window.partitionBy("digest", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("found")
    end = F.sum(F.col("gap") + size).over(line)
    return each.withColumn("stop", end.cast("long")).withColumn("start", F.col("stop") - size).drop("gap", "nth")


def context_patterns() -> Column:
    """Lexical patterns of an occurrence: the two words before it, and the words on both sides."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "9")
    two = F.regexp_extract(plain(F.col("before")), r"([^\s]+\s+[^\s]+\s*)$", 1)
    last = F.regexp_extract(plain(F.col("before")), r"([^\s]+\s*)$", 1)
    after = F.regexp_extract(plain(F.col("behind")), r"^(\s*[^\s]+)", 1)
    return F.filter(
        F.array(
            F.when(two != "", F.concat(F.lit("before:"), F.regexp_replace(two, r"\s+", " "))),
            F.when((last != "") & (after != ""), F.concat(F.lit("around:"), F.regexp_replace(F.concat(last, F.lit("_"), after), r"\s+", " "))),
        ),
        lambda p: p.isNotNull(),
    )


def learned_patterns(found: DataFrame, rounds: int, support: int, trust: float) -> DataFrame:
    """Patterns ``(pattern, kind)`` trusted after scoring patterns and instances by each other.

    ``found`` has one row for each occurrence: seeds with their kind, odd words
    outside them without.  A pattern's score for a kind is the mean trust, in
    that kind, of all occurrences it has in the corpus; an instance is trusted
    as far as one of its trusted patterns is right.  Seeds are trusted fully.
    A pattern needs ``support`` different trusted instances.
    """
    edges = cut_lineage(
        found.select(F.explode(context_patterns()).alias("pattern"), F.lower("found").alias("instance"), "kind")
        .groupBy("pattern", "instance", "kind")
        .agg(F.count(F.lit(1)).alias("times")),
        "contexts",
    )
    # Only patterns that a seed induced, and enough of them, can ever be trusted.
    begun = edges.filter(F.col("kind").isNotNull()).groupBy("pattern").agg(F.countDistinct("instance").alias("_n")).filter(F.col("_n") >= support)
    edges = cut_lineage(edges.join(begun.select("pattern"), "pattern", "left_semi"), "contexts")
    seeds = edges.filter(F.col("kind").isNotNull()).select("instance", "kind", F.lit(1.0).alias("trust")).distinct()
    trusted, patterns = seeds, None
    for _ in range(rounds):
        totals = edges.groupBy("pattern").agg(F.sum("times").alias("total"))
        backed = edges.drop("kind").groupBy("pattern", "instance").agg(F.sum("times").alias("times")).join(trusted, "instance")
        scored = (
            backed.groupBy("pattern", "kind")
            .agg(F.sum(F.col("times") * F.col("trust")).alias("right"), F.count(F.lit(1)).alias("instances"))
            .join(totals, "pattern")
            .withColumn("score", F.col("right") / F.col("total"))
            .filter((F.col("score") >= trust) & (F.col("instances") >= support))
        )
        patterns = cut_lineage(scored.select("pattern", "kind", "score"), "patterns")
        gained = (
            edges.filter(F.col("kind").isNull())
            .select("pattern", "instance")
            .join(patterns, "pattern")
            .groupBy("instance", "kind")
            .agg(F.max("score").alias("trust"))
        )
        trusted = cut_lineage(
            seeds.unionByName(gained).groupBy("instance", "kind").agg(F.max("trust").alias("trust")), "instances"
        )
    return patterns


def spans_of(docs: DataFrame, text_col: str = "text", rounds: int = 3, support: int = 3, trust: float = 0.8) -> DataFrame:
    """Personal data of every distinct text: ``(digest, kind, start, stop, base)``, in code points, end exclusive.

    Base spans are the valid matches of the four forms.  They are the seeds:
    the words around them are patterns, patterns and instances are scored by
    each other in ``rounds`` rounds, and odd words (at least six characters and
    four digits, or an at sign) outside base spans that stand in a trusted
    pattern are spans of its kind.
    """
    text = text_or_empty(docs[text_col])
    texts = docs.select(digest_of(text).alias("digest"), text.alias("text")).filter(F.col("digest").isNotNull())
    found = cut_lineage(occurrences(texts), "occurrences")
    base = found.filter((F.col("kind") != "word") & holds(F.col("kind"), F.col("found")))
    # A word's edges are not part of it.
    head = F.length(F.regexp_extract("found", f"^({EDGE}*)", 1))
    core = F.regexp_replace("found", f"^{EDGE}+|{EDGE}+$", "")
    words = (
        found.filter(F.col("kind") == "word")
        .withColumns({"start": F.col("start") + head, "found": core})
        .withColumn("stop", F.col("start") + F.length("found"))
        .filter((F.length("found") >= 6) & ((F.length(F.regexp_replace("found", "[^0-9]", "")) >= 4) | F.contains("found", F.lit("@"))))
    )
    both = base.unionByName(words.withColumn("kind", F.lit(None).cast("string")))
    line = Window.partitionBy("digest").orderBy("start", F.col("kind").asc_nulls_last())
    seed = F.col("kind").isNotNull()
    reached = F.max(F.when(seed, F.col("stop"))).over(line.rowsBetween(Window.unboundedPreceding, -1))
    coming = F.min(F.when(seed, F.col("start"))).over(line.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(reached, F.lit(-1)) <= F.col("start")) & (F.coalesce(coming, F.col("stop")) >= F.col("stop"))
    apart = cut_lineage(both.withColumn("free", free).filter(seed | F.col("free")).drop("free"), "instances")
    patterns = learned_patterns(apart, rounds, support, trust)
    known = (
        apart.filter(~seed)
        .select("digest", "start", "stop", F.explode(context_patterns()).alias("context"))
        .join(patterns, F.col("context") == F.col("pattern"))
        .groupBy("digest", "start", "stop")
        .agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    )
    columns = ["digest", "kind", "start", "stop"]
    return base.select(*columns, F.lit(True).alias("base")).unionByName(known.select(*columns, F.lit(False).alias("base")))


def digest_of(text: Column) -> Column:
    """Key of a text that may hold an identifier; null for others, which hold none."""
    return F.when(text.rlike("[0-9@]"), F.unhex(F.sha2(text, 256)))


def join_key(text: Column) -> Column:
    """``digest_of`` a text, or a shorter hash that meets none, so that texts without identifiers are dealt evenly."""
    return F.coalesce(digest_of(text), F.unhex(F.lpad(F.hex(F.xxhash64(text)), 16, "0")))


def mask_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", **learn) -> DataFrame:
    """``docs`` with all spans in their text replaced by their kind, and the length column, if there is one, made right."""
    text = text_or_empty(docs[text_col])
    found = listed(docs, text_col, **learn)
    clean = F.when(found["spans"].isNotNull(), masked(text, found["spans"])).otherwise(docs[text_col])
    joined = docs.join(found, join_key(text) == found["of_text"], "left")
    lengths = {length_col: F.when(found["spans"].isNotNull(), F.length(clean)).otherwise(docs[length_col])} if length_col in docs.columns else {}
    made = {text_col: clean} | lengths
    return joined.select(*[made[c].alias(c) if c in made else docs[c] for c in docs.columns])


def listed(docs: DataFrame, text_col: str = "text", **learn) -> DataFrame:
    """Spans of each distinct text in one row: ``(of_text, spans)``, sorted by kind as listed, then start."""
    spans = spans_of(docs, text_col, **learn)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    # Few for most texts; a text's spans are in its own row in the end.
    return spans.groupBy(F.col("digest").alias("of_text")).agg(
        F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "stop", "kind", "base"))).alias("spans")
    )


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **learn) -> DataFrame:
    """Spans of personal data of every document.

    Copies of a text are searched once and share its spans.  Null text is
    empty; repeated and null ids keep their rows; other columns are not read;
    an empty table gives no rows.

    Returns ``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``;
    the numbers and the digest are of base spans, ``spans`` lists all.
    """
    text = text_or_empty(docs[text_col])
    rows = docs.select(docs[id_col].alias("doc_id"), join_key(text).alias("digest"))
    found = listed(docs, text_col, **learn)
    own = F.coalesce("spans", F.expr("cast(array() as array<struct<rank:int,start:bigint,stop:bigint,kind:string,base:boolean>>)"))

    def line(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    base = F.filter(own, lambda s: s["base"])


    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.join(found, F.col("digest") == F.col("of_text"), "left").select(
        "doc_id", *map(number, KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(own).alias("spans")
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    begun = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, s: Column) -> Column:
        clear = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        put = F.concat(state["done"], clear, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(
            F.when(s["start"] >= state["at"], put).otherwise(state["done"]).alias("done"),
            F.greatest(state["at"], s["stop"]).alias("at"),
        )

    rest = lambda state: F.concat(state["done"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))
    return F.aggregate(ordered, begun, step, rest)
