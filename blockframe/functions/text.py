"""Column functions on text and word lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a token is a run of two or more word characters.
TOKEN_PATTERN = r"(?U)\w{2,}"

CONTENT_TYPE = "array<array<array<string>>>"
ENTITIES_TYPE = "array<array<string>>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def join_words(words) -> Column:
    """Word list to one text."""
    return F.array_join(_col(words), " ")


def join_non_empty(texts) -> Column:
    """Join the non-empty texts of a list with blanks, then trim."""
    kept = F.filter(_col(texts), lambda t: t.isNotNull() & (t != ""))
    return F.regexp_replace(F.array_join(kept, " "), r"(?U)^\s+|\s+$", "")


def words_or_marker(words, marker: str = "empty") -> Column:
    """Word list to one text; a cell without words gives ``marker``."""
    words = _col(words)
    return F.when(F.coalesce(F.size(words), F.lit(0)) <= 0, F.lit(marker)).otherwise(
        F.array_join(words, " ", marker)
    )


def content_text(content) -> Column:
    """Nested table content (rows of cells of words) to one text."""
    return F.array_join(F.flatten(F.flatten(_col(content))), " ")


def parse_nested(text, data_type: str = CONTENT_TYPE) -> Column:
    """A stringified nested list, single or double quoted, back to an array."""
    return F.from_json(_col(text), data_type)


def flatten_content(text) -> Column:
    """Stringified nested content to plain text; text that does not parse stays as it is."""
    text = _col(text)
    return F.coalesce(content_text(parse_nested(text)), text)


def concat_text(*texts) -> Column:
    """Join text columns with blanks, nulls counting as empty text."""
    return F.concat_ws(" ", *[F.coalesce(_col(t), F.lit("")) for t in texts])


def base_name(path) -> Column:
    """Last part of a path."""
    return F.element_at(F.split(_col(path), "/"), -1)


def pdf_name(source) -> Column:
    """Name of the document a result file came from."""
    return F.regexp_replace(_col(source), r"\.json$", ".pdf")


def has_content(text) -> Column:
    """1 when the text holds more than white space."""
    return F.coalesce(_col(text).rlike(r"(?U)\S").cast("int"), F.lit(0))


def tokenize(text) -> Column:
    """Lower-cased runs of at least two word characters, in text order."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN_PATTERN), F.lit(0))


def remove_stop_words(tokens, stop_words) -> Column:
    """Drop the given words from a token list."""
    stop = F.array(*[F.lit(w) for w in sorted(stop_words)])
    return F.filter(_col(tokens), lambda t: ~F.array_contains(stop, t))
