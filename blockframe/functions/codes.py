"""Fixed codes and colours, and the lookups that apply them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# Relation types in the order cells are listed.
RELATION_TYPES = ("CHILD", "MERGED_CELL", "TABLE_FOOTER", "TABLE_TITLE")

# Codes used as model features; everything else is 0.
CELL_TYPE_CODES = {"MERGED_CELL": 1, "TABLE_FOOTER": 2, "TABLE_TITLE": 3}
ENTITY_TYPE_CODES = {"COLUMN_HEADER": 1, "TABLE_SECTION_TITLE": 2, "TABLE_TITLE": 3}

# Box colours (red, green, blue) by table class.
TABLE_COLOURS = {
    "BIGRID_STACKED": (1.0, 0.0, 0.0),
    "BIGRID": (0.0, 1.0, 0.0),
    "KVP": (1.0, 0.0, 1.0),
}
TABLE_DEFAULT_COLOUR = (0.5, 0.5, 0.5)

# Box colours by predicted cell role; other roles are not drawn.
CELL_COLOURS = {
    "title": (1.0, 0.0, 0.0),
    "key": (0.0, 0.5, 0.0),
    "value": (0.0, 0.0, 1.0),
    "x1": (1.0, 0.5, 0.0),
    "x2": (0.5, 0.0, 0.5),
    "y1": (1.0, 1.0, 0.0),
    "y2": (0.0, 0.75, 0.75),
    "z1": (0.75, 0.5, 0.25),
    "empty": (0.75, 0.75, 0.75),
}

# Box colours by manually tagged cell role.
TAGGED_CELL_COLOURS = {
    "comment": (0.0, 0.0, 1.0),
    "empty": (1.0, 1.0, 0.0),
    "key": (0.0, 1.0, 1.0),
    "value": (1.0, 0.5, 0.0),
    "key_1_x": (0.5, 0.0, 0.0),
    "key_2_x": (0.0, 0.5, 0.0),
    "key_1_y": (0.5, 0.0, 0.5),
    "key_2_y": (0.0, 0.5, 0.5),
    "key_diagonal": (0.5, 0.5, 0.0),
    "merged_helper": (0.5, 0.5, 0.5),
    "title": (0.75, 0.75, 0.75),
}
TAGGED_CELL_DEFAULT_COLOUR = (0.75, 0.75, 0.75)


def lookup(key, mapping: dict, default=None) -> Column:
    """Value of ``key`` in a fixed mapping, ``default`` (or null) when absent."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    found = F.try_element_at(table, _col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def lookup_colour(key, mapping: dict, default=None) -> Column:
    """Colour struct ``(red, green, blue)`` of ``key``, or of the default, or null."""

    def colour(rgb) -> Column:
        return F.struct(*[F.lit(v).alias(n) for v, n in zip(rgb, ("red", "green", "blue"))])

    table = F.create_map(*chain.from_iterable((F.lit(k), colour(v)) for k, v in mapping.items()))
    found = F.try_element_at(table, _col(key))
    return found if default is None else F.coalesce(found, colour(default))


def cell_type_code(cell_type) -> Column:
    return lookup(cell_type, CELL_TYPE_CODES, 0)


def entity_type_code(entity_type) -> Column:
    return lookup(entity_type, ENTITY_TYPE_CODES, 0)


def relation_rank(relation) -> Column:
    """Place of a relation type in the fixed order, from 0; null when not listed."""
    return lookup(relation, {name: i for i, name in enumerate(RELATION_TYPES)})
