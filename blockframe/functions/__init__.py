from .codes import (
    CELL_COLOURS,
    CELL_TYPE_CODES,
    ENTITY_TYPE_CODES,
    RELATION_TYPES,
    TABLE_COLOURS,
    TAGGED_CELL_COLOURS,
    cell_type_code,
    entity_type_code,
    lookup,
    lookup_colour,
    relation_rank,
)
from .geometry import absolute_box, box_columns, page_in_range
from .grid import flatten_grid, grid_width, pad_grid
from .text import (
    base_name,
    concat_text,
    content_text,
    flatten_content,
    has_content,
    join_non_empty,
    join_words,
    parse_nested,
    pdf_name,
    remove_stop_words,
    tokenize,
    words_or_marker,
)
