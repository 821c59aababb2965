from .blocks import (
    decode_documents,
    decode_responses,
    dedupe_blocks,
    load_blocks,
    read_block_pages,
    read_blocks,
    save_blocks,
    store_blocks,
)
from .datasets import (
    concat_datasets,
    load_dataset,
    read_cells,
    read_csv,
    read_tables,
    save_dataset,
    write_csv,
)
from .schema import BLOCK, CELLS, RESPONSE, TABLES
