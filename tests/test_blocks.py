"""Hand-written block graphs with known cells, tables and titles."""

import json

import pytest
from pyspark.sql import functions as F

from blockframe import operators as op
from blockframe import sources as src


def cells(spark, data, name, **options):
    return op.normalize_indices(op.cells_from_blocks(src.read_blocks(spark, data(name)), **options))


def by_id(df, *columns):
    return {r.cell_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_read_blocks_keeps_order_and_source(spark, data):
    blocks = src.read_blocks(spark, [data("overlap"), data("ties")])
    expected = [b["Id"] for b in json.load(open(data("overlap")))]
    got = [r.Id for r in blocks.filter("source = 'overlap.json'").orderBy("pos").collect()]
    assert got == expected
    assert {r.source for r in blocks.select("source").distinct().collect()} == {"overlap.json", "ties.json"}


def test_malformed_document_is_not_dropped_silently(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"Id": "a", ')
    with pytest.raises(Exception):
        src.read_blocks(spark, str(tmp_path)).collect()
    assert src.read_blocks(spark, str(tmp_path), mode="PERMISSIVE").count() == 0


def test_source_name_with_special_characters(spark, tmp_path):
    (tmp_path / "my doc+1.json").write_text('[{"Id": "a", "BlockType": "PAGE"}]')
    assert [r.source for r in src.read_blocks(spark, str(tmp_path)).collect()] == ["my doc+1.json"]


def test_numbered_responses_in_order(spark, data):
    blocks = src.read_block_pages(spark, [data("page2"), data("page1")])
    rows = blocks.orderBy("pos").collect()
    assert [r.Id for r in rows] == ["t", "c1", "w1", "l1"]
    assert {r.source for r in rows} == {"page"} and {r.document_pages for r in rows} == {2}
    assert by_id(op.cells_from_blocks(blocks), "cell_content") == {"c1": ("late",)}


def test_responses_in_a_folder_per_document(spark, data, tmp_path):
    for document in ("a", "b"):
        (tmp_path / document).mkdir()
        for i in (1, 2):
            text = open(data(f"page{i}")).read()
            (tmp_path / document / str(i)).write_text(text)
    blocks = src.read_block_pages(spark, str(tmp_path / "*" / "*"), pattern=r"([^/]+)/(\d+)$")
    assert {r.source: r["count"] for r in blocks.groupBy("source").count().collect()} == {"a": 4, "b": 4}


def test_dangling_ids_are_dropped(spark, data):
    assert by_id(cells(spark, data, "dangling"), "cell_words") == {"c1": (["here"],)}


def _block(block_id, kind, text=None, children=(), relation="CHILD"):
    related = [{"Type": relation, "Ids": list(children)}] if children else None
    return {"Id": block_id, "BlockType": kind, "Text": text, "Relationships": related, "RowIndex": 1, "ColumnIndex": 1}


def test_last_copy_counts_even_without_text_and_any_block_can_be_listed(spark, tmp_path):
    import json

    table = _block("t", "TABLE", children=["c1"])
    table["Relationships"].append({"Type": "TABLE_FOOTER", "Ids": ["l1"]})
    blocks = [table, _block("c1", "CELL", children=["w1", "w2"]), _block("w1", "WORD", "stale"), _block("w1", "WORD"), _block("w2", "WORD", "kept"), _block("l1", "LINE", "foot", ["w2"])]
    (tmp_path / "d.json").write_text(json.dumps([{k: v for k, v in b.items() if v is not None} for b in blocks]))
    found = op.cells_from_blocks(src.read_blocks(spark, str(tmp_path / "d.json")))
    assert by_id(found, "cell_words") == {"c1": (["kept"],), "l1": (["kept"],)}


def test_last_duplicate_wins(spark, data):
    assert by_id(cells(spark, data, "duplicate"), "cell_words") == {"c1": (["new"],)}
    first = src.dedupe_blocks(src.read_blocks(spark, data("duplicate")), keep="first")
    assert by_id(op.cells_from_blocks(first, dedupe=False), "cell_words") == {"c1": (["old"],)}


def test_selection_elements(spark, data):
    assert by_id(cells(spark, data, "selection"), "cell_words") == {"c1": ([],), "c2": (["pick"],)}
    with_status = cells(spark, data, "selection", include_selection=True)
    assert by_id(with_status, "cell_words") == {"c1": (["SELECTED"],), "c2": (["pick", "NOT_SELECTED"],)}


def test_table_without_relations_and_cell_without_geometry(spark, data):
    got = cells(spark, data, "emptytable")
    rows = got.collect()
    assert [(r.table_id, r.cell_id) for r in rows] == [("t2", "c1")]
    r = rows[0]
    assert (r.row_index, r.column_index, r.row_span, r.column_span) == (0, 0, 1, 1)
    assert r.cell_width is None and r.cell_words == [] and r.cell_content == ""
    assert [t.table_id for t in op.summarize_tables(got).collect()] == ["t2"]


def test_title_and_footer_form_row_zero(spark, data):
    got = cells(spark, data, "titlefooter")
    order = [r.cell_type for r in got.orderBy("rel_rank", "pos").collect()]
    assert order == ["CHILD", "TABLE_FOOTER", "TABLE_TITLE"]
    table = op.summarize_tables(got).first()
    assert table.content == [[["foot"], ["big", "title"]], [["x"]]]
    assert table.entities == [["normal"]]
    assert (table.table_title_count, table.table_footer_count, table.child_count, table.cell_count) == (1, 1, 1, 3)
    assert op.table_content(got).first().content == table.content
    assert op.table_entities(got).first().entities == table.entities


def test_content_holds_merged_cells_as_empty_lists(spark, data):
    table = op.summarize_tables(cells(spark, data, "overlap")).first()
    assert table.content == [[["a"], [], [], ["d"]], [["b"], ["e"]]]
    assert table.entities == [["COLUMN_HEADER", "normal"], ["normal", "normal"]]
    assert (table.row_count, table.column_count, table.cell_count, table.merged_cell_count) == (2, 2, 6, 2)
    assert table.table_type == "STRUCTURED_TABLE"
    lean = op.summarize_tables(cells(spark, data, "overlap"), content=False).first()
    assert (lean.row_count, lean.cell_count) == (2, 6)
    distinct = op.summarize_tables(cells(spark, data, "titlefooter"), grid_size="distinct").first()
    assert (distinct.row_count, distinct.column_count) == (2, 2)


@pytest.mark.parametrize("replay_all", [False, True])
def test_overlapping_merged_cells(spark, data, replay_all):
    got = by_id(
        op.overlay_merged_cells(cells(spark, data, "overlap"), replay_all=replay_all),
        "cell_content", "merged_parent_cell_id", "has_merged_parent", "cell_words",
    )
    assert got["c11"] == ("a b d", "m2", 1, ["a"])
    assert got["c21"] == ("a b", "m1", 1, ["b"])
    assert got["c12"] == ("a b d", "m2", 1, ["d"])
    assert got["c22"] == ("e", "None", 0, ["e"])
    assert got["m1"] == ("", "None", 0, [])


def test_titles_and_ties(spark, data):
    blocks = src.read_blocks(spark, data("ties"))
    titles = op.layout_titles(blocks)
    assert {r.layout_title_id: r.layout_title_text for r in titles.collect()} == {
        "ti1": "First title", "ti2": "Second title", "ti3": "Low title",
    }
    tables = op.summarize_tables(op.normalize_indices(op.cells_from_blocks(blocks)))
    both = op.attach_page_title(tables, titles, ties="all")
    assert sorted(r.layout_title_text for r in both.collect()) == ["First title", "Second title"]
    first = op.attach_page_title(tables, titles, ties="first").collect()
    assert [r.layout_title_text for r in first] == ["First title"]


def test_document_without_titles_keeps_its_tables(spark, data):
    blocks = src.read_blocks(spark, data("notitle"))
    tables = op.summarize_tables(op.normalize_indices(op.cells_from_blocks(blocks)))
    rows = op.attach_page_title(tables, op.layout_titles(blocks)).collect()
    assert [r.layout_title_text for r in rows] == [None]


def test_title_options(spark):
    rows = [
        ("s", 0, "ti", "LAYOUT_TITLE", None, [("CHILD", ["l1", "w1"]), ("OTHER", ["l2"])]),
        ("s", 1, "l1", "LINE", "one", None),
        ("s", 2, "w1", "WORD", "two", None),
        ("s", 3, "l2", "LINE", "three", None),
    ]
    schema = (
        "source string, pos long, Id string, BlockType string, Text string, "
        "Relationships array<struct<Type:string,Ids:array<string>>>"
    )
    blocks = spark.createDataFrame(rows, schema).withColumns(
        {"Page": F.lit(1), "Confidence": F.lit(9.0)}
    )

    def text(**options):
        return op.layout_titles(blocks, **options).first().layout_title_text

    assert text() == "one two"
    assert text(line_only=True) == "one"
    assert text(all_relations=True) == "one two three"
    assert text(line_only=True, all_relations=True) == "one three"


def test_block_report(spark, data):
    report = {r.block_id: r for r in op.block_report(src.read_blocks(spark, data("selection"))).collect()}
    assert report["s1"].selection == "Selected" and report["s2"].selection == "Not selected"
    assert report["w1"].text == "pick" and report["w1"].confidence == "99.00%"
    assert report["c2"].column_index == 2 and "w1" in report["c2"].relationships
    assert report["w1"].row_index is None and report["w1"].selection is None
    page = op.block_report(src.read_blocks(spark, data("overlap"))).filter("block_id = 'p'").first()
    assert page.confidence is None and page.box_width == 1.0


def test_report_without_confidence(spark):
    block = _block("w", "WORD", "text") | {"Confidence": None}
    rows = src.decode_documents(spark.createDataFrame([("s", json.dumps([{k: v for k, v in block.items() if v is not None}]))], "source string, value string"))
    assert op.block_report(rows).first().confidence is None


def test_same_document_under_two_names_stays_apart(spark, data, tmp_path):
    for name in ("x", "y"):
        (tmp_path / f"{name}.json").write_text(open(data("overlap")).read())
    got = op.normalize_indices(op.cells_from_blocks(src.read_blocks(spark, str(tmp_path))))
    assert got.count() == 12
    assert {r.cell_count for r in op.table_counts(got).collect()} == {6}


def test_blocks_as_json_lines_round_trip(spark, data, tmp_path):
    blocks = src.read_blocks(spark, data("overlap"))
    src.save_blocks(blocks, str(tmp_path / "blocks"))
    back = src.load_blocks(spark, str(tmp_path / "blocks"))
    assert back.exceptAll(blocks.select(*back.columns)).isEmpty() and back.count() == blocks.count()
