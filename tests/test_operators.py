"""Literal cases, properties and edge cases of the engine's operators."""

import itertools
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import content, geometry, tensors
from pagewright.operators import assembly, binding, documents, layout, metrics, office, tables
from pagewright.streaming.credits import Admission, Credits

LINE = "doc_id bigint, page_no int, line_idx int, text string, left int, top int, right int, bottom int"
BOX = ("left", "top", "right", "bottom")


def lines_of(spark, rows, page=1):
    """Rows (text, left, top, width, height)."""
    return spark.createDataFrame([(1, page, i, t, x, y, x + w, y + h) for i, (t, x, y, w, h) in enumerate(rows)], LINE)


def unbound(lines):
    return lines.select("*", F.lit(None).cast("int").alias("region_idx"), *(F.lit(None).cast("int").alias(f"r_{e}") for e in BOX))


def in_order(lines):
    return [r.text for r in layout.reading_order(unbound(lines)).orderBy("read_idx").collect()]


# --- geometry ---------------------------------------------------------------


def box_frame(spark, pairs):
    names = [f"{p}{e}" for p in ("a_", "b_") for e in BOX]
    return spark.createDataFrame([(*a, *b) for a, b in pairs], ", ".join(f"{n} int" for n in names))


def test_iou_and_overlap(spark):
    big = 1_000_000_000
    df = box_frame(spark, [((0, 0, 10, 10), (0, 0, 10, 10)), ((0, 0, 10, 10), (20, 20, 30, 30)), ((0, 0, 10, 10), (5, 0, 15, 10)), ((-big, -big, big, big), (-big, -big, big, big)), ((0, 0, 0, 0), (0, 0, 5, 5)), ((0, 0, 100, 10), (60, 0, 160, 10))])
    a, b = geometry.Box.named("a_"), geometry.Box.named("b_")
    got = [(round(r[0], 4), r[1]) for r in df.select(geometry.iou(a, b), geometry.overlaps(a, b)).collect()]
    assert got[:3] == [(1.0, True), (0.0, False), (0.3333, True)]
    assert got[4] == (0.0, True) and got[5] == (0.25, True)


def test_centres_truncate_toward_zero(spark):
    values = range(-7, 8)
    df = spark.createDataFrame([(x, y) for x in values for y in values], "left int, right int").selectExpr("*", "left as top", "right as bottom")
    box = geometry.Box.named()
    rows = df.select("left", "right", box.centre_x.alias("x"), box.centre_y.alias("y")).collect()
    assert all(r.x == r.y == int((r.left + r.right) / 2) for r in rows)


def test_polygon_box_clip_and_pixels(spark):
    df = spark.createDataFrame([([(5, 6), (1, 9)],), ([],)], "polygon array<struct<x:int,y:int>>")
    assert [tuple(r.b) for r in df.select(geometry.polygon_box().alias("b")).collect()] == [(1, 6, 5, 9), (0, 0, 0, 0)]
    b = geometry.Box(*(F.lit(v) for v in (-5, 10, 500, 20)))
    r = spark.range(1).select(geometry.clip(b, F.lit(100), F.lit(50)).alias("c"), geometry.clip(b, F.lit(100), F.lit(5)).alias("n"), geometry.pixels(F.lit(36.18)).alias("px"), geometry.clamp32(F.lit(-3)).alias("z"), geometry.clamp32(F.lit(2**40)).alias("m"), geometry.image_twips(F.lit(100.0), F.lit(200.0), F.lit(0.0)).alias("tw")).first()
    assert tuple(r.c) == (0, 10, 100, 20) and tuple(r.n) == (0, 0, 0, 0) and (r.px, r.z, r.m, r.tw) == (101, 0, 2**31 - 1, 720.0)


# --- reading order ----------------------------------------------------------


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(f"{c}{i}", x, 100 * i, 200, 20) for i in (1, 2, 3) for c, x in (("A", 50), ("B", 550))], "A1 A2 A3 B1 B2 B3"),
        ([("B1", 550, 200, 200, 20), ("Title", 200, 40, 600, 20), ("A1", 50, 200, 200, 20), ("A2", 50, 300, 200, 20), ("B2", 550, 300, 200, 20)], "Title A1 A2 B1 B2"),
        ([("one", 0, 0, 10, 10)], "one"),
        ([("b", 5, 0, 10, 10), ("a", 0, 0, 10, 10), ("", 0, 50, 5, 5)], "a b"),
    ],
)
def test_reading_order(spark, rows, want):
    assert " ".join(in_order(lines_of(spark, rows))) == want


def brute_order(units):
    """The definition, cut by cut."""
    if len(units) < 2:
        return [u[4] for u in units]
    best = None
    for axis in (1, 0):
        reach = None
        for start, end in sorted((u[axis], u[axis + 2]) for u in units):
            if reach is not None and start > reach and (best is None or start - reach > best[0]):
                best = (start - reach, axis, reach)
            reach = end if reach is None else max(reach, end)
    if best is None:
        return [u[4] for u in sorted(units, key=lambda u: (u[1], u[0], u[4]))]
    _, axis, at = best
    return brute_order([u for u in units if u[axis] <= at]) + brute_order([u for u in units if u[axis] > at])


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(1, 20), st.integers(1, 20)), max_size=14))
@settings(max_examples=300, deadline=None)
def test_cuts_follow_the_definition(boxes):
    units = [(x, y, x + w, y + h, i) for i, (x, y, w, h) in enumerate(boxes)]
    assert layout.cut_order(units) == brute_order(units)


# --- binding ----------------------------------------------------------------

REGION = "doc_id bigint, page_no int, region_idx int, label string, confidence float, left int, top int, right int, bottom int"


def test_region_argmax_ties_and_edges(spark):
    lines = lines_of(spark, [("in", 10, 10, 20, 10), ("edge", 90, 0, 20, 0), ("out", 500, 500, 4, 4)])
    regions = spark.createDataFrame([(1, 1, 0, "table", 0.6, 0, 0, 100, 100), (1, 1, 1, "text", 0.9, 0, 0, 100, 100), (1, 1, 2, "list", 0.9, 0, 0, 100, 100), (1, 2, 0, "title", 1.0, 0, 0, 900, 900)], REGION)
    got = {r.text: (r.region_idx, r.region_label) for r in binding.bind_regions(lines, regions).collect()}
    assert got == {"in": (1, "text"), "edge": (1, "text"), "out": (None, None)}


def test_merge_keeps_recognised_duplicates_of_one_another(spark):
    digital = lines_of(spark, [("header", 0, 0, 100, 20), ("dup", 0, 100, 100, 20)])
    seen = lines_of(spark, [("dup-ocr", 2, 102, 100, 20), ("footer", 0, 300, 100, 20), ("mid", 0, 200, 100, 20), ("mid", 0, 200, 100, 20)])
    got = [r.text for r in binding.merge_recognised(digital, seen).orderBy("merged_idx").collect()]
    assert got == ["header", "dup", "mid", "mid", "footer"]


def test_suppression(spark):
    rng = random.Random(1)
    rows = [(1, 1, i, rng.choice(["a", "b"]), round(rng.random(), 1), x := rng.randrange(60), y := rng.randrange(60), x + rng.randrange(1, 30), y + rng.randrange(1, 30)) for i in range(80)]
    regions = spark.createDataFrame(rows, REGION)
    want = []
    for label in "ab":
        kept = []
        for r in sorted((r for r in rows if r[3] == label), key=lambda r: (-r[4], r[2])):
            def iou(p, q):
                w, h = max(0, min(p[7], q[7]) - max(p[5], q[5])), max(0, min(p[8], q[8]) - max(p[6], q[6]))
                return w * h / ((p[7] - p[5]) * (p[8] - p[6]) + (q[7] - q[5]) * (q[8] - q[6]) - w * h + 1e-5)
            if all(iou(r, k) <= 0.5 for k in kept):
                kept.append(r)
        want += [r[2] for r in kept]
    assert sorted(r.region_idx for r in binding.suppressed(regions).collect()) == sorted(want)
    assert binding.suppressed(regions, keep=1).count() == 2 and binding.suppressed(regions.limit(0)).count() == 0


# --- tables -----------------------------------------------------------------


def with_region(lines):
    return lines.withColumn("region_idx", F.lit(0))


def test_word_gaps_join_and_blanks_fill(spark):
    lines = with_region(lines_of(spark, [("Total", 50, 100, 60, 20), ("due", 116, 100, 40, 20), ("5", 300, 100, 20, 20), ("Tax", 50, 200, 60, 20), ("1", 300, 300, 20, 20)]))
    grid = {(r.row, r.col): r.text for r in tables.geometry_grid(lines).collect()}
    assert grid == {(0, 0): "Total due", (0, 1): "5", (1, 0): "Tax", (1, 1): "", (2, 0): "", (2, 1): "1"}


@given(st.lists(st.tuples(st.integers(0, 100), st.integers(0, 30)), min_size=1, max_size=12))
@settings(max_examples=200, deadline=None)
def test_running_maximum_equals_the_band_by_band_rule(spans):
    spans = sorted((t, t + h) for t, h in spans)
    walk, band, bottom = [], 0, None
    for t, b in spans:
        if bottom is not None and (t + b) // 2 > bottom:
            band, bottom = band + 1, b
        else:
            bottom = b if bottom is None else max(bottom, b)
        walk.append(band)
    running, band, reach = [], 0, None
    for t, b in spans:
        band += reach is not None and (t + b) // 2 > reach
        reach = b if reach is None else max(reach, b)
        running.append(band)
    assert walk == running


CELL = "doc_id bigint, page_no int, region_idx int, cell_idx int, row int, col int, row_span int, col_span int, header boolean, left int, top int, right int, bottom int"


def test_structured_grid_repeats_spans_and_fills_blanks(spark):
    cells = spark.createDataFrame([(1, 1, 0, 0, 0, 0, 1, 2, True, 0, 0, 100, 20), (1, 1, 0, 1, 1, 0, 1, 1, False, 0, 20, 50, 40)], CELL)
    lines = with_region(lines_of(spark, [("Head", 10, 5, 40, 10), ("x", 5, 25, 10, 10)]))
    grid = {(r.row, r.col): (r.text, r.header) for r in tables.structured_grid(cells, lines).collect()}
    assert grid == {(0, 0): ("Head", True), (0, 1): ("Head", True), (1, 0): ("x", False), (1, 1): ("", False)}
    other = with_region(lines_of(spark, [("free", 0, 0, 10, 10)], page=2))
    routed = {(r.page_no, r.row, r.col): r.text for r in tables.table_grids(lines.unionByName(other), cells).collect()}
    assert routed[(2, 0, 0)] == "free" and routed[(1, 0, 1)] == "Head" and len(routed) == 5


def test_token_placement(spark):
    head = ["<thead>", "<tr>", "<td", ' colspan="2"', ">", "</td>", "<td></td>", "</tr>", "</thead>"]
    body = ["<tr>", "<td", ' rowspan="2"', ">", "</td>", "<td></td>", "<td></td>", "</tr>", "<tr>", "<td></td>", "<td></td>", "</tr>"]
    cells = tables.place_tokens(head + body, [])
    assert len(cells) == 7 and [c[:2] for c in cells] == [(0, 0), (0, 2), (1, 0), (1, 1), (1, 2), (2, 1), (2, 2)]
    assert [c[4] for c in cells] == [True, True] + [False] * 5
    assert tables.place_tokens(["<td></td>"], [(1, 2, 3, 4), (9, 9, 9, 9)]) == [(0, 0, 1, 1, False, 1, 2, 3, 4)]
    df = spark.createDataFrame([(1, ["<tr>", "<td></td>"], [(1, 2, 3, 4)]), (2, [], [])], "id bigint, tokens array<string>, boxes array<struct<left:int,top:int,right:int,bottom:int>>")
    assert [(r.id, r.row, r.col, r.left) for r in tables.token_cells(df, ["id"]).collect()] == [(1, 0, 0, 1)]


def test_fold_caps_the_dense_grid(spark):
    rows = [("a", 0, 0, 0, "A1", "x", 2, 2), ("a", 1, -1, 0, "odd", "y", 2, 2), ("b", 0, 0, 0, "A1", "x", 70, 70), ("a", 2, 9, 9, "far", "z", 2, 2)]
    cells = spark.createDataFrame(rows, "t string, seq int, row int, col int, name string, text string, rows int, cols int")
    placed, grid, fields = tables.fold_cells(cells, ["t"])
    assert placed.count() == 3 and grid.count() == 4 and [tuple(r) for r in fields.collect()] == [("a", "cell:odd", "y")]


# --- assembly ---------------------------------------------------------------


def test_offsets_count_code_points_across_pages(spark):
    items = spark.createDataFrame([(1, 1, 0, "hé"), (1, 1, 1, "世界"), (1, 2, 2, "x"), (2, 1, 0, "")], "doc_id bigint, page_no int, ord int, text string")
    got = [(r.utf_start, r.utf_end) for r in assembly.text_offsets(items, ["page_no", "ord"]).orderBy("doc_id", "ord").collect()]
    assert got == [(0, 2), (3, 5), (6, 7), (0, 0)]
    refs = [r.ref for r in assembly.stable_refs(items, "texts", ["page_no", "ord"]).orderBy("doc_id", "ord").collect()]
    assert refs == ["#/texts/0", "#/texts/1", "#/texts/2", "#/texts/0"]


@pytest.mark.parametrize(("texts", "want"), [(["one", "two", "three"], "one\ntwo\nthree"), (["", "", "a", "", "b"], "a\n\nb"), ([""], "")])
def test_plain_text(spark, texts, want):
    items = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id bigint, ord int, text string")
    assert assembly.plain_text(items).first().text == want


def test_formatting_needs_agreement(spark):
    run = "k string, weight double, italic boolean, underline boolean, strike boolean"
    rows = [("all", 150.0, False, False, False), ("all", 200.0, False, False, False), ("mixed", 150.0, False, False, False), ("mixed", 100.0, False, False, False), ("none", 100.0, False, False, False)]
    got = {r.k: r.bold for r in assembly.uniform_formatting(spark.createDataFrame(rows, run), ["k"]).collect()}
    assert got == {"all": True, "mixed": None, "none": None}


def test_line_charspans_end_with_the_item(spark):
    r = spark.range(1).select(assembly.line_charspan(F.lit(0), F.lit(99), F.lit(10), F.lit(5)).alias("s")).first().s
    assert tuple(r) == (10, 15)


# --- documents --------------------------------------------------------------


def test_merge_and_integrity(spark):
    items = spark.createDataFrame([(1, 0, "texts", 0, "#/texts/0"), (1, 0, "tables", 0, "#/tables/0"), (1, 1, "texts", 0, "#/texts/0"), (1, 1, "tables", 0, "#/tables/0"), (1, 1, "field_items", 0, "#/field_items/0")], "doc_id bigint, plan_ord int, arena string, idx int, ref string")
    edges = spark.createDataFrame([(1, p, "#/body", f"#/{a}/0", i) for p in (0, 1) for i, a in enumerate(("texts", "tables"))] + [(1, 1, "#/body", "#/field_items/0", 2)], "doc_id bigint, plan_ord int, parent_ref string, child_ref string, ord int")
    merged, moved = documents.merge(items, edges)
    assert sorted(r.ref for r in merged.collect()) == ["#/tables/0", "#/tables/1", "#/texts/0", "#/texts/1"]
    assert [r.child_ref for r in moved.orderBy("ord").collect()] == ["#/texts/0", "#/tables/0", "#/texts/1", "#/tables/1"]
    checked = merged.select("doc_id", "ref", F.lit("x").alias("kind"), F.lit("#/body").alias("parent_ref"))
    assert documents.integrity_errors(checked, moved).count() == 0
    assert documents.renumbered(items, merge_all=True).count() == 5


def test_nested_references_are_rewritten(spark):
    df = spark.createDataFrame([(("#/texts/0", [("#/texts/1", "#/texts/0")]),)], "item struct<self_ref:string,children:array<struct<ref:string,note:string>>>")
    mapping = F.create_map(F.lit("#/texts/0"), F.lit("#/texts/7"), F.lit("#/texts/1"), F.lit("#/texts/8"))
    got = documents.rewrite_nested(df, mapping).first()["item"]
    assert got.self_ref == "#/texts/7" and got.children[0].ref == "#/texts/8" and got.children[0].note == "#/texts/0"


# --- contents ---------------------------------------------------------------


@pytest.mark.parametrize(("s", "want"), [("bWVt\nb3J5", "memory"), ("YQ==", "a"), ("YR==", "a"), ("", None), ("abc", None), ("====", None), ("a===", None), ("ab=c", None)])
def test_base64(spark, s, want):
    assert spark.createDataFrame([(s,)], "s string").select(content.decode_base64(F.col("s")).cast("string")).first()[0] == want


def test_names(spark):
    letters = spark.range(1).select(*(content.column_name(F.lit(i)) for i in (0, 25, 26, 701, 702, 16383))).first()
    assert tuple(letters) == ("A", "Z", "AA", "ZZ", "AAA", "XFD")
    files = [("letter.docx", ""), ("Sheet.XLSX", ""), ("x.csv", ""), ("a.pdf", ""), ("a.png", None), ("upload.bin", "application/vnd.oasis.opendocument.text")]
    got = [r[0] for r in spark.createDataFrame(files, "f string, t string").select(content.is_office(F.col("f"), F.col("t"))).collect()]
    assert got == [True, True, True, False, False, True]


def test_softmax_and_ranking(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], ["c", "b", "a"])], "p array<double>, l array<string>")
    r = df.select(tensors.softmax(F.col("p")).alias("s"), tensors.ranked_classes(F.col("p"), F.col("l")).alias("k")).first()
    assert abs(sum(r.s) - 1) < 1e-12 and [x.label for x in r.k] == ["a", "b", "c"]
    gate = spark.createDataFrame([([("qr_code", 0.9)],), ([],)], "k array<struct<label:string,confidence:double>>").select(tensors.barcode_gate(F.col("k"))).collect()
    assert [g[0] for g in gate] == [True, False]


# --- office events ----------------------------------------------------------


def events_of(spark, events):
    return spark.createDataFrame([(1, i, k, json.dumps(p)) for i, (k, p) in enumerate(events)], "doc_id bigint, seq bigint, kind string, payload string")


EVENTS = [
    ("document_info", {"document_id": "d.odt", "source_format": "odt", "page_rects": [{"x_twips": 10, "y_twips": 20, "width_twips": 1000, "height_twips": 2000}, {"x_twips": 10, "y_twips": 2100, "width_twips": 1000, "height_twips": 2000}]}),
    ("metadata", {"title": "T", "author": "me", "keywords": ["a"], "created_epoch_ms": 0}),
    ("paragraph", {"style": "Title", "list_level": -1, "runs": [{"text": "Hé"}, {"text": "llo"}], "page_index": 0, "start": {"x": 30, "y": 40}, "end": {"x": 15, "y": 60}}),
    ("paragraph", {"outline_level": 2, "list_level": -1, "runs": [{"text": "H"}], "char_offset": 7, "line_rects": [{"page_index": 1, "x_twips": 20, "y_twips": 2200, "width_twips": 5, "height_twips": 6, "char_start": 0, "char_end": 9}]}),
    ("comment", {"text": "c1", "char_start": -1}),
    ("comment", {"text": "", "runs": [{"text": "c2"}], "char_start": 3, "char_end": 4}),
    ("form_field", {"kind": "CHECKBOX", "checked": True, "selected_index": -1, "char_start": -1, "parameters": [{"name": "p", "int_value": 3}, {"name": "q"}]}),
    ("slide_shape", {"slide_index": 0, "shape_type": "TableShape"}),
    ("slide", {"index": 0, "name": "s0"}),
    ("slide_shape", {"slide_index": 0, "is_empty_placeholder": True}),
    ("slide_shape", {"slide_index": 0, "placeholder_role": "TITLE", "notes": True, "paragraphs": [{"runs": []}, {"runs": [{"text": "a"}]}, {"runs": [{"text": "b"}]}]}),
    ("shape", {"is_group": True, "z_order": 3, "name": "g"}),
    ("shape", {"group_path": "3", "name": "kid", "runs": [{"text": "k"}], "position": {"x": 100, "y": 2200}, "width_twips": 10, "height_twips": 10}),
    ("sheet", {"index": 0, "name": "S", "visible": False, "used_end_row": 3, "used_end_column": 1}),
    ("sheet_cell_comment", {"sheet_index": 0, "row": 1, "column": 2, "text": "cc"}),
    ("sheet_row", {"sheet_index": 0, "row": 0, "cells": [{"column": 27, "type": "VALUE", "number": 1.5, "display": "1.5", "merged_rows": 2}]}),
    ("sheet_row", {"sheet_index": 5, "row": 0, "cells": [{"column": 0}]}),
    ("embedded_object", {"kind": "CHART", "chart": {"kind": "BAR", "categories": ["a"], "series": [{"values_y": [1.0, 2.0]}, {"values_y": [9.0]}]}}),
    ("page_image", {"index": 4, "width_px": 100, "height_px": 50, "dpi": 100, "png": "QQ=="}),
    ("bookmark", {"name": "b", "char_start": 1, "char_end": 2, "page_index": 0}),
    ("bookmark", {"name": "b", "char_start": 5, "char_end": 6, "page_index": -1}),
    ("status", {"warnings": ["w1"]}),
]


def test_office_items(spark):
    events = events_of(spark, EVENTS)
    items = office.office_items(events)
    got = {r.ref: r for r in items.collect()}
    texts = [(r.label, r.text) for _, r in sorted(got.items(), key=lambda kv: (kv[1].seq, kv[1].sub_ord)) if r.arena == "texts"]
    assert texts == [("TITLE", "Héllo"), ("SECTION_HEADER", "H"), ("TEXT", "c1"), ("TEXT", "c2"), ("CHECKBOX_SELECTED", ""), ("TITLE", "a\nb"), ("TEXT", "k"), ("TEXT", "cc")]
    assert got["#/pictures/0"].parent_ref == "#/body", "a slide that comes later is no parent"
    assert got["#/texts/5"].layer == "NOTES" and got["#/texts/5"].parent_ref == "#/groups/2"
    assert got["#/texts/2"].parent_ref == got["#/texts/3"].parent_ref == "#/groups/0" and got["#/groups/0"].parent_ref == "#/furniture"
    assert got["#/texts/4"].fields["param:p"] == "3" and got["#/texts/4"].fields["param:q"] == "null"
    assert got["#/texts/6"].parent_ref == "#/groups/4" and got["#/groups/4"].parent_ref == "#/groups/3"
    assert {got[r].layer for r in ("#/groups/5", "#/tables/0", "#/texts/7")} == {"INVISIBLE"} and got["#/texts/7"].fields["cell"] == '"C2"'
    assert got["#/warnings/0"].text == "w1"
    prov = {r.ref: (r.page_no, r.left, r.top, r.start, r.end) for r in office.provenance(items, events).collect()}
    assert prov["#/texts/0"] == (1, 5.0, 20.0, 0, 5) and prov["#/texts/1"] == (2, 10.0, 100.0, 7, 8) and prov["#/texts/6"][:3] == (2, 90.0, 100.0)
    assert "#/texts/5" not in prov, "notes have no place on a page"


def test_office_tables_charts_and_identity(spark):
    events = events_of(spark, EVENTS)
    cells = office.sheet_cells(events).collect()
    assert [(c.table_ref, c.row, c.col, c.row_span, c.key, c.value) for c in cells] == [("#/tables/0", 0, 27, 2, "AB1", '{"number":1.5}')]
    assert [(p.label, p.y) for p in office.chart_points(events).orderBy("point_idx").collect()] == [("a", 1.0), ("2", 2.0)]
    who = office.document_identity(events).first()
    assert (who.name, who.mimetype, who.finished) == ("T", "application/vnd.oasis.opendocument.text", True)
    fields = {r.key: r.value for r in office.body_fields(office.office_items(events)).collect()}
    assert json.loads(fields["bookmark:b"]) == {"char_start": 5, "char_end": 6} and "created_epoch_ms" not in fields and fields["author"] == '"me"'
    pages = {r.page_no: (r.width, r.image_uri) for r in office.document_pages(events).collect()}
    assert pages == {1: (1000.0, None), 2: (1000.0, None), 5: (1440.0, "data:image/png;base64,QQ==")}


def test_no_events(spark):
    none = events_of(spark, EVENTS).limit(0)
    assert office.office_items(none).count() == 0 and office.document_pages(none).count() == 0


# --- metrics and credits ----------------------------------------------------


def test_exposition():
    text = metrics.exposition({"pages_ocr": ("counter", "Pages read.", 3)}, [("25", 1), ("+Inf", 6)])
    assert text == '# HELP pages_ocr Pages read.\n# TYPE pages_ocr counter\npages_ocr 3\n# TYPE page_latency histogram\npage_latency_bucket{le="25"} 1\npage_latency_bucket{le="+Inf"} 6\npage_latency_count 6\n'


@given(st.integers(1, 8), st.lists(st.integers(0, 5), max_size=30), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_credits_never_exceed_the_window(window, releases, total):
    credits, seen = Credits.fresh(window), []
    for n in [0, *releases]:
        credits = credits.release(n)
        credits, pages = credits.schedule(total)
        seen += pages
        assert 0 <= credits.available <= window
    assert seen == list(range(1, len(seen) + 1)) and len(seen) <= total


def test_admission():
    a = Admission(1, 1)
    assert [a.submit() for _ in range(3)] == ["active", "queued", "saturated"]
    a.finish()
    assert a.submit() == "queued" and list(itertools.islice([a.active], 1)) == [1]


def test_collectors_are_isolated_and_merged_in_plan_order(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id bigint")

    def reads(tag, failing=None):
        def run(d):
            kept = d if failing is None else d.filter(F.col("doc_id") != failing)
            items = kept.select("doc_id", F.lit("texts").alias("arena"), F.lit(0).alias("idx"), F.lit("#/texts/0").alias("ref"), F.lit(tag).alias("text"))
            edges = kept.select("doc_id", F.lit("#/body").alias("parent_ref"), F.lit("#/texts/0").alias("child_ref"), F.lit(0).alias("ord"))
            bad = d.filter(F.lit(failing is not None) & (F.col("doc_id") == F.lit(failing or 0))).select("doc_id", F.lit("INVALID_ARGUMENT").alias("code"), F.lit("bad").alias("error"))
            return items, edges, bad

        return run

    def breaks(_):
        raise RuntimeError("no service")

    items, edges, outcomes = documents.gather(docs, [("CV", reads("cv", failing=2)), ("LIBREOFFICE", breaks), ("POI", reads("poi"))])
    assert sorted((r.doc_id, r.ref, r.text) for r in items.collect()) == [(1, "#/texts/0", "cv"), (1, "#/texts/1", "poi"), (2, "#/texts/0", "poi")]
    assert sorted((r.doc_id, r.child_ref) for r in edges.collect()) == [(1, "#/texts/0"), (1, "#/texts/1"), (2, "#/texts/0")]
    rolled = {r.doc_id: (r.status, r.message) for r in documents.status_rollup(outcomes).collect()}
    assert rolled == {1: ("PARTIAL_SUCCESS", "no service"), 2: ("PARTIAL_SUCCESS", "bad; no service")}
    codes = spark.createDataFrame([("INTERNAL",), ("INVALID_ARGUMENT",)], "c string").select(documents.collector_code(F.col("c"))).collect()
    assert [c[0] for c in codes] == ["UNAVAILABLE", "INVALID_ARGUMENT"]


def test_counters_are_observed_on_the_way(spark):
    lines = spark.createDataFrame([("a", "OCR"), ("bé", "DIGITAL_PDF")], "text string, origin string")
    seen, counters = metrics.observed(lines)
    assert seen.count() == 2 and counters.get == {"lines": 2, "digital": 1, "recognised": 1, "code_points": 3}


def test_scalar_fields(spark):
    df = spark.createDataFrame([({"a": "1", "b": '"x"', "c": "[1]", "d": "1.5", "e": "true", "f": "null", "g": "{}"},)], "m map<string,string>")
    assert set(df.select(content.scalar_fields(F.col("m"))).first()[0]) == {"a", "b", "d", "e"}
