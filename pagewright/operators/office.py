"""Typed office events to document items, in one pass.

``events``: doc_id, seq, kind, payload (JSON).  One projection turns every event
into the items it makes; one explode and windows for numbers, parents and layers
finish the document.  An event only sees what came before
it: a parent is the latest definition with a smaller sequence number.

Values of custom fields are JSON texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.content import a1_name, a1_range, office_mime_type
from pagewright.operators import assembly, tables
from pagewright.operators.grouped import spread

RUN = "array<struct<text string, weight double, italic boolean, underline boolean, strikethrough boolean, hyperlink_url string, hyperlink_target string, hyperlink_name string>>"
RECT = "array<struct<page_index int, x_twips bigint, y_twips bigint, width_twips bigint, height_twips bigint, char_start bigint, char_end bigint>>"
PROV = "array<struct<page_index int, local boolean, left double, top double, right double, bottom double, start bigint, end bigint>>"
CELLS = "array<struct<row int, col int, row_span int, col_span int, name string, text string, at struct<page_index int, left double, top double, right double, bottom double>>>"
TABLE_CELLS = f"array<struct<row int, column int, name string, text string, line_rects {RECT}>>"
SHEET_CELLS = "array<struct<column int, type string, formula string, number double, display string, merged_columns int, merged_rows int>>"
RANGE = "struct<start_row int, start_column int, end_row int, end_column int>"
SERIES = "array<struct<label string, values_y array<double>, values_x array<double>>>"
ITEM = (
    f"struct<arena string, label string, layer string, name string, text string, level int, parent_kind string, parent_key string, defines string, define_key string, "
    f"fields map<string,string>, runs {RUN}, prov {PROV}, rows int, cols int, cells {CELLS}, image_uri string>"
)
SALTS = 16
SECTIONS = {"comment": "comments", "form_field": "form", "sheet_cell_comment": "sheet_comments"}
PICTURE_SHAPES = ("GraphicObjectShape", "OLE2Shape", "TableShape", "MediaShape")


def get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("v"), f"$.{path}", kind)


def text_of(path: str) -> Column:
    return F.coalesce(get(path), F.lit(""))


def number(path: str, default: int = 0, kind: str = "bigint") -> Column:
    return F.coalesce(get(path, kind), F.lit(default).cast(kind))


def flag(path: str) -> Column:
    return F.coalesce(get(path, "boolean"), F.lit(False))


def has(path: str) -> Column:
    return get(path, "variant").isNotNull()


def json(path: str) -> Column:
    return F.to_json(get(path, "variant"))


def quoted(value: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)


def filled(*paths: str) -> dict[str, Column]:
    """Fields that are there and neither empty nor zero."""
    return {p: F.when(~json(p).isin('""', "0", "[]", "{}", "null"), json(p)) for p in paths}


def plain(*paths: str, **other: Column) -> dict[str, Column]:
    return {p: F.coalesce(json(p), F.lit('""')) for p in paths} | other


def fields(values: dict[str, Column]) -> Column:
    pairs = [x for k, c in values.items() for x in (F.lit(k), c.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, c: c.isNotNull())


def runs(path: str = "runs") -> Column:
    return F.coalesce(get(path, RUN), F.array().cast(RUN))


def joined(r: Column) -> Column:
    return F.array_join(F.transform(r, lambda x: F.coalesce(x["text"], F.lit(""))), "")


def length(r: Column) -> Column:
    return F.char_length(joined(r)).cast("bigint")


def prov(page: Column, local: bool | Column, left: Column, top: Column, right: Column, bottom: Column, start: Column | int = 0, end: Column | int = 0) -> Column:
    as_long = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("bigint")
    row = F.struct(
        page.cast("int").alias("page_index"),
        (local if isinstance(local, Column) else F.lit(local)).alias("local"),
        *(c.cast("double").alias(n) for c, n in ((left, "left"), (top, "top"), (right, "right"), (bottom, "bottom"))),
        as_long(start).alias("start"),
        as_long(end).alias("end"),
    )
    return F.array(row).cast(PROV)


def no_prov() -> Column:
    return F.array().cast(PROV)


def caret(a: str = "anchor", b: str = "anchor", start: Column | int = 0, end: Column | int = 0) -> Column:
    x1, y1, x2, y2 = number(f"{a}.x"), number(f"{a}.y"), number(f"{b}.x"), number(f"{b}.y")
    return prov(number("page_index"), False, F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2), start, end)


def sized(at: str, local: bool | Column, page: Column | None = None, start: Column | int = 0, end: Column | int = 0) -> Column:
    x, y = number(f"{at}.x"), number(f"{at}.y")
    return prov(number("page_index") if page is None else page, local, x, y, x + number("width_twips"), y + number("height_twips"), start, end)


def measured(start: Column, end: Column) -> Column:
    """One place for each measured line; its span moves by the item's start and ends with the item."""
    to = lambda x: F.least(start + x, end)
    return F.transform(
        F.coalesce(get("line_rects", RECT), F.array().cast(RECT)),
        lambda r: F.struct(
            r["page_index"].alias("page_index"), F.lit(False).alias("local"), r["x_twips"].cast("double").alias("left"), r["y_twips"].cast("double").alias("top"),
            (r["x_twips"] + r["width_twips"]).cast("double").alias("right"), (r["y_twips"] + r["height_twips"]).cast("double").alias("bottom"), to(r["char_start"]).alias("start"), to(r["char_end"]).alias("end"),
        ),
    ).cast(PROV)


def lines_or(other: Column, start: Column | None = None, end: Column | None = None) -> Column:
    zero = F.lit(0).cast("bigint")
    m = measured(zero if start is None else start, zero if end is None else end)
    return F.when(F.size(m) > 0, m).otherwise(other)


def item(arena: str, label: Column | str, *, layer: Column | str = "BODY", name: Column | None = None, text: Column | None = None, level: Column | None = None, parent: tuple | str = "body", defines: tuple | None = None, own: dict | Column | None = None, run: Column | None = None, at: Column | None = None, rows: Column | None = None, cols: Column | None = None, cells: Column | None = None, image: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    kind, key = parent if isinstance(parent, tuple) else (parent, F.lit(""))
    made, made_key = defines or (F.lit(None), F.lit(None))
    values = {
        "arena": lit(arena), "label": lit(label), "layer": lit(layer), "name": name, "text": text, "level": level, "parent_kind": lit(kind), "parent_key": lit(key), "defines": lit(made), "define_key": lit(made_key),
        "fields": fields(own) if isinstance(own, dict) and own else own if isinstance(own, Column) else F.create_map().cast("map<string,string>"),
        "runs": run, "prov": no_prov() if at is None else at, "rows": rows, "cols": cols, "cells": cells, "image_uri": image,
    }
    return F.struct(*((F.lit(None) if v is None else v).alias(k) for k, v in values.items())).cast(ITEM)


def items_of(*parts: Column) -> Column:
    return F.array(*parts).cast(f"array<{ITEM}>")


def field_item(prefix: str, key: Column, value: Column) -> Column:
    """A field of the body; of one key, the last event's stays."""
    return items_of(item("fields", "FIELD", name=F.concat(F.lit(prefix), key), text=value))


def picture_uri(mime: str, data: str) -> Column:
    return F.when(text_of(data) != "", F.concat(F.lit("data:"), text_of(mime), F.lit(";base64,"), text_of(data)))


def first_page_box(rects: Column) -> Column:
    """The hull of the lines on the first page that one of them is on; null without such a line."""
    known = F.filter(F.coalesce(rects, F.array().cast(RECT)), lambda r: r["page_index"] >= 0)
    page = F.get(known, F.lit(0))["page_index"]
    there = F.filter(known, lambda r: r["page_index"] == page)
    z = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    hull = {
        "left": F.array_min(F.transform(there, lambda r: z(r["x_twips"]))),
        "top": F.array_min(F.transform(there, lambda r: z(r["y_twips"]))),
        "right": F.array_max(F.transform(there, lambda r: z(r["x_twips"]) + z(r["width_twips"]))),
        "bottom": F.array_max(F.transform(there, lambda r: z(r["y_twips"]) + z(r["height_twips"]))),
    }
    return F.when(F.size(known) > 0, F.struct(page.alias("page_index"), *(c.alias(n) for n, c in hull.items())))


def folded(path: str) -> dict[str, Column]:
    """Size and cells of a table payload; cells with a negative place become fields."""
    cells = F.coalesce(get(f"{path}cells", TABLE_CELLS), F.array().cast(TABLE_CELLS))
    inside = F.filter(cells, lambda c: (c["row"] >= 0) & (c["column"] >= 0))
    outside = F.filter(cells, lambda c: (c["row"] < 0) | (c["column"] < 0))
    one = F.lit(1)
    return {
        "rows": number(f"{path}rows", 0, "int"),
        "cols": number(f"{path}columns", 0, "int"),
        "cells": F.transform(inside, lambda c: F.struct(c["row"].alias("row"), c["column"].alias("col"), one.alias("row_span"), one.alias("col_span"), c["name"].alias("name"), c["text"].alias("text"), first_page_box(c["line_rects"]).alias("at"))).cast(CELLS),
        "own": F.map_from_entries(F.transform(outside, lambda c: F.struct(F.concat(F.lit("cell:"), F.coalesce(c["name"], F.lit(""))), quoted(F.coalesce(c["text"], F.lit("")))))),
    }


def range_text(path: str) -> Column:
    r = get(path, RANGE)
    z = lambda c: F.coalesce(c, F.lit(0))
    return a1_range(z(r["start_row"]), z(r["start_column"]), z(r["end_row"]), z(r["end_column"]))


def range_list(path: str) -> Column:
    ranges = F.coalesce(get(path, f"array<{RANGE}>"), F.array().cast(f"array<{RANGE}>"))
    names = F.transform(ranges, lambda r: a1_range(F.coalesce(r["start_row"], F.lit(0)), F.coalesce(r["start_column"], F.lit(0)), F.coalesce(r["end_row"], F.lit(0)), F.coalesce(r["end_column"], F.lit(0))))
    return F.when(F.size(ranges) > 0, F.to_json(names))


def child_path(group: str = "group_path") -> Column:
    return F.when(text_of(group) == "", number("z_order").cast("string")).otherwise(F.concat(text_of(group), F.lit("/"), number("z_order").cast("string")))


def _paragraph() -> Column:
    r = runs()
    start = F.greatest(F.lit(0).cast("bigint"), number("char_offset"))
    outline, listed = number("outline_level", 0, "int"), number("list_level", 0, "int")
    label = F.when(text_of("style") == "Title", "TITLE").when(outline >= 1, "SECTION_HEADER").when(listed >= 0, "LIST_ITEM").otherwise("TEXT")
    level = F.when((text_of("style") != "Title") & (outline >= 1), outline)
    return items_of(item("texts", label, text=joined(r), level=level, run=r, at=lines_or(caret("start", "end", start, start + length(r)), start, start + length(r))))


def _table() -> Column:
    return items_of(item("tables", "TABLE", at=lines_or(caret("start", "end")), **folded("")))


def _embedded_image() -> Column:
    at = F.when(has("anchor"), sized("anchor", False)).otherwise(lines_or(no_prov()))
    return items_of(item("pictures", "PICTURE", parent=("writer", text_of("group_path")), own=filled("name"), at=at, image=picture_uri("mime_type", "data")))


def _footnote() -> Column:
    r = runs()
    return items_of(item("texts", "FOOTNOTE", text=joined(r), run=r, own=filled("label") | {"endnote": flag("endnote")}, at=caret(end=length(r))))


def _header_footer() -> Column:
    label = F.when(flag("footer"), "PAGE_FOOTER").otherwise("PAGE_HEADER")
    paragraphs = F.coalesce(get("paragraphs", f"array<struct<runs {RUN}>>"), F.array().cast(f"array<struct<runs {RUN}>>"))
    return F.transform(paragraphs, lambda p: item("texts", label, layer="FURNITURE", parent="furniture", text=joined(p["runs"]), run=p["runs"], own={"page_style": quoted(text_of("page_style"))})).cast(f"array<{ITEM}>")


def _page_style() -> Column:
    names = [f"{n}_twips" for n in ("width", "height", "margin_left", "margin_right", "margin_top", "margin_bottom")]
    return field_item("page_style:", text_of("name"), F.to_json(F.struct(*(number(n).cast("double").alias(n) for n in names), number("columns").cast("double").alias("columns"))))


def _document_index() -> Column:
    r = runs()
    return items_of(item("texts", "DOCUMENT_INDEX", text=joined(r), run=r, own={"index_type": quoted(text_of("type"))} | filled("title"), at=caret(end=length(r))))


def _drawing_shape() -> Column:
    r = runs()
    page = number("page_index").cast("string")
    key = lambda path: F.concat(page, F.lit(":"), path)
    parent, shape = ("draw", key(text_of("group_path"))), {"shape_type": quoted(text_of("shape_type"))}
    group = item("groups", "PICTURE_AREA", name=text_of("name"), parent=parent, defines=("draw", key(child_path())))
    text = item("texts", "TEXT", text=joined(r), run=r, parent=parent, own=shape, at=sized("position", True, end=length(r)))
    picture = item("pictures", "PICTURE", parent=parent, own=shape | filled("name"), at=sized("position", True))
    return items_of(F.when(flag("is_group"), group).when(flag("has_text"), text).otherwise(picture))


def _slide() -> Column:
    own = {"layout": number("layout").cast("string")} | filled("master_page_name")
    return items_of(item("groups", "SLIDE", name=text_of("name"), own=own, defines=("slide", number("index").cast("string"))))


def _slide_shape() -> Column:
    kind = f"array<struct<outline_depth int, runs {RUN}>>"
    paragraphs = F.coalesce(get("paragraphs", kind), F.array().cast(kind))
    spoken = F.filter(paragraphs, lambda p: F.size(F.coalesce(p["runs"], F.array().cast(RUN))) > 0)
    parent, layer = ("slide", number("slide_index").cast("string")), F.when(flag("notes"), "NOTES").otherwise("BODY")
    page = F.when(flag("notes"), F.lit(-1)).otherwise(number("slide_index"))
    at = lambda end: sized("position", True, page, 0, end)
    ends = F.lit(False)
    for s in PICTURE_SHAPES:
        ends = ends | text_of("shape_type").endswith(s)
    picture = item("pictures", "PICTURE", layer=layer, parent=parent, own={"shape_type": quoted(text_of("shape_type"))}, at=at(0))

    def line(p: Column) -> Column:
        top = F.coalesce(p["outline_depth"], F.lit(0)) == 0
        return item("texts", F.when(top, "SECTION_HEADER").otherwise("LIST_ITEM"), layer=layer, parent=parent, text=joined(p["runs"]), level=F.when(top, 1), run=p["runs"], at=at(length(p["runs"])))

    # a paragraph before which nothing was said adds no newline
    texts = F.transform(paragraphs, lambda p: joined(F.coalesce(p["runs"], F.array().cast(RUN))))
    text = F.aggregate(texts, F.lit(""), lambda a, t: F.when(a == "", t).otherwise(F.concat(a, F.lit("\n"), t)))
    size = F.aggregate(texts, F.lit(0).cast("bigint"), lambda a, t: a + F.char_length(t))
    role = text_of("placeholder_role")
    whole = item("texts", F.when(role == "TITLE", "TITLE").otherwise("TEXT"), layer=layer, parent=parent, text=text, at=at(size))
    nothing = F.array().cast(f"array<{ITEM}>")
    return (
        F.when(flag("is_empty_placeholder"), nothing)
        .when((F.size(spoken) == 0) & ends, items_of(picture))
        .when(F.size(spoken) == 0, nothing)
        .when(role == "OUTLINE", F.transform(spoken, line).cast(f"array<{ITEM}>"))
        .otherwise(items_of(whole))
    )


def _framed(group: Column, r: Column, at: Column) -> Column:
    return items_of(group, item("texts", "TEXT", text=joined(r), run=r, parent="own", at=at))


def _text_frame() -> Column:
    r = runs()
    group = item("groups", "UNSPECIFIED", name=text_of("name"), own=filled("chain_next", "chain_prev"), defines=("own", F.lit("")))
    return _framed(group, r, F.when(has("anchor"), sized("anchor", False, end=length(r))).otherwise(no_prov()))


def _shape() -> Column:
    r = runs()
    parent, kind = ("writer", text_of("group_path")), {"shape_type": quoted(text_of("shape_type"))}
    area = item("groups", "PICTURE_AREA", name=text_of("name"), parent=parent, own=kind, defines=("writer", child_path()))
    group = item("groups", "UNSPECIFIED", name=text_of("name"), parent=parent, own=kind | filled("chain_next", "chain_prev"), defines=("own", F.lit("")))
    # a shape without anchor lies on the page that holds its middle: page -2 asks for it
    at = F.when(has("anchor"), sized("anchor", False, end=length(r))).when(has("position"), sized("position", False, F.lit(-2), 0, length(r))).otherwise(no_prov())
    return F.when(flag("is_group"), items_of(area)).otherwise(_framed(group, r, at))


def _embedded_object() -> Column:
    local = ~has("anchor")
    at = lambda end: F.when(has("anchor"), sized("anchor", local, end=end)).otherwise(sized("position", local, end=end))
    formula = item("texts", "FORMULA", text=text_of("formula"), own=filled("name"), at=at(F.octet_length(text_of("formula")).cast("bigint")))
    inner = folded("inner_table.")
    sheet = item("tables", "TABLE", at=at(0), **(inner | {"own": F.map_concat(F.map_filter(inner["own"], lambda k, _: k != "name"), fields(filled("name")))}))
    label = F.when(text_of("kind") == "CHART", "CHART").otherwise("PICTURE")
    tabular = folded("chart.tabular.")
    picture = item("pictures", label, own=filled("name", "clsid"), at=at(0), image=picture_uri("replacement_mime_type", "replacement_image"), rows=F.when(label == "CHART", tabular["rows"]), cols=F.when(label == "CHART", tabular["cols"]), cells=F.when(label == "CHART", tabular["cells"]))
    return items_of(F.when(text_of("kind") == "FORMULA", formula).when(text_of("kind") == "SPREADSHEET", sheet).otherwise(picture))


def _sheet() -> Column:
    layer = F.when(flag("visible"), "BODY").otherwise("INVISIBLE")
    key = number("index").cast("string")
    own = {"visible": flag("visible"), "tab_color_rgb": F.when(number("tab_color_rgb", 0) >= 0, number("tab_color_rgb", 0)), "print_areas": range_list("print_areas")}
    zero = F.lit(0)
    group = item("groups", "SHEET", layer=layer, name=text_of("name"), own=own, defines=("sheet", key))
    table = item("tables", "TABLE", layer=layer, parent=("sheet", key), defines=("sheet_table", key), rows=number("used_end_row", 0, "int") + 1, cols=number("used_end_column", 0, "int") + 1, at=prov(number("index"), True, zero, zero, zero, zero))
    return items_of(group, table)


def _named_range() -> Column:
    return field_item("named_range:", text_of("name"), F.to_json(F.struct(text_of("content").alias("content"), number("type_flags").cast("double").alias("type_flags"))))


def _database_range() -> Column:
    value = F.struct(number("sheet_index").cast("double").alias("sheet_index"), range_text("range").alias("range"), *(flag(n).alias(n) for n in ("contains_header", "totals_row", "auto_filter")))
    return field_item("database_range:", text_of("name"), F.to_json(value))


def _sheet_key() -> Column:
    return number("sheet_index").cast("string")


def _sheet_cell_comment() -> Column:
    own = {"cell": quoted(a1_name(number("row", 0, "int"), number("column", 0, "int")))} | filled("author", "date") | {"visible": flag("visible")}
    section = item("groups", "COMMENT_SECTION", layer="SHEET", name=F.lit("comments"), parent=("sheet", _sheet_key()), defines=("sheet_comments", _sheet_key()))
    text = item("texts", "TEXT", layer="SHEET", text=text_of("text"), own=own, parent=("sheet_comments", _sheet_key()))
    return F.when(F.col("first"), items_of(section, text)).otherwise(items_of(text))


def _sheet_chart() -> Column:
    zero = F.lit(0)
    own = {"name": quoted(text_of("name")), "source_ranges": range_list("ranges"), "has_column_headers": flag("has_column_headers"), "has_row_headers": flag("has_row_headers")}
    return items_of(item("pictures", "CHART", layer="SHEET", parent=("sheet", _sheet_key()), own=own, at=prov(number("sheet_index"), True, zero, zero, zero, zero)))


def _sheet_pivot_table() -> Column:
    zero = F.lit(0)
    out = lambda n: number(f"output_range.{n}", 0, "int")
    own = {"pivot_table": quoted(text_of("name")), "source_range": quoted(range_text("source_range")), "output_range": quoted(range_text("output_range"))} | filled("row_fields", "column_fields", "data_fields", "page_fields")
    return items_of(item("tables", "TABLE", layer="SHEET", parent=("sheet", _sheet_key()), own=own, rows=out("end_row") - out("start_row") + 1, cols=out("end_column") - out("start_column") + 1, at=prov(number("sheet_index"), True, zero, zero, zero, zero)))


def _comment() -> Column:
    r = runs()
    text = F.when(text_of("text") != "", text_of("text")).otherwise(joined(r))
    spanned = number("char_start") >= 0
    own = (
        filled("name", "author", "initials")
        | {"date_ms": F.when(number("epoch_ms") != 0, number("epoch_ms")), "resolved": F.when(flag("resolved"), F.lit(True)), "reply_to": F.when(text_of("parent_name") != "", json("parent_name")), "char_start": F.when(spanned, number("char_start")), "char_end": F.when(spanned, number("char_end"))}
        | filled("anchored_text")
    )
    section = item("groups", "COMMENT_SECTION", layer="FURNITURE", name=F.lit("comments"), parent="furniture", defines=("comments", F.lit("")))
    body = item("texts", "TEXT", layer="FURNITURE", text=text, own=own, parent="comments", at=caret(end=length(r)))
    return F.when(F.col("first"), items_of(section, body)).otherwise(items_of(body))


def _some(path: str, alias: str, condition: Column | None = None, value: Column | None = None) -> Column:
    value = get(path) if value is None else value
    return F.when((text_of(path) != "") if condition is None else condition, value).alias(alias)


def _tracked_change() -> Column:
    kind = F.when(text_of("kind_name") == "", "Unspecified").otherwise(text_of("kind_name"))
    later = F.struct(text_of("successor.kind_name").alias("kind"), _some("successor.author", "author"), F.when(number("successor.epoch_ms") != 0, number("successor.epoch_ms")).alias("date_ms"))
    value = F.struct(
        kind.alias("kind"), _some("author", "author"), F.when(number("epoch_ms") != 0, number("epoch_ms")).alias("date_ms"), _some("comment", "comment"),
        number("char_start").alias("char_start"), number("char_end").alias("char_end"), _some("changed_text", "text"), F.when(has("successor"), later).alias("supersedes"),
    )
    return field_item("tracked_change:", number("index").cast("string"), F.to_json(value))


def _bookmark() -> Column:
    page = number("page_index")
    value = F.struct(number("char_start").alias("char_start"), number("char_end").alias("char_end"), F.when(page >= 0, page + 1).alias("page"), _some("covered_text", "text"))
    return field_item("bookmark:", text_of("name"), F.to_json(value))


def _form_field() -> Column:
    box = text_of("kind") == "CHECKBOX"
    label = F.when(box & flag("checked"), "CHECKBOX_SELECTED").when(box, "CHECKBOX_UNSELECTED").otherwise("TEXT")
    text = F.when(text_of("text") != "", text_of("text")).otherwise(text_of("label"))
    spanned, chosen = number("char_start") >= 0, number("selected_index") >= 0
    own = (
        filled("field_type", "name", "label")
        | {"control": F.when(flag("control"), F.lit(True)), "checked": F.when(box, flag("checked")), "selected_index": F.when(chosen, number("selected_index"))}
        | filled("list_entries")
        | {"char_start": F.when(spanned, number("char_start")), "char_end": F.when(spanned, number("char_end"))}
    )
    kinds = "array<struct<name string, bool_value variant, int_value variant, double_value variant, string_value variant, string_list variant>>"
    given = F.coalesce(get("parameters", kinds), F.array().cast(kinds))
    typed = lambda p: F.coalesce(*(F.to_json(p[n]) for n in ("bool_value", "int_value", "double_value", "string_value", "string_list")), F.lit("null"))
    extra = F.map_from_entries(F.transform(given, lambda p: F.struct(F.concat(F.lit("param:"), p["name"]), typed(p))))
    at = F.when(flag("control") & (number("width_twips") > 0) & has("anchor"), sized("anchor", False)).otherwise(caret())
    section = item("groups", "FORM_AREA", name=F.lit("form_fields"), defines=("form", F.lit("")))
    body = item("texts", label, text=text, own=F.map_concat(fields(own), extra), parent="form", at=at)
    return F.when(F.col("first"), items_of(section, body)).otherwise(items_of(body))


def _metadata() -> Column:
    names = ("author", "subject", "keywords", "created_epoch_ms", "modified_epoch_ms", "modified_by", "generator", "printed_epoch_ms", "printed_by", "template_name", "statistics", "user_properties", "language")
    pairs = F.map_entries(fields(filled(*names)))
    return F.transform(pairs, lambda p: item("fields", "FIELD", name=p["key"], text=p["value"])).cast(f"array<{ITEM}>")


def _status() -> Column:
    warnings = F.coalesce(get("warnings", "array<string>"), F.array().cast("array<string>"))
    return F.transform(warnings, lambda w: item("warnings", "WARNING", text=w)).cast(f"array<{ITEM}>")


MAKERS = {
    "metadata": _metadata, "status": _status, "paragraph": _paragraph, "table": _table, "embedded_image": _embedded_image, "footnote": _footnote, "header_footer": _header_footer, "page_style": _page_style,
    "document_index": _document_index, "drawing_shape": _drawing_shape, "slide": _slide, "slide_shape": _slide_shape, "text_frame": _text_frame, "shape": _shape, "embedded_object": _embedded_object,
    "sheet": _sheet, "sheet_named_range": _named_range, "sheet_database_range": _database_range, "sheet_cell_comment": _sheet_cell_comment, "sheet_chart": _sheet_chart, "sheet_pivot_table": _sheet_pivot_table,
    "comment": _comment, "tracked_change": _tracked_change, "bookmark": _bookmark, "form_field": _form_field,
}


def parsed(events: DataFrame) -> DataFrame:
    return events.select("doc_id", "seq", "kind", F.parse_json("payload").alias("v"))


def office_items(events: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Items of all arenas with ``ref`` and ``parent_ref``.

    ``kinds`` limits the work to some event kinds, as a request for parts would.
    """
    makers = {k: f for k, f in MAKERS.items() if kinds is None or k in kinds}
    # payloads are small beside the work on them: a short file would give it to one task
    rows = parsed(spread(events.filter(F.col("kind").isin(*makers)), "doc_id", "seq"))
    if set(makers) & set(SECTIONS):
        # the first comment or form field makes its section
        section = F.when(F.col("kind").isin(*SECTIONS), F.concat("kind", F.when(F.col("kind") == "sheet_cell_comment", _sheet_key()).otherwise(F.lit("")))).otherwise(F.col("seq").cast("string"))
        rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("doc_id", section).orderBy("seq")) == 1)
    made = F.array().cast(f"array<{ITEM}>")
    for kind, f in makers.items():
        made = F.when(F.col("kind") == kind, f()).otherwise(made)
    flat = rows.select("doc_id", "seq", "kind", F.posexplode(made).alias("sub_ord", "i")).select("doc_id", "seq", "kind", "sub_ord", "i.*")
    n = F.row_number().over(Window.partitionBy("doc_id", "arena").orderBy("seq", "sub_ord")) - 1
    named = flat.withColumn("ref", F.concat(F.lit("#/"), "arena", F.lit("/"), n.cast("string")))
    return _with_parents(named, set(makers))


#: Kinds of events whose items others hang on.
DEFINING = {"drawing_shape", "slide", "text_frame", "shape", "sheet", *SECTIONS}


def _latest(rows: DataFrame, kind: Column, key: Column, order: tuple[str, ...], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: ``value`` of the latest earlier row of the document that defines ``kind`` and ``key``; null without one.

    Each row is there once as a reader and, if it defines anything, once as a
    definition; both meet in one window, so the items are made once.
    """
    defined = F.struct(F.lit(True).alias("gives"), F.col("defines").alias("kind"), F.when(F.col("defines") == "own", F.col("seq").cast("string")).otherwise(F.col("define_key")).alias("key"))
    asked = F.struct(F.lit(False).alias("gives"), kind.alias("kind"), key.alias("key"))
    both = rows.withColumn("__at", F.explode(F.when(F.col("defines").isNotNull(), F.array(asked, defined)).otherwise(F.array(asked))))
    # of one place, readers come first: a definition is only seen by what is later
    w = Window.partitionBy("doc_id", "__at.kind", "__at.key").orderBy(*order, "__at.gives", "sub_ord").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(name, F.last(F.when(F.col("__at.gives"), value), ignorenulls=True).over(w)).filter("not __at.gives").drop("__at")


def _with_parents(named: DataFrame, kinds: set[str]) -> DataFrame:
    key = F.when(F.col("parent_kind") == "own", F.col("seq").cast("string")).otherwise(F.col("parent_key"))
    root = F.when(F.col("parent_kind") == "furniture", "#/furniture").otherwise("#/body")
    out = named
    if kinds & DEFINING:
        out = _latest(out, F.col("parent_kind"), key, ("seq", "sub_ord"), F.col("ref"), "__parent").withColumn("parent_ref", F.coalesce("__parent", root)).drop("__parent")
    else:
        out = out.withColumn("parent_ref", root)
    # what hangs on a sheet, or on its comments, has the sheet's layer
    if "sheet" in kinds:
        of_sheet = F.col("layer") == "SHEET"
        out = _latest(out, F.when(of_sheet, "sheet"), F.when(of_sheet, F.col("parent_key")), ("seq",), F.when(F.col("defines") == "sheet", F.col("layer")), "__layer")
        out = out.withColumn("layer", F.when(of_sheet, F.coalesce("__layer", F.lit("BODY"))).otherwise(F.col("layer"))).drop("__layer")
    else:
        out = out.withColumn("layer", F.when(F.col("layer") == "SHEET", "BODY").otherwise(F.col("layer")))
    return out.drop("parent_kind", "parent_key", "defines", "define_key")


# Who made the items of office events.
STAMP = ("libreoffice", "lok")


def stamped(items: DataFrame) -> DataFrame:
    """``items`` with ``tag`` (collector, model, confidence)."""
    return items.withColumn("tag", F.struct(F.lit(STAMP[0]).alias("collector"), F.lit(STAMP[1]).alias("model"), F.lit(None).cast("float").alias("confidence")))


def run_rows(items: DataFrame) -> DataFrame:
    """(doc_id, ref, run_idx, text, weight, italic, underline, strike, url, target, name): the runs of the items."""
    rows = items.select("doc_id", "ref", F.posexplode("runs").alias("run_idx", "r"))
    flag_ = lambda n: F.coalesce(F.col(f"r.{n}"), F.lit(False))
    return rows.select(
        "doc_id", "ref", "run_idx", F.coalesce("r.text", F.lit("")).alias("text"), F.coalesce("r.weight", F.lit(0.0)).alias("weight"), flag_("italic").alias("italic"), flag_("underline").alias("underline"), flag_("strikethrough").alias("strike"),
        F.col("r.hyperlink_url").alias("url"), F.col("r.hyperlink_target").alias("target"), F.col("r.hyperlink_name").alias("name"),
    )


def item_formatting(items: DataFrame) -> DataFrame:
    """(doc_id, ref, bold, italic, underline, strike) of items whose runs agree."""
    return assembly.uniform_formatting(run_rows(items), ["doc_id", "ref"])


def item_links(items: DataFrame) -> DataFrame:
    """(doc_id, ref, link_idx, url, start, end): links of the items' runs; 0 is the item's own."""
    return assembly.hyperlink_spans(run_rows(items), ["doc_id", "ref"])


def table_cells(items: DataFrame, events: DataFrame) -> DataFrame:
    """(doc_id, ref, cell_idx, row, col, name, text, left, top, right, bottom): cells of the tables, places on their page."""
    rows = items.filter("arena = 'tables'").select("doc_id", "ref", F.posexplode("cells").alias("cell_idx", "c")).select("doc_id", "ref", "cell_idx", "c.row", "c.col", "c.name", "c.text", "c.at")
    rects = page_rects(events)
    last = rects.groupBy("doc_id").agg(F.max("seq").alias("seq"))
    origin = rects.join(last, ["doc_id", "seq"], "left_semi").select(F.col("doc_id").alias("o_doc"), F.col("page_index").alias("o_page"), F.col("left").alias("ox"), F.col("top").alias("oy"))
    moved = rows.join(origin, (F.col("doc_id") == F.col("o_doc")) & (F.col("at.page_index") == F.col("o_page")), "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    return moved.select("doc_id", "ref", "cell_idx", "row", "col", "name", "text", *((F.col(f"at.{e}") - z(F.col("ox" if e in ("left", "right") else "oy"))).alias(e) for e in ("left", "top", "right", "bottom")))


#: Positions of a grid that one row stands for until all tasks have their part of the rows.
GRID_RUN = 4096


def table_grid(items: DataFrame, limit: int | None = tables.GRID_LIMIT) -> DataFrame:
    """(doc_id, ref, row, col, text): the dense grid of every table; the last cell of a place stands there.

    The reference makes no grid of more than ``limit`` positions; None makes them all.  A grid may dwarf its
    table: a cell and the blanks up to the next one are a run, and runs, cut to ``GRID_RUN`` positions, are dealt out
    before they become rows.
    """
    cols = F.col("cols").cast("bigint")
    n = F.col("rows").cast("bigint") * cols
    sized_ = items.filter((F.col("arena") == "tables") & (F.col("rows") > 0) & (F.col("cols") > 0))
    if limit is not None:
        sized_ = sized_.filter(n <= limit)
    inside = F.filter(F.coalesce("cells", F.array().cast(CELLS)), lambda c: (c["row"] >= 0) & (c["row"] < F.col("rows")) & (c["col"] >= 0) & (c["col"] < F.col("cols")))
    given = F.transform(inside, lambda c, i: F.struct((c["row"] * cols + c["col"]).alias("at"), i.alias("seq"), F.coalesce(c["text"], F.lit("")).alias("text")))
    blank = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(-1).alias("seq"), F.lit("").alias("text"))
    sorted_ = sized_.select("doc_id", "ref", "cols", n.alias("n"), F.array_sort(F.concat(F.array(blank), given)).alias("all"))
    # of the cells of a place, all but the last have empty runs
    runs = F.transform("all", lambda c, i: F.struct(c["at"].alias("at"), (F.coalesce(F.get("all", i + 1)["at"], F.col("n")) - 1).alias("to"), c["text"].alias("text")))
    whole = sorted_.select("doc_id", "ref", "cols", F.explode(F.filter(runs, lambda r: r["at"] <= r["to"])).alias("r"))
    cut = whole.select("doc_id", "ref", "cols", "r", F.explode(F.sequence("r.at", "r.to", F.lit(GRID_RUN).cast("bigint"))).alias("at"))
    parts = cut.select("doc_id", "ref", "cols", "at", F.least(F.col("at") + GRID_RUN - 1, "r.to").alias("to"), F.when(F.col("at") == F.col("r.at"), F.col("r.text")).otherwise("").alias("text"))
    dense = spread(parts, "doc_id", "ref", "at").select("doc_id", "ref", "cols", "at", "text", F.explode(F.sequence("at", "to")).alias("p"))
    return dense.select("doc_id", "ref", F.expr("cast(p div cols as int)").alias("row"), F.expr("cast(p % cols as int)").alias("col"), F.when(F.col("p") == F.col("at"), F.col("text")).otherwise("").alias("text"))


def document_errors(events: DataFrame) -> DataFrame:
    """(doc_id, code, error) of documents whose events end without a status."""
    ended = events.groupBy("doc_id").agg(F.bool_or(F.col("kind") == "status").alias("ended")).filter("not ended")
    return ended.select("doc_id", F.lit("UNAVAILABLE").alias("code"), F.lit("the document's events end without a status").alias("error"))


def body_fields(items: DataFrame) -> DataFrame:
    """(doc_id, key, value) of the body's custom fields; of one key, the last stays."""
    last = F.max_by("text", F.struct("seq", "sub_ord"))
    return items.filter("arena = 'fields'").groupBy("doc_id", F.col("name").alias("key")).agg(last.alias("value"))


def page_rects(events: DataFrame) -> DataFrame:
    """(doc_id, seq, page_index, left, top, right, bottom) of every document_info event."""
    kind = "array<struct<x_twips bigint, y_twips bigint, width_twips bigint, height_twips bigint>>"
    rows = parsed(events.filter("kind = 'document_info'")).select("doc_id", "seq", F.posexplode(get("page_rects", kind)).alias("page_index", "r"))
    z = lambda n: F.coalesce(F.col(f"r.{n}"), F.lit(0))
    return rows.select("doc_id", "seq", "page_index", z("x_twips").alias("left"), z("y_twips").alias("top"), (z("x_twips") + z("width_twips")).alias("right"), (z("y_twips") + z("height_twips")).alias("bottom"))


def document_pages(events: DataFrame) -> DataFrame:
    """(doc_id, page_no, width, height, image_uri): pages by rectangle or by image, the last event of each kind."""
    rects = page_rects(events).groupBy("doc_id", (F.col("page_index") + 1).alias("page_no")).agg(F.max_by(F.struct((F.col("right") - F.col("left")).cast("double").alias("w"), (F.col("bottom") - F.col("top")).cast("double").alias("h")), "seq").alias("s"))
    images = parsed(events.filter("kind = 'page_image'")).select("doc_id", "seq", (number("index", 0, "int") + 1).alias("page_no"), number("width_px").alias("pw"), number("height_px").alias("ph"), number("dpi").alias("dpi"), F.concat(F.lit("data:image/png;base64,"), text_of("png")).alias("uri"))
    last = images.groupBy("doc_id", "page_no").agg(F.max_by(F.struct("pw", "ph", "dpi", "uri"), "seq").alias("i"))
    both = rects.join(last, ["doc_id", "page_no"], "full")
    size = lambda known, px: F.when(F.col("s.w") > 0, F.col(known)).when(F.col("i.dpi") > 0, F.col(px) * F.lit(1440.0) / F.col("i.dpi")).otherwise(F.coalesce(F.col(known), F.lit(0.0)))
    return both.select("doc_id", "page_no", size("s.w", "i.pw").alias("width"), size("s.h", "i.ph").alias("height"), F.col("i.uri").alias("image_uri"))


def document_identity(events: DataFrame) -> DataFrame:
    """(doc_id, name, mimetype, finished): the last title, else the first document id; whether a status came."""
    rows = parsed(events.filter("kind in ('document_info', 'metadata', 'status')"))
    picked = rows.select("doc_id", "seq", "kind", F.when(F.col("kind") == "metadata", F.nullif(text_of("title"), F.lit(""))).alias("title"), F.when(F.col("kind") == "document_info", F.nullif(text_of("document_id"), F.lit(""))).alias("did"), F.when(F.col("kind") == "document_info", office_mime_type(F.concat(F.lit("x."), text_of("source_format")))).alias("mime"))
    return picked.groupBy("doc_id").agg(F.coalesce(F.max_by("title", F.when(F.col("title").isNotNull(), F.col("seq"))), F.min_by("did", F.when(F.col("did").isNotNull(), F.col("seq"))), F.lit("")).alias("name"), F.max_by("mime", F.when(F.col("mime").isNotNull(), F.col("seq"))).alias("mimetype"), F.bool_or(F.col("kind") == "status").alias("finished"))


def provenance(items: DataFrame, events: DataFrame) -> DataFrame:
    """(doc_id, ref, prov_idx, page_no, left, top, right, bottom, start, end) in page coordinates; unknown pages give no row."""
    rects = page_rects(events)
    last = rects.groupBy("doc_id").agg(F.max("seq").alias("seq"))
    rects = rects.join(last, ["doc_id", "seq"], "left_semi").drop("seq")
    rows = items.select("doc_id", "ref", F.posexplode("prov").alias("prov_idx", "p")).select("doc_id", "ref", "prov_idx", "p.*")
    middle = rows.filter("page_index = -2").withColumn("x", (F.col("left") + F.col("right")) / 2).withColumn("y", (F.col("top") + F.col("bottom")) / 2)
    box = rects.select("doc_id", F.col("page_index").alias("on_page"), *(F.col(e).alias(f"r_{e}") for e in ("left", "top", "right", "bottom")))
    on = middle.join(box, "doc_id").filter("x >= r_left and x < r_right and y >= r_top and y < r_bottom").groupBy("doc_id", "ref", "prov_idx").agg(F.min("on_page").alias("on_page"))
    placed = rows.join(on, ["doc_id", "ref", "prov_idx"], "left").withColumn("page_index", F.when(F.col("page_index") == -2, F.coalesce("on_page", F.lit(-1))).otherwise(F.col("page_index"))).drop("on_page")
    origin = rects.select("doc_id", "page_index", F.col("left").alias("ox"), F.col("top").alias("oy"))
    local = placed.filter("page_index >= 0").join(origin, ["doc_id", "page_index"], "left")
    dx, dy = (F.when(F.col("local"), 0.0).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in ("ox", "oy"))
    return local.select("doc_id", "ref", "prov_idx", (F.col("page_index") + 1).alias("page_no"), (F.col("left") - dx).alias("left"), (F.col("top") - dy).alias("top"), (F.col("right") - dx).alias("right"), (F.col("bottom") - dy).alias("bottom"), "start", "end")


def sheet_cells(events: DataFrame) -> DataFrame:
    """(doc_id, table_ref, row, col, row_span, col_span, text, key, value): cells of the sheets' tables.

    ``key`` is the A1 name and ``value`` the JSON text of a number or formula.
    Rows of unknown sheets are dropped.
    """
    # every event of these kinds makes one table, so its number needs no items
    makes = (F.col("kind") != "embedded_object") | (text_of("kind") == "SPREADSHEET")
    made = parsed(events.filter(F.col("kind").isin("sheet", "table", "embedded_object", "sheet_pivot_table"))).filter(makes)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    owners = made.withColumn("ref", F.concat(F.lit("#/tables/"), n.cast("string"))).filter("kind = 'sheet'").select("doc_id", "seq", number("index").alias("sheet"), "ref")
    # a document's sheets are few: they come to its rows as one small array, so the rows move once
    sheets = owners.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "sheet", "ref")).alias("__sheets"))
    rows = parsed(events.filter("kind = 'sheet_row'")).select("doc_id", "seq", number("sheet_index").alias("sheet"), number("row", 0, "int").alias("row"), get("cells", SHEET_CELLS).alias("cells"))
    before = F.filter("__sheets", lambda s: (s["sheet"] == F.col("sheet")) & (s["seq"] < F.col("seq")))
    # one workbook may hold very many rows: they meet its sheets in SALTS parts
    parts = sheets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int"))
    owned = salted.join(parts, ["doc_id", "__salt"]).withColumn("table_ref", F.array_max(before)["ref"]).filter("table_ref is not null")
    cells = owned.select("doc_id", "table_ref", "row", F.explode("cells").alias("c"))
    z = lambda n: F.coalesce(F.col(f"c.{n}"), F.lit(0))
    name = a1_name(F.col("row"), z("column"))
    value = F.when(F.col("c.type") == "VALUE", F.to_json(F.struct(F.col("c.number").alias("number")))).when(F.col("c.type") == "FORMULA", F.to_json(F.struct(F.coalesce("c.formula", F.lit("")).alias("formula"), F.col("c.number").alias("number"))))
    return cells.select("doc_id", "table_ref", "row", z("column").alias("col"), F.greatest(F.lit(1), z("merged_rows")).alias("row_span"), F.greatest(F.lit(1), z("merged_columns")).alias("col_span"), F.coalesce("c.display", F.lit("")).alias("text"), F.when(value.isNotNull(), name).alias("key"), value.alias("value"))


def chart_points(events: DataFrame) -> DataFrame:
    """(doc_id, seq, shape, series_idx, point_idx, label, x, y) of the embedded charts.

    Bars and slices take the first series under the category's name, or its
    number from 1; lines take x or the index; points take as many as have both.
    """
    rows = parsed(events.filter("kind = 'embedded_object'")).filter(text_of("kind") == "CHART")
    shape = F.when(get("chart.kind").isin("BAR", "COLUMN"), "bar").when(get("chart.kind").isin("LINE", "AREA"), "line").when(get("chart.kind") == "PIE", "pie").when(get("chart.kind").isin("SCATTER", "BUBBLE"), "scatter")
    series = rows.select("doc_id", "seq", shape.alias("shape"), get("chart.categories", "array<string>").alias("categories"), F.posexplode(get("chart.series", SERIES)).alias("series_idx", "s")).filter("shape is not null")
    series = series.filter("series_idx = 0 or shape not in ('bar', 'pie')")
    points = series.select("doc_id", "seq", "shape", "categories", "series_idx", "s", F.posexplode("s.values_y").alias("point_idx", "y"))
    at = F.col("point_idx") + 1
    given = F.try_element_at(F.coalesce("s.values_x", F.array().cast("array<double>")), at)
    category = F.coalesce(F.try_element_at(F.coalesce("categories", F.array().cast("array<string>")), at), at.cast("string"))
    x = F.when(F.col("shape") == "line", F.coalesce(given, F.col("point_idx").cast("double"))).when(F.col("shape") == "scatter", given)
    label = F.when(F.col("shape").isin("bar", "pie"), category).when(F.col("shape") == "line", F.coalesce("s.label", F.lit("")))
    return points.select("doc_id", "seq", "shape", "series_idx", "point_idx", label.alias("label"), x.alias("x"), "y").filter("shape <> 'scatter' or x is not null")
