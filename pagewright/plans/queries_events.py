"""One query for each kind of office event: twenty events of the kind a document, made from ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators import office, tables
from pagewright.plans import parse
from pagewright.plans.adapter import office_event as _event
from pagewright.plans.adapter import payload as _json
from pagewright.plans.catalog import query, table

_P = "p as (select p_partkey // 20 as doc_id, p_partkey as seq, p_partkey % 20 as k, p_name as name, p_brand as brand, p_size as size from part)"


def k():
    return F.col("k")


def name():
    return F.col("name")


def brand():
    return F.col("brand")


def size():
    return F.col("size")



def sql(select: str, *more: str) -> str:
    return "with " + ", ".join([_P, *more]) + "\n" + select


def _parts(spark, sf) -> DataFrame:
    n = F.col("p_partkey")
    return table(spark, sf, "part").select(F.expr("p_partkey div 20").alias("doc_id"), n.alias("seq"), (n % 20).alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))


def _events(spark, sf, kind: str, /, **payload) -> DataFrame:
    return _event(_parts(spark, sf), F.col("doc_id"), F.col("seq"), kind, _json(**payload))


def _once(spark, sf, kind: str, seq: int, /, **payload) -> DataFrame:
    """One event a document, before or after all others."""
    docs = _parts(spark, sf).select("doc_id").distinct()
    return _event(docs, F.col("doc_id"), F.lit(seq), kind, _json(**payload))


def _point(x, y):
    return F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))


def _runs(*texts):
    return F.array(*(F.struct(t.alias("text")) for t in texts))


def _field(name: str):
    return F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(""))


def _place(*edges: str):
    return [F.get("prov", F.lit(0))[e].cast("bigint").alias(e) for e in edges]


@query(
    "event_table",
    sql("""select doc_id, '#/tables/' || k as ref, 2 as n_rows, 3 as n_cols, 1 as n_cells, name as text, to_json(brand)::varchar as odd, 5::bigint as "left", least(20, size)::bigint as top, 10::bigint as "right", greatest(20, size)::bigint as bottom from p"""),
)
def event_table(spark, sf):
    cell = lambda r, c, n, t: F.struct(F.lit(r).alias("row"), F.lit(c).alias("column"), F.lit(n).alias("name"), t.alias("text"))
    events = _events(spark, sf, "table", rows=F.lit(2), columns=F.lit(3), cells=F.array(cell(0, 1, "B1", name()), cell(0, -1, "odd", brand())), page_index=F.lit(0), start=_point(F.lit(10), F.lit(20)), end=_point(F.lit(5), size()))
    items = office.office_items(events, ("table",))
    return items.select("doc_id", "ref", F.col("rows").alias("n_rows"), F.col("cols").alias("n_cols"), F.size("cells").alias("n_cells"), F.get("cells", F.lit(0))["text"].alias("text"), _field("cell:odd").alias("odd"), *_place("left", "top", "right", "bottom"))


@query(
    "event_embedded_image",
    sql("""select doc_id, '#/pictures/' || k as ref, '#/body' as parent_ref, to_json(name)::varchar as named, case when k % 2 = 0 then 'data:image/png;base64,' || to_base64(encode(brand)) else '' end as uri, 7::bigint as "left", (7 + size)::bigint as "right", 39::bigint as bottom from p"""),
)
def event_embedded_image(spark, sf):
    data = F.when(k() % 2 == 0, F.base64(F.encode(brand(), "utf-8"))).otherwise("")
    events = _events(spark, sf, "embedded_image", name=name(), group_path=F.lit(""), mime_type=F.lit("image/png"), data=data, page_index=F.lit(1), anchor=_point(F.lit(7), F.lit(9)), width_twips=size(), height_twips=F.lit(30))
    items = office.office_items(events, ("embedded_image",))
    return items.select("doc_id", "ref", "parent_ref", _field("name").alias("named"), F.coalesce("image_uri", F.lit("")).alias("uri"), *_place("left", "right", "bottom"))


@query("event_footnote", sql("""select doc_id, '#/texts/' || k as ref, 'FOOTNOTE' as label, name || ' ' || brand as text, case when k % 3 = 0 then 'true' else 'false' end as endnote, case when k % 2 = 0 then '"*"' else '' end as mark, (length(name) + length(brand) + 1)::bigint as "end" from p"""))
def event_footnote(spark, sf):
    events = _events(spark, sf, "footnote", runs=_runs(name(), F.lit(" "), brand()), label=F.when(k() % 2 == 0, "*").otherwise(""), endnote=k() % 3 == 0, page_index=F.lit(0), anchor=_point(F.lit(1), F.lit(2)))
    return office.office_items(events, ("footnote",)).select("doc_id", "ref", "label", "text", _field("endnote").alias("endnote"), _field("label").alias("mark"), *_place("end"))


@query(
    "event_header_footer",
    sql("""select doc_id, '#/texts/' || (2 * k + i) as ref, '#/furniture' as parent_ref, 'FURNITURE' as layer, case when k % 2 = 0 then 'PAGE_FOOTER' else 'PAGE_HEADER' end as label, case i when 0 then name else brand end as text, '"Standard"' as style, 0 as places from p, (values (0), (1)) t(i)"""),
)
def event_header_footer(spark, sf):
    paragraphs = F.array(*(F.struct(_runs(t).alias("runs")) for t in (name(), brand())))
    items = office.office_items(_events(spark, sf, "header_footer", footer=k() % 2 == 0, page_style=F.lit("Standard"), paragraphs=paragraphs), ("header_footer",))
    return items.select("doc_id", "ref", "parent_ref", "layer", "label", "text", _field("page_style").alias("style"), F.size("prov").alias("places"))


@query(
    "event_page_style",
    sql("""select doc_id, 'page_style:' || (k % 3) as key, '{"width_twips":' || arg_max(size, seq)::double || ',"height_twips":15840.0,"margin_left_twips":0.0,"margin_right_twips":0.0,"margin_top_twips":0.0,"margin_bottom_twips":72.0,"columns":2.0}' as value from p group by 1, 2"""),
)
def event_page_style(spark, sf):
    events = _events(spark, sf, "page_style", name=(k() % 3).cast("string"), width_twips=size(), height_twips=F.lit(15840), margin_bottom_twips=F.lit(72), columns=F.lit(2))
    return office.body_fields(office.office_items(events, ("page_style",)))


@query("event_document_index", sql("""select doc_id, '#/texts/' || k as ref, 'DOCUMENT_INDEX' as label, name as text, '"TOC"' as kind, to_json(brand)::varchar as title, 2 as page, length(name)::bigint as "end" from p"""))
def event_document_index(spark, sf):
    events = _events(spark, sf, "document_index", runs=_runs(name()), type=F.lit("TOC"), title=brand(), page_index=F.lit(2), anchor=_point(F.lit(1), F.lit(2)))
    return office.office_items(events, ("document_index",)).select("doc_id", "ref", "label", "text", _field("index_type").alias("kind"), _field("title").alias("title"), F.get("prov", F.lit(0))["page_index"].alias("page"), *_place("end"))


@query(
    "event_drawing_shape",
    sql("""select doc_id, case k % 4 when 0 then '#/groups/' || (k // 4) when 1 then '#/texts/' || (k // 4) else '#/pictures/' || (2 * (k // 4) + k % 4 - 2) end as ref, case k % 4 when 0 then '#/body' else '#/groups/' || (k // 4) end as parent_ref,
 case k % 4 when 0 then 'PICTURE_AREA' when 1 then 'TEXT' else 'PICTURE' end as label, case k % 4 when 1 then name else '' end as text, case k % 4 when 0 then '' else '"Shape"' end as shape from p"""),
)
def event_drawing_shape(spark, sf):
    group = F.when(k() % 4 == 0, "").otherwise((k() - k() % 4).cast("string"))
    events = _events(spark, sf, "drawing_shape", page_index=F.lit(3), group_path=group, z_order=k(), is_group=k() % 4 == 0, has_text=k() % 4 == 1, name=brand(), shape_type=F.lit("Shape"), runs=_runs(name()), position=_point(F.lit(1), F.lit(2)), width_twips=F.lit(3), height_twips=F.lit(4))
    return office.office_items(events, ("drawing_shape",)).select("doc_id", "ref", "parent_ref", "label", F.coalesce("text", F.lit("")).alias("text"), _field("shape_type").alias("shape"))


@query(
    "event_text_frame",
    sql("""select doc_id, 'groups' as arena, '#/groups/' || k as ref, '#/body' as parent_ref, brand as named, '' as text, case when k % 2 = 0 then to_json(name)::varchar else '' end as next, 0::bigint as "end" from p
 union all select doc_id, 'texts', '#/texts/' || k, '#/groups/' || k, '', name, '', length(name) from p"""),
)
def event_text_frame(spark, sf):
    events = _events(spark, sf, "text_frame", name=brand(), chain_next=F.when(k() % 2 == 0, name()).otherwise(""), runs=_runs(name()), page_index=F.lit(0), anchor=_point(F.lit(1), F.lit(2)), width_twips=F.lit(3), height_twips=F.lit(4))
    items = office.office_items(events, ("text_frame",))
    return items.select("doc_id", "arena", "ref", "parent_ref", F.coalesce("name", F.lit("")).alias("named"), F.coalesce("text", F.lit("")).alias("text"), _field("chain_next").alias("next"), F.coalesce(F.get("prov", F.lit(0))["end"], F.lit(0)).alias("end"))


def _shapes(spark, sf):
    """Groups with four shapes each; the second and third have an anchor, the others a position on one of two pages."""
    group = F.when(k() % 5 == 0, "").otherwise((k() - k() % 5).cast("string"))
    anchor = F.when((k() % 5).isin(2, 3), _point(F.lit(4), F.lit(6)))
    position = F.when(~(k() % 5).isin(2, 3), _point(F.lit(8), size() * 40))
    shapes = _events(spark, sf, "shape", name=brand(), group_path=group, z_order=k(), is_group=k() % 5 == 0, shape_type=F.lit("S"), runs=_runs(name()), page_index=F.lit(0), anchor=anchor, position=position, width_twips=F.lit(10), height_twips=F.lit(20))
    rect = lambda y: F.struct(F.lit(0).alias("x_twips"), F.lit(y).alias("y_twips"), F.lit(500).alias("width_twips"), F.lit(1000).alias("height_twips"))
    return shapes.unionByName(_once(spark, sf, "document_info", -1, page_rects=F.array(rect(0), rect(1000))))


@query(
    "event_shape",
    sql("""select doc_id, '#/groups/' || k as ref, case k % 5 when 0 then '#/body' else '#/groups/' || (k - k % 5) end as parent_ref, case k % 5 when 0 then 'PICTURE_AREA' else 'UNSPECIFIED' end as label, '' as text from p
 union all select doc_id, '#/texts/' || (k - k // 5 - 1), '#/groups/' || k, 'TEXT', name from p where k % 5 > 0"""),
)
def event_shape(spark, sf):
    return office.office_items(_shapes(spark, sf), ("shape",)).select("doc_id", "ref", "parent_ref", "label", F.coalesce("text", F.lit("")).alias("text"))


@query(
    "event_shape_pages",
    sql("""select doc_id, '#/texts/' || (k - k // 5 - 1) as ref, case when k % 5 in (2, 3) or size * 40 + 10 < 1000 then 1 else 2 end as page_no, case when k % 5 in (2, 3) then 4 else 8 end::double as "left",
 case when k % 5 in (2, 3) then 6 when size * 40 + 10 < 1000 then size * 40 else size * 40 - 1000 end::double as top, length(name)::bigint as "end" from p where k % 5 > 0 and (k % 5 in (2, 3) or size * 40 + 10 < 2000)"""),
)
def event_shape_pages(spark, sf):
    events = _shapes(spark, sf)
    items = office.office_items(events, ("shape",)).filter("arena = 'texts'")
    return office.provenance(items, events).select("doc_id", "ref", "page_no", "left", "top", "end")


@query(
    "event_embedded_object",
    sql("""select doc_id, case k % 3 when 0 then '#/texts/' || (k // 3) when 1 then '#/tables/' || (k // 3) else '#/pictures/' || (k // 3) end as ref, case k % 3 when 0 then 'FORMULA' when 1 then 'TABLE' else 'PICTURE' end as label, case k % 3 when 0 then 'a = ' || name else '' end as text,
 to_json(brand)::varchar as named, case k % 3 when 1 then 4 else 0 end as n_rows, case k % 3 when 1 then name else '' end as cell, case k % 3 when 2 then 'data:image/svg;base64,QQ==' else '' end as uri, (1 + size)::bigint as "right" from p"""),
)
def event_embedded_object(spark, sf):
    kind = F.when(k() % 3 == 0, "FORMULA").when(k() % 3 == 1, "SPREADSHEET").otherwise("OTHER")
    cells = F.array(F.struct(F.lit(0).alias("row"), F.lit(0).alias("column"), F.lit("A1").alias("name"), name().alias("text")))
    inner = F.struct(F.lit(4).alias("rows"), F.lit(2).alias("columns"), cells.alias("cells"))
    events = _events(spark, sf, "embedded_object", kind=kind, name=brand(), formula=F.concat(F.lit("a = "), name()), inner_table=inner, replacement_mime_type=F.lit("image/svg"), replacement_image=F.lit("QQ=="), page_index=F.lit(0), position=_point(F.lit(1), F.lit(2)), width_twips=size(), height_twips=F.lit(3))
    items = office.office_items(events, ("embedded_object",))
    return items.select("doc_id", "ref", "label", F.coalesce("text", F.lit("")).alias("text"), _field("name").alias("named"), F.coalesce("rows", F.lit(0)).alias("n_rows"), F.coalesce(F.try_element_at("cells", F.lit(1))["text"], F.lit("")).alias("cell"), F.coalesce("image_uri", F.lit("")).alias("uri"), *_place("right"))


def _range(c1, r1, c2, r2):
    return F.struct(r1.cast("int").alias("start_row"), c1.cast("int").alias("start_column"), r2.cast("int").alias("end_row"), c2.cast("int").alias("end_column"))


@query(
    "event_ranges",
    sql("""select doc_id, 'named_range:' || name || k as key, '{"content":' || to_json(brand) || ',"type_flags":' || (k % 4)::double || '}' as value from p where k % 2 = 0
 union all select doc_id, 'database_range:' || k, '{"sheet_index":' || size::double || ',"range":"B' || (k + 1) || ':AA' || (k + 4) || '","contains_header":' || (k % 4 = 1) || ',"totals_row":false,"auto_filter":true}' from p where k % 2 = 1"""),
)
def event_ranges(spark, sf):
    named = _events(spark, sf, "sheet_named_range", name=F.concat(name(), k().cast("string")), content=brand(), type_flags=k() % 4).filter("seq % 2 = 0")
    based = _events(spark, sf, "sheet_database_range", name=k().cast("string"), sheet_index=size(), range=_range(F.lit(1), k(), F.lit(26), k() + 3), contains_header=k() % 4 == 1, auto_filter=F.lit(True)).filter("seq % 2 = 1")
    return office.body_fields(office.office_items(named.unionByName(based), ("sheet_named_range", "sheet_database_range")))


def _hidden_sheet(spark, sf):
    return _once(spark, sf, "sheet", -2, index=F.lit(1), name=F.lit("Hidden"), visible=F.lit(False), used_end_row=F.lit(9), used_end_column=F.lit(9), tab_color_rgb=F.lit(-1))


@query(
    "event_sheet_comment",
    sql("""select doc_id, '#/groups/' || case k when 0 then 1 else 2 end as ref, case k when 0 then '#/groups/0' else '#/body' end as parent_ref, 'COMMENT_SECTION' as label, case k when 0 then 'INVISIBLE' else 'BODY' end as layer, '' as text, '' as cell, '' as author from p where k < 2
 union all select doc_id, '#/texts/' || k, '#/groups/' || (k % 2 + 1), 'TEXT', case k % 2 when 0 then 'INVISIBLE' else 'BODY' end, name, '"' || chr((65 + k % 3)::int) || (size + 1) || '"', to_json(brand)::varchar from p"""),
)
def event_sheet_comment(spark, sf):
    """Every second comment lies on a sheet that nothing defines."""
    said = _events(spark, sf, "sheet_cell_comment", sheet_index=F.when(k() % 2 == 0, 1).otherwise(5), row=size(), column=k() % 3, text=name(), author=brand())
    items = office.office_items(_hidden_sheet(spark, sf).unionByName(said), ("sheet", "sheet_cell_comment")).filter("kind = 'sheet_cell_comment'")
    return items.select("doc_id", "ref", "parent_ref", "label", "layer", F.coalesce("text", F.lit("")).alias("text"), _field("cell").alias("cell"), _field("author").alias("author"))


@query(
    "event_sheet_chart",
    sql("""select doc_id, '#/pictures/' || k as ref, '#/groups/0' as parent_ref, 'CHART' as label, 'INVISIBLE' as layer, to_json(name)::varchar as named, case when k % 2 = 0 then '["A1:C' || (size + 1) || '","D2:D2"]' else '' end as ranges, (k % 3 = 0)::varchar as headers, 1 as page from p"""),
)
def event_sheet_chart(spark, sf):
    ranges = F.when(k() % 2 == 0, F.array(_range(F.lit(0), F.lit(0), F.lit(2), size()), _range(F.lit(3), F.lit(1), F.lit(3), F.lit(1))))
    drawn = _events(spark, sf, "sheet_chart", sheet_index=F.lit(1), name=name(), ranges=ranges, has_column_headers=k() % 3 == 0)
    items = office.office_items(_hidden_sheet(spark, sf).unionByName(drawn), ("sheet", "sheet_chart")).filter("kind = 'sheet_chart'")
    return items.select("doc_id", "ref", "parent_ref", "label", "layer", _field("name").alias("named"), _field("source_ranges").alias("ranges"), _field("has_column_headers").alias("headers"), F.get("prov", F.lit(0))["page_index"].alias("page"))


@query(
    "event_sheet_pivot",
    sql("""select doc_id, '#/tables/' || (k + 1) as ref, '#/groups/0' as parent_ref, 'INVISIBLE' as layer, size + 1 as n_rows, 3 as n_cols, to_json(name)::varchar as pivot, '"A1:B9"' as source, case when k % 2 = 0 then '["x",' || to_json(brand) || ']' else '' end as row_fields from p"""),
)
def event_sheet_pivot(spark, sf):
    rows = F.when(k() % 2 == 0, F.array(F.lit("x"), brand())).otherwise(F.array().cast("array<string>"))
    made = _events(spark, sf, "sheet_pivot_table", sheet_index=F.lit(1), name=name(), source_range=_range(F.lit(0), F.lit(0), F.lit(1), F.lit(8)), output_range=_range(F.lit(2), F.lit(10), F.lit(4), size() + 10), row_fields=rows)
    items = office.office_items(_hidden_sheet(spark, sf).unionByName(made), ("sheet", "sheet_pivot_table")).filter("kind = 'sheet_pivot_table'")
    return items.select("doc_id", "ref", "parent_ref", "layer", F.col("rows").alias("n_rows"), F.col("cols").alias("n_cols"), _field("pivot_table").alias("pivot"), _field("source_range").alias("source"), _field("row_fields").alias("row_fields"))


@query(
    "event_tracked_change",
    sql("""select doc_id, 'tracked_change:' || (k % 7) as key, '{"kind":"' || case when max(k) % 2 = 0 then 'Insert' else 'Unspecified' end || '","author":' || to_json(arg_max(brand, k)) || ',"char_start":' || max(k) || ',"char_end":' || (max(k) + 3) || ',"text":' || to_json(arg_max(name, k))
 || case when max(k) % 3 = 0 then ',"supersedes":{"kind":"Delete","date_ms":5}' else '' end || '}' as value from p group by 1, 2"""),
)
def event_tracked_change(spark, sf):
    later = F.when(k() % 3 == 0, F.struct(F.lit("Delete").alias("kind_name"), F.lit(5).alias("epoch_ms")))
    events = _events(spark, sf, "tracked_change", index=k() % 7, kind_name=F.when(k() % 2 == 0, "Insert").otherwise(""), author=brand(), char_start=k(), char_end=k() + 3, changed_text=name(), successor=later)
    return office.body_fields(office.office_items(events, ("tracked_change",)))


@query(
    "event_form_field",
    sql("""select doc_id, '#/texts/' || k as ref, '#/groups/0' as parent_ref, case k % 4 when 0 then 'CHECKBOX_SELECTED' when 1 then 'CHECKBOX_UNSELECTED' else 'TEXT' end as label, case when k % 2 = 0 then name else brand end as text, case k % 4 when 0 then 'true' when 1 then 'false' else '' end as checked,
 case k % 4 when 2 then '1' else '' end as chosen, case k % 4 when 2 then '["a","b"]' else '' end as entries, case k % 3 when 0 then (k)::varchar when 1 then to_json(name)::varchar else 'null' end as param, case when k % 5 = 0 then k::varchar else '' end as char_start from p"""),
)
def event_form_field(spark, sf):
    typed = F.array(F.struct(F.lit("p").alias("name"), F.when(k() % 3 == 0, k()).alias("int_value"), F.when(k() % 3 == 1, name()).alias("string_value")))
    events = _events(
        spark, sf, "form_field",
        kind=F.when(k() % 4 < 2, "CHECKBOX").otherwise("DROPDOWN"), checked=k() % 4 == 0, text=F.when(k() % 2 == 0, name()).otherwise(""), label=brand(), selected_index=F.when(k() % 4 == 2, 1).otherwise(-1),
        list_entries=F.when(k() % 4 == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")), parameters=typed, char_start=F.when(k() % 5 == 0, k()).otherwise(-1), char_end=k() + 1, page_index=F.lit(0), anchor=_point(F.lit(1), F.lit(2)),
    )
    items = office.office_items(events, ("form_field",)).filter("arena = 'texts'")
    return items.select("doc_id", "ref", "parent_ref", "label", "text", _field("checked").alias("checked"), _field("selected_index").alias("chosen"), _field("list_entries").alias("entries"), _field("param:p").alias("param"), _field("char_start").alias("char_start"))


@query(
    "event_metadata",
    sql("""select doc_id, 'author' as key, to_json(arg_max(brand, k))::varchar as value from p group by 1 union all select doc_id, 'created_epoch_ms', arg_max(size, k)::varchar from p group by 1
 union all select doc_id, 'keywords', to_json(arg_max(name, k) filter (k % 2 = 0))::varchar from p group by 1 union all select doc_id, 'language', '"de-CH"' from p group by 1"""),
)
def event_metadata(spark, sf):
    events = _events(spark, sf, "metadata", author=brand(), subject=F.lit(""), keywords=F.when(k() % 2 == 0, name()).otherwise(""), created_epoch_ms=size(), modified_epoch_ms=F.lit(0), language=F.lit("de-CH"))
    return office.body_fields(office.office_items(events, ("metadata",)))


@query(
    "event_status",
    sql("""select doc_id, '#/warnings/' || (row_number() over (partition by doc_id order by seq, i) - 1) as ref, case i when 0 then name else brand end as text from p, (values (0), (1)) t(i) where i < k % 3"""),
)
def event_status(spark, sf):
    said = F.slice(F.array(name(), brand()), 1, (k() % 3).cast("int"))
    return office.office_items(_events(spark, sf, "status", warnings=said), ("status",)).select("doc_id", "ref", "text")


def _infos(spark, sf):
    """Identity events: a document number at the first, titles at the third and later, a status in every second document."""
    info = _events(spark, sf, "document_info", document_id=F.concat(F.lit("d"), k().cast("string")), source_format=F.lit("odt"))
    meta = _events(spark, sf, "metadata", title=F.when((k() > 2) & (F.col("doc_id") % 3 > 0), name()).otherwise("")).withColumn("seq", F.col("seq") + 1_000_000)
    done = _events(spark, sf, "status", warnings=F.array().cast("array<string>")).filter("doc_id % 2 = 0").withColumn("seq", F.col("seq") + 2_000_000)
    return info.unionByName(meta).unionByName(done)


@query("event_document_info", sql("""select doc_id, case when doc_id % 3 > 0 then arg_max(name, k) else 'd0' end as name, 'application/vnd.oasis.opendocument.text' as mimetype, doc_id % 2 = 0 as finished from p group by doc_id having max(k) > 2"""))
def event_document_info(spark, sf):
    return office.document_identity(_infos(spark, sf))


@query(
    "event_pages",
    sql("""select doc_id, (i + 1)::int as page_no, case i when 0 then 500 when 1 then 600 else 1440 * last.size / 96.0 end::double as width, case i when 0 then 1000 when 1 then 700 else 1440 * 10 / 96.0 end::double as height, case i when 1 then '' else 'data:image/png;base64,' || to_base64(encode(last.brand)) end as image
 from (select doc_id, arg_max({'size': size, 'brand': brand}, k) as last from p group by 1), (values (0), (1), (2)) t(i)"""),
)
def event_pages(spark, sf):
    """Two pages by rectangle, the first and the third by image."""
    rect = lambda w, h: F.struct(F.lit(w).alias("width_twips"), F.lit(h).alias("height_twips"))
    info = _once(spark, sf, "document_info", -1, page_rects=F.array(rect(500, 1000), rect(600, 700)))
    image = lambda i: _events(spark, sf, "page_image", index=F.lit(i), width_px=size(), height_px=F.lit(10), dpi=F.lit(96), png=F.base64(F.encode(brand(), "utf-8")))
    return office.document_pages(info.unionByName(image(0)).unionByName(image(2))).select("doc_id", "page_no", "width", "height", F.coalesce("image_uri", F.lit("")).alias("image"))


def _tables(spark, sf):
    """A table for every part: a cell with lines on two pages, one without lines, one outside of the grid; the last table of a document has 10,000 positions."""
    rect = lambda page, x, y: F.struct(page.alias("page_index"), F.lit(x).alias("x_twips"), y.cast("bigint").alias("y_twips"), F.lit(50).alias("width_twips"), F.lit(10).alias("height_twips"))
    lines = F.array(rect(F.lit(-1), 0, F.lit(0)), rect(k() % 2, 100, size() + 1000), rect(k() % 2, 20, size() + 1030), rect(F.lit(7), 0, F.lit(0)))
    cell = lambda r, c, n, t, at: F.struct(F.lit(r).alias("row"), F.lit(c).alias("column"), F.lit(n).alias("name"), t.alias("text"), at.alias("line_rects"))
    none = F.array().cast(lines_type := "array<struct<page_index:int,x_twips:int,y_twips:bigint,width_twips:int,height_twips:int>>")
    cells = F.array(cell(0, 1, "B1", name(), lines.cast(lines_type)), cell(1, 0, "A2", brand(), none), cell(-1, 0, "odd", brand(), none))
    events = _events(spark, sf, "table", rows=F.when(k() == 19, 5000).otherwise(2), columns=F.lit(2), cells=cells)
    page = lambda y: F.struct(F.lit(5).alias("x_twips"), F.lit(y).alias("y_twips"), F.lit(500).alias("width_twips"), F.lit(1000).alias("height_twips"))
    return events.unionByName(_once(spark, sf, "document_info", -1, page_rects=F.array(page(0), page(1000))))


@query(
    "event_table_cells",
    sql("""select doc_id, '#/tables/' || k as ref, 0 as "row", 1 as col, name as text, 15::bigint as "left", size + 1000 * (1 - k % 2) as top, 145::bigint as "right", size + 1040 - 1000 * (k % 2) as bottom from p
 union all select doc_id, '#/tables/' || k, 1, 0, brand, -1, -1, -1, -1 from p"""),
)
def event_table_cells(spark, sf):
    events = _tables(spark, sf)
    cells = office.table_cells(office.office_items(events, ("table",)), events)
    return cells.select("doc_id", "ref", "row", "col", "text", *(F.coalesce(F.col(e).cast("bigint"), F.lit(-1)).alias(e) for e in ("left", "top", "right", "bottom")))


@query(
    "event_table_grid",
    sql("""select doc_id, '#/tables/' || k as ref, r::int as "row", c as col, case when r = 0 and c = 1 then name when r = 1 and c = 0 then brand else '' end as text from (select *, unnest(range(case when k = 19 then 5000 else 2 end)) as r from p), (values (0), (1)) b(c)"""),
)
def event_table_grid(spark, sf):
    return office.table_grid(office.office_items(_tables(spark, sf), ("table",)), limit=None).select("doc_id", "ref", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "text")


def _styled(spark, sf):
    """Paragraphs of three runs: bold in some or all, the last two of one link."""
    run = lambda t, heavy, url: F.struct(t.alias("text"), F.when(heavy, 150.0).otherwise(100.0).alias("weight"), F.lit(True).alias("italic"), url.alias("hyperlink_url"))
    link = F.when(k() % 2 == 0, F.concat(F.lit("http://x/"), brand())).otherwise("")
    return _events(spark, sf, "paragraph", runs=F.array(run(name(), k() % 3 > 0, F.lit("")), run(F.lit(" "), k() % 3 > 1, link), run(brand(), k() % 3 > 1, link)), list_level=F.lit(-1))


@query("event_formatting", sql("""select doc_id, '#/texts/' || k as ref, k % 3 = 2 as bold, true as italic from p where k % 3 <> 1"""))
def event_formatting(spark, sf):
    return office.item_formatting(office.office_items(_styled(spark, sf), ("paragraph",))).filter("italic is not null").select("doc_id", "ref", "bold", "italic")


@query("event_links", sql("""select doc_id, '#/texts/' || k as ref, 'http://x/' || brand as url, length(name)::bigint as "start", (length(name) + 1 + length(brand))::bigint as "end" from p where k % 2 = 0"""))
def event_links(spark, sf):
    return office.item_links(office.office_items(_styled(spark, sf), ("paragraph",))).select("doc_id", "ref", "url", "start", "end")


@query(
    "collector_events",
    sql("""select doc_id, (row_number() over (partition by doc_id order by r, place) - 1)::bigint as seq, event, collector, error from (
 select doc_id, 0 as r, k as place, 'page' as event, '' as collector, '' as error from p where k < doc_id % 4 union all
 select doc_id, 1, i, 'collector_document', c, '' from (select distinct doc_id from p), (values (0, 'CV'), (1, 'LIBREOFFICE'), (2, 'POI')) t(i, c) where (doc_id + i) % 3 > 0 and doc_id % 5 > 0 union all
 select doc_id, 2, 0, case when doc_id % 5 > 0 or doc_id % 4 > 0 then 'complete' else 'error' end, '', case when doc_id % 5 = 0 then 'failed 0' else 'failed ' || ((3 - doc_id % 3) % 3) end from (select distinct doc_id from p))"""),
)
def collector_events(spark, sf):
    """Pages, documents of the collectors and one end; in every fifth document all three collectors fail."""
    rows = _parts(spark, sf)
    pages = rows.filter("k < doc_id % 4").select("doc_id", (k() + 1).cast("int").alias("page_no"))
    names = F.array(F.lit("CV"), F.lit("LIBREOFFICE"), F.lit("POI"))
    each = rows.select("doc_id").distinct().select("doc_id", F.posexplode(names).alias("plan_ord", "collector"))
    success = ((F.col("doc_id") + F.col("plan_ord")) % 3 > 0) & (F.col("doc_id") % 5 > 0)
    outcomes = each.select("doc_id", "plan_ord", "collector", success.alias("success"), F.when(~success, F.concat(F.lit("failed "), F.col("plan_ord").cast("string"))).alias("error"))
    return parse.numbered_events(pages, outcomes).select("doc_id", "seq", "event", F.coalesce("collector", F.lit("")).alias("collector"), F.coalesce("error", F.lit("")).alias("error"))


@query(
    "token_cells",
    sql("""select seq, 0 as cell_idx, 0 as "row", 0 as col, 1 as row_span, (k % 3 + 1)::int as col_span, true as header from p union all select seq, 1, 0, (k % 3 + 1)::int, 1, 1, true from p
 union all select seq, 2, 1, 0, 2, 1, false from p union all select seq, 3, 1, 1, 1, 1, false from p union all select seq, 4, 2, 1, 1, 1, false from p"""),
)
def token_cells(spark, sf):
    """A head with a colspan, a cell that carries down, a cell that is never closed."""
    head = F.array(F.lit("<thead>"), F.lit("<tr>"), F.lit("<td"), F.concat(F.lit(' colspan="'), (k() % 3 + 1).cast("string"), F.lit('"')), *map(F.lit, (">", "</td>", "<td></td>", "</tr>", "</thead>")))
    body = F.array(*map(F.lit, ("<tr>", "<td", ' rowspan="2"', ">", "</td>", "<td></td>", "</tr>", "<tr>", "<td></td>", "<td", ' colspan="9"', ">")))
    streams = _parts(spark, sf).select("seq", F.concat(head, body).alias("tokens"), F.array().cast("array<struct<left:int,top:int,right:int,bottom:int>>").alias("boxes"))
    return tables.token_cells(streams, ["seq"]).select("seq", "cell_idx", "row", "col", "row_span", "col_span", "header")
