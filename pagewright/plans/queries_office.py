"""Queries over typed office events made from the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import office
from pagewright.plans import adapter
from pagewright.plans.adapter import office_event as _event
from pagewright.plans.adapter import payload as _json
from pagewright.plans.catalog import query, table


def _sheets(spark, sf):
    """One workbook of five sheets, one a priority; a row for every order, and rows of an unknown sheet."""
    o = table(spark, sf, "orders")
    sheets = o.groupBy("o_orderpriority").agg(F.max("o_orderkey").alias("most"))
    head = _event(sheets, F.lit(1), F.substring("o_orderpriority", 1, 1).cast("int"), "sheet", _json(index=F.substring("o_orderpriority", 1, 1).cast("int") - 1, name=F.col("o_orderpriority"), visible=F.lit(True), used_end_row=F.col("most").cast("int"), used_end_column=F.lit(2), tab_color_rgb=F.lit(-1)))
    cell = lambda c, t, d, n: F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), d.alias("display"), n.cast("double").alias("number"), (F.col("o_orderkey") % 3).cast("int").alias("merged_rows"))
    cells = F.array(cell(0, "TEXT", F.col("o_orderstatus"), F.lit(0)), cell(1, "VALUE", F.col("o_custkey").cast("string"), F.col("o_custkey")))
    where = F.when(F.col("o_orderkey") % 97 == 0, F.lit(77)).otherwise(F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    rows = _event(o, F.lit(1), F.col("o_orderkey") + 10, "sheet_row", _json(sheet_index=where, row=F.col("o_orderkey").cast("int"), cells=cells))
    return head.unionByName(rows)


@query(
    "sheet_fold",
    """select '#/tables/' || (substr(o_orderpriority, 1, 1)::int - 1) as table_ref, o_orderkey::int as row, c.col, greatest(1, o_orderkey % 3)::int as row_span, 1 as col_span, case c.col when 0 then o_orderstatus else o_custkey::varchar end as text,
 case c.col when 1 then 'B' || (o_orderkey + 1) else '' end as key from orders, (values (0), (1)) c(col) where o_orderkey % 97 <> 0""",
)
def sheet_fold(spark, sf):
    cells = office.sheet_cells(_sheets(spark, sf))
    return cells.select("table_ref", "row", "col", "row_span", "col_span", "text", F.coalesce("key", F.lit("")).alias("key"))


def _slides(spark, sf):
    """A slide for every conversation, an outline shape for every turn."""
    c = table(spark, sf, "conversations")
    slides = _event(c.groupBy("conv_id").agg(F.max("turn").alias("t")), F.col("conv_id"), F.lit(0), "slide", _json(index=F.col("conv_id"), name=F.concat(F.lit("s"), F.col("conv_id").cast("string")), layout=F.lit(1)))
    run = F.array(F.struct(F.col("text").alias("text")))
    paragraph = F.array(F.struct((F.col("turn") % 3).cast("int").alias("outline_depth"), run.alias("runs")))
    place = F.struct(F.lit(10).alias("x"), F.lit(20).alias("y"))
    shapes = _event(c, F.col("conv_id"), F.col("turn") + 1, "slide_shape", _json(slide_index=F.col("conv_id"), placeholder_role=F.lit("OUTLINE"), paragraphs=paragraph, position=place, width_twips=F.lit(100), height_twips=F.lit(50)))
    return slides.unionByName(shapes)


@query(
    "slide_outline",
    """select conv_id as doc_id, '#/texts/' || (row_number() over (partition by conv_id order by turn) - 1) as ref, '#/groups/0' as parent_ref, case turn % 3 when 0 then 'SECTION_HEADER' else 'LIST_ITEM' end as label, text from conversations""",
)
def slide_outline(spark, sf):
    items = office.office_items(_slides(spark, sf), ("slide", "slide_shape"))
    return items.filter("arena = 'texts'").select("doc_id", "ref", "parent_ref", "label", "text")


@query("slide_provenance", "select conv_id as doc_id, '#/texts/' || (row_number() over (partition by conv_id order by turn) - 1) as ref, (conv_id + 1)::bigint as page_no, 10::double as \"left\", 110::double as \"right\", length(text)::bigint as \"end\" from conversations")
def slide_provenance(spark, sf):
    events = _slides(spark, sf)
    items = office.office_items(events, ("slide", "slide_shape"))
    return office.provenance(items.filter("arena = 'texts'"), events).select("doc_id", "ref", F.col("page_no").cast("bigint").alias("page_no"), "left", "right", "end")


def _charts(spark, sf):
    """A chart of each kind in turn for every vector; categories are one short."""
    e = table(spark, sf, "embeddings")
    ys = F.transform(F.slice("embedding", 1, 3), lambda x: F.floor(x * F.lit(1000).cast("float")).cast("double"))
    xs = F.transform(F.slice("embedding", 4, 2), lambda x: F.floor(x * F.lit(1000).cast("float")).cast("double"))
    series = F.array(*(F.struct(F.lit(n).alias("label"), ys.alias("values_y"), xs.alias("values_x")) for n in ("a", "b")))
    kinds = F.array(*(F.lit(k) for k in ("BAR", "LINE", "PIE", "SCATTER", "NET")))
    chart = F.struct(F.element_at(kinds, (F.col("vec_id") % 5 + 1).cast("int")).alias("kind"), F.array(F.lit("c0"), F.lit("c1")).alias("categories"), series.alias("series"))
    return _event(e, F.col("vec_id"), F.lit(0), "embedded_object", _json(kind=F.lit("CHART"), name=F.lit("chart"), chart=chart))


@query(
    "chart_projection",
    """with p as (select vec_id, (['bar', 'line', 'pie', 'scatter', 'none'])[vec_id % 5 + 1] as shape, s.range as series_idx, i.range as point_idx, floor(embedding[i.range + 1] * 1000)::double as y, case when i.range < 2 then floor(embedding[i.range + 4] * 1000)::double end as gx from embeddings, range(2) s, range(3) i)
 select vec_id as doc_id, shape, series_idx::int as series_idx, point_idx::int as point_idx, case when shape in ('bar', 'pie') then case when point_idx < 2 then 'c' || point_idx else (point_idx + 1)::varchar end when shape = 'line' then (['a', 'b'])[series_idx + 1] else '' end as label,
 case shape when 'line' then coalesce(gx, point_idx) when 'scatter' then gx else 0 end::double as x, y from p where (shape in ('bar', 'pie') and series_idx = 0) or shape = 'line' or (shape = 'scatter' and gx is not null)""",
)
def chart_projection(spark, sf):
    p = office.chart_points(_charts(spark, sf))
    return p.select("doc_id", "shape", "series_idx", "point_idx", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("x", F.lit(0.0)).alias("x"), "y")


def _paragraphs(spark, sf):
    """A paragraph for every line of the documents; titles, headings, list items and plain text in turn."""
    lines = adapter.lines(spark, sf)
    k = F.col("line_idx")
    run = F.array(F.struct(F.col("text").alias("text"), F.lit(100.0).alias("weight")))
    at = lambda x, y: F.struct(F.lit(x).alias("x"), (F.lit(y) + k).alias("y"))
    payload = _json(style=F.when(k == 0, "Title").otherwise("Body"), outline_level=F.when(k % 4 == 1, 2).otherwise(0), list_level=F.when(k % 4 == 2, 0).otherwise(-1), runs=run, page_index=F.lit(0), start=at(30, 40), end=at(15, 60), char_offset=F.lit(5))
    return _event(lines, F.col("doc_id"), k, "paragraph", payload)


@query("paragraph_items", adapter.oracle("select doc_id, '#/texts/' || line_idx as ref, case when line_idx = 0 then 'TITLE' when line_idx % 4 = 1 then 'SECTION_HEADER' when line_idx % 4 = 2 then 'LIST_ITEM' else 'TEXT' end as label, case when line_idx > 0 and line_idx % 4 = 1 then 2 else 0 end as level, text from lines"))
def paragraph_items(spark, sf):
    items = office.office_items(_paragraphs(spark, sf), ("paragraph",))
    return items.select("doc_id", "ref", "label", F.coalesce("level", F.lit(0)).alias("level"), "text")


def _remarks(spark, sf):
    """Comments and bookmarks: one of each for every line."""
    lines = adapter.lines(spark, sf)
    k = F.col("line_idx")
    said = _event(lines, F.col("doc_id"), 2 * k, "comment", _json(text=F.col("text"), author=F.col("origin"), char_start=F.lit(-1)))
    marked = _event(lines, F.col("doc_id"), 2 * k + 1, "bookmark", _json(name=F.concat(F.lit("b"), (k % 3).cast("string")), char_start=k, char_end=k + 1, page_index=F.lit(-1)))
    return said.unionByName(marked)


@query("comment_section", adapter.oracle("select doc_id, '#/texts/' || line_idx as ref, '#/groups/0' as parent_ref, 'FURNITURE' as layer, text from lines"))
def comment_section(spark, sf):
    items = office.office_items(_remarks(spark, sf), ("comment", "bookmark"))
    return items.filter("arena = 'texts'").select("doc_id", "ref", "parent_ref", "layer", "text")


@query("bookmark_fields", adapter.oracle("""select doc_id, 'bookmark:b' || (line_idx % 3) as key, '{"char_start":' || max(line_idx) || ',"char_end":' || (max(line_idx) + 1) || '}' as value from lines group by 1, 2"""))
def bookmark_fields(spark, sf):
    return office.body_fields(office.office_items(_remarks(spark, sf), ("bookmark",)))


_ROLES = """r as (select conv_id, turn, text, turn % 6 as m from conversations)"""


@query(
    "slide_roles",
    f"""with {_ROLES} select conv_id as doc_id, turn as seq, case m when 4 then 'PICTURE' when 0 then 'TITLE' else 'TEXT' end as label, case m when 2 then 'NOTES' else 'BODY' end as layer, case m when 4 then '' when 1 then text || chr(10) || 'x' else text end as text, case m when 2 then -1 else 7 end as page from r where m not in (3, 5)""",
)
def slide_roles(spark, sf):
    """Shapes of a slide that are no outline: a title, two paragraphs, a note, an empty placeholder, a picture and a shape without text."""
    c, m = table(spark, sf, "conversations"), F.col("turn") % 6
    paragraph = lambda t: F.struct(F.array(F.struct(t.alias("text"))).alias("runs"))
    said = F.when(m == 1, F.array(paragraph(F.col("text")), paragraph(F.lit("x")))).when(m < 4, F.array(paragraph(F.col("text"))))
    kind = F.when(m == 4, "com.sun.star.drawing.GraphicObjectShape").otherwise("com.sun.star.drawing.CustomShape")
    payload = _json(slide_index=F.lit(7), placeholder_role=F.when(m == 0, "TITLE").otherwise(""), notes=m == 2, is_empty_placeholder=m == 3, shape_type=kind, paragraphs=said, position=F.struct(F.lit(1).alias("x"), F.lit(2).alias("y")), width_twips=F.lit(3), height_twips=F.lit(4))
    items = office.office_items(_event(c, F.col("conv_id"), F.col("turn"), "slide_shape", payload), ("slide_shape",))
    return items.select("doc_id", "seq", "label", "layer", F.coalesce("text", F.lit("")).alias("text"), F.get("prov", F.lit(0))["page_index"].alias("page"))
