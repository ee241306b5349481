"""Queries over lines, regions, tables and items."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.operators import assembly, binding, documents, layout, models, tables
from pagewright.plans import adapter
from pagewright.plans.adapter import oracle
from pagewright.plans.catalog import query

BOX = ("left", "top", "right", "bottom")


@query("text_offsets", oracle("""select doc_id, page_no, line_idx, (sum(length(text) + 1) over w - 1 - length(text))::bigint as utf_start, (sum(length(text) + 1) over w - 1)::bigint as utf_end from lines window w as (partition by doc_id order by line_idx)"""))
def text_offsets(spark, sf):
    rows = assembly.text_offsets(adapter.lines(spark, sf), ["line_idx"])
    return rows.select("doc_id", "page_no", "line_idx", "utf_start", "utf_end")


@query("text_export", oracle("""select doc_id, string_agg(text, chr(10) order by line_idx) as text from lines group by doc_id"""))
def text_export(spark, sf):
    return assembly.plain_text(adapter.lines(spark, sf), "line_idx")


@query("stable_refs", oracle("""select doc_id, page_no, line_idx, '#/texts/' || (row_number() over (partition by doc_id order by page_no, line_idx) - 1) as ref from lines"""))
def stable_refs(spark, sf):
    return assembly.stable_refs(adapter.lines(spark, sf), "texts", ["page_no", "line_idx"]).select("doc_id", "page_no", "line_idx", "ref")


@query(
    "line_boxes",
    oracle("""select doc_id, line_idx, "left", top, "right", bottom, ("right" - "left")::bigint as width, (bottom - top)::bigint as height, ("right" - "left")::bigint * (bottom - top) as area, (("left" + "right") // 2)::bigint as centre_x, ((top + bottom) // 2)::bigint as centre_y from lines where text <> ''"""),
)
def line_boxes(spark, sf):
    rows = assembly.usable(adapter.lines(spark, sf).withColumn("polygon", adapter.polygon()))
    rows = rows.select("doc_id", "line_idx", G.polygon_box().alias("b"))
    b = G.Box.of(F.col("b"))
    return rows.select("doc_id", "line_idx", "b.*", b.width.alias("width"), b.height.alias("height"), b.area.alias("area"), b.centre_x.alias("centre_x"), b.centre_y.alias("centre_y"))


def _pairs(spark, sf):
    a = adapter.lines(spark, sf).filter("origin = 'DIGITAL_PDF'").select("doc_id", "page_no", "line_idx", *BOX)
    b = adapter.recognised(spark, sf).select("doc_id", "page_no", F.col("line_idx").alias("other_idx"), *(F.col(e).alias(f"o_{e}") for e in BOX))
    return a.join(b, ["doc_id", "page_no"])


_IOU = """pairs as (select a.doc_id, a.line_idx, b.line_idx as other_idx, a."left" al, a.top aty, a."right" ar, a.bottom ab, b."left" bl, b.top bt, b."right" br, b.bottom bb,
  greatest(0, least(a."right", b."right") - greatest(a."left", b."left"))::bigint * greatest(0, least(a.bottom, b.bottom) - greatest(a.top, b.top)) as shared
  from lines a join recognised b on a.doc_id = b.doc_id and a.page_no = b.page_no where a.origin = 'DIGITAL_PDF'),
scored as (select *, (shared / ((ar - al)::bigint * (ab - aty) + (br - bl)::bigint * (bb - bt) - shared))::float as iou from pairs)"""


@query("iou_pairs", oracle("select doc_id, line_idx, other_idx, iou from scored where iou > 0", _IOU))
def iou_pairs(spark, sf):
    rows = _pairs(spark, sf).select("doc_id", "line_idx", "other_idx", G.iou(G.Box.named(), G.Box.named("o_")).alias("iou"))
    return rows.filter("iou > 0")


@query("overlap_pairs", oracle("""select doc_id, line_idx, other_idx from scored where iou >= 0.25::float or ((al + ar) // 2 between bl and br and (aty + ab) // 2 between bt and bb) or ((bl + br) // 2 between al and ar and (bt + bb) // 2 between aty and ab)""", _IOU))
def overlap_pairs(spark, sf):
    return _pairs(spark, sf).filter(G.overlaps(G.Box.named(), G.Box.named("o_"))).select("doc_id", "line_idx", "other_idx")


@query(
    "digital_ocr_merge",
    oracle(
        """select doc_id, page_no, line_idx, text, origin, (row_number() over (partition by doc_id, page_no order by top, "left", src, line_idx) - 1)::int as merged_idx from
 (select *, 0 as src from lines where origin = 'DIGITAL_PDF' union all select *, 1 from recognised r where not exists (select 1 from scored s where s.doc_id = r.doc_id and s.other_idx = r.line_idx and
  (iou >= 0.25::float or ((al + ar) // 2 between bl and br and (aty + ab) // 2 between bt and bb) or ((bl + br) // 2 between al and ar and (bt + bb) // 2 between aty and ab))))""",
        _IOU,
    ),
)
def digital_ocr_merge(spark, sf):
    digital = adapter.lines(spark, sf).filter("origin = 'DIGITAL_PDF'")
    return binding.merge_recognised(digital, adapter.recognised(spark, sf)).select("doc_id", "page_no", "line_idx", "text", "origin", "merged_idx")


@query(
    "coverage_gate",
    oracle(
        r"""select doc_id, page_no, n_lines, n_bytes, coverage, n_bytes >= 32 and n_lines >= 4 and (coverage >= 0.12 or n_bytes >= 128) as skip_ocr from (
 select doc_id, page_no, count(*) as n_lines, sum(strlen(regexp_replace(text, '[ \t\n\r\f\x0B]', '', 'g')))::bigint as n_bytes, (greatest(0, max(bottom)) - least(2200, min(top))) / 2200.0::double as coverage from lines group by 1, 2)"""
    ),
)
def coverage_gate(spark, sf):
    return documents_gate(adapter.lines(spark, sf), F.lit(adapter.HEIGHT))


def documents_gate(lines, extent):
    """Per page: line count, bytes that are no white space, vertical coverage, and whether recognition can be skipped."""
    bare = F.octet_length(F.regexp_replace("text", r"[ \t\n\r\f\x0B]", "")).cast("bigint")
    spread = (F.greatest(F.lit(0), F.max("bottom")) - F.least(extent, F.min("top"))).cast("double") / extent.cast("double")
    stats = lines.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(bare).alias("n_bytes"), F.when(extent > 0, spread).otherwise(F.lit(0.0)).alias("coverage"))
    return stats.withColumn("skip_ocr", (F.col("n_bytes") >= 32) & (F.col("n_lines") >= 4) & ((F.col("coverage") >= 0.12) | (F.col("n_bytes") >= 128)))


@query("region_bind", oracle("select doc_id, page_no, line_idx, region_idx, region_label from bound"))
def region_bind(spark, sf):
    return _bound(spark, sf).select("doc_id", "page_no", "line_idx", "region_idx", "region_label")


def _bound(spark, sf):
    return binding.bind_regions(adapter.lines(spark, sf), adapter.regions(spark, sf))


@query(
    "item_labels",
    oracle("""select doc_id, line_idx, case region_label when 'title' then 'TITLE' when 'list' then 'LIST_ITEM' else 'TEXT' end as label, origin as source, case origin when 'OCR' then 'rapidocr' else 'poppler-text' end as model, confidence from bound"""),
)
def item_labels(spark, sf):
    source = assembly.text_source(F.col("origin"), F.lit("MERGED"))
    rows = _bound(spark, sf).withColumn("source", source).withColumn("tag", assembly.source_tag("engine", source, F.col("confidence")))
    return rows.select("doc_id", "line_idx", assembly.item_label(F.col("region_label")).alias("label"), "source", "tag.model", "tag.confidence")


_TABLE = """tl as (select * from bound where region_label = 'table' and text <> '')"""


def _table_lines(spark, sf):
    return _bound(spark, sf).filter("region_label = 'table'")


@query(
    "geometry_row_bands",
    oracle(
        """select doc_id, page_no, line_idx, sum(n) over (partition by doc_id, page_no order by top, "left", line_idx)::int as band from
 (select *, coalesce((top + bottom) // 2 > max(bottom) over (partition by doc_id, page_no order by top, "left", line_idx rows between unbounded preceding and 1 preceding), false)::int as n from tl)""",
        _TABLE,
    ),
)
def geometry_row_bands(spark, sf):
    return tables.row_bands(_table_lines(spark, sf)).select("doc_id", "page_no", "line_idx", "band")


_COLUMNS = """gut as (select doc_id, page_no, region_idx, greatest(2, (list_sort(list(bottom - top)))[len(list(bottom - top)) // 2 + 1] // 2) as gutter from tl group by 1, 2, 3),
isl as (select t.*, gutter, coalesce("left" > max("right") over (partition by t.doc_id, t.page_no order by "left", "right", line_idx rows between unbounded preceding and 1 preceding) + gutter, false)::int as n from tl t join gut g using (doc_id, page_no, region_idx)),
num as (select *, sum(n) over (partition by doc_id, page_no order by "left", "right", line_idx)::int as col from isl),
cols as (select doc_id, page_no, region_idx, col, min("left") as span_start, max("right") as span_end from num group by 1, 2, 3, 4)"""


@query("geometry_columns", oracle("select doc_id, page_no, col, span_start, span_end from cols", _TABLE, _COLUMNS))
def geometry_columns(spark, sf):
    return tables.column_spans(_table_lines(spark, sf)).select("doc_id", "page_no", "col", "span_start", "span_end")


_CELLS = """bands as (select *, sum(n) over (partition by doc_id, page_no order by top, "left", line_idx)::int as band from
 (select *, coalesce((top + bottom) // 2 > max(bottom) over (partition by doc_id, page_no order by top, "left", line_idx rows between unbounded preceding and 1 preceding), false)::int as n from tl)),
placed as (select b.doc_id, b.page_no, b.line_idx, any_value(b.band) as band, any_value(b.text) as text, any_value(b.top) as top, any_value(b."left") as l, arg_max(c.col, (case when least(b."right", span_end) > greatest(b."left", span_start) then least(b."right", span_end) - greatest(b."left", span_start) else -abs((b."left" + b."right") // 2 - (span_start + span_end) // 2) end, -c.col)) as col
  from bands b join cols c using (doc_id, page_no, region_idx) group by 1, 2, 3),
cells as (select doc_id, page_no, band as row, col, string_agg(text, ' ' order by top, l, line_idx) as text from placed group by 1, 2, 3, 4),
dense as (select * from (select doc_id, page_no, unnest(range(max(band) + 1))::int as row from bands group by 1, 2) join (select doc_id, page_no, unnest(range(max(col) + 1))::int as col from cols group by 1, 2) using (doc_id, page_no))"""


@query("geometry_cells", oracle("""select d.doc_id, d.page_no, d.row, d.col, coalesce(text, '') as text from dense d left join cells c on d.doc_id = c.doc_id and d.page_no = c.page_no and d.row = c.row and d.col = c.col""", _TABLE, _COLUMNS, _CELLS))
def geometry_cells(spark, sf):
    return tables.geometry_grid(_table_lines(spark, sf)).select("doc_id", "page_no", "row", "col", "text")


def _structured_cells(spark, sf):
    """Recognised cells of each table region: a heading over both columns, then rows of 100 pixels; the last cell spans two rows."""
    made = [(0, 0, 1, 2, True, 40, 580, 800, 680), (1, 0, 1, 1, False, 40, 681, 420, 780), (1, 1, 1, 1, False, 421, 681, 800, 780), (2, 0, 2, 1, False, 40, 781, 420, 980), (1, 1, 1, 1, False, 40, 600, 800, 700)]
    names = ("row", "col", "row_span", "col_span", "header", *BOX)
    cells = F.array(*(F.struct(F.lit(i).alias("cell_idx"), *(F.lit(v).alias(n) for n, v in zip(names, c, strict=True))) for i, c in enumerate(made)))
    return adapter.regions(spark, sf).filter("label = 'table'").select("doc_id", "page_no", "region_idx", F.inline(cells))


_STRUCTURED = """sc(cell_idx, row, col, row_span, col_span, header, l, t, r, b) as (values (0, 0, 0, 1, 2, true, 40, 580, 800, 680), (1, 1, 0, 1, 1, false, 40, 681, 420, 780), (2, 1, 1, 1, 1, false, 421, 681, 800, 780), (3, 2, 0, 2, 1, false, 40, 781, 420, 980), (4, 1, 1, 1, 1, false, 40, 600, 800, 700)),
tabs as (select doc_id, page_no from regions where label = 'table'),
texts as (select t.doc_id, t.page_no, sc.cell_idx, coalesce(string_agg(tl.text, ' ' order by tl.top, tl."left", tl.line_idx), '') as text from tabs t cross join sc left join bound tl on tl.doc_id = t.doc_id and tl.page_no = t.page_no and tl.region_label = 'table'
  and (tl."left" + tl."right") // 2 between l and r and (tl.top + tl.bottom) // 2 between t and b group by 1, 2, 3),
claims as (select cell_idx, rr as row, cc as col, header from sc, unnest(range(row, row + row_span)) as x(rr), unnest(range(col, col + col_span)) as y(cc)),
firsts as (select row, col, min(cell_idx) as cell_idx, arg_min(header, cell_idx) as header from claims group by 1, 2),
grid as (select r.range::int as row, c.range::int as col from range(4) r, range(2) c)"""


@query("structured_grid", oracle("""select t.doc_id, t.page_no, g.row, g.col, coalesce(f.cell_idx, -1) as cell_idx, coalesce(x.text, '') as text, coalesce(f.header, false) as header from tabs t cross join grid g left join firsts f on f.row = g.row and f.col = g.col left join texts x on x.doc_id = t.doc_id and x.page_no = t.page_no and x.cell_idx = f.cell_idx""", _STRUCTURED))
def structured_grid(spark, sf):
    grid = tables.structured_grid(_structured_cells(spark, sf), _bound(spark, sf))
    return grid.withColumn("cell_idx", F.coalesce("cell_idx", F.lit(-1))).select("doc_id", "page_no", "row", "col", "cell_idx", "text", "header")


def _with_boxes(lines, regions=None):
    if regions is None:
        return lines.select("*", F.lit(None).cast("int").alias("region_idx"), *(F.lit(None).cast("int").alias(f"r_{e}") for e in BOX))
    bound = binding.bind_regions(lines, regions)
    return bound.join(regions.select("doc_id", "page_no", "region_idx", *(F.col(e).alias(f"r_{e}") for e in BOX)), ["doc_id", "page_no", "region_idx"], "left")


def _shuffled(lines):
    """The same lines under indexes that say nothing of their order."""
    return lines.withColumn("k", F.col("line_idx")).withColumn("line_idx", (F.col("line_idx") * 7919 % 1009 * 10000 + F.col("line_idx")).cast("int"))


@query("reading_order_plain", oracle("""select doc_id, page_no, line_idx as k, (row_number() over (partition by doc_id, page_no order by line_idx) - 1)::int as read_idx from lines"""))
def reading_order_plain(spark, sf):
    return layout.reading_order(_with_boxes(_shuffled(adapter.lines(spark, sf)))).select("doc_id", "page_no", "k", "read_idx")


@query(
    "reading_order_regions",
    oracle("""select doc_id, page_no, line_idx as k, (row_number() over (partition by doc_id, page_no order by case region_label when 'title' then 0 when 'text' then 1 when 'table' then 2 when 'list' then 3 end, top, "left") - 1)::int as read_idx from bound"""),
)
def reading_order_regions(spark, sf):
    return layout.reading_order(_with_boxes(_shuffled(adapter.lines(spark, sf)), adapter.regions(spark, sf))).select("doc_id", "page_no", "k", "read_idx")


@query(
    "widest_gap",
    oracle(
        """select doc_id, page_no, max_by.w as gap_width, max_by.reach as gap_at from (select doc_id, page_no, arg_max({'w': w, 'reach': reach}, (w, -reach)) as max_by from (
 select *, top - reach as w from (select doc_id, page_no, top, max(bottom) over (partition by doc_id, page_no order by top, bottom rows between unbounded preceding and 1 preceding) as reach from lines) where top > reach) group by 1, 2)"""
    ),
)
def widest_gap(spark, sf):
    spans = adapter.lines(spark, sf).select("doc_id", "page_no", F.col("top").alias("span_start"), F.col("bottom").alias("span_end"))
    return layout.widest_gap(spans, ["doc_id", "page_no"])


# every label has three candidates on a page, so three steps are the whole scan
_NMS = """c as (select doc_id, page_no, region_idx, label, confidence, region_idx * 3 + n as idx, (confidence - dx / 1000)::float as conf, "left" + dx as l, top as t, "right" + dx as r, bottom as b, n from regions, (values (0, 0), (1, 20), (2, 400)) s(n, dx)),
 near as (select a.doc_id, a.page_no, a.label, a.n as n, b.n as m, greatest(0, least(a.r, b.r) - greatest(a.l, b.l)) * greatest(0, least(a.b, b.b) - greatest(a.t, b.t)) as shared, (a.r - a.l) * (a.b - a.t) + (b.r - b.l) * (b.b - b.t) as areas from c a join c b on a.doc_id = b.doc_id and a.page_no = b.page_no and a.label = b.label and a.n < b.n),
 over as (select doc_id, page_no, label, bool_or(shared > 0.5 * (areas - shared)) filter (n = 0 and m = 1) as o1, bool_or(shared > 0.5 * (areas - shared)) filter (n = 0 and m = 2) as o2, bool_or(shared > 0.5 * (areas - shared)) filter (n = 1 and m = 2) as o3 from near group by 1, 2, 3)"""


@query("nms_regions", oracle("""select c.doc_id, c.page_no, c.idx as region_idx, c.label, c.conf as confidence, c.l as "left", c.t as top, c.r as "right", c.b as bottom from c join over o on c.doc_id = o.doc_id and c.page_no = o.page_no and c.label = o.label where c.n = 0 or (c.n = 1 and not o1) or (c.n = 2 and not o2 and (o1 or not o3))""", _NMS))
def nms_regions(spark, sf):
    """Three shifted copies of every region, with falling confidence."""
    base = adapter.regions(spark, sf)
    shift = F.explode(F.array(*(F.lit(v) for v in (0, 20, 400)))).alias("dx")
    rows = base.select("*", shift).select("doc_id", "page_no", (F.col("region_idx") * 3 + F.when(F.col("dx") == 0, 0).when(F.col("dx") == 20, 1).otherwise(2)).alias("region_idx"), "label", (F.col("confidence") - F.col("dx") / 1000).cast("float").alias("confidence"), (F.col("left") + F.col("dx")).alias("left"), "top", (F.col("right") + F.col("dx")).alias("right"), "bottom")
    return binding.suppressed(rows)


@query("region_order", oracle("""select doc_id, page_no, region_idx, (row_number() over (partition by doc_id, page_no order by confidence desc, top, "left", region_idx) - 1)::int as region_ord from regions"""))
def region_order(spark, sf):
    return binding.ordered_regions(adapter.regions(spark, sf)).select("doc_id", "page_no", "region_idx", "region_ord")


@query(
    "body_order",
    oracle(
        """select doc_id, page_no, ref, (row_number() over (partition by doc_id order by page_no, kind, ord) - 1)::int as body_ord from (
 select doc_id, page_no, '#/texts/' || (row_number() over (partition by doc_id order by line_idx) - 1) as ref, 0 as kind, line_idx as ord from lines
 union all select doc_id, page_no, '#/tables/' || (row_number() over (partition by doc_id order by page_no) - 1), 1, region_idx from regions where label = 'table'
 union all select doc_id, page_no, '#/pictures/' || (row_number() over (partition by doc_id order by page_no) - 1), 2, region_idx from regions where label = 'figure')"""
    ),
)
def body_order(spark, sf):
    texts = assembly.stable_refs(adapter.lines(spark, sf), "texts", ["page_no", "line_idx"]).withColumn("ord", F.col("line_idx"))
    part = lambda label, arena: assembly.stable_refs(adapter.regions(spark, sf).filter(F.col("label") == label), arena, ["page_no", "region_idx"]).withColumn("ord", F.col("region_idx"))
    return assembly.body_order(texts, part("table", "tables"), part("figure", "pictures"))


@query("clip_regions", oracle("""select doc_id, page_no, region_idx, least("left", 1000) * (least("right", 1000) > least("left", 1000) and least(bottom, 900) > least(top, 900))::int as "left", least(top, 900) * (least("right", 1000) > least("left", 1000) and least(bottom, 900) > least(top, 900))::int as top, least("right", 1000) * (least("right", 1000) > least("left", 1000) and least(bottom, 900) > least(top, 900))::int as "right", least(bottom, 900) * (least("right", 1000) > least("left", 1000) and least(bottom, 900) > least(top, 900))::int as bottom from regions"""))
def clip_regions(spark, sf):
    return adapter.regions(spark, sf).select("doc_id", "page_no", "region_idx", G.clip(G.Box.named(), F.lit(1000), F.lit(900)).alias("b")).select("doc_id", "page_no", "region_idx", "b.*")


@query("visual_lines", oracle("""select doc_id, page_no, v::bigint as visual_line, string_agg(text, ' ' order by line_idx) as text from (select *, sum(n) over (partition by doc_id, page_no order by line_idx) - 1 as v from (
 select *, coalesce(not ((least(bottom, lag(bottom) over w) - greatest(top, lag(top) over w)) * 2 > least(bottom - top, lag(bottom) over w - lag(top) over w)), true)::int as n from (select doc_id, page_no, line_idx, text, top - 70 * (line_idx % 2) as top, bottom - 70 * (line_idx % 2) as bottom from lines) window w as (partition by doc_id, page_no order by line_idx))) group by 1, 2, 3"""))
def visual_lines(spark, sf):
    rows = adapter.lines(spark, sf).withColumns({"top": F.col("top") - 70 * (F.col("line_idx") % 2), "bottom": F.col("bottom") - 70 * (F.col("line_idx") % 2)})
    return assembly.visual_lines(rows, ["doc_id", "page_no"], "line_idx")


# --- document algebra -------------------------------------------------------


def _source(lines, plan_ord):
    items = lines.select("doc_id", F.lit(plan_ord).alias("plan_ord"), F.lit("texts").alias("arena"), F.col("line_idx").alias("idx"), F.concat(F.lit("#/texts/"), F.col("line_idx").cast("string")).alias("ref"), "text")
    edges = items.select("doc_id", "plan_ord", F.lit("#/body").alias("parent_ref"), F.col("ref").alias("child_ref"), F.col("idx").alias("ord"))
    return items, edges


def _two_sources(spark, sf):
    """Items of even documents, then of all documents."""
    rows = adapter.lines(spark, sf)
    a, b = _source(rows.filter("doc_id % 2 = 0"), 0), _source(rows, 1)
    return a[0].unionByName(b[0]), a[1].unionByName(b[1])


_MERGED = """src as (select 0 as plan_ord, doc_id, line_idx as idx, text from lines where doc_id % 2 = 0 union all select 1, doc_id, line_idx, text from lines),
merged as (select *, (row_number() over (partition by doc_id order by plan_ord, idx) - 1)::int as n from src)"""


@query("merge_documents", oracle("select doc_id, plan_ord, 'texts' as arena, n as idx, '#/texts/' || n as ref, text from merged", _MERGED))
def merge_documents(spark, sf):
    items, _ = documents.merge(*_two_sources(spark, sf))
    return items.select("doc_id", "plan_ord", "arena", "idx", "ref", "text")


@query("ref_rewrite", oracle("select doc_id, plan_ord, '#/body' as parent_ref, '#/texts/' || n as child_ref, n as ord from merged", _MERGED))
def ref_rewrite(spark, sf):
    _, edges = documents.merge(*_two_sources(spark, sf))
    return edges.select("doc_id", "plan_ord", "parent_ref", "child_ref", "ord")


@query("merge_replay", oracle("select doc_id, count(*) as n_items, count(distinct ref) as n_refs from (select doc_id, '#/texts/' || (row_number() over (partition by doc_id order by p, line_idx) - 1) as ref from lines, (values (0), (1)) t(p)) group by 1"))
def merge_replay(spark, sf):
    a, b = _source(adapter.lines(spark, sf), 0), _source(adapter.lines(spark, sf), 1)
    items, _ = documents.merge(a[0].unionByName(b[0]), a[1].unionByName(b[1]))
    return items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct("ref").alias("n_refs"))


def _checked(spark, sf):
    items, edges = documents.merge(*_two_sources(spark, sf))
    return items.select("doc_id", "ref", F.lit("text").alias("kind"), F.lit("#/body").alias("parent_ref")), edges.select("doc_id", "parent_ref", "child_ref")


@query("integrity_report", "select doc_id, '' as error, '' as ref from documents where false")
def integrity_report(spark, sf):
    return documents.integrity_errors(*_checked(spark, sf))


@query(
    "integrity_report_broken",
    oracle(
        """select doc_id, 'empty self_ref' as error, '' as ref from merged where n = 0 and doc_id % 7 = 1
 union all select doc_id, 'duplicate self_ref', '#/texts/2' from merged where n = 3 and doc_id % 7 = 2
 union all select doc_id, 'unset item', '#/texts/1' from merged where n = 1 and doc_id % 7 = 3
 union all select doc_id, 'unresolved parent', '#/groups/9' from merged where n = 0 and doc_id % 7 = 4
 union all select doc_id, 'unresolved child', '#/texts/0' from merged where n = 0 and doc_id % 7 = 1
 union all select doc_id, 'unresolved child', '#/texts/3' from merged where n = 3 and doc_id % 7 = 2
 union all select doc_id, 'parent does not list child', '#/texts/0' from merged where n = 0 and doc_id % 7 = 4
 union all select doc_id, 'unresolved table comment', '#/texts/x' from documents where doc_id % 7 = 5""",
        _MERGED,
    ),
)
def integrity_report_broken(spark, sf):
    items, edges = _checked(spark, sf)
    hit = lambda ref, m: (F.col("ref") == ref) & (F.col("doc_id") % 7 == m)
    broken = items.select(
        "doc_id",
        F.when(hit("#/texts/0", 1), "").when(hit("#/texts/3", 2), "#/texts/2").otherwise(F.col("ref")).alias("ref"),
        F.when(hit("#/texts/1", 3), None).otherwise(F.col("kind")).alias("kind"),
        F.when(hit("#/texts/0", 4), "#/groups/9").otherwise(F.col("parent_ref")).alias("parent_ref"),
    )
    comments = adapter.documents(spark, sf).filter("doc_id % 7 = 5").select("doc_id", F.lit("#/tables/0").alias("ref"), F.lit("#/texts/x").alias("comment_ref"))
    return documents.integrity_errors(broken, edges, comments)


@query("merge_root_fields", "select doc_id, key, min(v) as value from (select doc_id, 'lang' as key, 'a:' || lang as v, 0 as p from documents where doc_id % 2 = 0 union all select doc_id, 'lang', 'b:' || lang, 1 from documents union all select doc_id, 'source', 'b:' || source, 1 from documents) group by doc_id, key")
def merge_root_fields(spark, sf):
    docs = adapter.documents(spark, sf)
    row = lambda d, p, key, tag: d.select("doc_id", F.lit(p).alias("plan_ord"), F.lit(key).alias("key"), F.concat(F.lit(tag), key).alias("value"))
    rows = row(docs.filter("doc_id % 2 = 0"), 0, "lang", "a:").unionByName(row(docs, 1, "lang", "b:")).unionByName(row(docs, 1, "source", "b:"))
    return documents.first_wins(rows, ["doc_id", "key"]).select("doc_id", "key", "value")


@query(
    "geometry_cell_boxes",
    oracle("""select p.doc_id, p.page_no, p.band as row, p.col, min(t."left") as "left", min(t.top) as top, max(t."right") as "right", max(t.bottom) as bottom from placed p join tl t using (doc_id, page_no, line_idx) group by 1, 2, 3, 4""", _TABLE, _COLUMNS, _CELLS),
)
def geometry_cell_boxes(spark, sf):
    """Boxes of the cells that hold lines."""
    return tables.geometry_grid(_table_lines(spark, sf)).filter("left is not null").select("doc_id", "page_no", "row", "col", *BOX)


@query(
    "table_route",
    oracle(
        """select d.doc_id, d.page_no, d.row, d.col, coalesce(text, '') as text, false as header from dense d left join cells c on d.doc_id = c.doc_id and d.page_no = c.page_no and d.row = c.row and d.col = c.col where d.doc_id % 2 = 1
 union all select t.doc_id, t.page_no, g.row, g.col, coalesce(x.text, ''), coalesce(f.header, false) from tabs t cross join grid g left join firsts f on f.row = g.row and f.col = g.col left join texts x on x.doc_id = t.doc_id and x.page_no = t.page_no and x.cell_idx = f.cell_idx where t.doc_id % 2 = 0""",
        _TABLE, _COLUMNS, _CELLS, _STRUCTURED,
    ),
)
def table_route(spark, sf):
    """Tables with recognised cells, those of every second document, take them; the others their lines' geometry."""
    grids = tables.table_grids(_table_lines(spark, sf), _structured_cells(spark, sf).filter("doc_id % 2 = 0"))
    return grids.select("doc_id", "page_no", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "text", "header")


@query("line_charspans", oracle("""select doc_id, line_idx, least(line_idx + 3, 3 + length(text))::bigint as "start", least(line_idx + 13, 3 + length(text))::bigint as "end" from lines"""))
def line_charspans(spark, sf):
    """A measured span of ten code points from the line's number on, in an item that begins at 3."""
    k = F.col("line_idx").cast("bigint")
    span = assembly.line_charspan(k, k + 10, F.lit(3).cast("bigint"), F.char_length("text").cast("bigint"))
    return adapter.lines(spark, sf).select("doc_id", "line_idx", span.alias("s")).select("doc_id", "line_idx", "s.*")


@query("model_pages", oracle("""select doc_id, page_no from (select doc_id, page_no, bool_or(origin = 'OCR') as ocr, count(*) as n from lines group by 1, 2) where ocr or n < 30"""))
def model_pages(spark, sf):
    """Pages that have to be rendered: all but digital ones with 30 lines or more."""
    g = adapter.lines(spark, sf).groupBy("doc_id", "page_no").agg(F.bool_or(F.col("origin") == "OCR").alias("ocr"), F.count(F.lit(1)).alias("n"))
    pages = g.select("doc_id", "page_no", F.when(F.col("ocr"), "OCR").otherwise("DIGITAL_PDF").alias("source"), (F.col("n") >= 30).alias("skip_ocr"))
    return models.needs_models(pages, False, False).select("doc_id", "page_no")


@query(
    "crop_cells",
    oracle("""select doc_id, page_no, region_idx, c.cell_idx, "left" + c.l as "left", top + 2 as top, "left" + c.l + 10 as "right", top + 12 as bottom from regions, (values (0, 1), (1, 20)) c(cell_idx, l) where label = 'table' and doc_id % 2 = 0"""),
)
def crop_cells(spark, sf):
    """Cells of table crops, moved to their page; crops of odd documents hold none."""
    crops = adapter.regions(spark, sf).withColumn("crop", F.encode((F.col("doc_id") % 2).cast("string"), "utf-8"))
    cell = {"row": 0, "row_span": 1, "col_span": 1, "header": False, "top": 2, "bottom": 12}

    def structurer():
        return lambda crop: [cell | {"col": i, "left": x, "right": x + 10} for i, x in enumerate((1, 20))] if crop == b"0" else []

    return models.structured_cells(crops, structurer).select("doc_id", "page_no", "region_idx", "cell_idx", *BOX)


@query(
    "merge_arenas",
    """select doc_id, p as plan_ord, a as arena, n as idx, '#/' || a || '/' || case when p = 0 or doc_id % 2 > 0 then n else n + 2 end as new_ref from documents, (values (0), (1)) s(p), (values ('texts'), ('field_items'), ('groups'), ('key_value_items')) x(a), (values (0), (1)) i(n) where a <> 'field_items' and (p = 1 or doc_id % 2 = 0)""",
)
def merge_arenas(spark, sf):
    """Items of four arenas from one or two sources: those of field items are not merged, the others are counted on."""
    docs = adapter.documents(spark, sf).select("doc_id")
    rows = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("plan_ord")).filter("plan_ord = 1 or doc_id % 2 = 0")
    rows = rows.select("*", F.explode(F.array(*map(F.lit, ("texts", "field_items", "groups", "key_value_items")))).alias("arena")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("idx"))
    named = documents.renumbered(rows.withColumn("ref", F.concat(F.lit("#/"), "arena", F.lit("/"), F.col("idx").cast("string"))))
    return named.select("doc_id", "plan_ord", "arena", "idx", "new_ref")
