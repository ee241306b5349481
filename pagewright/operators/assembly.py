"""Items of a document: references, offsets, labels, sources and plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.binding import ordered_text

# Region label -> item label; anything else is TEXT.
ITEM_LABELS = {"title": "TITLE", "list": "LIST_ITEM"}
# Models that item sources name.
MODELS = {"DIGITAL_PDF": "poppler-text", "OCR": "rapidocr", "structured": "slanet-plus", "geometry": "geometry", "picture": "picodet-publaynet"}


def usable(lines: DataFrame) -> DataFrame:
    """Lines with a text and a polygon."""
    return lines.filter("text <> '' and size(polygon) > 0")


def item_label(region_label: Column) -> Column:
    out = F.lit("TEXT")
    for label, item in ITEM_LABELS.items():
        out = F.when(region_label == label, item).otherwise(out)
    return out


def text_source(line_origin: Column, page_source: Column) -> Column:
    """The line's origin, else what the page is; a merged page without origin counts as OCR."""
    return F.coalesce(line_origin, F.when(page_source == "DIGITAL_PDF", "DIGITAL_PDF").otherwise("OCR"))


def source_tag(collector: str, source: Column, confidence: Column) -> Column:
    """Struct (collector, model, confidence): who made an item."""
    model = F.try_element_at(F.create_map(*(F.lit(x) for kv in MODELS.items() for x in kv)), source)
    return F.struct(F.lit(collector).alias("collector"), model.alias("model"), confidence.alias("confidence"))


def text_offsets(items: DataFrame, order: list[str], text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``items`` with ``utf_start`` and ``utf_end`` in code points of the texts joined by a newline, and ``char_end`` within the item."""
    w = Window.partitionBy(doc).orderBy(*order)
    size = F.char_length(text).cast("bigint")
    end = F.sum(size + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return items.withColumn("utf_end", end).withColumn("utf_start", F.col("utf_end") - size).withColumn("char_end", size)


def stable_refs(items: DataFrame, arena: str, order: list[str], doc: str = "doc_id") -> DataFrame:
    """``items`` with ``ref``, ``#/<arena>/<n>`` with n counted across the document's pages."""
    n = F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1
    return items.withColumn("ref", F.concat(F.lit(f"#/{arena}/"), n.cast("string")))


def body_order(texts: DataFrame, tables: DataFrame, pictures: DataFrame) -> DataFrame:
    """(doc_id, page_no, ref, body_ord): texts in reading order, then tables, then pictures, page by page."""
    parts = [d.select("doc_id", "page_no", "ref", F.lit(k).alias("kind_rank"), F.col("ord")) for k, d in enumerate((texts, tables, pictures))]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "kind_rank", "ord")) - 1
    return union.withColumn("body_ord", n).select("doc_id", "page_no", "ref", "body_ord")


def plain_text(items: DataFrame, order: str = "ord", doc: str = "doc_id") -> DataFrame:
    """(doc, text): item texts joined by newlines; empty ones before the first text add nothing, later ones keep their separator."""
    joined = items.groupBy(doc).agg(ordered_text([order], "\n").alias("text"))
    return joined.withColumn("text", F.regexp_replace("text", r"^\n+", ""))


def line_charspan(start: Column, end: Column, item_start: Column, item_length: Column) -> Column:
    """A measured line span moved by the item's start and clipped to its end."""
    to = lambda v: F.least(v + item_start, item_start + item_length)
    return F.struct(to(start).alias("start"), to(end).alias("end"))


def runs_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.coalesce(r["text"], F.lit(""))), "")


def runs_length(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda a, r: a + F.char_length(F.coalesce(r["text"], F.lit(""))))


def uniform_formatting(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bold, italic, underline, strike): set only if all runs agree on every flag and one at least is on; null otherwise."""
    flags = {"bold": F.col("weight") >= 150, "italic": F.col("italic"), "underline": F.col("underline"), "strike": F.col("strike")}
    on = runs.groupBy(*keys).agg(*(F.bool_and(c).alias(f"{n}_all") for n, c in flags.items()), *(F.bool_or(c).alias(f"{n}_any") for n, c in flags.items()))
    agree, some = F.lit(True), F.lit(False)
    for n in flags:
        agree, some = agree & (F.col(f"{n}_all") == F.col(f"{n}_any")), some | F.col(f"{n}_any")
    return on.select(*keys, *(F.when(agree & some, F.col(f"{n}_all")).alias(n) for n in flags))


def hyperlink_spans(runs: DataFrame, keys: list[str], order: str = "run_idx") -> DataFrame:
    """(keys, link_idx, url, start, end): runs in a row with one link make one span, in the item's code points.

    ``link_idx`` 0 is the item's own link.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    link = F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in ("url", "target", "name")))
    size = F.char_length(F.coalesce("text", F.lit(""))).cast("bigint")
    marked = runs.withColumn("__link", link).withColumn("__end", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__start", F.col("__end") - size)
    change = F.coalesce((F.lag("__link").over(w) != F.col("__link")).cast("int"), F.lit(1))
    island = marked.withColumn("__change", change).withColumn("__island", F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = island.filter("__link.url <> ''").groupBy(*keys, "__island", F.col("__link.url").alias("url")).agg(F.min("__start").alias("start"), F.max("__end").alias("end"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("__island")) - 1
    return spans.withColumn("link_idx", n).select(*keys, "link_idx", "url", "start", "end")


def visual_lines(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, visual_line, text): items in a row join where they share over half of the smaller height."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = {e: F.lag(e).over(w) for e in ("top", "bottom")}
    shared = F.least("bottom", prev["bottom"]) - F.greatest("top", prev["top"])
    least = F.least(F.col("bottom") - F.col("top"), prev["bottom"] - prev["top"])
    new = F.coalesce(~(shared * 2 > least), F.lit(True))
    marked = items.withColumn("__new", new.cast("int"))
    numbered = marked.withColumn("visual_line", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(*keys, "visual_line").agg(ordered_text([order]).alias("text"))
