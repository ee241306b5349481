"""From raw documents to items, offsets, cells, edges, pages and errors, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators import assembly, binding, layout, models, office, tables
from pagewright.sources import files, pdf
from pagewright.streaming.run import once

BOX = ("left", "top", "right", "bottom")
PAGE = ["doc_id", "page_no"]


@dataclass(frozen=True)
class Config:
    """Model factories are optional; without them only digital text is read."""

    renderer: Callable[[DataFrame, DataFrame], DataFrame] | None = None  # (documents, pages) -> pages with a raster
    recognizer: Callable | None = None
    detector: Callable | None = None
    cropper: Callable | None = None  # what follows works on crops of the detector's regions
    structurer: Callable | None = None
    classifier: Callable | None = None
    decoder: Callable | None = None
    barcodes: str = "class_triggered"
    collector: str = "engine"


def assemble(pages: DataFrame, lines: DataFrame, regions: DataFrame, cells: DataFrame, collector: str = "engine", only: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Tables of a document from its pages' lines, regions and recognised cells; ``only`` names those that are asked for."""
    bound = binding.bind_regions(lines.filter("text <> ''"), regions)
    part = lambda label, arena: assembly.stable_refs(regions.filter(F.col("label") == label), arena, ["page_no", "region_idx"])
    table_items, pictures = part("table", "tables"), part("figure", "pictures")
    grids = tables.table_grids(bound.filter("region_label = 'table'"), cells)
    out = {"cells": grids.join(table_items.select("doc_id", "page_no", "region_idx", "ref"), [*PAGE, "region_idx"]).select("doc_id", "ref", "row", "col", "text", "header"), "pages": pages}
    if only is not None and set(only) <= set(out):
        return {k: out[k] for k in only}  # the reading order is dear, and only the other tables need it
    boxed = bound.join(regions.select(*PAGE, "region_idx", *(F.col(e).alias(f"r_{e}") for e in BOX)), [*PAGE, "region_idx"], "left")
    ordered = layout.reading_order(boxed)
    page_source = pages.select(*PAGE, F.col("source").alias("page_source"))
    source = assembly.text_source(F.col("origin"), F.col("page_source"))
    texts = ordered.join(page_source, PAGE, "left").withColumn("source", source).withColumn("label", assembly.item_label(F.col("region_label")))
    # the reading order is found by sequential scans: once, for all the tables below
    texts = once(assembly.stable_refs(texts, "texts", ["page_no", "read_idx"]).withColumn("tag", assembly.source_tag(collector, F.col("source"), F.col("confidence"))))
    offsets = assembly.text_offsets(texts, ["page_no", "read_idx"])
    body = assembly.body_order(texts.withColumn("ord", F.col("read_idx")), table_items.withColumn("ord", F.col("region_idx")), pictures.withColumn("ord", F.col("region_idx")))
    edges = body.select("doc_id", F.lit("#/body").alias("parent_ref"), F.col("ref").alias("child_ref"), F.col("body_ord").alias("ord"))
    shape = ["doc_id", "page_no", "ref", "label", "text", *BOX]
    items = texts.select(*shape).unionByName(table_items.select("doc_id", "page_no", "ref", F.lit("TABLE").alias("label"), F.lit("").alias("text"), *BOX)).unionByName(pictures.select("doc_id", "page_no", "ref", F.lit("PICTURE").alias("label"), F.lit("").alias("text"), *BOX))
    out |= {
        "items": items,
        "offsets": offsets.select("doc_id", "page_no", "ref", "utf_start", "utf_end", "confidence", "source"),
        "edges": edges,
        "texts": assembly.plain_text(texts.withColumn("ord", F.struct("page_no", "read_idx"))),
    }
    return {k: v for k, v in out.items() if only is None or k in only}


_REGION = "doc_id {0}, page_no int, region_idx int, label string, confidence float, left int, top int, right int, bottom int"
_CELL = "doc_id {0}, page_no int, region_idx int, cell_idx int, row int, col int, row_span int, col_span int, header boolean, left int, top int, right int, bottom int"


_FIGURE = "doc_id {0}, page_no int, region_idx int, ref string, figure_classes array<struct<label:string,confidence:double>>, barcodes array<struct<format:string,text:string>>"
_FIELD = "doc_id {0}, key string, value string"


def office_tables(events: DataFrame) -> dict[str, DataFrame]:
    """The tables of ``assemble``, and ``fields``, for documents given as office events (doc_id, seq, kind, payload).

    Places are twips of the page; the cells are those of tables and sheets.
    """
    items = office.stamped(office.office_items(events))
    first = office.provenance(items, events).filter("prov_idx = 0").select("doc_id", "ref", "page_no", *(F.col(e).cast("int").alias(e) for e in BOX))
    kept = items.filter(F.col("arena").isin("texts", "tables", "pictures", "groups"))
    placed = kept.join(first, ["doc_id", "ref"], "left")
    order = ["seq", "sub_ord"]
    texts = assembly.text_offsets(items.filter("arena = 'texts'").withColumn("text", F.coalesce("text", F.lit(""))), order)
    edge_ord = F.row_number().over(Window.partitionBy("doc_id", "parent_ref").orderBy(*order)) - 1
    cells = office.table_cells(items, events).select("doc_id", "ref", "row", "col", "text", F.lit(False).alias("header"))
    sheets = office.sheet_cells(events).select("doc_id", F.col("table_ref").alias("ref"), "row", F.col("col").cast("int").alias("col"), "text", F.lit(False).alias("header"))
    pages = office.document_pages(events).select("doc_id", "page_no", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.lit("OFFICE").alias("source"), F.lit(True).alias("skip_ocr"))
    return {
        "items": placed.select("doc_id", "page_no", "ref", "label", F.coalesce("text", F.lit("")).alias("text"), *BOX),
        "offsets": texts.join(first.select("doc_id", "ref", "page_no"), ["doc_id", "ref"], "left").select("doc_id", "page_no", "ref", "utf_start", "utf_end", F.lit(None).cast("float").alias("confidence"), F.lit("OFFICE").alias("source")),
        "cells": cells.unionByName(sheets),
        "edges": kept.select("doc_id", "parent_ref", F.col("ref").alias("child_ref"), edge_ord.alias("ord")),
        "pages": pages,
        "texts": assembly.plain_text(texts.withColumn("ord", F.struct(*order))),
        "fields": office.body_fields(items),
        "errors": office.document_errors(events),
    }


def parse_documents(docs: DataFrame, config: Config = Config(), events: DataFrame | None = None, only: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """``docs`` (doc_id, filename, content_type, content) to the tables of ``assemble``, ``figures``, ``fields`` and ``errors``.

    ``events`` holds the office documents' events (doc_id, seq, kind, payload),
    as an office program gives them.  A document that cannot be read, and an
    office document without events, gives a row of ``errors`` and nothing else.
    What files and models give is computed here, once, and kept in the shared
    folder; the tables are lazy plans over it.  ``only`` names the tables of
    ``assemble`` that are asked for: without those that need it, no reading order
    is computed.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    route = files.routed(docs)
    pages, lines, broken = pdf.pdf_pages_and_lines(route.filter("route = 'pdf'"))
    rasters = files.raster_pages(route)
    pages = pages.unionByName(rasters.drop("raster"))
    regions, cells = spark.createDataFrame([], _REGION.format(kind)), spark.createDataFrame([], _CELL.format(kind))
    if config.recognizer or config.detector:
        pixels = rasters
        if config.renderer:
            pixels = pixels.unionByName(config.renderer(route.filter("route = 'pdf'"), models.needs_models(pages.filter("source = 'DIGITAL_PDF' or not skip_ocr"), bool(config.detector), False)))
        if config.recognizer:
            lines = binding.merge_recognised(lines, once(models.recognised_lines(pixels, config.recognizer))).withColumn("line_idx", F.col("merged_idx")).drop("merged_idx", "src_ord")
        if config.detector:
            regions = once(models.detected_regions(pixels, config.detector))
    figures, fields = spark.createDataFrame([], _FIGURE.format(kind)), spark.createDataFrame([], _FIELD.format(kind))
    if config.detector and config.cropper:
        crops = models.cropped(pixels, regions, config.cropper)
        if config.structurer:
            cells = once(models.structured_cells(crops, config.structurer))
        if config.classifier:
            figures = models.classified(crops, config.classifier)
            figures = models.decoded(figures, config.decoder, config.barcodes) if config.decoder else figures.withColumn("barcodes", F.array().cast(models.BARCODES))
            named = assembly.stable_refs(regions.filter("label = 'figure'"), "pictures", ["page_no", "region_idx"]).select(*PAGE, "region_idx", "ref")
            figures = once(named.join(figures, [*PAGE, "region_idx"]).select(*PAGE, "region_idx", "ref", "figure_classes", "barcodes"))
    out = assemble(pages, lines, regions, cells, config.collector, only)
    unread = route.filter("route = 'office'").select("doc_id")
    if events is not None:
        own = events.join(unread, "doc_id", "left_semi")
        read = office_tables(own)
        fields, failed = read.pop("fields"), read.pop("errors")
        out = {k: v.unionByName(read[k]) for k, v in out.items()}
        unread = unread.join(own.select("doc_id").distinct(), "doc_id", "left_anti")
    invalid = route.filter("route = 'invalid'").select("doc_id", F.lit("INVALID_ARGUMENT").alias("code"), "error")
    none = unread.select("doc_id", F.lit("FAILED_PRECONDITION").alias("code"), F.lit("there are no office events of the document").alias("error"))
    errors = invalid.unionByName(broken).unionByName(none)
    return out | {"figures": figures, "fields": fields, "errors": errors if events is None else errors.unionByName(failed)}


def responses(tables_: dict[str, DataFrame], docs: DataFrame) -> DataFrame:
    """One row a document: status, text, items, errors and origin, as an in-body answer holds them.

    A document with errors and items is a partial success.
    """
    items = tables_["items"].groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "ref", "label", "text"))).alias("items"))
    errors = tables_["errors"].groupBy("doc_id").agg(F.collect_list(F.struct("code", "error")).alias("errors"))
    origin = F.struct(*(F.col(c) for c in ("filename", "mimetype", "binary_hash"))).alias("origin")
    out = files.identified(docs).select("doc_id", origin).join(tables_["texts"], "doc_id", "left").join(items, "doc_id", "left").join(errors, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("errors").isNull(), "SUCCESS").when(F.col("items").isNull(), "FAILURE").otherwise("PARTIAL_SUCCESS").alias("status"), F.coalesce("text", F.lit("")).alias("text"), "items", "errors", "origin")


def json_lines(events: DataFrame, top: int = 3) -> DataFrame:
    """One compact JSON text a row; of figure classes, the first ``top``."""
    cols = [F.slice(c, 1, top).alias(c) if c == "figure_classes" else F.col(c) for c in events.columns]
    return events.select(F.to_json(F.struct(*cols)).alias("value"))


def numbered_events(pages: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """(doc_id, seq, event, page_no, collector, error): page rows, then the documents of the collectors, then one end.

    ``outcomes`` (doc_id, plan_ord, collector, success, error): each success is a ``collector_document`` event.  The end is
    ``complete`` with the first failure's error if there is a page or a success, else ``error``.
    """
    no = F.lit(None).cast("string")
    none = F.lit(None).cast("int")
    events = pages.select("doc_id", F.lit(0).alias("rank"), F.col("page_no").alias("place"), F.lit("page").alias("event"), "page_no", no.alias("collector"), no.alias("error"))
    ends = pages.groupBy("doc_id").agg(F.lit(True).alias("good"), no.alias("error"))
    if outcomes is not None:
        events = events.unionByName(outcomes.filter("success").select("doc_id", F.lit(1).alias("rank"), F.col("plan_ord").alias("place"), F.lit("collector_document").alias("event"), none.alias("page_no"), "collector", no.alias("error")))
        told = outcomes.groupBy("doc_id").agg(F.bool_or("success").alias("good"), F.min_by("error", F.when(~F.col("success"), F.col("plan_ord"))).alias("error"))
        ends = ends.unionByName(told).groupBy("doc_id").agg(F.bool_or("good").alias("good"), F.max("error").alias("error"))
    last = ends.select("doc_id", F.lit(2).alias("rank"), F.lit(0).alias("place"), F.when(F.col("good"), "complete").otherwise("error").alias("event"), none.alias("page_no"), no.alias("collector"), "error")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "place")) - 1
    return events.unionByName(last).withColumn("seq", n.cast("bigint")).select("doc_id", "seq", "event", "page_no", "collector", "error")
