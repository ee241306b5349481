"""Seams for what needs pixels or a neural model.

A model is a callable from bytes to plain values, made once a worker by a
factory.  Each seam is an Arrow-batched function behind a native filter, so only
the pages and crops that need a model reach it, and no pixel column leaves it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.tensors import barcode_gate

LINES = "array<struct<text:string,polygon:array<struct<x:int,y:int>>,confidence:float>>"
REGIONS = "array<struct<label:string,confidence:float,left:int,top:int,right:int,bottom:int>>"
CELLS = "array<struct<row:int,col:int,row_span:int,col_span:int,header:boolean,left:int,top:int,right:int,bottom:int>>"
CLASSES = "array<struct<label:string,confidence:float>>"
BARCODES = "array<struct<format:string,text:string>>"


def batched(factory: Callable[[], Callable], kind: str) -> Callable[[Column], Column]:
    """A column function that runs a model; the model is made on first use in each worker and made anew after an error."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for values in batches:
            out = []
            for v in values:
                if v is None:
                    out.append(None)
                    continue
                if model is None:
                    model = factory()
                try:
                    out.append(model(bytes(v)))
                except Exception:
                    model = None
                    raise
            yield pd.Series(out, dtype=object)

    return run


def needs_models(pages: DataFrame, detector: bool, previews: bool) -> DataFrame:
    """Pages that must be rendered: all but digital ones with enough text, when nothing else asks for pixels."""
    if detector or previews:
        return pages
    return pages.filter(~((F.col("source") == "DIGITAL_PDF") & F.col("skip_ocr")))


def recognised_lines(pages: DataFrame, recognizer: Callable[[], Callable]) -> DataFrame:
    """Lines of the pages' rasters; pages with enough digital text are left out before the model."""
    found = pages.filter(~F.col("skip_ocr")).select("doc_id", "page_no", F.posexplode(batched(recognizer, LINES)("raster")).alias("line_idx", "l"))
    xs, ys = F.transform("l.polygon", lambda p: p["x"]), F.transform("l.polygon", lambda p: p["y"])
    kept = found.filter("l.text <> '' and size(l.polygon) > 0")
    return kept.select("doc_id", "page_no", "line_idx", "l.text", F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom"), "l.confidence", F.lit("OCR").alias("origin"))


def detected_regions(pages: DataFrame, detector: Callable[[], Callable]) -> DataFrame:
    return pages.select("doc_id", "page_no", F.posexplode(batched(detector, REGIONS)("raster")).alias("region_idx", "r")).select("doc_id", "page_no", "region_idx", "r.*")


def cropped(pages: DataFrame, regions: DataFrame, cropper: Callable[[], Callable], labels: tuple[str, ...] = ("table", "figure")) -> DataFrame:
    """(doc_id, page_no, region_idx, label, left, top, crop): regions cut out of their page's raster; empty ones are left out.

    The cropper makes the bytes of a crop from a raster and a box, which is clipped to the page's size where it is known.
    """
    edge = lambda e, size: F.greatest(F.lit(0), F.least(F.col(e), F.coalesce(F.col(size), F.lit(2**31 - 1))))
    boxed = regions.filter(F.col("label").isin(*labels)).join(pages.select("doc_id", "page_no", "width", "height", "raster"), ["doc_id", "page_no"])
    box = boxed.select("doc_id", "page_no", "region_idx", "label", edge("left", "width").alias("left"), edge("top", "height").alias("top"), edge("right", "width").alias("right"), edge("bottom", "height").alias("bottom"), "raster").filter("right > left and bottom > top")

    @F.pandas_udf("binary")
    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = cropper()
        for raster, *edges in batches:
            yield pd.Series([model(bytes(r), *map(int, b)) for r, *b in zip(raster, *edges, strict=True)], dtype=object)

    return box.withColumn("crop", cut("raster", "left", "top", "right", "bottom")).select("doc_id", "page_no", "region_idx", "label", "left", "top", "crop")


def structured_cells(crops: DataFrame, structurer: Callable[[], Callable]) -> DataFrame:
    """Cells of table crops (doc_id, page_no, region_idx, label, left, top, crop), moved from the crop to the page."""
    found = crops.filter(F.col("label") == "table").select("doc_id", "page_no", "region_idx", "left", "top", F.posexplode(batched(structurer, CELLS)("crop")).alias("cell_idx", "c"))
    dx, dy = F.col("left"), F.col("top")
    return found.select("doc_id", "page_no", "region_idx", "cell_idx", "c.row", "c.col", "c.row_span", "c.col_span", "c.header", (F.col("c.left") + dx).alias("left"), (F.col("c.top") + dy).alias("top"), (F.col("c.right") + dx).alias("right"), (F.col("c.bottom") + dy).alias("bottom"))


def classified(crops: DataFrame, classifier: Callable[[], Callable]) -> DataFrame:
    """Figure crops with their classes, most likely first."""
    figures = crops.filter(F.col("label") == "figure").withColumn("figure_classes", batched(classifier, CLASSES)("crop"))
    order = F.transform("figure_classes", lambda c: F.struct((-c["confidence"]).alias("k"), c["label"].alias("label"), c["confidence"].alias("confidence")))
    return figures.withColumn("figure_classes", F.transform(F.array_sort(order), lambda c: F.struct(c["label"].alias("label"), c["confidence"].alias("confidence"))))


def decoded(figures: DataFrame, decoder: Callable[[], Callable], mode: str = "class_triggered") -> DataFrame:
    """Figures with ``barcodes``: of all, of those whose first class carries a code, or of none."""
    gate = {"all": F.lit(True), "off": F.lit(False)}.get(mode, barcode_gate(F.col("figure_classes")))
    read = batched(decoder, BARCODES)
    hit = figures.filter(gate).withColumn("barcodes", read("crop"))
    return hit.unionByName(figures.filter(~gate).withColumn("barcodes", F.array().cast(BARCODES)))


def enriched_pictures(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Figures found on page renders, in the pages' own units: pages (doc_id, page_no, page_width, raster_width)."""
    scale = F.col("page_width") / F.col("raster_width")
    rows = regions.filter("label = 'figure'").join(pages.filter("raster_width > 0"), ["doc_id", "page_no"])
    return rows.select("doc_id", "page_no", "region_idx", "confidence", *((F.col(e) * scale).alias(e) for e in ("left", "top", "right", "bottom")))


def enriched(pages: DataFrame, pictures: DataFrame, detector: Callable[[], Callable], cropper: Callable[[], Callable], classifier: Callable[[], Callable], decoder: Callable[[], Callable], mode: str = "class_triggered") -> DataFrame:
    """(doc_id, page_no, ref, label, parent_ref, left, top, right, bottom, figure_classes, barcodes): pictures that page renders show beyond ``pictures``.

    ``pages``: doc_id, page_no, raster, width and height of the raster in pixels, page_width in the document's units.  The new
    pictures follow the document's own ones (doc_id, ref) in number, by page and by the detector's order.
    """
    found = detected_regions(pages, detector).filter("label = 'figure'")
    crops = cropped(pages, found, cropper, ("figure",))
    known = decoded(classified(crops, classifier), decoder, mode).select("doc_id", "page_no", "region_idx", "figure_classes", "barcodes")
    placed = enriched_pictures(pages.withColumn("raster_width", F.col("width")).select("doc_id", "page_no", "page_width", "raster_width"), found)
    before = pictures.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "region_idx")) - 1 + F.coalesce("n", F.lit(0))
    named = placed.join(known, ["doc_id", "page_no", "region_idx"]).join(before, "doc_id", "left").withColumn("ref", F.concat(F.lit("#/pictures/"), n.cast("string")))
    return named.select("doc_id", "page_no", "ref", F.lit("PICTURE").alias("label"), F.lit("#/body").alias("parent_ref"), "left", "top", "right", "bottom", "figure_classes", "barcodes")
