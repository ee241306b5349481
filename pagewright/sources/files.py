"""Raw documents: reading, identifying and routing them; all native expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import content as C


def from_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(doc_id, filename, content_type, content) of every file under a path of any store Spark reads."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return reader.load(path).select(F.col("path").alias("doc_id"), name.alias("filename"), F.lit("").alias("content_type"), "content")


def from_base64(rows: DataFrame, text: str = "base64_string") -> DataFrame:
    """``rows`` with ``content`` decoded; null content for what is no strict base64."""
    return rows.withColumn("content", C.decode_base64(F.col(text)))


def identified(docs: DataFrame, bulk: bool = True) -> DataFrame:
    """``docs`` with ``mimetype`` and ``binary_hash``.

    A nameless document counts as ``document.pdf``.  The hash runs over every byte in order: in Arrow batches, or with
    ``bulk`` off as a native expression, which suits contents of some hundred bytes.
    """
    name = F.when(F.coalesce("filename", F.lit("")) == "", "document.pdf").otherwise(F.regexp_extract("filename", r"([^/]*)$", 1))
    hashed = C.fnv1a_bulk(F.col("content")).cast("decimal(20,0)") if bulk else C.fnv1a(F.col("content"))
    named = docs.withColumn("filename", name)
    return named.withColumns({"mimetype": F.when(C.is_pdf(F.col("filename"), F.col("content")), "application/pdf").otherwise(C.mime_type(F.col("filename"))), "binary_hash": hashed})


def routed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``route``: pdf, raster, office or invalid, and ``error`` for the last.

    Nothing is decoded here, so a broken upload costs no Python.
    """
    name = F.coalesce("filename", F.lit(""))
    empty = F.coalesce(F.length("content"), F.lit(0)) == 0
    route = F.when(empty, "invalid").when(C.is_office(name, F.col("content_type")), "office").when(C.is_pdf(name, F.col("content")), "pdf").when(C.raster_kind(F.col("content")).isNotNull(), "raster").otherwise("invalid")
    error = F.when(empty, "document is empty").when(route == "invalid", "unsupported document format")
    return docs.withColumns({"route": route, "error": error})


def raster_pages(docs: DataFrame) -> DataFrame:
    """One page for every document of the raster route; a PNG has its size, other rasters get theirs from the decoder's seam."""
    known = F.when(C.raster_kind(F.col("content")) == "png", F.col("content"))
    size = C.png_size(known)
    return docs.filter(F.col("route") == "raster").select("doc_id", F.lit(1).alias("page_no"), size["width"].try_cast("int").alias("width"), size["height"].try_cast("int").alias("height"), F.lit("OCR").alias("source"), F.lit(False).alias("skip_ocr"), F.col("content").alias("raster"))
