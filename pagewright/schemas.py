"""Explicit schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])
BOX = T.StructType([T.StructField(e, T.IntegerType()) for e in ("left", "top", "right", "bottom")])
CLASS = T.StructType([T.StructField("label", T.StringType()), T.StructField("confidence", T.FloatType())])
BARCODE = T.StructType([T.StructField("format", T.StringType()), T.StructField("text", T.StringType())])
CELL = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in ("row", "col", "row_span", "col_span")] + [T.StructField("header", T.BooleanType())] + [T.StructField(e, T.IntegerType()) for e in ("left", "top", "right", "bottom")]
)
DOCUMENT = T.StructType(
    [T.StructField("doc_id", T.StringType()), T.StructField("filename", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("binary_hash", T.DecimalType(20, 0))]
)
PAGE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("skip_ocr", T.BooleanType()),
        T.StructField("preview_png", T.BinaryType()),
    ]
)
LINE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("line_idx", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("polygon", T.ArrayType(POINT)),
        T.StructField("confidence", T.FloatType()),
        T.StructField("origin", T.StringType()),
    ]
)
REGION = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("region_idx", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("confidence", T.FloatType()),
        *BOX.fields,
        T.StructField("structured_cells", T.ArrayType(CELL)),
        T.StructField("figure_classes", T.ArrayType(CLASS)),
        T.StructField("barcodes", T.ArrayType(BARCODE)),
    ]
)
CHUNK = T.StructType(
    [
        T.StructField("stream_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("document_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("complete", T.BooleanType()),
        T.StructField("collectors", T.ArrayType(T.StringType())),
    ]
)
OUTCOME = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("plan_ord", T.IntegerType()),
        T.StructField("collector", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
    ]
)
EVENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("payload", T.StringType())])

# The public enum vocabularies of the data model.
INPUT_FORMATS = "ASCIIDOC AUDIO CSV DOCX HTML IMAGE JSON_DOCLING MD METS_GBS PDF PPTX XLSX XML_JATS XML_USPTO LATEX VTT XML_XBRL".split()
OUTPUT_FORMATS = "DOCTAGS HTML HTML_SPLIT_PAGE JSON MARKDOWN TEXT YAML VTT DOCLANG".split()
CONVERSION_STATUS = "PENDING STARTED FAILURE SUCCESS PARTIAL_SUCCESS SKIPPED".split()
STREAM_PHASES = "QUEUED STARTED PROCESSING EXPORTING COMPLETED FAILED".split()
CONTENT_LAYERS = "BODY FURNITURE BACKGROUND INVISIBLE NOTES".split()
TEXT_SOURCES = "OCR DIGITAL_PDF".split()
LAYOUT_LABELS = "text title list table figure".split()
