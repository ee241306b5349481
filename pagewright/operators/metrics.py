"""Counters, histograms and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds of the page latency histogram in milliseconds; the last bucket is open.
LATENCY_BOUNDS = (25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)


def latency_bucket(ms: Column) -> Column:
    """Number of the first bucket whose bound is not exceeded; the last for anything above."""
    out = F.lit(len(LATENCY_BOUNDS))
    for i, bound in reversed(list(enumerate(LATENCY_BOUNDS))):
        out = F.when(ms <= bound, i).otherwise(out)
    return out


def latency_histogram(rows: DataFrame, ms: Column) -> DataFrame:
    """(bucket, n) of all buckets, empty ones too."""
    counts = rows.groupBy(latency_bucket(ms).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(len(LATENCY_BOUNDS) + 1).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def cumulative(histogram: DataFrame) -> DataFrame:
    """(bucket, le, n): counts at or under each bound.  The table has one row a bucket."""
    names = F.array(*(F.lit(str(b)) for b in LATENCY_BOUNDS), F.lit("+Inf"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return histogram.select("bucket", F.element_at(names, F.col("bucket") + 1).alias("le"), F.sum("n").over(w).alias("n"))


def busy_percent(busy_ns: Column, seconds: Column, workers: Column) -> Column:
    """Share of the workers' time in percent, cut to whole numbers and at 100; 0 for no time, no workers or no progress."""
    share = F.floor(busy_ns.cast("double") * 100.0 / (seconds * 1e9 * workers))
    return F.when((seconds > 0) & (workers > 0) & (busy_ns > 0), F.least(F.lit(100).cast("bigint"), share.cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


def deltas(snapshots: DataFrame, keys: list[str], order: str, counters: list[str]) -> DataFrame:
    """``snapshots`` with ``<counter>_delta`` since the one before; the first counts from zero."""
    w = Window.partitionBy(*keys).orderBy(order)
    return snapshots.select("*", *((F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias(f"{c}_delta") for c in counters))


def exposition(values: dict[str, tuple[str, str, float]], histogram: list[tuple[str, int]] = (), name: str = "page_latency") -> str:
    """Prometheus text: name -> (type, help, value), then a histogram of (bound, cumulative count)."""
    out = []
    for metric, (kind, text, value) in values.items():
        out += [f"# HELP {metric} {text}", f"# TYPE {metric} {kind}", f"{metric} {value:g}" if isinstance(value, float) else f"{metric} {value}"]
    if histogram:
        out += [f"# TYPE {name} histogram", *(f'{name}_bucket{{le="{le}"}} {n}' for le, n in histogram), f"{name}_count {histogram[-1][1]}"]
    return "\n".join(out) + "\n"


# The counters of a parse and what they count.
PARSE_COUNTERS = {
    "documents_submitted_total": "Documents accepted for parsing.",
    "documents_rejected_total": "Documents that could not be read.",
    "pages_digital_total": "Pages whose text came from the digital layer.",
    "pages_rendered_total": "Pages rasterized for inference.",
    "pages_ocr_total": "Pages that went through recognition.",
    "tables_structured_total": "Table regions with recognised cells.",
    "figures_classified_total": "Figure regions that were classified.",
    "barcodes_decoded_total": "Payloads decoded from figure crops.",
}


def parse_counters(docs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(metric, value) of ``PARSE_COUNTERS`` for a parse: the documents and the tables it gave."""
    pages, one = tables["pages"], F.lit(1)
    read = F.col("source") == "DIGITAL_PDF"
    parts = [
        docs.agg(F.count(one).alias("documents_submitted_total")),
        tables["errors"].agg(F.count_distinct("doc_id").alias("documents_rejected_total")),
        pages.agg(F.count_if(read).alias("pages_digital_total"), F.count_if(F.col("source") == "OCR").alias("pages_rendered_total"), F.count_if(~F.col("skip_ocr") & (F.col("source") != "OFFICE")).alias("pages_ocr_total")),
        tables["figures"].agg(F.count(one).alias("figures_classified_total"), F.coalesce(F.sum(F.size("barcodes")), F.lit(0)).alias("barcodes_decoded_total")),
        tables["cells"].agg(F.count_distinct("doc_id", "ref").alias("tables_structured_total")),
    ]
    each = [p.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, p.columns)), F.array(*(F.col(c).cast("bigint") for c in p.columns)))).alias("metric", "value")) for p in parts]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def parse_exposition(counters: dict[str, int], histogram: list[tuple[str, int]] = (), prefix: str = "pagewright_") -> str:
    """The counters as Prometheus text, names with a prefix, missing ones as 0."""
    values = {prefix + k: ("counter", text, int(counters.get(k, 0))) for k, text in PARSE_COUNTERS.items()}
    return exposition(values, histogram, f"{prefix}page_latency")


def page_counters(texts: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, page_no, texts, digital, ocr, tables, pictures) of every page that has lines."""
    a = texts.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("origin") == "DIGITAL_PDF").alias("digital"), F.count_if(F.col("origin") == "OCR").alias("ocr"))
    b = regions.groupBy("doc_id", "page_no").agg(F.count_if(F.col("label") == "table").alias("tables"), F.count_if(F.col("label") == "figure").alias("pictures"))
    zero = F.lit(0).cast("bigint")
    return a.join(b, ["doc_id", "page_no"], "left").select("doc_id", "page_no", "texts", "digital", "ocr", F.coalesce("tables", zero).alias("tables"), F.coalesce("pictures", zero).alias("pictures"))


def observed(lines: DataFrame, name: str = "pages"):
    """(``lines``, observation): counters gathered while the plan runs, without a pass of their own.

    The observation's ``get`` holds lines, digital and recognised ones, and
    code points once an action has run.
    """
    from pyspark.sql import Observation

    seen = Observation(name)
    counters = (
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("origin") == "DIGITAL_PDF").alias("digital"),
        F.count_if(F.col("origin") == "OCR").alias("recognised"),
        F.sum(F.char_length("text")).alias("code_points"),
    )
    return lines.observe(seen, *counters), seen


def interval_listener(report):
    """A streaming listener that hands (rows, rows a second, state rows, changes since the last) of each trigger to ``report``."""
    from pyspark.sql.streaming.listener import StreamingQueryListener

    class Listener(StreamingQueryListener):
        last = 0

        def onQueryStarted(self, event):
            self.last = 0

        def onQueryProgress(self, event):
            p = event.progress
            state = sum(s.numRowsTotal for s in p.stateOperators)
            report({"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "state_rows": state, "state_delta": state - self.last})
            self.last = state

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    return Listener()
