"""Queries over chunk streams and page streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.plans import adapter
from pagewright.plans.adapter import oracle
from pagewright.plans.catalog import query, table
from pagewright.streaming import chunks, credits, pages
from pagewright.streaming.run import to_the_end

PIECE = 1000


def _chunks(spark, sf):
    """Every text in pieces of 1,000 bytes; broken streams by the document's number modulo 11."""
    raw = adapter.documents(spark, sf).select("doc_id", F.encode("text", "utf-8").alias("b"))
    n = F.greatest(F.lit(1), F.ceil(F.length("b") / PIECE).cast("int"))
    rows = raw.withColumn("n", n).select("doc_id", "n", "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    m, last = F.col("doc_id") % 11, F.col("i") == F.col("n") - 1
    name = F.concat(F.lit("dir/doc"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    rows = rows.select(
        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("stream_id"), F.col("i").cast("bigint").alias("seq"),
        F.when((m == 1) & (F.col("i") == 0), "").otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("document_id"),
        F.when(F.col("i") == 0, name).when((m == 2) & (F.col("i") == 1), "other.pdf").alias("filename"),
        F.lit("application/pdf").alias("content_type"), F.when(m == 3, F.lit(b"")).otherwise(F.substring("b", F.col("i") * PIECE + 1, F.lit(PIECE))).alias("data"),
        ((last & (m != 4)) | ((m == 5) & (F.col("i") == 0))).alias("complete"),
        F.when(F.col("i") == 1, F.array(F.lit("CV"))).otherwise(F.array().cast("array<string>")).alias("collectors"),
    )
    return rows


@query(
    "chunk_reassembly",
    """with d as (select doc_id, doc_id % 11 as m, strlen(text) as bytes, greatest(1, ceil(strlen(text) / 1000.0))::int as n, text from documents)
 select 's' || doc_id as stream_id, case when m = 3 then 0 else bytes end::bigint as size,
 case when m = 1 or (m = 2 and n > 1) or (m = 5 and n > 1) or m = 3 or m = 4 then 'INVALID_ARGUMENT' else 'OK' end as code,
 case when m = 1 then 'first chunk requires document_id and filename' when m = 2 and n > 1 then 'all chunks must describe the same document' when m = 5 and n > 1 then 'received data after complete chunk' when m = 3 or m = 4 then 'stream must end with a non-empty complete chunk' else '' end as error,
 case when m = 1 or (m = 2 and n > 1) or (m = 5 and n > 1) or m = 3 or m = 4 then '' else text end as content from d""",
)
def chunk_reassembly(spark, sf):
    rows = chunks.reassemble(_chunks(spark, sf))
    return rows.select("stream_id", "size", F.coalesce("code", F.lit("OK")).alias("code"), F.coalesce("error", F.lit("")).alias("error"), F.coalesce(F.decode("content", "utf-8"), F.lit("")).alias("content"))


@query("stream_chunks")
def stream_chunks(spark, sf):
    """The same through the stateful stream."""
    told = ("stream_id", "document_id", "filename", "size", F.coalesce("code", F.lit("OK")).alias("code"), F.coalesce("error", F.lit("")).alias("error"))
    return to_the_end(_chunks(spark, sf), lambda s: chunks.reassembled(s).select(*told), files=1000)


def _arrivals(spark, sf):
    """Pages of the adapter's lines, the last page first, then the end of the only part."""
    rows = adapter.lines(spark, sf).groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("line_idx", "text"))).alias("l"))
    page = rows.select("doc_id", (-F.col("page_no")).cast("bigint").alias("arrival"), F.lit("page").alias("kind"), "page_no", F.transform("l", lambda x: x["text"]).alias("texts"), F.lit(None).cast("string").alias("error"))
    end = rows.select("doc_id").distinct().select("doc_id", F.lit(1).cast("bigint").alias("arrival"), F.lit("part_done").alias("kind"), F.lit(None).cast("int").alias("page_no"), F.lit(None).cast("array<string>").alias("texts"), F.lit(None).cast("string").alias("error"))
    return page.unionByName(end).repartition("doc_id")


@query("stream_pages")
def stream_pages(spark, sf):
    """Ordered page events with offsets, and one terminal event for each document."""
    return to_the_end(_arrivals(spark, sf), lambda s: pages.released(s, window=1000), files=1000)


@query(
    "page_events",
    oracle(
        """select doc_id, page_no, (row_number() over (partition by doc_id order by page_no) - 1)::bigint as seq, n, max(utf_end) over (partition by doc_id order by page_no)::bigint as utf_end from (
 select doc_id, page_no, count(*) as n, max(e) as utf_end from (select doc_id, page_no, sum(length(text) + 1) over (partition by doc_id order by line_idx) - 1 as e from lines) group by 1, 2)"""
    ),
)
def page_events(spark, sf):
    """The page events of the stream, against the batch offsets."""
    told = ("doc_id", "page_no", "seq", F.size("texts").cast("bigint").alias("n"), F.element_at("utf_end", -1).alias("utf_end"))
    return to_the_end(_arrivals(spark, sf), lambda s: pages.released(s, window=1000).filter("event = 'page'").select(*told), files=1000)


@query("event_windows", "select event_type, time_bucket(interval 1 hour, ts) as start, count(*) as n, sum(round(value * 100)::bigint)::bigint as cents from events group by 1, 2")
def event_windows(spark, sf):
    """Hourly windows over the event stream, with a watermark, run to the end as a stream would."""
    e = table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    g = e.withWatermark("ts", "1 hour").groupBy("event_type", F.window("ts", "1 hour"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "cents")


@query(
    "page_credits",
    """with r as (select p_partkey // 20 as doc_id, p_partkey % 20 + 1 as page_no, p_size * 10 as released from part), t as (select doc_id, list_sort(list(released)) as l from r group by 1)
 select doc_id, page_no, case when page_no <= 4 then 0 else l[page_no - 4] end::bigint as start from r join t using (doc_id)""",
)
def page_credits(spark, sf):
    """When each of twenty pages can start under a window of four."""
    n = F.col("p_partkey")
    pages_ = table(spark, sf, "part").select(F.expr("p_partkey div 20").alias("doc_id"), (n % 20 + 1).alias("page_no"), (F.col("p_size") * 10).alias("released"))
    return credits.earliest_starts(pages_, 4).select("doc_id", "page_no", "start")


@query("document_limits", "select doc_id, case when n_chars > 1000 or doc_id % 7 > 5 then 'RESOURCE_EXHAUSTED' else '' end as code from documents")
def document_limits(spark, sf):
    docs = adapter.documents(spark, sf).select("doc_id", F.col("n_chars").alias("n_bytes"), (F.col("doc_id") % 7).alias("n_pages"))
    return credits.within_limits(docs, 1000, 5).select("doc_id", F.coalesce("code", F.lit("")).alias("code"))
