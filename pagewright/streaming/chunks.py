"""Chunked uploads: reassembly and validation, as a batch plan and as a stateful stream.

The rules, the first broken one deciding:

* the first chunk names the document and its file; later chunks may leave either
  out but not change it (the file's folder does not count);
* nothing follows the chunk marked complete;
* the contents stay within the limit;
* a stream ends with a complete chunk and holds at least one byte.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LIMIT = 50 * 1024 * 1024
INVALID, EXHAUSTED = "INVALID_ARGUMENT", "RESOURCE_EXHAUSTED"
FIRST = "first chunk requires document_id and filename"
SAME = "all chunks must describe the same document"
AFTER = "received data after complete chunk"
TOO_LONG = "document exceeds the streaming limit"
INCOMPLETE = "stream must end with a non-empty complete chunk"
RESULT = "stream_id string, document_id string, filename string, content_type string, collectors array<string>, size bigint, content binary, code string, error string"

RESULT_ROW = Row(*(c.split()[0] for c in RESULT.split(", ")))


def base_name(name: F.Column) -> F.Column:
    return F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)$", 1)


def reassemble(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row a finished stream: its identity and contents, or the code and text of its first error.

    All native: window minima find the first broken rule, one ordered aggregate
    joins the bytes of streams that break none.
    """
    w = Window.partitionBy("stream_id").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = chunks.select("stream_id", "seq", F.coalesce("document_id", F.lit("")).alias("document_id"), base_name(F.col("filename")).alias("filename"), F.coalesce("content_type", F.lit("")).alias("content_type"), F.coalesce("data", F.lit(b"")).alias("data"), F.coalesce("complete", F.lit(False)).alias("complete"), F.coalesce("collectors", F.array().cast("array<string>")).alias("collectors"))
    rows = rows.withColumns({"n": F.row_number().over(w), "done": F.coalesce(F.max("complete").over(before), F.lit(False)), "total": F.sum(F.length("data").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "did": first("document_id"), "fname": first("filename"), "ctype": first("content_type")})
    other = ((F.col("document_id") != "") & (F.col("document_id") != F.col("did"))) | ((F.col("filename") != "") & (F.col("filename") != F.col("fname")))
    broken = (
        F.when(F.col("done"), F.struct(F.lit(INVALID).alias("code"), F.lit(AFTER).alias("error")))
        .when((F.col("n") == 1) & ((F.col("did") == "") | (F.col("fname") == "")), F.struct(F.lit(INVALID).alias("code"), F.lit(FIRST).alias("error")))
        .when(other, F.struct(F.lit(INVALID).alias("code"), F.lit(SAME).alias("error")))
        .when(F.col("total") > limit, F.struct(F.lit(EXHAUSTED).alias("code"), F.lit(TOO_LONG).alias("error")))
    )
    judged = rows.withColumn("broken", broken)
    g = judged.groupBy("stream_id").agg(
        F.max("did").alias("document_id"), F.max("fname").alias("filename"), F.max("ctype").alias("content_type"),
        F.min_by("collectors", F.when(F.size("collectors") > 0, F.col("seq"))).alias("collectors"),
        F.max("total").alias("size"), F.max("complete").alias("complete"),
        F.min_by("broken", F.when(F.col("broken").isNotNull(), F.col("seq"))).alias("broken"),
    )
    end = F.when(~F.col("complete") | (F.col("size") == 0), F.struct(F.lit(INVALID).alias("code"), F.lit(INCOMPLETE).alias("error")))
    g = g.withColumn("broken", F.coalesce("broken", end))
    whole = judged.join(g.filter("broken is null").select("stream_id"), "stream_id", "left_semi").groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("parts"))
    joined = whole.select("stream_id", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), "")).alias("content"))
    return g.join(joined, "stream_id", "left").select("stream_id", "document_id", "filename", "content_type", F.coalesce("collectors", F.array().cast("array<string>")).alias("collectors"), "size", "content", "broken.code", "broken.error")


class Reassembler(StatefulProcessor):
    """State of a stream: what it is, how much came, whether it ended; and its chunks, if it did not end with the trigger's rows.

    A stream answers once, at its complete chunk or first error; what comes later
    is an error row of its own.
    """

    def __init__(self, limit: int = LIMIT):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.identity = handle.getValueState("identity", "document_id string, filename string, content_type string, size bigint, done boolean, failed boolean, collectors array<string>, held boolean")
        self.parts = handle.getListState("parts", "data binary")

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        out: list[Row] = []
        known = self.identity.get()
        fresh: list[tuple[bytes]] = []
        did, fname, ctype, size, done, failed, wanted, held = known or ("", "", "", 0, False, False, [], False)
        wanted = list(wanted)

        def answer(content=None, code=None, error=None):
            out.append(RESULT_ROW(key[0], did, fname, ctype, wanted, size, content, code, error))

        for r in sorted(rows, key=lambda r: (r.seq is None, r.seq or 0)):
            if failed:
                continue
            name = (r.filename or "").rsplit("/", 1)[-1]
            if done:
                failed = True
                answer(code=INVALID, error=AFTER)
                continue
            if not did:
                did, fname, ctype = r.document_id or "", name, r.content_type or ""
                if not did or not fname:
                    failed = True
                    answer(code=INVALID, error=FIRST)
                    continue
            elif (r.document_id and r.document_id != did) or (name and name != fname):
                failed = True
                answer(code=INVALID, error=SAME)
                continue
            if not wanted and r.collectors is not None and len(r.collectors):
                wanted = list(r.collectors)
            data = bytes(r.data) if r.data is not None else b""
            if len(data) > self.limit - size:
                failed = True
                answer(code=EXHAUSTED, error=TOO_LONG)
                continue
            size += len(data)
            fresh.append((data,))
            if r.complete:
                done = True
                if size:
                    before = [p[0] for p in self.parts.get()] if held else []
                    answer(content=b"".join([*before, *(p[0] for p in fresh)]))
                else:
                    failed = True
                    answer(code=INVALID, error=INCOMPLETE)
        if done or failed:
            if held:
                self.parts.clear()
            held = False
        elif fresh:
            self.parts.appendList(fresh)
            held = True
        now = (did, fname, ctype, size, done, failed, wanted, held)
        if now != known:
            self.identity.update(now)
        yield from out

    def close(self) -> None:
        pass


def reassembled(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The same for a stream of chunks, keyed by ``stream_id``; needs the RocksDB state store."""
    return chunks.groupBy("stream_id").transformWithState(Reassembler(limit), RESULT, "Append", "None")
