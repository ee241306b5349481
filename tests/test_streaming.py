"""Stateful streams run to their end."""

import pytest
from pyspark.sql import functions as F

from pagewright.plans import catalog
from pagewright.schemas import CHUNK
from pagewright.streaming import chunks, pages
from pagewright.streaming.run import to_the_end

SF = "/root/testdata/sf0.001"


def chunk(stream, seq, did="d", name="x/f.pdf", data=b"ab", complete=False, wanted=()):
    return (stream, seq, did, name, "t", data, complete, list(wanted))


CASES = [
    chunk("ok", 0), chunk("ok", 1, "", None, b"cd", False, ["CV"]), chunk("ok", 2, "d", "y/f.pdf", b"", True, ["POI"]),
    chunk("first", 0, ""), chunk("same", 0), chunk("same", 1, "other", None, b"", True), chunk("after", 0, complete=True), chunk("after", 1), chunk("empty", 0, data=b"", complete=True), chunk("long", 0, data=b"x" * 11, complete=True),
]
WANT = {"ok": (None, None, b"abcd"), "first": (chunks.INVALID, chunks.FIRST, None), "same": (chunks.INVALID, chunks.SAME, None), "empty": (chunks.INVALID, chunks.INCOMPLETE, None), "long": (chunks.EXHAUSTED, chunks.TOO_LONG, None)}


def test_chunk_rules_batch_and_stream(spark):
    df = spark.createDataFrame([*CASES, chunk("open", 0)], CHUNK)
    batch = {r.stream_id: (r.code, r.error, None if r.content is None else bytes(r.content)) for r in chunks.reassemble(df, limit=10).collect()}
    assert batch == WANT | {"after": (chunks.INVALID, chunks.AFTER, None), "open": (chunks.INVALID, chunks.INCOMPLETE, None)}
    assert chunks.reassemble(df, limit=10).filter("stream_id = 'ok'").first().collectors == ["CV"]
    rows = to_the_end(df.repartition(3), lambda s: chunks.reassembled(s, limit=10), files=99).collect()
    stream = {r.stream_id: (r.code, r.error, None if r.content is None else bytes(r.content)) for r in rows if r.stream_id != "after"}
    assert stream == WANT
    assert sorted((r.code or "", r.error or "") for r in rows if r.stream_id == "after") == [("", ""), (chunks.INVALID, chunks.AFTER)]


def arrivals(spark, rows):
    full = [(d, i, k, p, t, e) for i, (d, k, p, t, e) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id bigint, arrival bigint, kind string, page_no int, texts array<string>, error string").coalesce(1)


@pytest.mark.parametrize("files", [1, 99])
def test_pages_come_out_in_order_with_one_end(spark, files):
    rows = [
        (1, "page", 2, ["two"], None), (1, "page", 3, ["three"], None), (1, "page", 1, ["one"], None), (1, "part_done", None, None, None), (1, "page", 4, ["late"], None),
        (2, "failed", None, None, "first"), (2, "failed", None, None, "second"),
        (3, "page", 1, ["a", "bé"], None), (3, "cancel", None, None, None), (3, "part_done", None, None, None),
    ]
    out = to_the_end(arrivals(spark, rows), lambda s: pages.released(s, parts=1), files).orderBy("doc_id", "seq").collect()
    by = {d: [(r.event, r.page_no, r.utf_start, r.utf_end, r.error) for r in out if r.doc_id == d] for d in (1, 2, 3)}
    assert by[1] == [("page", 1, [0], [3], None), ("page", 2, [4], [7], None), ("page", 3, [8], [13], None), ("complete", None, None, None, None)]
    assert by[2] == [("error", None, None, None, "first")]
    assert by[3] == [("page", 1, [0, 2], [1, 4], None), ("cancelled", None, None, None, None)]


def test_a_slow_reader_ends_with_an_error(spark):
    rows = [(1, "page", p, ["x"], None) for p in (5, 4, 3)]
    out = to_the_end(arrivals(spark, rows), lambda s: pages.released(s, window=2), 99).collect()
    assert [r.event for r in out] == ["error"] and "RESOURCE_EXHAUSTED" in out[0].error


class State:
    """One document's state variables, and how often they are asked."""

    def __init__(self):
        self.values, self.asked = {}, []

    def getValueState(self, name, kind):  # noqa: N802
        return Variable(self, name)

    getListState = getValueState  # noqa: N815


class Variable:
    def __init__(self, state, name):
        self.state, self.name = state, name

    def get(self):
        self.state.asked.append("get")
        return iter(list(self.state.values[self.name])) if self.name in ("waiting", "parts") else self.state.values.get(self.name)

    def put(self, values):
        self.state.asked.append("put")
        self.state.values[self.name] = values

    update = put

    def appendList(self, values):  # noqa: N802
        self.put(self.state.values.get(self.name, []) + values)

    def clear(self):
        self.state.asked.append("clear")
        self.state.values.pop(self.name, None)


def driven(processor, key, triggers):
    state = State()
    processor.init(state)
    out = [tuple(r) for rows in triggers for r in processor.handleInputRows((key,), iter(rows), None)]
    return out, state


def test_what_ends_in_one_trigger_is_never_waiting_state():
    from pyspark.sql import Row

    arrival = Row("doc_id", "arrival", "kind", "page_no", "texts", "error")
    rows = [arrival(1, i, "page", p, [f"t{p}", "é"], None) for i, p in enumerate((4, 2, 7, 1, 3, 6, 5))] + [arrival(1, 9, "part_done", None, None, None)]
    whole, state = driven(pages.PageRelease(), 1, [rows])
    assert state.asked == ["get", "put"] and [r[2:4] for r in whole] == [*(("page", p) for p in range(1, 8)), ("complete", None)]
    for cuts in ([2, 3, 5, 7], [1, 2, 3, 4, 5, 6, 7], [6]):
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        assert driven(pages.PageRelease(), 1, parts)[0] == whole

    piece = Row("stream_id", "seq", "document_id", "filename", "content_type", "data", "complete", "collectors")
    rows = [piece("s", i, "d" if i == 0 else "", "f", "t", b"ab%d" % i, i == 4, ["CV"] if i == 1 else []) for i in range(5)]
    whole, state = driven(chunks.Reassembler(), "s", [rows])
    assert state.asked == ["get", "put"] and whole == [("s", "d", "f", "t", ["CV"], 15, b"ab0ab1ab2ab3ab4", None, None)]
    assert driven(chunks.Reassembler(), "s", [rows[:1], rows[1:4], rows[4:]])[0] == whole == driven(chunks.Reassembler(), "s", [[r] for r in rows])[0]


def test_streams_over_the_tables(spark):
    got = catalog.QUERIES["stream_pages"](spark, SF)
    assert got.filter("event = 'complete'").count() == spark.read.parquet(f"{SF}/documents.parquet").filter("text <> ''").count()
    want = catalog.QUERIES["text_offsets"](spark, SF).agg(F.sum("utf_end")).first()[0]
    assert got.select(F.explode("utf_end").alias("e")).agg(F.sum("e")).first()[0] == want
    codes = catalog.QUERIES["stream_chunks"](spark, SF).groupBy("code").count().collect()
    assert {r.code for r in codes} == {"OK", "INVALID_ARGUMENT"}
