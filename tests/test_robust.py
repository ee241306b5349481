"""Ordinary and broken inputs that must not end a job."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import content as C
from pagewright.operators import binding, documents, tables
from pagewright.sources import files, pdf
from pagewright.streaming import pages
from pagewright.streaming.run import to_the_end
from test_parse import PNG, make_pdf
from test_streaming import arrivals


def test_rasters_without_png_header_have_no_size(spark):
    rows = [(1, "a.jpg", "", bytes.fromhex("FFD8FFE0") + b"\xff" * 40), (2, "b.tif", "", bytes.fromhex("49492A00") + b"\xff" * 40), (3, "c.png", "", PNG), (4, "d.png", "", PNG[:16] + b"\xff" * 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, filename string, content_type string, content binary")
    got = {r.doc_id: (r.width, r.height) for r in files.raster_pages(files.routed(docs)).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (300, 200), 4: (None, None)}


def test_broken_pdfs_are_rows_of_their_own(spark):
    good = make_pdf([[(72, 720, "fine")]], packed=True)
    at = good.index(b"stream\n") + 9
    rng = random.Random(5)
    broken = [good[:at] + b"\0\0\0" + good[at + 3 :], good.replace(b"[0 0 612 792]", b"[0 0 612]"), good.replace(b"\nendstream", b"", 1)[: at + 12] + b"\nendstream\nendobj\n"]
    noise = []
    for _ in range(200):
        b = bytearray(good)
        for _ in range(rng.randrange(1, 12)):
            b[rng.randrange(5, len(b))] = rng.randrange(256)
        noise.append(bytes(b))
    for data in broken[:2]:
        with pytest.raises(pdf.InvalidDocument):
            pdf.digital_pages(data)
    docs = spark.createDataFrame([(i, d) for i, d in enumerate([good, *broken, *noise])], "doc_id bigint, content binary")
    rows = pdf.pdf_rows(docs).collect()
    assert {r.doc_id for r in rows} == set(range(len(broken) + len(noise) + 1))
    assert [r.text for r in rows if r.doc_id == 0] == ["fine"] and {1, 2} <= {r.doc_id for r in rows if r.error}


def test_repeated_pages_take_no_room_and_gaps_are_named(spark):
    rows = [
        (1, "page", 1, ["a"], None), (1, "page", 1, ["again"], None), (1, "page", 3, ["c"], None), (1, "page", 3, ["c2"], None), (1, "page", 3, ["c3"], None), (1, "page", 2, ["b"], None), (1, "part_done", None, None, None),
        (2, "page", 2, ["x"], None), (2, "page", 4, ["y"], None), (2, "part_done", None, None, None),
    ]
    out = to_the_end(arrivals(spark, rows), lambda s: pages.released(s, window=2), 99).orderBy("doc_id", "seq").collect()
    assert [(r.event, r.texts) for r in out if r.doc_id == 1] == [("page", ["a"]), ("page", ["b"]), ("page", ["c"]), ("complete", None)]
    end = [r for r in out if r.doc_id == 2]
    assert [r.event for r in end] == ["complete"] and "page 1 is missing, 2 later pages from 2 on" in end[0].error


def test_cells_are_placed_where_they_close():
    place = lambda *t: [c[:4] for c in tables.place_tokens(list(t), [])]
    assert place("<tr>", "<td", ' colspan="2"', "</td>") == [(0, 0, 1, 2)]
    assert place("<tr>", "<td>", "</td>", "<td>") == [(0, 0, 1, 1)]
    assert place("<tr>", "<td", ">", "<td></td>") == [(0, 0, 1, 1)]
    assert place("<tr>", "<td", 'x colspan="3"', ">", "</td>") == [(0, 0, 1, 1)]


def test_column_names_by_arithmetic(spark):
    def name(i):
        out = ""
        while i >= 0:
            out, i = chr(65 + i % 26) + out, i // 26 - 1
        return out

    values = [0, 25, 26, 701, 702, 18277, 18278, 475253, 475254, 2**31 - 1]
    got = spark.createDataFrame([(v,) for v in [*values, -1]], "i bigint").select("i", C.column_name(F.col("i")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {**{v: name(v) for v in values}, -1: None}


def test_long_contents_are_hashed_like_short_ones(spark):
    def fnv(data):
        h = C.FNV_OFFSET
        for b in data:
            h = ((h ^ b) * C.FNV_PRIME) % 2**64
        return str(h)

    rng = random.Random(1)
    values = [rng.randbytes(n) for n in (0, 1, 7, 300, 5000, 200_000)] + [rng.randbytes(40) for _ in range(40)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(99, None)], "i int, content binary").coalesce(1)
    got = {r.i: r.h for r in rows.select("i", C.fnv1a_bulk(F.col("content")).alias("h")).collect()}
    assert got == {**{i: fnv(v) for i, v in enumerate(values)}, 99: None}


def test_regions_bind_like_brute_force(spark):
    rng = random.Random(9)
    edges = ("left", "top", "right", "bottom")
    box = lambda w: (lambda x, y: (x, y, x + rng.randrange(w), y + rng.randrange(w)))(rng.randrange(60), rng.randrange(60))
    lines = [(d, p, i, *box(20)) for d in (1, 2) for p in (1, 2, 3) for i in range(25)]
    regions = [(d, p, i, rng.choice(["text", "table", None]), rng.choice([0.5, 0.7, 0.9]), *box(60)) for d in (1, 2) for p in (1, 2) for i in range(6)]
    kinds = ", ".join(f"{e} int" for e in edges)
    got = binding.bind_regions(spark.createDataFrame(lines, f"doc_id int, page_no int, line_idx int, {kinds}"), spark.createDataFrame(regions, f"doc_id int, page_no int, region_idx int, label string, confidence float, {kinds}")).collect()
    assert len(got) == len(lines)
    half = lambda a, b: (a + b) // 2
    for r in got:
        x, y = half(r.left, r.right), half(r.top, r.bottom)
        held = [(-c, i, label) for d, p, i, label, c, le, t, ri, b in regions if (d, p) == (r.doc_id, r.page_no) and le <= x <= ri and t <= y <= b]
        want = min(held, key=lambda h: h[:2], default=(None, None, None))
        assert (r.region_idx, r.region_label) == want[1:]


def test_integrity_counts_every_use(spark):
    items = spark.createDataFrame([(1, "#/texts/0", "TEXT", "#/body"), (1, "#/texts/0", "TEXT", "#/body"), (1, None, None, "#/gone"), (1, "#/texts/1", "TEXT", "#/gone"), (1, "", "TEXT", None)], "doc_id int, ref string, kind string, parent_ref string")
    edges = spark.createDataFrame([(1, "#/body", "#/texts/0"), (1, "#/body", "#/texts/7"), (1, "#/x", "#/texts/7"), (1, "#/body", None)], "doc_id int, parent_ref string, child_ref string")
    got = sorted((r.error, r.ref) for r in documents.integrity_errors(items, edges).collect())
    assert got == sorted(
        [("empty self_ref", ""), ("empty self_ref", ""), ("duplicate self_ref", "#/texts/0"), ("unset item", ""), ("unresolved child", "#/texts/7"), ("unresolved child", "#/texts/7")]
        + [("unresolved parent", "#/gone"), ("unresolved parent", "#/gone"), ("parent does not list child", "#/texts/1")]
    )
