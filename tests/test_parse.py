"""Whole documents: files, PDF text, models behind their seams, assembled tables."""

import zlib

import pytest
from pyspark.sql import functions as F

from pagewright.operators import documents, models
from pagewright.plans import parse
from pagewright.sources import files, pdf


def make_pdf(pages, turn=0, packed=False):
    """Pages are lists of (x, y, text)."""
    kids = " ".join(f"{3 + 2 * i} 0 R" for i in range(len(pages)))
    out = [b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n", f"2 0 obj\n<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /MediaBox [0 0 612 792] >>\nendobj\n".encode()]
    for i, lines in enumerate(pages):
        text = "".join(f"BT /F1 12 Tf {x} {y} Td ({t}) Tj ET\n" for x, y, t in lines).encode("cp1252")
        body, name = (zlib.compress(text), b"/Filter /FlateDecode ") if packed else (text, b"")
        out.append(f"{3 + 2 * i} 0 obj\n<< /Type /Page /Parent 2 0 R /Rotate {turn} /Contents {4 + 2 * i} 0 R >>\nendobj\n".encode())
        out.append(f"{4 + 2 * i} 0 obj\n<< ".encode() + name + f"/Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream\nendobj\n")
    return b"".join([*out, b"trailer\n<< /Root 1 0 R >>\n%%EOF"])


@pytest.mark.parametrize("packed", [False, True])
def test_digital_text(packed):
    p = pdf.digital_pages(make_pdf([[(72, 720, "Hello \\(world\\)"), (72, 700, "caf\\351")], []], packed=packed))
    assert [[line[0] for line in q["lines"]] for q in p] == [["Hello (world)", "café"], []]
    assert p[0]["lines"][0][1:3] == (72.0, 60.0)


def test_rotation_swaps_the_page():
    p = pdf.digital_pages(make_pdf([[(72, 720, "up")]], turn=90))[0]
    assert (p["width"], p["height"]) == (792.0, 612.0) and p["lines"][0][2] == 72.0


@pytest.mark.parametrize("data", [b"", b"%PDF-1.4 nothing", b"PK\x03\x04", b"%PDF-1.4\n1 0 obj\n<< /ObjStm /N 1 /First 4 /FlateDecode >>\nstream\nbad\nendstream\nendobj"])
def test_broken_files_are_invalid_documents(data):
    with pytest.raises(pdf.InvalidDocument):
        pdf.digital_pages(data)


PNG = bytes.fromhex("89504E470D0A1A0A0000000D494844520000012C000000C8")


@pytest.fixture(scope="module")
def docs(spark):
    two = make_pdf([[(72, 700 - 30 * i, f"left {i}") for i in range(5)] + [(400, 700 - 30 * i, f"right {i}") for i in range(5)], [(72, 700, "second page")]])
    rows = [(1, "a.pdf", "", two), (2, "noname", "", make_pdf([[(72, 700, "sniffed")]])), (3, "b.png", "", PNG), (4, "c.docx", "", b"PK"), (5, "d.webp", "", b"RIFF"), (6, "e.pdf", "", b"%PDF-"), (7, "f.pdf", "", b"")]
    return spark.createDataFrame(rows, "doc_id bigint, filename string, content_type string, content binary")


def test_routes(docs):
    got = {r.doc_id: r.route for r in files.routed(docs).collect()}
    assert got == {1: "pdf", 2: "pdf", 3: "raster", 4: "office", 5: "invalid", 6: "pdf", 7: "invalid"}


def test_parse_documents(spark, docs):
    out = parse.parse_documents(docs)
    texts = {r.doc_id: r.text for r in out["texts"].collect()}
    assert texts[1] == "\n".join([f"left {i} right {i}" for i in range(5)] + ["second page"]) and texts[2] == "sniffed"
    last = out["offsets"].groupBy("doc_id").agg(F.max("utf_end").alias("e")).collect()
    assert {r.doc_id: r.e for r in last} == {d: len(t) for d, t in texts.items()}
    assert {r.doc_id for r in out["errors"].collect()} == {4, 5, 6, 7}
    checked = out["items"].select("doc_id", "ref", F.col("label").alias("kind"), F.lit("#/body").alias("parent_ref"))
    assert documents.integrity_errors(checked, out["edges"]).count() == 0
    whole = {r.doc_id: r for r in parse.responses(out, docs).collect()}
    answers = {d: r.status for d, r in whole.items()}
    assert whole[3].origin.mimetype == "image/png" and whole[1].origin.filename == "a.pdf" and whole[1].origin.binary_hash > 0
    assert answers == {1: "SUCCESS", 2: "SUCCESS", 3: "SUCCESS", 4: "FAILURE", 5: "FAILURE", 6: "FAILURE", 7: "FAILURE"}
    page = out["pages"].filter("doc_id = 1 and page_no = 1").first()
    assert (page.width, page.height, page.source, page.skip_ocr) == (1700, 2200, "DIGITAL_PDF", True)


def square(x, y, w, h):
    return [{"x": x, "y": y}, {"x": x + w, "y": y}, {"x": x + w, "y": y + h}, {"x": x, "y": y + h}]


def reader():
    return lambda _: [{"text": "seen", "polygon": square(10, 10, 50, 20), "confidence": 0.5}, {"text": "", "polygon": square(0, 0, 1, 1), "confidence": 1.0}, {"text": "cell", "polygon": square(110, 110, 40, 20), "confidence": 0.9}]


def finder():
    return lambda _: [{"label": "title", "confidence": 0.9, "left": 0, "top": 0, "right": 100, "bottom": 50}, {"label": "table", "confidence": 0.8, "left": 100, "top": 100, "right": 200, "bottom": 200}, {"label": "figure", "confidence": 0.7, "left": 0, "top": 100, "right": 50, "bottom": 200}]


def test_models_behind_their_seams(docs):
    out = parse.parse_documents(docs.filter("doc_id in (1, 3)"), parse.Config(recognizer=reader, detector=finder))
    got = [(r.label, r.text) for r in out["items"].filter("doc_id = 3").orderBy("ref").collect()]
    assert got == [("PICTURE", ""), ("TABLE", ""), ("TITLE", "seen"), ("TEXT", "cell")]
    assert [(r.row, r.col, r.text) for r in out["cells"].collect()] == [(0, 0, "cell")]
    assert out["edges"].filter("doc_id = 3").count() == 4


def cutter():
    return lambda raster, left, top, right, bottom: f"{raster[:4].hex()} {left} {top} {right} {bottom}".encode()


def structure():
    cell = {"row_span": 1, "col_span": 1, "header": True, "left": 0, "top": 0, "right": 60, "bottom": 60}
    return lambda crop: [cell | {"row": 0, "col": 0}, cell | {"row": 0, "col": 1, "left": 60, "right": 100}] if crop == b"89504e47 100 100 200 200" else []


def test_crops_reach_structurer_classifier_and_decoder(docs):
    def classes():
        return lambda crop: [{"label": "qr_code", "confidence": 0.9}, {"label": "icon", "confidence": 0.1}]

    def codes():
        return lambda crop: [{"format": "QR", "text": crop.decode()}]

    config = parse.Config(recognizer=reader, detector=finder, cropper=cutter, structurer=structure, classifier=classes, decoder=codes)
    out = parse.parse_documents(docs.filter("doc_id = 3"), config)
    assert sorted((r.row, r.col, r.text, r.header) for r in out["cells"].collect()) == [(0, 0, "cell", True), (0, 1, "", True)]
    figure = out["figures"].first()
    assert (figure.ref, figure.figure_classes[0].label, figure.barcodes[0].text) == ("#/pictures/0", "qr_code", "89504e47 0 100 50 200")
    assert parse.parse_documents(docs.filter("doc_id = 3"), parse.Config(detector=finder))["figures"].count() == 0


def test_pictures_of_page_renders_are_appended(spark):
    pages = spark.createDataFrame([(1, 1, PNG, 200, 200, 1440.0), (1, 2, PNG, 200, 200, 720.0), (2, 1, PNG, 200, 200, 200.0)], "doc_id bigint, page_no int, raster binary, width int, height int, page_width double")
    own = spark.createDataFrame([(1, "#/pictures/0"), (1, "#/pictures/1")], "doc_id bigint, ref string")

    def classes():
        return lambda crop: [{"label": "bar_code", "confidence": 0.6}]

    def codes():
        return lambda crop: [{"format": "EAN", "text": crop.decode().split(" ", 1)[1]}]

    got = models.enriched(pages, own, finder, cutter, classes, codes).orderBy("doc_id", "ref").collect()
    assert [(r.doc_id, r.page_no, r.ref) for r in got] == [(1, 1, "#/pictures/2"), (1, 2, "#/pictures/3"), (2, 1, "#/pictures/0")]
    assert [(r.top, r.right) for r in got] == [(720.0, 360.0), (360.0, 180.0), (100.0, 50.0)]
    assert got[0].barcodes[0].text == "0 100 50 200" and got[0].figure_classes[0].label == "bar_code"


def test_office_documents_are_read_from_their_events(spark, docs):
    para = lambda t: '{"list_level":-1,"page_index":0,"runs":[{"text":"%s"}],"start":{"x":10,"y":20},"end":{"x":30,"y":40}}' % t
    rows = [
        (4, 0, "document_info", '{"document_id":"x","source_format":"docx","page_rects":[{"x_twips":5,"y_twips":5,"width_twips":100,"height_twips":200}]}'),
        (4, 1, "paragraph", para("first")), (4, 2, "paragraph", para("")), (4, 3, "paragraph", para("third")), (4, 4, "bookmark", '{"name":"b","char_start":1,"char_end":2,"page_index":-1}'),
        (4, 5, "table", '{"rows":1,"columns":1,"cells":[{"row":0,"column":0,"name":"A1","text":"c"}]}'), (4, 6, "status", "{}"),
        (1, 0, "paragraph", para("not an office file")),
    ]
    extra = spark.createDataFrame([(8, "g.odt", "", b"x"), (9, "h.ods", "", b"x")], docs.schema)
    events = spark.createDataFrame([*rows, (8, 0, "paragraph", para("cut off"))], "doc_id bigint, seq bigint, kind string, payload string")
    out = parse.parse_documents(docs.filter("doc_id in (1, 4)").unionByName(extra), events=events)
    assert {r.doc_id: r.text for r in out["texts"].collect()}[4] == "first\n\nthird"
    assert [(r.ref, r.utf_start, r.utf_end) for r in out["offsets"].filter("doc_id = 4").orderBy("utf_start").collect()] == [("#/texts/0", 0, 5), ("#/texts/1", 6, 6), ("#/texts/2", 7, 12)]
    assert [(r.ref, r.text) for r in out["cells"].filter("doc_id = 4").collect()] == [("#/tables/0", "c")]
    item = out["items"].filter("doc_id = 4 and ref = '#/texts/0'").first()
    assert (item.page_no, item.left, item.top, item.right, item.bottom) == (1, 5, 15, 25, 35)
    assert {(r.doc_id, r.code) for r in out["errors"].collect()} == {(8, "UNAVAILABLE"), (9, "FAILED_PRECONDITION")}
    assert [r.key for r in out["fields"].collect()] == ["bookmark:b"] and out["edges"].filter("doc_id = 4").count() == 4
    answers = {r.doc_id: r.status for r in parse.responses(out, docs.filter("doc_id in (1, 4)").unionByName(extra)).collect()}
    assert answers == {1: "SUCCESS", 4: "SUCCESS", 8: "PARTIAL_SUCCESS", 9: "FAILURE"}


def test_crops(spark):
    crops = spark.createDataFrame([(1, 1, 0, "table", 10, 20, b"t"), (1, 1, 1, "figure", 0, 0, b"q"), (1, 1, 2, "figure", 0, 0, b"x")], "doc_id bigint, page_no int, region_idx int, label string, left int, top int, crop binary")
    cells = models.structured_cells(crops, lambda: lambda _: [{"row": 0, "col": 0, "row_span": 1, "col_span": 1, "header": False, "left": 1, "top": 2, "right": 3, "bottom": 4}]).collect()
    assert [(c.left, c.top, c.right, c.bottom) for c in cells] == [(11, 22, 13, 24)]
    figures = models.classified(crops, lambda: lambda b: [{"label": "icon", "confidence": 0.3}, {"label": "qr_code" if b == b"q" else "photo", "confidence": 0.7}])
    read = models.decoded(figures, lambda: lambda b: [{"format": "QR", "text": b.decode()}])
    assert {r.region_idx: [x.text for x in r.barcodes] for r in read.collect()} == {1: ["q"], 2: []}


def test_files_are_read_and_hashed(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "memory.txt").write_bytes(b"memory")
    got = files.identified(files.from_files(spark, str(tmp_path))).first()
    assert (got.filename, str(got.binary_hash), got.mimetype) == ("memory.txt", "3348685368019988462", "image/png")
    assert files.from_base64(spark.createDataFrame([("YQ==",), ("a",)], "base64_string string")).select(F.col("content").cast("string")).collect()[0][0] == "a"
    lines = parse.json_lines(spark.createDataFrame([(1, [("a", 1.0)] * 5)], "doc_id int, figure_classes array<struct<label:string,confidence:double>>")).first().value
    assert lines.count("label") == 3
