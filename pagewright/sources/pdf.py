"""Digital text of PDF files, in pure Python: enough for simple, unencrypted files.

A page's text operators give pieces with a place and a size; pieces of one
baseline make a line.  Places are points of 1/72 inch from the top left, turned
by the page's rotation.  Glyphs are taken as one byte a character and half an em
wide where the font says nothing.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagewright.functions.geometry import pixels
from pagewright.operators.grouped import bound_batches
from pagewright.streaming.run import once

OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+", re.S)
#: Unpacked bytes of one stream.
MAX_STREAM = 256 << 20
#: Lines of a batch that goes out.
OUT_ROWS = 4096
ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class InvalidDocument(ValueError):
    """The bytes are no document that can be read."""


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")
    raw = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), token[1:-1])
    return re.sub(rb"\\(.)", lambda m: ESCAPE.get(m[1], m[1]), raw, flags=re.S).decode("cp1252", "replace")


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[3] for m in OBJECT.finditer(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body and (n := re.search(rb"/N\s+(\d+)", body)) and (first := re.search(rb"/First\s+(\d+)", body)):
            text = _stream(body)
            head = list(map(int, text[: int(first[1])].split()))[: 2 * int(n[1])]
            starts = head[1::2] + [len(text) - int(first[1])]
            for number, a, b in zip(head[::2], starts, starts[1:], strict=False):
                found.setdefault(number, text[int(first[1]) + a : int(first[1]) + b])
    return found


def _stream(body: bytes) -> bytes:
    m = STREAM.search(body)
    if not m:
        return b""
    if b"/FlateDecode" not in body[: m.start()]:
        return m[1]
    d = zlib.decompressobj()
    out = d.decompress(m[1], MAX_STREAM)
    if not d.eof:
        raise InvalidDocument("a stream is cut off or too long")
    return out


def _refs(body: bytes, key: bytes) -> list[int]:
    m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def _pages(objects: dict[int, bytes]) -> list[dict]:
    out: list[dict] = []

    def walk(number: int, box, turn: int, depth: int) -> None:
        body = objects.get(number, b"")
        if m := re.search(rb"/MediaBox\s*\[([^\]]*)\]", body):
            box = [float(x) for x in m[1].split()[:4]]
        if m := re.search(rb"/Rotate\s+(-?\d+)", body):
            turn = int(m[1]) % 360
        kids = _refs(body, b"Kids")
        if kids and depth < 32:
            for k in kids:
                walk(k, box, turn, depth + 1)
        elif re.search(rb"/Type\s*/Page\b", body):
            out.append({"box": box or [0, 0, 612, 792], "turn": turn, "contents": _refs(body, b"Contents")})

    for number, body in objects.items():
        if m := re.search(rb"/Type\s*/Catalog", body):
            for root in _refs(body, b"Pages"):
                walk(root, None, 0, 0)
            if m and out:
                break
    return out


def _pieces(text: bytes) -> list[tuple[float, float, float, str]]:
    """(x, baseline, size, string) of every shown string."""
    out, args, array, in_array = [], [], [], False
    line, x, y, size, leading = (0.0, 0.0), 0.0, 0.0, 12.0, 0.0

    def show(s: str) -> None:
        nonlocal x
        if s:
            out.append((x, y, size, s))
            x += 0.5 * size * len(s)

    def move(dx: float, dy: float) -> None:
        nonlocal line, x, y
        line = (line[0] + dx, line[1] + dy)
        x, y = line

    for m in TOKEN.finditer(text):
        t = m[0]
        if t[:1] in b"(<":
            (array if in_array else args).append(_string(t))
        elif t == b"[":
            in_array, array = True, []
        elif t == b"]":
            in_array = False
        elif t[:1] in b"+-.0123456789":
            (array if in_array else args).append(float(t))
        elif t[:1] == b"/":
            args.append(t.decode("latin-1"))
        else:
            nums = [a for a in args if isinstance(a, float)]
            words = [a for a in args if isinstance(a, str) and a[:1] != "/"]
            if t == b"BT":
                line, x, y = (0.0, 0.0), 0.0, 0.0
            elif t == b"Tf" and nums:
                size = nums[-1]
            elif t == b"TL" and nums:
                leading = nums[-1]
            elif t in (b"Td", b"TD") and len(nums) >= 2:
                leading = -nums[-1] if t == b"TD" else leading
                move(nums[-2], nums[-1])
            elif t == b"Tm" and len(nums) >= 6:
                line = (nums[-2], nums[-1])
                x, y = line
            elif t == b"T*":
                move(0, -leading)
            elif t == b"Tj" and words:
                show(words[-1])
            elif t in (b"'", b'"') and words:
                move(0, -leading)
                show(words[-1])
            elif t == b"TJ":
                show("".join(a if isinstance(a, str) else " " if a < -200 else "" for a in array))
            args = []
    return out


def digital_pages(data: bytes) -> list[dict]:
    """Pages with ``width`` and ``height`` in points and ``lines`` (text, left, top, right, bottom).

    Raises ``InvalidDocument`` if there is no page to be found, or for anything
    in the file that cannot be read: one broken file is that file's error.
    """
    try:
        return _digital_pages(data)
    except InvalidDocument:
        raise
    except (zlib.error, ValueError, ArithmeticError, LookupError, TypeError, RecursionError) as e:
        raise InvalidDocument(f"the PDF is broken: {e}") from e


def _digital_pages(data: bytes) -> list[dict]:
    objects = _objects(data) if data.startswith(b"%PDF-") else {}
    pages = _pages(objects)
    if not pages:
        raise InvalidDocument("the PDF has no pages")
    out = []
    for p in pages:
        x0, y0, x1, y1 = p["box"]
        w, h = x1 - x0, y1 - y0
        lines: dict[tuple, list] = {}
        for number in p["contents"]:
            for x, y, size, s in _pieces(_stream(objects.get(number, b""))):
                lines.setdefault((round(y), round(size, 1)), []).append((x, y, size, s))
        made = []
        for parts in lines.values():
            parts.sort(key=lambda q: q[0])
            left, y, size = parts[0][0] - x0, parts[0][1] - y0, parts[0][2]
            right = parts[-1][0] - x0 + 0.5 * size * len(parts[-1][3])
            text = " ".join(q[3].strip() for q in parts if q[3].strip())
            box = (left, h - y - size, right, h - y + 0.2 * size)
            if p["turn"] in (90, 180, 270):
                a, b, c, d = box
                box = {90: (h - d, a, h - b, c), 180: (w - c, h - d, w - a, h - b), 270: (b, w - c, d, w - a)}[p["turn"]]
            if text:
                made.append((text, *box))
        made.sort(key=lambda q: (q[2], q[1]))
        wide, high = (h, w) if p["turn"] in (90, 270) else (w, h)
        out.append({"width": wide, "height": high, "lines": made})
    return out


ROWS = "page_no int, width_pt double, height_pt double, line_idx int, text string, left_pt double, top_pt double, right_pt double, bottom_pt double, error string"


def pdf_rows(docs: DataFrame) -> DataFrame:
    """One row a line (or an empty page, or an unreadable document) of ``docs`` (doc_id, content).

    Files are parsed where they are read: there is no shuffle before the text is out.
    A worker holds one bounded batch of files, one file's text and ``OUT_ROWS`` lines.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = to_arrow_schema(T.StructType.fromDDL(ROWS))

    def rows_of(content: bytes | None):
        try:
            pages = digital_pages(content or b"")
        except InvalidDocument as e:
            return [(*[None] * (len(shape) - 1), str(e))]
        out = []
        for n, p in enumerate(pages, 1):
            if not p["lines"]:
                out.append((n, p["width"], p["height"], *[None] * (len(shape) - 3)))
            out += [(n, p["width"], p["height"], i, *line, None) for i, line in enumerate(p["lines"])]
        return out

    def run(batches):
        for b in batches:
            at: list[int] = []
            out: list[tuple] = []

            def made() -> pa.RecordBatch:
                columns = zip(*out, strict=True) if out else [()] * len(shape)
                made_ = [pa.array(c, t.type) for c, t in zip(columns, shape, strict=True)]
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *made_], names=["doc_id", *shape.names])

            for r in range(b.num_rows):
                rows = rows_of(b.column(1)[r].as_py())
                for i in range(0, len(rows), OUT_ROWS):
                    part = rows[i : i + OUT_ROWS]
                    at += [r] * len(part)
                    out += part
                    if len(out) >= OUT_ROWS:
                        yield made()
                        at, out = [], []
            yield made()

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, {ROWS}")


def pdf_pages_and_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, lines, errors): pixels at 200 DPI, and whether recognition can be skipped on a page.

    The files are parsed once, here; the three tables are read from the shared folder.
    """
    rows = once(pdf_rows(docs))
    bare = F.octet_length(F.regexp_replace("text", r"[ \t\n\r\f\x0B]", ""))
    high = F.first("height_pt")
    cover = F.when(high > 0, (F.greatest(F.lit(0.0), F.max("bottom_pt")) - F.least(high, F.min("top_pt"))) / high).otherwise(F.lit(0.0))
    stats = rows.filter("page_no is not null").groupBy("doc_id", "page_no").agg(F.first("width_pt").alias("w"), high.alias("h"), F.sum(bare).alias("bytes"), F.count("line_idx").alias("n"), cover.alias("cover"))
    dense = (F.col("bytes") >= 32) & (F.col("n") >= 4) & ((F.col("cover") >= 0.12) | (F.col("bytes") >= 128))
    pages = stats.select("doc_id", "page_no", pixels(F.col("w")).alias("width"), pixels(F.col("h")).alias("height"), F.when(F.col("n") > 0, "DIGITAL_PDF").otherwise("OCR").alias("source"), F.coalesce(dense, F.lit(False)).alias("skip_ocr"))
    edges = (pixels(F.col(f"{e}_pt")).alias(e) for e in ("left", "top", "right", "bottom"))
    lines = rows.filter("line_idx is not null").select("doc_id", "page_no", "line_idx", "text", *edges, F.lit(None).cast("float").alias("confidence"), F.lit("DIGITAL_PDF").alias("origin"))
    errors = rows.filter("error is not null").select("doc_id", F.lit("INVALID_ARGUMENT").alias("code"), "error")
    return pages, lines, errors
