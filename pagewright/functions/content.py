"""Bytes, names and text as native column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> MIME type of uploads; anything else is taken for a PNG.
UPLOAD_MIME = {
    ".pdf": "application/pdf",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".odt": "application/vnd.oasis.opendocument.text",
    ".ods": "application/vnd.oasis.opendocument.spreadsheet",
    ".odp": "application/vnd.oasis.opendocument.presentation",
    ".doc": "application/msword",
    ".xls": "application/vnd.ms-excel",
    ".ppt": "application/vnd.ms-powerpoint",
    ".csv": "text/csv",
    ".rtf": "application/rtf",
}
# Office media types beyond those of uploads; anything else is application/octet-stream.
OFFICE_MEDIA = {
    ".odg": "application/vnd.oasis.opendocument.graphics",
    ".fodt": "application/vnd.oasis.opendocument.text",
    ".fods": "application/vnd.oasis.opendocument.spreadsheet",
    ".fodp": "application/vnd.oasis.opendocument.presentation",
    ".fodg": "application/vnd.oasis.opendocument.graphics",
    ".txt": "text/plain",
    ".html": "text/html",
}
# Extensions and MIME parts of office documents.
OFFICE_EXTENSIONS = ".doc .docx .docm .dot .dotx .odt .ott .fodt .rtf .xls .xlsx .xlsm .xlsb .ods .ots .fods .csv .ppt .pptx .pptm .odp .otp .fodp".split()
OFFICE_MIME_PARTS = ("officedocument", "msword", "ms-excel", "ms-powerpoint", "opendocument")
OFFICE_MIME = ("text/csv", "application/rtf")
# The first bytes of the supported rasters.
RASTER_MAGIC = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "tiff_le": "49492A00", "tiff_be": "4D4D002A"}
# 64-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
BASE64 = r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


def decode_base64(s: Column) -> Column:
    """Bytes of strict base64, white space ignored; null for anything else, the empty string too."""
    bare = F.regexp_replace(s, r"\s", "")
    return F.when((bare != "") & bare.rlike(BASE64), F.try_to_binary(bare, F.lit("base64")))


def encode_base64(b: Column) -> Column:
    return F.regexp_replace(F.base64(b), r"[\r\n]", "")


def data_uri(mime: Column, b: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), encode_base64(b))


def extension(name: Column) -> Column:
    """From the last dot on; none for a name that only begins with a dot."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.regexp_extract(base, r".(\.[^.]*)$", 1)


def is_pdf(name: Column, content: Column) -> Column:
    return (extension(name) == ".pdf") | F.coalesce(F.startswith(content, F.unhex(F.lit("255044462D"))), F.lit(False))


def raster_kind(content: Column) -> Column:
    """Name of the raster format by its first bytes; null if it is none."""
    out = F.lit(None).cast("string")
    for kind, magic in reversed(RASTER_MAGIC.items()):
        out = F.when(F.startswith(content, F.unhex(F.lit(magic))), kind).otherwise(out)
    return out


def mime_type(name: Column, table: dict[str, str] | None = None, default: str = "image/png") -> Column:
    """Case-sensitive lookup by extension."""
    pairs = F.create_map(*(F.lit(x) for kv in (table or UPLOAD_MIME).items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, extension(name)), F.lit(default))


def office_mime_type(name: Column) -> Column:
    """The lookup for office media, by extension."""
    rasters = (".jpg", ".jpeg", ".tif", ".tiff")
    return mime_type(name, {k: v for k, v in UPLOAD_MIME.items() if k not in rasters} | OFFICE_MEDIA, "application/octet-stream")


def ascii_lower(s: Column) -> Column:
    """A-Z in small letters; everything else stays."""
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_office(name: Column, content_type: Column) -> Column:
    kind = ascii_lower(F.coalesce(content_type, F.lit("")))
    by_name = ascii_lower(extension(name)).isin(*OFFICE_EXTENSIONS)
    by_type = kind.isin(*OFFICE_MIME)
    for part in OFFICE_MIME_PARTS:
        by_type = by_type | kind.contains(part)
    return by_name | by_type


def format_errors(formats: Column, known: tuple[str, ...] = ("TEXT",)) -> Column:
    """The requested formats that are not produced."""
    return F.filter(F.coalesce(formats, F.array().cast("array<string>")), lambda f: ~f.isin(*known))


def requested(formats: Column, wanted: str) -> Column:
    """An empty list asks for everything."""
    return (F.size(formats) == 0) | F.array_contains(formats, wanted)


def fnv1a(content: Column) -> Column:
    """64-bit FNV-1a of the bytes as DECIMAL(20, 0); for short contents, see ``fnv1a_bulk`` for long ones."""
    digits = F.hex(content)
    at = F.when(F.length(content) > 0, F.sequence(F.lit(0), F.length(content) - 1)).otherwise(F.array().cast("array<int>"))
    octet = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint")
    big = lambda v: F.lit(str(v)).cast("decimal(38,0)")

    def step(h, i):
        low = (h % big(256)).cast("bigint")
        mixed = h - low.cast("decimal(38,0)") + low.bitwiseXOR(octet(i)).cast("decimal(38,0)")
        return (mixed.cast("decimal(38,0)") * big(FNV_PRIME)).cast("decimal(38,0)") % big(2**64)

    hashed = F.aggregate(at, F.lit(str(FNV_OFFSET)).cast("decimal(38,0)"), lambda h, i: step(h, i).cast("decimal(38,0)")).cast("decimal(20,0)")
    return F.when(content.isNotNull(), hashed)


def fnv1a_bulk(content: Column) -> Column:
    """The same hash as text, for long contents: all contents of an Arrow batch move one byte at a step."""
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        known = [v if v is not None else b"" for v in values]
        size = np.fromiter(map(len, known), dtype=np.int64, count=len(known))
        order = np.argsort(-size, kind="stable")
        buffer = np.frombuffer(b"".join(known) + b"\0", dtype=np.uint8)
        begin, size = (np.cumsum(size) - size)[order], size[order]
        h = np.full(len(known), FNV_OFFSET, dtype=np.uint64)
        prime = np.uint64(FNV_PRIME)
        for i in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -i, side="left"))
            if live <= 16:  # few are left: one after another is faster than a step of all
                for k in range(live):
                    x = int(h[k])
                    for b in known[order[k]][i:]:
                        x = ((x ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
                    h[k] = x
                break
            h[:live] = (h[:live] ^ buffer[begin[:live] + i]) * prime
        out = np.empty(len(known), dtype=object)
        out[order] = [str(x) for x in h.tolist()]
        return pd.Series(out).where(values.notna().to_numpy(), None)

    return run(content)


def png_size(content: Column) -> Column:
    """Width and height from a PNG header; null if there are under 24 bytes."""
    word = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("bigint")
    return F.when(F.length(content) >= 24, F.struct(word(17).alias("width"), word(21).alias("height")))


def column_name(index: Column) -> Column:
    """Spreadsheet letters of a 0-based column: 0 is A, 26 is AA, 18278 is AAAA; null for a negative one."""
    i = index.cast("bigint")
    out, first = F.lit(None).cast("string"), 0
    for letters in range(1, 8):  # 26 + 26^2 + ... + 26^7 columns are more than 32 bits count
        at = i - F.lit(first)
        name = F.concat(*(F.chr(F.lit(65) + F.call_function("div", at, F.lit(26**p)) % 26) for p in reversed(range(letters))))
        out = F.when(at >= 0, name).otherwise(out)
        first += 26**letters
    return out


def a1_name(row: Column, col: Column) -> Column:
    return F.concat(column_name(col), (row + 1).cast("string"))


def a1_range(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    return F.concat(a1_name(r1, c1), F.lit(":"), a1_name(r2, c2))


def language_subtag(tag: Column, known: list[str]) -> Column:
    """The first subtag in capitals if it is a known language, else null."""
    sub = F.upper(F.split_part(tag, F.lit("-"), F.lit(1)))
    return F.when(sub.isin(*known), sub)


def span_value(token: Column) -> Column:
    """The number between the first and the last quotation mark, clamped to 1 to 20; 1 if there is none."""
    inner = F.regexp_extract(token, '"(.*)"', 1)
    number = F.regexp_extract(inner, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")
    return F.greatest(F.lit(1), F.least(F.lit(20), F.coalesce(number, F.lit(1))))


def scalar_fields(payload: Column) -> Column:
    """Of a map of JSON texts, the entries that are strings, numbers or booleans."""
    return F.map_filter(payload, lambda _, v: F.schema_of_variant(F.try_parse_json(v)).isin("STRING", "BIGINT", "DOUBLE", "BOOLEAN") | F.schema_of_variant(F.try_parse_json(v)).startswith("DECIMAL"))
