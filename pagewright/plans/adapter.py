"""The shared tables as the engine's inputs, in integer arithmetic only.

Each shape exists twice: as a DataFrame and as DuckDB SQL (``SQL``, common table
expressions to put in front of an oracle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGIONS = (("title", 0.9, 0, 80, 840, 180), ("table", 0.8, 40, 580, 800, 980), ("text", 0.7, 40, 90, 800, 2100), ("list", 0.6, 880, 90, 1650, 2100), ("figure", 0.5, 0, 2120, 1700, 2190))
WIDTH, HEIGHT = 1700, 2200


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents with boxes; 40 to a page in two columns of 20."""
    split = documents(spark, sf_dir).select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("k", "text"))
    left, top = F.expr("cast(50 + 850 * (k % 40 div 20) as int)"), F.expr("100 + 100 * (k % 20)")
    digital = F.col("k") % 3 != 0
    return split.select(
        "doc_id",
        F.expr("cast(k div 40 + 1 as int)").alias("page_no"),
        F.col("k").alias("line_idx"),
        "text",
        left.alias("left"),
        top.alias("top"),
        (left + F.least(F.lit(700), 10 * F.char_length("text"))).alias("right"),
        (top + 60).alias("bottom"),
        F.when(~digital, ((F.col("k") % 100) / F.lit(100)).cast("float")).alias("confidence"),
        F.when(digital, "DIGITAL_PDF").otherwise("OCR").alias("origin"),
    )


def polygon() -> F.Column:
    """The four corners of a line's box, clockwise from the top left."""
    at = lambda x, y: F.struct(F.col(x).cast("int").alias("x"), F.col(y).cast("int").alias("y"))
    return F.array(at("left", "top"), at("right", "top"), at("right", "bottom"), at("left", "bottom"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five regions on every page of ``lines``."""
    made = F.array(
        *(
            F.struct(F.lit(i).alias("region_idx"), F.lit(n).alias("label"), F.lit(c).cast("float").alias("confidence"), *(F.lit(v).alias(e) for e, v in zip(("left", "top", "right", "bottom"), b, strict=True)))
            for i, (n, c, *b) in enumerate(REGIONS)
        )
    )
    size = documents(spark, sf_dir).select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("n")).filter("n > 0")
    pages = size.select("doc_id", F.explode(F.expr("sequence(1, cast((n - 1) div 40 + 1 as int))")).alias("page_no"))
    return pages.select("doc_id", "page_no", F.inline(made))


def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised lines: a shifted copy of every second digital line, and the lines that are not digital."""
    all_lines = lines(spark, sf_dir)
    copies = all_lines.filter("origin = 'DIGITAL_PDF' and line_idx % 2 = 0").select(
        "doc_id", "page_no", (F.col("line_idx") + 1_000_000).alias("line_idx"), "text", *((F.col(e) + 5).alias(e) for e in ("left", "top", "right", "bottom")), F.lit(0.5).cast("float").alias("confidence"), F.lit("OCR").alias("origin")
    )
    return copies.unionByName(all_lines.filter("origin = 'OCR'"))


def payload(**values: F.Column) -> F.Column:
    """An office event's payload as JSON text."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in values.items())))


def office_event(df: DataFrame, doc: F.Column, seq: F.Column, kind: str, payload: F.Column) -> DataFrame:
    """Rows of ``df`` as office events (doc_id, seq, kind, payload)."""
    return df.select(doc.cast("bigint").alias("doc_id"), seq.cast("bigint").alias("seq"), F.lit(kind).alias("kind"), payload.alias("payload"))


SQL = """
l0 as (select doc_id, unnest(l) as text, generate_subscripts(l, 1) - 1 as k from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') as l from documents)),
lines as (select doc_id, (k // 40 + 1)::int as page_no, k::int as line_idx, text, (50 + 850 * (k % 40 // 20))::int as "left", (100 + 100 * (k % 20))::int as top,
  (50 + 850 * (k % 40 // 20) + least(700, 10 * length(text)))::int as "right", (160 + 100 * (k % 20))::int as bottom,
  case when k % 3 = 0 then ((k % 100) / 100)::float end as confidence, case when k % 3 <> 0 then 'DIGITAL_PDF' else 'OCR' end as origin from l0),
region_rows(region_idx, label, confidence, "left", top, "right", bottom) as (values (0, 'title', 0.9::float, 0, 80, 840, 180), (1, 'table', 0.8::float, 40, 580, 800, 980), (2, 'text', 0.7::float, 40, 90, 800, 2100), (3, 'list', 0.6::float, 880, 90, 1650, 2100), (4, 'figure', 0.5::float, 0, 2120, 1700, 2190)),
regions as (select p.doc_id, p.page_no, r.* from (select distinct doc_id, page_no from lines) p cross join region_rows r),
recognised as (
  select doc_id, page_no, (line_idx + 1000000)::int as line_idx, text, "left" + 5 as "left", top + 5 as top, "right" + 5 as "right", bottom + 5 as bottom, 0.5::float as confidence, 'OCR' as origin from lines where origin = 'DIGITAL_PDF' and line_idx % 2 = 0
  union all select * from lines where origin = 'OCR'),
bound as (select l.*, r.region_idx, r.label as region_label from lines l left join (
  select l.doc_id, l.line_idx, arg_max(r, (r.confidence, -r.region_idx)) as r from lines l join regions r on l.doc_id = r.doc_id and l.page_no = r.page_no
   and (l."left" + l."right") // 2 between r."left" and r."right" and (l.top + l.bottom) // 2 between r.top and r.bottom group by 1, 2) b on l.doc_id = b.doc_id and l.line_idx = b.line_idx
  left join regions r on r.doc_id = l.doc_id and r.page_no = l.page_no and r.region_idx = b.r.region_idx)
"""


def oracle(select: str, *more: str) -> str:
    """A full DuckDB query over the adapter's shapes."""
    return "with " + ",\n".join([SQL.strip(), *more]) + "\n" + select
