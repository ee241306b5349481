"""Reading order by recursive cuts at the widest gap.

A page's units are the regions that hold text, each grown to its lines, and the
lines outside any region.  The units are cut at the single widest gap of either
axis, horizontal bands winning ties; what starts at or before the gap comes
first; both parts are cut again.  Units without a gap go by top, then left.
Lines inside a unit go by top, then left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.operators.grouped import scan_groups

PAGE = ["doc_id", "page_no"]


def gap(spans: list[tuple[int, int]]) -> tuple[int, int] | None:
    """(width, where the gap begins) of the widest gap between spans; the first of equals."""
    best, reach = None, None
    for start, end in sorted(spans):
        if reach is not None and start > reach and (best is None or start - reach > best[0]):
            best = (start - reach, reach)
        reach = end if reach is None else max(reach, end)
    return best


def cut_order(units: list[tuple[int, int, int, int, int]]) -> list[int]:
    """Numbers of units (left, top, right, bottom, number) in reading order."""
    out: list[int] = []
    todo = [units]
    while todo:
        part = todo.pop()
        rows = gap([(u[1], u[3]) for u in part]) if len(part) > 1 else None
        cols = gap([(u[0], u[2]) for u in part]) if len(part) > 1 else None
        if rows is None and cols is None:
            out += [u[4] for u in sorted(part, key=lambda u: (u[1], u[0], u[4]))]
            continue
        axis, at = (1, rows[1]) if cols is None or (rows is not None and rows[0] >= cols[0]) else (0, cols[1])
        todo.append([u for u in part if u[axis] > at])
        todo.append([u for u in part if u[axis] <= at])
    return out


def reading_order(lines: DataFrame) -> DataFrame:
    """``lines`` with ``read_idx``, their place in the page's reading order.

    ``lines`` have boxes, ``line_idx`` and, where a region holds them,
    ``region_idx`` with the region's box ``r_left`` ... ``r_bottom``.  Lines
    without text keep no place and are left out.  Pages are small groups; the
    recursion is the one part that no relational operator expresses.
    """
    shape = lines.filter("text <> ''").select(*PAGE, "line_idx", "left", "top", "right", "bottom", *("region_idx r_left r_top r_right r_bottom".split()))

    def order(page: list[tuple]):
        units: dict = {}
        for doc, no, line, *box, region, l, t, r, b in page:  # noqa: E741
            own = ("region", region) if region is not None else ("line", line)
            have = units.setdefault(own, [l, t, r, b, []] if region is not None else [*box, []])
            have[:4] = min(have[0], box[0]), min(have[1], box[1]), max(have[2], box[2]), max(have[3], box[3])
            have[4].append(line)
        # regions come before free lines, both by index
        ranked = [units[k] for k in sorted(units, key=lambda k: (k[0] == "line", k[1]))]
        placed = (line for u in cut_order([(*u[:4], k) for k, u in enumerate(ranked)]) for line in ranked[u][4])
        return [(doc, no, line, i) for i, line in enumerate(placed)]

    schema = T.StructType([lines.schema["doc_id"], T.StructField("page_no", T.IntegerType()), T.StructField("line_idx", T.IntegerType()), T.StructField("read_idx", T.IntegerType())])
    placed = scan_groups(shape, PAGE, ["top", "left", "line_idx"], schema, order)
    return lines.join(placed, [*PAGE, "line_idx"])


def widest_gap(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gap_width, gap_at): the widest gap of each group's spans ``span_start`` to ``span_end``, the first of equals."""
    before = Window.partitionBy(*keys).orderBy("span_start", "span_end").rowsBetween(Window.unboundedPreceding, -1)
    gaps = spans.withColumn("reach", F.max("span_end").over(before)).withColumn("width", F.col("span_start") - F.col("reach")).filter("width > 0")
    best = F.max_by(F.struct("width", "reach"), F.struct("width", -F.col("reach")))
    return gaps.groupBy(*keys).agg(best.alias("g")).select(*keys, F.col("g.width").alias("gap_width"), F.col("g.reach").alias("gap_at"))
