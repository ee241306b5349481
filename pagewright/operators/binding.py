"""Spatial joins between lines, regions, cells, columns and pages.

Every join has the equi keys (doc_id, page_no), so Spark hashes or sorts on them
and checks the boxes as a residual; none is a nested loop over a whole table.
Ties are broken by explicit keys, never by row order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.geometry import Box, overlaps
from pagewright.operators.grouped import scan_groups

PAGE = ["doc_id", "page_no"]


def bind_regions(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """``lines`` with ``region_idx`` and ``region_label`` of the most confident region that holds the line's centre.

    Ties go to the first region; a line in no region has nulls.
    """
    line = Box.named()
    edges = ("left", "top", "right", "bottom")
    # a page's regions are few: they come to its lines as one small array, so the lines move once
    one = F.struct(F.col("confidence").alias("confidence"), (-F.col("region_idx")).alias("minus"), F.col("label").alias("label"), F.struct(*edges).alias("box"))
    pages = regions.groupBy(*PAGE).agg(F.collect_list(one).alias("__regions"))
    holds = lambda r: Box(*(r["box"][e] for e in edges)).contains(line.centre_x, line.centre_y)
    best = F.array_max(F.filter("__regions", holds))
    joined = lines.join(pages, PAGE, "left").withColumn("__best", best)
    return joined.select(*lines.columns, (-F.col("__best.minus")).alias("region_idx"), F.col("__best.label").alias("region_label"))


def merge_recognised(digital: DataFrame, recognised: DataFrame) -> DataFrame:
    """Digital lines and the recognised ones that overlap none of them, numbered ``merged_idx`` from top to bottom.

    Recognised lines are not compared with one another.  Input order breaks ties,
    digital lines first.
    """
    other = digital.select(*PAGE, *(F.col(e).alias(f"d_{e}") for e in ("left", "top", "right", "bottom")))
    d, o = other.alias("d"), recognised.alias("o")
    same = (F.col("d.doc_id") == F.col("o.doc_id")) & (F.col("d.page_no") == F.col("o.page_no"))
    kept = o.join(d, same & overlaps(Box(*(F.col(f"o.{e}") for e in ("left", "top", "right", "bottom"))), Box(*(F.col(f"d.d_{e}") for e in ("left", "top", "right", "bottom")))), "left_anti")
    both = digital.withColumn("src_ord", F.lit(0)).unionByName(kept.withColumn("src_ord", F.lit(1)))
    order = Window.partitionBy(*PAGE).orderBy("top", "left", "src_ord", "line_idx")
    return both.withColumn("merged_idx", F.row_number().over(order) - 1)


def cell_texts(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """``cells`` with the texts of the region's lines whose centre they hold, joined by spaces.

    A line belongs to every cell that holds it.  Lines go by top, left, index;
    a cell without lines has an empty text.  ``lines`` carry ``region_idx``.
    """
    box, line = Box.named("c_"), Box.named()
    keys = [*PAGE, "region_idx"]
    held = cells.select(*keys, "cell_idx", *(F.col(e).alias(f"c_{e}") for e in ("left", "top", "right", "bottom")))
    hits = lines.select(*keys, "line_idx", "text", "left", "top", "right", "bottom").join(held, keys).filter(box.contains(line.centre_x, line.centre_y))
    texts = hits.groupBy(*keys, "cell_idx").agg(ordered_text(["top", "left", "line_idx"]).alias("text"))
    return cells.join(texts, [*keys, "cell_idx"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def ordered_text(order: list[str], separator: str = " ", text: str = "text") -> Column:
    """Aggregate: texts joined in the given order."""
    pieces = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__text"))))
    return F.array_join(F.transform(pieces, lambda p: p["__text"]), separator)


def page_of_point(points: DataFrame, rects: DataFrame, point_keys: list[str]) -> DataFrame:
    """``points`` (doc_id, x, y) with ``page_index`` of the first page rectangle that holds them, -1 if none.

    Left and top edges belong to a page, right and bottom ones do not.
    """
    hit = (F.col("x") >= F.col("left")) & (F.col("x") < F.col("right")) & (F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom"))
    first = points.join(rects, "doc_id").filter(hit).groupBy("doc_id", *point_keys).agg(F.min("page_index").alias("page_index"))
    return points.join(first, ["doc_id", *point_keys], "left").withColumn("page_index", F.coalesce("page_index", F.lit(-1)))


def suppressed(regions: DataFrame, top: int = 200, keep: int = 100, limit: float = 0.5) -> DataFrame:
    """Greedy suppression per page and label, in 32-bit arithmetic; columns as before.

    Candidates go by confidence, the first of equals first; one stays if its IoU
    with every kept one is at most ``limit``.  ``top`` candidates are looked at
    and ``keep`` kept: both are the operator's own limits.  The choice of the top
    is a native window; only the sequential scan runs in Python, on at most
    ``top`` rows a group.
    """
    order = Window.partitionBy(*PAGE, "label").orderBy(F.desc("confidence"), "region_idx")
    short = regions.withColumn("rank_", F.row_number().over(order)).filter(F.col("rank_") <= top)
    at = [regions.columns.index(e) for e in ("left", "top", "right", "bottom")]
    f32 = np.float32

    def scan(group: list[tuple]):
        box = np.array([[row[i] for i in at] for row in group], dtype=f32)
        area = np.maximum(box[:, 2] - box[:, 0], f32(0)) * np.maximum(box[:, 3] - box[:, 1], f32(0))
        open_ = np.ones(len(group), dtype=bool)
        kept: list[int] = []
        for i in range(len(group)):
            if not open_[i]:
                continue
            kept.append(i)
            if len(kept) == keep:
                break
            w = np.maximum(np.minimum(box[i, 2], box[i:, 2]) - np.maximum(box[i, 0], box[i:, 0]), f32(0))
            h = np.maximum(np.minimum(box[i, 3], box[i:, 3]) - np.maximum(box[i, 1], box[i:, 1]), f32(0))
            shared = w * h
            open_[i:] &= shared / (area[i] + area[i:] - shared + f32(1e-5)) <= f32(limit)
        return [group[i][:-1] for i in kept]

    return scan_groups(short, [*PAGE, "label"], ["rank_"], regions.schema, scan)


def ordered_regions(regions: DataFrame) -> DataFrame:
    """``regions`` with ``region_ord``: by confidence, highest first, then top, left and index."""
    order = Window.partitionBy(*PAGE).orderBy(F.desc("confidence"), "top", "left", "region_idx")
    return regions.withColumn("region_ord", F.row_number().over(order) - 1)
