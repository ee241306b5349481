"""Table grids: from line geometry, from recognised cells and from token streams."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagewright.functions.geometry import Box, half, union_box
from pagewright.operators.binding import cell_texts, ordered_text
from pagewright.operators.grouped import spread

TABLE = ["doc_id", "page_no", "region_idx"]
GRID_LIMIT = 4096


def row_bands(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``lines`` with ``band``: a new band begins where a line's centre lies below all that came before.

    Lines go by top, left, index.  The running maximum over all earlier lines
    equals that of the current band, since a new band only begins below it.
    """
    keys = keys or TABLE
    order = Window.partitionBy(*keys).orderBy("top", "left", "line_idx")
    below = F.coalesce(Box.named().centre_y > F.max("bottom").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    marked = lines.withColumn("__new", below.cast("int"))
    return marked.withColumn("band", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def _columned(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``lines`` with ``gutter`` and ``island``, the number of the column span that a line is part of."""
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("left", "right", "line_idx")
    heights = F.sort_array(F.collect_list((F.col("bottom") - F.col("top")).cast("bigint")).over(whole))
    wide = lines.withColumn("__h", heights).withColumn("gutter", F.greatest(F.lit(2).cast("bigint"), F.expr("__h[size(__h) div 2] div 2"))).drop("__h")
    new = F.coalesce(F.col("left") > F.max("right").over(order.rowsBetween(Window.unboundedPreceding, -1)) + F.col("gutter"), F.lit(False))
    return wide.withColumn("__new", new.cast("int")).withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def column_spans(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, col, span_start, span_end): line spans merged while they lie within the gutter of one another."""
    keys = keys or TABLE
    return _columned(lines, keys).groupBy(*keys, F.col("island").alias("col")).agg(F.min("left").alias("span_start"), F.max("right").alias("span_end"))


def geometry_grid(lines: DataFrame) -> DataFrame:
    """Dense grid (TABLE, row, col, text, left, top, right, bottom) from the lines of table regions.

    A cell joins its lines by top, left; blanks have an empty text and no box.
    All windows and aggregates share the table's keys, so the lines move once: a
    table's spans and cells are small arrays beside its rows, not joins.
    """
    whole = Window.partitionBy(*TABLE)
    rows = row_bands(_columned(lines.filter("text <> ''"), TABLE))
    span = F.struct(F.col("island").alias("col"), F.min("left").over(whole.partitionBy(*TABLE, "island")).cast("bigint").alias("start"), F.max("right").over(whole.partitionBy(*TABLE, "island")).cast("bigint").alias("end"))
    rows = rows.withColumn("__span", span).withColumn("__spans", F.collect_set("__span").over(whole))
    box = Box.named()

    def rank(s):
        shared = F.least(box.right, s["end"]) - F.greatest(box.left, s["start"])
        apart = F.abs(box.centre_x - half(s["start"] + s["end"]))
        return F.struct(F.when(shared > 0, shared).otherwise(-apart).alias("score"), (-s["col"]).alias("minus"))

    rows = rows.withColumn("__col", -F.array_max(F.transform("__spans", rank))["minus"])
    place = F.struct(F.col("band").alias("row"), F.col("__col").alias("col"))
    cells = rows.groupBy(*TABLE, place.alias("place"), F.size("__spans").alias("cols")).agg(F.struct(ordered_text(["top", "left", "line_idx"]).alias("text"), *union_box()).alias("cell"))
    grids = cells.groupBy(*TABLE, "cols").agg((F.max("place.row") + 1).alias("rows"), F.map_from_entries(F.collect_list(F.struct("place", "cell"))).alias("cells"))
    dense = grids.select(*TABLE, "cols", "cells", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row")).select(*TABLE, "cells", "row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    cell = F.try_element_at("cells", F.struct(F.col("row"), F.col("col")))
    return dense.select(*TABLE, "row", "col", cell.alias("c")).select(*TABLE, "row", "col", F.coalesce("c.text", F.lit("")).alias("text"), "c.left", "c.top", "c.right", "c.bottom")


def _dense(size: DataFrame) -> DataFrame:
    """One row for each position of each grid."""
    return size.select(*TABLE, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "cols").select(*TABLE, "row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))


def structured_grid(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Dense grid (TABLE, row, col, cell_idx, text, header) from recognised cells.

    The first cell that claims a position has it; a spanning cell repeats;
    an unclaimed position is a blank unit cell.
    """
    filled = cell_texts(cells, lines)
    span = lambda at, n: F.sequence(F.col(at), F.col(at) + F.greatest(F.lit(1), F.col(n)) - 1)
    claims = filled.select(*TABLE, "cell_idx", "text", "header", F.explode(span("row", "row_span")).alias("r"), "col", "col_span").select(*TABLE, "cell_idx", "text", "header", "r", F.explode(span("col", "col_span")).alias("c"))
    first = claims.groupBy(*TABLE, F.col("r").alias("row"), F.col("c").alias("col")).agg(F.min_by(F.struct("cell_idx", "text", "header"), "cell_idx").alias("cell"))
    size = grid_extent(cells)
    dense = _dense(size).join(first, [*TABLE, "row", "col"], "left")
    return dense.select(*TABLE, "row", "col", F.col("cell.cell_idx").alias("cell_idx"), F.coalesce("cell.text", F.lit("")).alias("text"), F.coalesce("cell.header", F.lit(False)).alias("header"))


def grid_extent(cells: DataFrame) -> DataFrame:
    """(TABLE, rows, cols): the farthest ends of the cells."""
    return cells.groupBy(*TABLE).agg(F.max(F.col("row") + F.col("row_span")).alias("rows"), F.max(F.col("col") + F.col("col_span")).alias("cols"))


def table_grids(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """Both builders: a table with recognised cells takes them, any other its line geometry."""
    recognised = cells.select(*TABLE).distinct()
    shape = [*TABLE, "row", "col", "text", "header"]
    plain = geometry_grid(lines.join(recognised, TABLE, "left_anti")).withColumn("header", F.lit(False)).select(*shape)
    return plain.unionByName(structured_grid(cells, lines.join(recognised, TABLE, "left_semi")).select(*shape))


def fold_cells(cells: DataFrame, keys: list[str], limit: int = GRID_LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, grid, fields) of named cells with row, col, name and text.

    A cell with a negative place becomes the field ``cell:<name>``.  The dense
    grid is made only for tables of at most ``limit`` positions; cells beyond the
    table's size stay out of it.  ``rows`` and ``cols`` are columns of the input.
    """
    placed = cells.filter("row >= 0 and col >= 0")
    fields = cells.filter("row < 0 or col < 0").select(*keys, F.concat(F.lit("cell:"), "name").alias("key"), F.col("text").alias("value"))
    size = cells.select(*keys, "rows", "cols").distinct().filter(F.col("rows").cast("bigint") * F.col("cols").cast("bigint") <= limit).filter("rows > 0 and cols > 0")
    dense = size.select(*keys, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "cols").select(*keys, "row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    last = placed.groupBy(*keys, "row", "col").agg(F.max_by("text", "seq").alias("text"))
    grid = dense.join(last, [*keys, "row", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    return placed, grid, fields


CELL = "row int, col int, row_span int, col_span int, header boolean, left int, top int, right int, bottom int"
NO_BOX = (0, 0, 0, 0)
#: Shapes of tables that a task remembers, and rows of a batch that goes out.
PLACED, OUT_ROWS = 1024, 16_384
_QUOTED = re.compile('"(.*)"')


def _span(token: str) -> int:
    m = _QUOTED.search(token)
    number = re.match(r"\s*([+-]?\d+)", m.group(1)) if m else None
    return max(1, min(20, int(number.group(1)))) if number else 1


def place_tokens(tokens: list[str], boxes: list[tuple[int, int, int, int]], limit: int = 1000) -> list[tuple]:
    """Cells of a stream of table tags by the HTML rules.

    A cell is placed where it is closed, and one that is never closed not at all.
    It takes the first run of free columns that fits its colspan; rowspans carry
    down; cells in the head are headers; a missing row tag is tolerated; boxes
    beyond the last cell are ignored.
    """
    cells: list[tuple] = []
    taken: set[tuple[int, int]] = set()
    row, head, box = -1, False, 0

    def put(row_span: int, col_span: int) -> None:
        nonlocal row, box
        row = max(row, 0)
        col = 0
        while col < limit and any((row, c) in taken for c in range(col, col + col_span)):
            col += 1
        taken.update((r, c) for r in range(row, row + row_span) for c in range(col, col + col_span))
        cells.append((row, col, row_span, col_span, head, *(boxes[box] if box < len(boxes) else NO_BOX)))
        box += 1

    spans: list[int] | None = None
    for t in tokens:
        if t == "<thead>":
            head = True
        elif t == "</thead>":
            head = False
        elif t == "<tr>":
            row += 1
        elif t == "<td></td>":
            put(1, 1)
        elif t in ("<td", "<td>"):
            spans = [1, 1]
        elif spans is not None and t.startswith(" rowspan="):
            spans[0] = _span(t)
        elif spans is not None and t.startswith(" colspan="):
            spans[1] = _span(t)
        elif spans is not None and t == "</td>":
            put(*spans)
            spans = None
    return cells


def token_cells(streams: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cell_idx, cell columns) of each row's ``tokens`` and ``boxes``.

    Placement depends on all cells before, so each stream is placed in Python,
    batch by batch, in as many tasks as a shuffle has.  It does not depend on the boxes: streams
    of the same tags, as tables of one shape have them, are placed once.
    """
    kinds = ", ".join(f"{k} {streams.schema[k].dataType.simpleString()}" for k in keys)
    cell = to_arrow_schema(T.StructType.fromDDL(f"cell_idx int, {CELL}"))
    width = len(keys)

    def run(batches):
        placed = lru_cache(PLACED)(lambda tokens: tuple(c[:5] for c in place_tokens(tokens, [])))
        for b in batches:
            at: list[int] = []
            out: list[tuple] = []

            def made() -> pa.RecordBatch:
                columns = zip(*out, strict=True) if out else [()] * len(cell)
                made_ = [pa.array(c, t.type) for c, t in zip(columns, cell, strict=True)]
                return pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(at, pa.int64())) for i in range(width)), *made_], names=[*keys, *cell.names])

            for r, (tokens, boxes) in enumerate(zip(b.column(width).to_pylist(), b.column(width + 1).to_pylist(), strict=True)):
                places = [(x["left"], x["top"], x["right"], x["bottom"]) for x in boxes or ()]
                for i, c in enumerate(placed(tuple(tokens or ()))):
                    at.append(r)
                    out.append((i, *c, *(places[i] if i < len(places) else NO_BOX)))
                if len(out) >= OUT_ROWS:
                    yield made()
                    at, out = [], []
            yield made()

    return spread(streams.select(*keys, "tokens", "boxes"), *keys).mapInArrow(run, f"{kinds}, cell_idx int, {CELL}")
