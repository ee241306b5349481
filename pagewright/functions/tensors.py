"""Decoding of raw model outputs as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The layout grid and its classes.
LAYOUT_WIDTH, LAYOUT_HEIGHT, BINS = 608, 800, 8
FIGURE_GATE = ("bar_code", "qr_code")


def softmax(logits: Column) -> Column:
    """exp(x - max) normalised; an empty array stays empty."""
    e = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def ranked_classes(probabilities: Column, labels: Column) -> Column:
    """Structs (label, confidence), most likely first, ties by label."""
    pairs = F.arrays_zip(labels.alias("label"), probabilities.alias("confidence"))
    pairs = F.transform(pairs, lambda p: F.struct((-p["confidence"]).alias("k"), p["label"].alias("label")))
    return F.transform(F.array_sort(pairs), lambda p: F.struct(p["label"].alias("label"), (-p["k"]).alias("confidence")))


def barcode_gate(classes: Column) -> Column:
    """Whether the first class is one that carries a code; no class, no."""
    return F.coalesce(F.try_element_at(classes, F.lit(1))["label"].isin(*FIGURE_GATE), F.lit(False))


def expected_distance(logits: Column, side: int, stride: Column, bins: int = BINS) -> Column:
    """Distance of one side: expectation of the bin number under softmax, times the stride."""
    p = softmax(F.slice(logits, side * bins + 1, bins))
    return F.aggregate(F.transform(p, lambda v, i: v * i), F.lit(0.0), lambda a, x: a + x) * stride


def decoded_box(logits: Column, centre_x: Column, centre_y: Column, stride: Column, width: int = LAYOUT_WIDTH, height: int = LAYOUT_HEIGHT) -> Column:
    """A box from four distance distributions around a grid centre, clamped to the grid."""
    d = [expected_distance(logits, s, stride) for s in range(4)]
    to = lambda v, most: F.greatest(F.lit(0.0), F.least(v, F.lit(float(most))))
    return F.struct(to(centre_x - d[0], width).alias("left"), to(centre_y - d[1], height).alias("top"), to(centre_x + d[2], width).alias("right"), to(centre_y + d[3], height).alias("bottom"))


def rescaled(box: Column, page_width: Column, page_height: Column, width: int = LAYOUT_WIDTH, height: int = LAYOUT_HEIGHT) -> Column:
    """A grid box in page pixels, rounded half away from zero."""
    sx, sy = F.lit(float(width)) / page_width, F.lit(float(height)) / page_height
    return F.struct(F.round(box["left"] / sx).cast("int").alias("left"), F.round(box["top"] / sy).cast("int").alias("top"), F.round(box["right"] / sx).cast("int").alias("right"), F.round(box["bottom"] / sy).cast("int").alias("bottom"))


# Classes of the layout grid, and the score that a candidate has to pass.
LAYOUT_LABELS, LAYOUT_SCORE = ("text", "title", "list", "table", "figure"), 0.5


def layout_candidates(scores: Column, logits: Column, cell: Column, stride: Column, threshold: float = LAYOUT_SCORE) -> Column:
    """Structs (label, confidence, box) of one grid cell: one for every class whose score is over the threshold."""
    wide = F.ceil(F.lit(LAYOUT_WIDTH) / stride)
    centre = lambda at: (at.cast("double") + 0.5) * stride
    box = decoded_box(logits, centre(cell % wide), centre(F.floor(cell / wide)), stride)
    labels = F.array(*map(F.lit, LAYOUT_LABELS))
    each = F.transform(scores, lambda s, i: F.struct(F.get(labels, i).alias("label"), s.alias("confidence"), box.alias("box")))
    return F.filter(each, lambda c: c["confidence"] > threshold)


# Tokens that open a cell.
CELL_OPEN = ("<td></td>", "<td", "<td>")


def token_boxes(tokens: Column, corners: Column, width: Column, height: Column) -> Column:
    """Boxes (left, top, right, bottom) of the cell-open tokens: the hull of the step's four corners, in pixels of the crop.

    ``corners``: eight numbers a step, as shares of the padded square.
    """
    longest = F.greatest(width, height).cast("double")
    opened = F.filter(tokens, lambda t: t["token"].isin(*CELL_OPEN))

    def edge(points, of, most):
        return F.greatest(F.lit(0), F.least(F.round(of(points) * longest).cast("int"), most.cast("int")))

    def box(t):
        c = F.get(corners, t["step"])
        xs, ys = (F.transform(F.sequence(F.lit(first), F.lit(first + 6), F.lit(2)), lambda i: F.get(c, i).cast("double")) for first in (0, 1))
        return F.struct(edge(xs, F.array_min, width).alias("left"), edge(ys, F.array_min, height).alias("top"), edge(xs, F.array_max, width).alias("right"), edge(ys, F.array_max, height).alias("bottom"))

    return F.transform(opened, box)


def greedy_tokens(steps: Column, vocabulary: Column, begin: str = "sos", end: str = "eos") -> Column:
    """Structs (step, token, p) of the likeliest token of each step, up to ``end`` after the first step; both marks are left out."""
    best = F.transform(steps, lambda p, i: F.struct(i.alias("step"), F.element_at(vocabulary, F.array_position(p, F.array_max(p)).cast("int")).alias("token"), F.array_max(p).alias("p")))
    stop = F.coalesce(F.array_min(F.transform(F.filter(best, lambda b: (b["token"] == end) & (b["step"] > 0)), lambda b: b["step"])), F.size(best))
    return F.filter(best, lambda b: (b["step"] < stop) & ~b["token"].isin(begin, end))


def token_score(tokens: Column) -> Column:
    """Mean probability of the emitted tokens; 0 without any."""
    total = F.aggregate(F.transform(tokens, lambda t: t["p"].cast("double")), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(tokens) > 0, total / F.size(tokens)).otherwise(F.lit(0.0))


def text_confidence(char_scores: Column, box_score: Column) -> Column:
    """Mean of the characters' scores; the box's score without any."""
    total = F.aggregate(F.transform(char_scores, lambda s: s.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(char_scores) > 0, total / F.size(char_scores)).otherwise(box_score.cast("double"))
