"""Model inputs on small images, crops, and the text form of a parse's counters."""

import numpy as np
import pytest

from pagewright.functions import pixels
from pagewright.operators import metrics


def plain_resize(image, height, width):
    h, w, _ = image.shape
    out = np.zeros((height, width, 3), dtype=np.uint8)
    for y in range(height):
        for x in range(width):
            sy, sx = min(max((y + 0.5) * h / height - 0.5, 0), h - 1), min(max((x + 0.5) * w / width - 0.5, 0), w - 1)
            y0, x0 = int(sy), int(sx)
            y1, x1 = min(y0 + 1, h - 1), min(x0 + 1, w - 1)
            fy, fx = sy - y0, sx - x0
            for c in range(3):
                top = float(image[y0, x0, c]) * (1 - fx) + float(image[y0, x1, c]) * fx
                low = float(image[y1, x0, c]) * (1 - fx) + float(image[y1, x1, c]) * fx
                out[y, x, c] = int(np.floor(top * (1 - fy) + low * fy + 0.5))
    return out


@pytest.mark.parametrize("size", [(3, 5), (9, 4), (7, 7), (1, 1), (20, 30)])
def test_resizing_agrees_with_the_plain_rule(size):
    image = np.random.default_rng(1).integers(0, 256, (7, 9, 3), dtype=np.uint8)
    got = pixels.resized(image, *size)
    assert np.abs(got.astype(int) - plain_resize(image, *size).astype(int)).max() <= 1
    assert (pixels.resized(image, 7, 9) == image).all()


def test_inputs_have_the_models_shapes_and_channels():
    image = np.zeros((100, 50, 3), dtype=np.uint8)
    image[:, :, 0] = 255  # blue
    first = lambda std: (1 - 0.485) / std
    layout = pixels.layout_input(image)
    assert layout.shape == (3, 800, 608) and layout.dtype == np.float32 and np.allclose(layout[0], first(0.229)) and np.allclose(layout[2], -0.406 / 0.225)
    table = pixels.table_input(image)
    assert table.shape == (3, 488, 488) and np.allclose(table[0, :, :244], first(0.229)) and (table[:, :, 244:] == 0).all()
    figure = pixels.figure_input(image)
    assert figure.shape == (3, 224, 224) and np.allclose(figure[2], (1 - 0.406) / 0.47434163) and np.allclose(figure[0], -0.485 / 0.47853944)


def test_crops_are_clipped():
    image = np.arange(4 * 5 * 3, dtype=np.uint8).reshape(4, 5, 3)
    assert (pixels.crop(image, -2, 1, 3, 99) == image[1:4, 0:3]).all()
    assert pixels.crop(image, 4, 0, 2, 3).size == 0 and pixels.crop(image, 9, 9, 12, 12).size == 0


def test_counters_as_text():
    text = metrics.parse_exposition({"pages_digital_total": 7}, [("25", 1), ("+Inf", 3)])
    lines = text.splitlines()
    assert "# TYPE pagewright_pages_digital_total counter" in lines and "pagewright_pages_digital_total 7" in lines and "pagewright_documents_rejected_total 0" in lines
    assert lines[-1] == "pagewright_page_latency_count 3" and sum(x.startswith("# HELP") for x in lines) == len(metrics.PARSE_COUNTERS)
