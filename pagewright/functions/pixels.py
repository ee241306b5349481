"""Model inputs from pixels: small NumPy helpers for the functions that run a model.

An image is an array (height, width, 3) of bytes, blue first.
"""

from __future__ import annotations

import numpy as np

# Input sizes and normalisation of the models.
LAYOUT_SIZE, TABLE_SIZE, FIGURE_SIZE = (800, 608), 488, 224
MEAN, STD, FIGURE_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225), (0.47853944, 0.4732864, 0.47434163)


def crop(image: np.ndarray, left: int, top: int, right: int, bottom: int) -> np.ndarray:
    """The part of the image inside the box, which is clipped to it; empty where nothing is left."""
    h, w = image.shape[:2]
    x0, y0 = min(max(left, 0), w), min(max(top, 0), h)
    return image[y0 : max(y0, min(bottom, h)), x0 : max(x0, min(right, w))]


def _weights(size: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.clip((np.arange(to) + 0.5) * size / to - 0.5, 0, size - 1)
    low = np.floor(at).astype(np.int64)
    return low, np.minimum(low + 1, size - 1), (at - low).astype(np.float64)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres on half steps, edges held; bytes, rounded half up."""
    y0, y1, fy = _weights(image.shape[0], height)
    x0, x1, fx = _weights(image.shape[1], width)
    rows = image[y0].astype(np.float64) * (1 - fy)[:, None, None] + image[y1] * fy[:, None, None]
    out = rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]
    return np.floor(out + 0.5).astype(np.uint8)


def _normal(image: np.ndarray, mean, std) -> np.ndarray:
    """(3, height, width) of 32-bit floats."""
    scaled = (image.astype(np.float32) / np.float32(255) - np.asarray(mean, np.float32)) / np.asarray(std, np.float32)
    return np.ascontiguousarray(scaled.transpose(2, 0, 1))


def layout_input(image: np.ndarray) -> np.ndarray:
    """Stretched to the layout grid; channels stay blue first."""
    return _normal(resized(image, *LAYOUT_SIZE), MEAN, STD)


def table_input(image: np.ndarray) -> np.ndarray:
    """The longer side to the model's size, the rest zeros at the right or the bottom; channels stay blue first."""
    h, w = image.shape[:2]
    ratio = np.float32(TABLE_SIZE) / np.float32(max(h, w))
    part = _normal(resized(image, max(1, int(np.float32(h) * ratio)), max(1, int(np.float32(w) * ratio))), MEAN, STD)
    out = np.zeros((3, TABLE_SIZE, TABLE_SIZE), dtype=np.float32)
    out[:, : part.shape[1], : part.shape[2]] = part
    return out


def figure_input(image: np.ndarray) -> np.ndarray:
    """Stretched to a square; channels red first."""
    return _normal(resized(image, FIGURE_SIZE, FIGURE_SIZE)[:, :, ::-1], MEAN, FIGURE_STD)
