"""Image arrays around detection and recognition models: scaling, padding, resizing, boxes from score maps, decoding order."""

from __future__ import annotations

import numpy as np


def standardize(image: np.ndarray, mean: tuple[float, ...], std: tuple[float, ...], scaled: bool = True) -> np.ndarray:
    """Subtract the channel means and divide by the deviations, after division by 255 if asked; channels come last."""
    x = image.astype(np.float32) / (255.0 if scaled else 1.0)
    return (x - np.asarray(mean, np.float32)) / np.asarray(std, np.float32)


def channels_first(image: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(image.transpose(2, 0, 1))


def gray(image: np.ndarray, inverse: bool = False) -> np.ndarray:
    g = image @ np.array([0.299, 0.587, 0.114]) if image.ndim == 3 else image.astype(float)
    g = np.rint(g).astype(np.uint8)[..., None]
    return 255 - g if inverse else g


def pad_to(image: np.ndarray, multiple: int = 32, size: tuple[int, int] | None = None) -> np.ndarray:
    """Zeros below and to the right, up to a size or the next multiple."""
    h, w = image.shape[:2]
    high, wide = size or (-(-h // multiple) * multiple, -(-w // multiple) * multiple)
    return np.pad(image, [(0, high - h), (0, wide - w)] + [(0, 0)] * (image.ndim - 2))


def resize(image: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Bilinear, with pixel centres aligned."""
    h, w = image.shape[:2]
    y = np.clip((np.arange(high) + 0.5) * h / high - 0.5, 0, h - 1)
    x = np.clip((np.arange(wide) + 0.5) * w / wide - 0.5, 0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    if image.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    im = image.astype(np.float64)
    out = (im[y0][:, x0] * (1 - fx) + im[y0][:, x1] * fx) * (1 - fy) + (im[y1][:, x0] * (1 - fx) + im[y1][:, x1] * fx) * fy
    return np.rint(out).astype(image.dtype) if np.issubdtype(image.dtype, np.integer) else out.astype(image.dtype)


def detector_size(h: int, w: int, limit: int = 960, kind: str = "max", multiple: int = 32) -> tuple[int, int]:
    """Size for a text detector: the longer (or shorter) side held to a limit, both sides at multiples."""
    side = max(h, w) if kind == "max" else min(h, w)
    ratio = limit / side if (side > limit if kind == "max" else side < limit) else 1.0
    fit = lambda n: max(int(round(n * ratio / multiple) * multiple), multiple)
    return fit(h), fit(w)


def line_image(image: np.ndarray, high: int, ratio: float) -> np.ndarray:
    """A text line at a fixed height, at most ratio times as wide, scaled to -1..1 and padded with zeros to that width."""
    wide = int(high * ratio)
    own = min(wide, int(np.ceil(high * image.shape[1] / image.shape[0])))
    x = resize(image, high, own).astype(np.float32).transpose(2, 0, 1) / 255.0
    out = np.zeros((3, high, wide), np.float32)
    out[:, :, :own] = (x - 0.5) / 0.5
    return out


def regions(mask: np.ndarray) -> list[np.ndarray]:
    """Pixels (row, column) of each 4-connected region, by runs and union of labels."""
    labels = np.zeros(mask.shape, int)
    up: list[int] = [0]

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for r, c in zip(*np.nonzero(mask)):
        above, left = labels[r - 1, c] if r else 0, labels[r, c - 1] if c else 0
        near = [root(n) for n in (above, left) if n]
        if not near:
            up.append(len(up))
            labels[r, c] = len(up) - 1
        else:
            labels[r, c] = min(near)
            for n in near:
                up[n] = min(near)
    at = np.argwhere(labels)
    own = np.array([root(labels[r, c]) for r, c in at]) if len(at) else np.empty(0, int)
    return [at[own == k] for k in np.unique(own)]


def boxes_of(scores: np.ndarray, threshold: float = 0.3, box_threshold: float = 0.5, grow: float = 1.5, least: int = 3, original: tuple[int, int] | None = None, most: int = 1000) -> list[tuple[np.ndarray, float]]:
    """(corner points, mean score) of text regions of a score map: upright boxes, grown by area over perimeter.

    Boxes under `least` pixels on a side or under the mean score go; points scale to the original size and stay inside it.
    """
    h, w = scores.shape
    high, wide = original or (h, w)
    out = []
    for pixels in regions(scores > threshold)[:most]:
        (top, left), (bottom, right) = pixels.min(0), pixels.max(0) + 1
        if min(bottom - top, right - left) < least:
            continue
        score = float(scores[pixels[:, 0], pixels[:, 1]].mean())
        if score < box_threshold:
            continue
        by = (bottom - top) * (right - left) * grow / (2 * (bottom - top + right - left))
        x0, x1, y0, y1 = left - by, right + by, top - by, bottom + by
        if min(x1 - x0, y1 - y0) < least + 2:
            continue
        points = np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]]) * [wide / w, high / h]
        out.append((np.clip(np.rint(points), 0, [wide, high]), score))
    return out
