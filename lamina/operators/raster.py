"""Raster operators on pixel arrays: numpy for whole pictures, column expressions for pixels in rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def difference_hash(grey: np.ndarray) -> str:
    """64 bits, row by row, of left > right in a 9 x 8 grid, as 16 hex digits."""
    bits = (grey[:, :-1] > grey[:, 1:]).ravel()
    return f"{int(''.join('01'[int(b)] for b in bits), 2):0{-(-len(bits) // 4)}x}"


def difference_hash_of(values: Column, columns: int, rows: int) -> Column:
    """difference_hash() of an array column that holds the grid row by row."""
    at = [r * columns + c + 1 for r in range(rows) for c in range(columns - 1)]
    bits = F.transform(F.array(*map(F.lit, at)), lambda i: F.when(F.element_at(values, i) > F.element_at(values, i + 1), 1).otherwise(0))
    first = len(at) % 4 or 4
    cuts = F.array(*[F.struct(F.lit(max(1, i - 3)).alias("a"), F.lit(min(4, i)).alias("n")) for i in range(first, len(at) + 1, 4)])
    digit = lambda own: F.substring(F.lit("0123456789abcdef"), F.aggregate(own, F.lit(0), lambda s, b: s * 2 + b) + 1, F.lit(1))
    return F.element_at(F.transform(F.array(bits), lambda b: F.array_join(F.transform(cuts, lambda x: digit(F.slice(b, x["a"], x["n"]))), "")), 1)


def flood_from_border(background: np.ndarray) -> np.ndarray:
    """Background cells that the border reaches over edges of background cells; enclosed ones are not.

    background is one picture, or a stack of pictures of one size. Each round takes the neighbours of the cells found last,
    all at once.
    """
    h, w = background.shape[-2:]
    # a frame of foreground around each picture, so that neighbours need no bounds
    wide = np.zeros((background.size // max(1, h * w), h + 2, w + 2), bool)
    wide[:, 1:-1, 1:-1] = background.reshape(-1, h, w)
    inner = np.ones((h, w), bool)
    inner[1:-1, 1:-1] = False
    left = wide.ravel().copy()  # background cells that are not reached yet
    wide[:, 1:-1, 1:-1] &= inner
    at = np.flatnonzero(wide)
    left[at] = False
    while len(at):
        near = np.concatenate([at - 1, at + 1, at - (w + 2), at + (w + 2)])
        at = np.unique(near[left[near]])
        left[at] = False
    reached = ~left.reshape(wide.shape)[:, 1:-1, 1:-1] & background.reshape(-1, h, w)
    return reached.reshape(background.shape)


def corner_background(rgba: np.ndarray, tolerance: int) -> tuple[int, int, int]:
    """The colour of the largest set of opaque corners, three at least, that lie within tolerance of one of them."""
    corners = rgba[[0, 0, -1, -1], [0, -1, 0, -1]].astype(int)
    corners = corners[corners[:, 3] == 255, :3]
    if len(corners) < 3:
        raise ValueError("fewer than three opaque corners: give the background")
    near = np.abs(corners[:, None] - corners[None]).max(-1) <= tolerance
    best = int(near.sum(1).argmax())
    if near[best].sum() < 3:
        raise ValueError("the corners have no common background: give it")
    return tuple(int(v) for v in np.rint(corners[near[best]].mean(0)))


def without_background(rgba: np.ndarray, tolerance: int = 12, background: tuple[int, int, int] | None = None) -> tuple[np.ndarray, int]:
    """(picture whose cells near the background colour, reached from the border, are transparent; their number)."""
    if not 0 <= tolerance <= 255:
        raise ValueError("tolerance must be in 0..255")
    if not rgba.size:
        raise ValueError("the picture is empty")
    colour = np.array(background if background is not None else corner_background(rgba, tolerance))
    near = (rgba[..., 3] == 0) | (np.abs(rgba[..., :3].astype(int) - colour).max(-1) <= tolerance)
    gone = flood_from_border(near)
    out = rgba.copy()
    out[..., 3] = np.where(gone, 0, out[..., 3])
    return out, int((gone & (rgba[..., 3] > 0)).sum())


def trimmed(rgba: np.ndarray, padding: int = 0) -> np.ndarray:
    """The picture cut to what is not transparent, with transparent cells around it."""
    if padding < 0:
        raise ValueError("padding cannot be negative")
    left, top, right, bottom = opaque_box(rgba[..., 3])
    return np.pad(rgba[top:bottom, left:right], ((padding, padding), (padding, padding), (0, 0)))


def hex_colour(text: str) -> tuple[int, int, int]:
    """#RGB or #RRGGBB as three numbers."""
    raw = text.strip().removeprefix("#")
    raw = "".join(c + c for c in raw) if len(raw) == 3 else raw
    if len(raw) != 6 or any(c not in "0123456789abcdefABCDEF" for c in raw):
        raise ValueError("a colour is #RGB or #RRGGBB")
    return int(raw[:2], 16), int(raw[2:4], 16), int(raw[4:], 16)


def matte_alpha(dark: list[Column], light: list[Column]) -> Column:
    """Alpha of a pixel from its channels on black and on white: 255 less the median difference."""
    deltas = F.array_sort(F.array(*[F.greatest(F.lit(0), F.least(F.lit(255), b - a)) for a, b in zip(dark, light, strict=True)]))
    return F.lit(255) - F.element_at(deltas, 2)


def matte_colour(dark: Column, alpha: Column) -> Column:
    """A channel of the picture itself, from the one on black."""
    return F.when(alpha <= 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), F.bround(dark * 255 / alpha).cast("int"))))


def alpha_from_mattes(dark: np.ndarray, light: np.ndarray) -> np.ndarray:
    """RGBA from the same picture on black and on white: alpha is 255 less the median channel difference."""
    delta = np.median(np.clip(light.astype(int) - dark.astype(int), 0, 255), axis=-1)
    alpha = np.clip(255 - delta, 0, 255).astype(int)
    colour = np.where(alpha[..., None] > 0, np.clip(np.rint(dark.astype(float) * 255 / np.maximum(alpha, 1)[..., None]), 0, 255), 0).astype(int)
    return np.concatenate([colour, alpha[..., None]], -1).astype(np.uint8)


def opaque_box(alpha: np.ndarray, padding: int = 0) -> tuple[int, int, int, int]:
    """left, top, right, bottom of alpha > 0 with padding, within the picture; an error if there is none."""
    ys, xs = np.nonzero(alpha > 0)
    if not len(ys):
        raise ValueError("the picture is fully transparent")
    h, w = alpha.shape
    return max(0, int(xs.min()) - padding), max(0, int(ys.min()) - padding), min(w, int(xs.max()) + 1 + padding), min(h, int(ys.max()) + 1 + padding)
