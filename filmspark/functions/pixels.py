"""Small numpy helpers for one 8-bit image; pixel operators map them over Arrow batches."""

from __future__ import annotations

import numpy as np


def gray(rgb: np.ndarray) -> np.ndarray:
    """299, 587 and 114 thousandths of R, G and B, rounded half to even."""
    return np.rint((rgb[..., 0] * 299.0 + rgb[..., 1] * 587.0 + rgb[..., 2] * 114.0) / 1000).astype(np.uint8)


def _box(n: int, m: int) -> np.ndarray:
    """m x n weights: each of m cells takes the share of n samples that it covers."""
    edges = np.arange(m + 1) * (n / m)
    low, high = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(1, n + 1))
    return np.maximum(high - low, 0) * (m / n)


def _linear(n: int, m: int) -> np.ndarray:
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    w = np.zeros((m, n))
    w[np.arange(m), low] += 1 - (at - low)
    w[np.arange(m), np.minimum(low + 1, n - 1)] += at - low
    return w


def _apply(image: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    x = np.tensordot(rows, image.astype(np.float64), (1, 0))
    x = np.moveaxis(np.tensordot(cols, x, (1, 1)), 0, 1)
    # what is half but for the noise of floating sums counts as half
    return np.clip(np.rint(np.round(x, 9)), 0, 255).astype(np.uint8)


def resize_area(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """Exact box integration, rounded half to even."""
    return _apply(image, _box(image.shape[0], h), _box(image.shape[1], w))


def resize_linear(image: np.ndarray, w: int, h: int) -> np.ndarray:
    return image.copy() if image.shape[:2] == (h, w) else _apply(image, _linear(image.shape[0], h), _linear(image.shape[1], w))


def _lanczos(n: int, m: int, lobes: int = 3) -> np.ndarray:
    """m x n weights of a windowed sinc about each of m cells of n samples; its width grows as an image shrinks. Weights of a cell are cut at the border and add up to one."""
    scale = n / m
    wide = max(1.0, scale)
    centre = (np.arange(m)[:, None] + 0.5) * scale
    at = np.arange(n)[None, :] + 0.5
    first = np.maximum(0, np.floor(centre - lobes * wide + 0.5))
    stop = np.minimum(n, np.floor(centre + lobes * wide + 0.5))
    d = (at - centre) / wide
    w = np.where((at > first) & (at < stop) & (np.abs(d) < lobes), np.sinc(d) * np.sinc(d / lobes), 0.0)
    return w / w.sum(1, keepdims=True)


def resize_lanczos(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """Windowed-sinc resampling, along rows and then along columns; both results are rounded to 8 bits, half up. A side that keeps its length isn't touched."""
    x = image
    for axis, n in ((1, w), (0, h)):
        if x.shape[axis] != n:
            part = np.moveaxis(np.tensordot(_lanczos(x.shape[axis], n), x.astype(np.float64), (1, axis)), 0, axis)
            x = np.clip(np.floor(np.round(part, 6) + 0.5), 0, 255).astype(np.uint8)
    return x.copy()


def laplacian_variance(g: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian, borders mirrored about the edge sample."""
    p = np.pad(g.astype(np.float64), 1, mode="reflect") if min(g.shape) > 1 else np.pad(g.astype(np.float64), 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def unit(hist: np.ndarray) -> np.ndarray:
    n = np.sqrt((hist.astype(np.float64) ** 2).sum())
    return (hist / n if n else hist).astype(np.float32)


def gray_hist(g: np.ndarray, bins: int = 32) -> np.ndarray:
    return unit(np.bincount((g.ravel().astype(int) * bins) // 256, minlength=bins))


def hue_saturation(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hue 0 to 179 (half degrees) and saturation 0 to 255."""
    c = rgb.astype(np.float64)
    top, low = c.max(-1), c.min(-1)
    d = top - low
    safe = np.where(d == 0, 1, d)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    hue = np.where(top == r, (g - b) / safe, np.where(top == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 60
    hue = np.where(d == 0, 0, hue) % 360
    return np.rint(hue / 2).astype(int) % 180, np.rint(np.where(top == 0, 0, d / np.where(top == 0, 1, top)) * 255).astype(int)


def color_hist(rgb: np.ndarray, hues: int = 24, saturations: int = 16) -> np.ndarray:
    h, s = hue_saturation(rgb)
    return unit(np.bincount((h * hues // 180 * saturations + s * saturations // 256).ravel(), minlength=hues * saturations))


def edge_map(g: np.ndarray, low: float = 60, high: float = 140) -> np.ndarray:
    """0 or 255: 3 x 3 gradients, thinned along their direction, kept above `high` and where they connect to that above `low`."""
    p = np.pad(g.astype(np.float64), 1, mode="edge")
    dx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    dy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    m = np.abs(dx) + np.abs(dy)
    q = np.pad(m, 1)
    angle = (np.rint(np.arctan2(dy, dx) / (np.pi / 4)) % 4).astype(int)
    before = np.choose(angle, [q[1:-1, :-2], q[:-2, :-2], q[:-2, 1:-1], q[:-2, 2:]])
    after = np.choose(angle, [q[1:-1, 2:], q[2:, 2:], q[2:, 1:-1], q[2:, :-2]])
    thin = (m > before) & (m >= after)
    weak, out = thin & (m > low), thin & (m > high)
    while True:
        grown = np.pad(out, 1)
        near = np.zeros_like(out)
        for y in range(3):
            for x in range(3):
                near |= grown[y : y + out.shape[0], x : x + out.shape[1]]
        more = out | (near & weak)
        if (more == out).all():
            return out.astype(np.uint8) * 255
        out = more


def edge_hist(g: np.ndarray) -> np.ndarray:
    return unit(np.bincount(edge_map(g).ravel() // 16, minlength=16))


def dhash(g: np.ndarray) -> list[int]:
    """256 neighbour comparisons of a 17 x 16 reduction, as four signed 64-bit words, first bit lowest."""
    tiny = resize_area(g, 17, 16)
    bits = np.packbits((tiny[:, 1:] > tiny[:, :-1]).ravel(), bitorder="little")
    return bits.view("<i8").tolist()


def lift_table(lift: float = 0.018, gamma: float = 1.06) -> np.ndarray:
    lift, gamma = min(0.25, max(0.0, lift)), max(0.1, gamma)
    return np.clip(np.rint(255 * (lift + (1 - lift) * (np.arange(256) / 255) ** (1 / gamma))), 0, 255).astype(np.uint8)


def restore_table(lift: float = 0.018, gamma: float = 1.06) -> np.ndarray:
    lift, gamma = min(0.25, max(0.0, lift)), max(0.1, gamma)
    v = np.arange(256) / 255
    return np.clip(np.rint(np.where(v < lift, 0, 255 * (np.maximum(v - lift, 0) / (1 - lift)) ** gamma)), 0, 255).astype(np.uint8)


def letterbox(g: np.ndarray, threshold: int = 18, least: float = 0.035) -> tuple[int, int, int, int]:
    """left, right, top, bottom bars: up to the first row or column with enough bright samples within 45 % of the side; tiny ones count as none."""
    out = []
    for axis, n in ((0, g.shape[1]), (1, g.shape[0])):
        full = (g > threshold).mean(axis=axis) >= least
        reach, floor = int(n * 0.45), max(4, n // 200)
        for side in (full[:reach], full[::-1][:reach]):
            k = int(np.argmax(side)) if side.any() else 0
            out.append(0 if k < floor else k)
    return tuple(out)


def feather(w: int, pixels: int = 80) -> np.ndarray:
    """Opacity (0 to 255) along a row: a ramp at either end."""
    f, x = max(1, pixels), np.arange(w)
    return np.where(x < f, 255 * x / f, np.where(x > w - f, 255 * (w - x) / f, 255.0))


def pad_canvas(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """A black canvas with the image in its centre, cut where it is larger."""
    out = np.zeros((h, w, *image.shape[2:]), np.uint8)
    y, x = (h - image.shape[0]) // 2, (w - image.shape[1]) // 2
    part = image[max(0, -y) : max(0, -y) + h, max(0, -x) : max(0, -x) + w]
    out[max(0, y) : max(0, y) + part.shape[0], max(0, x) : max(0, x) + part.shape[1]] = part
    return out


def _luma_chroma(rgb: np.ndarray) -> np.ndarray:
    """Luma and both chroma differences, around 0: an offset would cost them bits, and a value that lies halfway between two samples its side."""
    c = rgb.astype(np.float64)
    y = 0.299 * c[..., 0] + 0.587 * c[..., 1] + 0.114 * c[..., 2]
    return np.stack([y, (c[..., 2] - y) / 1.772, (c[..., 0] - y) / 1.402], -1)


def _samples(yuv: np.ndarray) -> np.ndarray:
    y, u, v = yuv[..., 0], yuv[..., 1], yuv[..., 2]
    return np.clip(np.rint(np.stack([y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u], -1)), 0, 255).astype(np.uint8)


def to_yuv(rgb: np.ndarray) -> np.ndarray:
    return _luma_chroma(rgb) + np.array([0, 128, 128])


def to_rgb(yuv: np.ndarray) -> np.ndarray:
    return _samples(yuv - np.array([0, 128, 128]))


def composite(plate: np.ndarray, source: np.ndarray, color: np.ndarray | None, pixels: int = 80, saturation: float = 0.82, temperature: float = -0.015, opacity: float = 1.0) -> np.ndarray:
    """The source, scaled to the plate's height, over the plate's centre with feathered sides; with a colour layer its chroma, and the luma of what was merged."""
    h, w = plate.shape[:2]
    sw = int(h * source.shape[1] / source.shape[0] / 2) * 2
    over = resize_linear(source, max(2, sw), h)
    a = np.clip(feather(over.shape[1], pixels), 0, 255)[None, :, None] / 255
    x = (w - over.shape[1]) // 2
    merged = plate.astype(np.float64)
    left, right = max(0, x), min(w, x + over.shape[1])
    a, over = a[:, left - x : right - x], over[:, left - x : right - x]
    merged[:, left:right] = over * a + merged[:, left:right] * (1 - a)
    merged = np.clip(np.rint(merged), 0, 255).astype(np.uint8)
    if color is None:
        return merged
    base, tint = _luma_chroma(merged), _luma_chroma(resize_linear(color, w, h))
    tint[..., 1:] *= max(0.0, saturation)
    shifted = _samples(tint).astype(np.float64)
    shifted[..., 0] += 255 * max(temperature, 0.0) / 2
    shifted[..., 2] += 255 * max(-temperature, 0.0) / 2
    tint = _luma_chroma(np.clip(shifted, 0, 255))
    share = min(1.0, max(0.0, opacity))
    return _samples(np.concatenate([base[..., :1], base[..., 1:] * (1 - share) + tint[..., 1:] * share], -1))


def _blur(x: np.ndarray, radius: int) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / (radius / 2)) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        p = np.pad(x, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        x = sum(w * np.take(p, np.arange(x.shape[axis]) + i, axis) for i, w in enumerate(k))
    return x


def guide_composite(guide: np.ndarray, frame: np.ndarray, shift: tuple[int, int] = (-1, 1), edge: int = 10, black: int = 4) -> np.ndarray:
    """A guide fitted into the frame's canvas and shifted, the frame's content over it with an edge that fades inwards only; what stays black takes the nearest other sample of its column, else of its row."""
    h, w = frame.shape[:2]
    scale = min(w / guide.shape[1], h / guide.shape[0])
    nw, nh = max(1, int(np.rint(guide.shape[1] * scale))), max(1, int(np.rint(guide.shape[0] * scale)))
    fit = resize_linear(guide, nw, nh)
    x, y = (w - nw) // 2 + shift[0], (h - nh) // 2 + shift[1]
    out = np.zeros((h, w, 3))
    part = fit[max(0, -y) : max(0, -y) + h - max(0, y), max(0, -x) : max(0, -x) + w - max(0, x)]
    out[max(0, y) : max(0, y) + part.shape[0], max(0, x) : max(0, x) + part.shape[1]] = part
    content = (frame > black).any(-1)
    if content.any():
        a = (_blur(content.astype(np.float64), edge) * content)[..., None]
        out = frame * a + out * (1 - a)
    # cut to whole numbers; what is whole but for the noise of floating sums counts as whole
    out = np.clip(np.round(out, 6), 0, 255).astype(np.uint8)
    for axis in (0, 1):
        dark = (out <= black).all(-1)
        if not dark.any():
            break
        lines = out if axis else out.swapaxes(0, 1)
        gone = dark if axis else dark.T
        for k in np.flatnonzero(gone.any(1) & ~gone.all(1)):
            good = np.flatnonzero(~gone[k])
            holes = np.flatnonzero(gone[k])
            lines[k, holes] = lines[k, good[np.abs(holes[:, None] - good).argmin(1)]]
    return out
