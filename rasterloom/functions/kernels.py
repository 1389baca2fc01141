"""numpy kernels on packed images (height, width, 3) of uint8: one per node of the operator catalogue.

Filters follow 8-bit conventions: values are rounded after every pass, three-by-three kernels copy
border pixels, box filters extend the edge, resampling widens its support when it shrinks.
"""

from __future__ import annotations

import colorsys
import functools
import math
import random
import zlib

import numpy as np

from .pixels import HUES, REGION_COLORS, palette_table


def clip8(v) -> np.ndarray:
    """Held to 0..255, fractions cut off."""
    return np.clip(v, 0, 255).astype(np.uint8)


def round8(v) -> np.ndarray:
    return np.floor(np.clip(v, 0, 255) + 0.5).clip(0, 255).astype(np.uint8)


def luma(a: np.ndarray) -> np.ndarray:
    r, g, b = (a[..., k].astype(np.int64) for k in range(3))
    return ((19595 * r + 38470 * g + 7471 * b + 32768) >> 16).astype(np.uint8)


def gray3(v: np.ndarray) -> np.ndarray:
    return np.repeat(v[..., None], 3, 2).astype(np.uint8)


def blend(a, b, f: float) -> np.ndarray:
    a, b = np.asarray(a, float), np.asarray(b, float)
    return clip8(a + f * (b - a))


def brightness(a, amount=0):
    return clip8(a * (1 + amount / 100))


def contrast_factor(a, f):
    return blend(math.floor(luma(a).mean() + 0.5), a, f)


def contrast(a, amount=0):
    return contrast_factor(a, 1 + amount / 100)


def saturation_factor(a, f):
    return blend(gray3(luma(a)), a, f)


def saturation(a, amount=0):
    return saturation_factor(a, 1 + amount / 100)


def _along(v: np.ndarray, axis: int, radius: float) -> np.ndarray:
    """Box mean of a possibly fractional radius along one axis, edges extended, rounded to 8 bits."""
    whole = int(radius)
    part = radius - whole
    n = v.shape[axis]
    at = np.arange(-whole - 1, n + whole + 1).clip(0, n - 1)
    x = np.take(v.astype(float), at, axis)
    cut = lambda start: np.take(x, np.arange(start, start + n), axis)
    total = np.zeros(v.shape)
    for i in range(1, 2 * whole + 2):
        total += cut(i)
    if part:
        total += part * (cut(0) + cut(2 * whole + 2))
    return np.floor(total / (2 * radius + 1) + 0.5)


def box(a, radius, passes=1):
    v = a
    for axis in (1, 0):
        for _ in range(passes):
            v = _along(v, axis, radius)
    return v.astype(np.uint8)


def gaussian(a, sigma):
    """Three extended box passes along each axis whose variance is the Gaussian's."""
    if sigma <= 0:
        return a
    n = 3
    ideal = math.sqrt(12 * sigma * sigma / n + 1)
    whole = math.floor((ideal - 1) / 2)
    width = 2 * whole + 1
    part = width * (whole * (whole + 1) - 3 * sigma * sigma / n) / (6 * (sigma * sigma / n - (whole + 1) ** 2))
    return box(a, whole + part, n)


def median(a, size):
    r = size // 2
    p = np.pad(a, ((r, r), (r, r), (0, 0)), "edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(p, (size, size), (0, 1)), (-2, -1)).astype(np.uint8)


def blur(a, mode="gaussian", radius=2):
    radius = max(0.1, float(radius))
    if mode == "box":
        return box(a, radius)
    if mode == "median":
        return median(a, max(3, int(round(radius)) | 1))
    return gaussian(a, radius)


def sharpen(a, amount=30):
    percent = int((0.3 + amount / 100 * 4) * 100)
    d = a.astype(np.int64) - gaussian(a, 2)
    more = np.sign(d) * (np.abs(d) * percent // 100)
    return clip8(np.where(np.abs(d) > 2, a + more, a))


def noise(a, mode="gaussian", amount=10):
    """Seeded by the image's content, so that a cached result can be made again."""
    rng = np.random.default_rng(zlib.crc32(a.tobytes()))
    h, w = a.shape[:2]
    if mode == "saltpepper":
        n = int(w * h * amount / 100 * 0.05)
        out = a.copy()
        out[rng.integers(0, h, n), rng.integers(0, w, n)] = np.where(rng.random(n) < 0.5, 255, 0)[:, None]
        return out
    drawn = clip8(128 + int(max(1, amount / 100 * 80)) * rng.standard_normal((h, w)))
    return blend(a, gray3(drawn), min(0.6, amount / 100 * 0.6))


SOBEL = ((-1, 0, 1, -2, 0, 2, -1, 0, 1), (-1, -2, -1, 0, 0, 0, 1, 2, 1))
PREWITT = ((-1, 0, 1, -1, 0, 1, -1, 0, 1), (-1, -1, -1, 0, 0, 0, 1, 1, 1))
LAPLACIAN = (0, 1, 0, 1, -4, 1, 0, 1, 0)
FIND_EDGES = (-1, -1, -1, -1, 8, -1, -1, -1, -1)
EMBOSS = (-1, 0, 0, 0, 1, 0, 0, 0, 0)


def kernel(v: np.ndarray, weights, offset=0) -> np.ndarray:
    """3 by 3, its first row over the pixels below; borders copied."""
    out = v.copy()
    h, w = v.shape[:2]
    if h < 3 or w < 3:
        return out
    x = v.astype(np.int64)
    total = np.full(v[1:-1, 1:-1].shape, offset, np.int64)
    for i, k in enumerate(weights):
        if k:
            dy, dx = 2 - i // 3, i % 3
            total += k * x[dy : dy + h - 2, dx : dx + w - 2]
    out[1:-1, 1:-1] = total.clip(0, 255)
    return out


def magnitude(g: np.ndarray, method="sobel") -> np.ndarray:
    if method == "laplacian":
        return np.minimum(255, np.abs(kernel(g, LAPLACIAN, 128).astype(np.int64) - 128) * 3).astype(np.uint8)
    if method == "find":
        return kernel(g, FIND_EDGES)
    gx, gy = (kernel(g, k, 128).astype(np.int64) - 128 for k in (SOBEL if method == "sobel" else PREWITT))
    return np.minimum(255, np.sqrt(gx * gx + gy * gy).astype(np.int64)).astype(np.uint8)


# Resampling


def _triangle(x):
    return np.maximum(0, 1 - np.abs(x))


def _cubic(x, a=-0.5):
    x = np.abs(x)
    return np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, (((x - 5) * x + 8) * x - 4) * a, 0))


def _lanczos(x):
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


FILTERS = {"bilinear": (_triangle, 1.0), "bicubic": (_cubic, 2.0), "lanczos": (_lanczos, 3.0)}


def _weights(n: int, to: int, name: str) -> np.ndarray:
    f, support = FILTERS[name]
    scale = n / to
    wide = max(scale, 1.0)
    centre = (np.arange(to) + 0.5) * scale
    low = np.maximum(0, (centre - support * wide + 0.5).astype(int))
    high = np.minimum(n, (centre + support * wide + 0.5).astype(int))
    at = np.arange(n)
    w = f((at[None] - centre[:, None] + 0.5) / wide) * ((at >= low[:, None]) & (at < high[:, None]))
    return w / w.sum(1, keepdims=True)


def resample(a: np.ndarray, w: int, h: int, name="bilinear") -> np.ndarray:
    if (h, w) == a.shape[:2]:
        return a
    v = round8(np.einsum("ij,hj...->hi...", _weights(a.shape[1], w, name), a.astype(float)))
    return round8(np.einsum("ij,j...->i...", _weights(a.shape[0], h, name), v.astype(float)))


def downscale(a: np.ndarray, longest: int) -> np.ndarray:
    h, w = a.shape[:2]
    if max(w, h) <= longest:
        return a
    s = longest / max(w, h)
    return resample(a, max(1, round(w * s)), max(1, round(h * s)))


def edges(a, method="sobel", strength=50):
    s = strength / 100
    g = luma(a)
    m = magnitude(downscale(g, 900), method if method in ("sobel", "prewitt", "laplacian") else "find")
    if s < 0.999:
        m = blend(math.floor(m.mean() + 0.5), m, 0.4 + s * 1.6)
    m = resample(m, a.shape[1], a.shape[0])
    return gray3(blend(g, m, 0.5))


def emboss(a, strength=40):
    return contrast_factor(kernel(a, EMBOSS, 128), 0.5 + strength / 100)


def grayscale(a, mode="luma", channel="r"):
    if mode.startswith("average"):
        s = a.astype(np.int64)
        total = np.minimum(255, np.minimum(255, s[..., 0] + s[..., 1]) + s[..., 2]) if mode == "average" else s.sum(2)
        return gray3(total // 3)
    if mode == "channel":
        return gray3(a[..., {"r": 0, "g": 1, "b": 2}.get(channel, 0)])
    return gray3(luma(a))


def invert(a):
    return 255 - a


def threshold(a, mode="binary", value=127, block=15):
    if mode == "adaptive":
        return np.full_like(a, 255)
    g = luma(a)
    cut = box(g, max(1, block // 2)) if mode == "adaptive_signed" else value
    return gray3(np.where(g >= cut, 255, 0))


def equalize(a, mode="luminance"):
    out = a.copy()
    for k in range(3):
        h = np.bincount(a[..., k].ravel(), minlength=256)
        used = np.flatnonzero(h)
        step = (h.sum() - h[used[-1]]) // 255
        if len(used) > 1 and step:
            out[..., k] = np.minimum(255, (step // 2 + np.concatenate([[0], np.cumsum(h)[:-1]])) // step).astype(np.uint8)[a[..., k]]
    return out


def color_balance(a, r=0, g=0, b=0):
    gains = [1 + x / 100 for x in (r, g, b)]
    return np.stack([a[..., k] if gains[k] == 1 else clip8(a[..., k] * gains[k]) for k in range(3)], 2)


def posterize(a, levels=4):
    step = 1 << (8 - max(2, min(8, int(levels))))
    return a - a % step


def false_color(a, palette="thermal"):
    return np.array(palette_table(palette), np.uint8)[luma(a)]


def solarize(a, threshold=128):
    return np.where(a < threshold, a, 255 - a).astype(np.uint8)


def resize(a, mode="scale", scale=1.0, width=800, height=600):
    h, w = a.shape[:2]
    size = {"width": (width, h * width / w), "height": (w * height / h, height)}.get(mode, (w * scale, h * scale))
    return resample(a, max(1, round(size[0])), max(1, round(size[1])), "lanczos")


def rotate(a, angle=0, expand=True, fill=(255, 255, 255)):
    """Counter-clockwise, bicubic; right angles move pixels only."""
    angle %= 360
    h, w = a.shape[:2]
    if angle % 90 == 0 and (expand or angle == 180 or w == h):
        return np.rot90(a, int(angle // 90)).copy()
    t = math.radians(angle)
    c, s = math.cos(t), math.sin(t)
    nw, nh = (math.ceil(round(abs(w * c) + abs(h * s), 9)), math.ceil(round(abs(w * s) + abs(h * c), 9))) if expand else (w, h)
    y, x = np.mgrid[0:nh, 0:nw] + 0.5
    u, v = x - nw / 2, y - nh / 2
    sx, sy = c * u - s * v + w / 2 - 0.5, s * u + c * v + h / 2 - 0.5
    inside = (sx >= -0.5) & (sx < w - 0.5) & (sy >= -0.5) & (sy < h - 0.5)
    ix, iy = np.floor(sx).astype(int), np.floor(sy).astype(int)
    out = np.zeros((nh, nw, 3))
    for j in range(-1, 3):
        for i in range(-1, 3):
            k = _cubic(sx - ix - i) * _cubic(sy - iy - j)
            out += k[..., None] * a[(iy + j).clip(0, h - 1), (ix + i).clip(0, w - 1)]
    return np.where(inside[..., None], round8(out), np.array(fill, np.uint8)).astype(np.uint8)


def crop(a, left=0, top=0, right=1, bottom=1):
    h, w = a.shape[:2]
    x0, x1, y0, y1 = (round(n * min(1.0, max(0.0, float(f)))) for n, f in ((w, left), (w, right), (h, top), (h, bottom)))
    return a[y0:y1, x0:x1].copy() if x1 > x0 and y1 > y0 else a


def flip(a, mode="horizontal"):
    return (a[::-1] if mode == "vertical" else a[:, ::-1]).copy()


def border(a, width=10, color="#000000"):
    n, c = max(0, int(width)), color.lstrip("#")
    c = "".join(2 * d for d in c) if len(c) == 3 else c
    out = np.empty((a.shape[0] + 2 * n, a.shape[1] + 2 * n, 3), np.uint8)
    out[:] = [int(c[i : i + 2], 16) for i in (0, 2, 4)]
    out[n : n + a.shape[0], n : n + a.shape[1]] = a
    return out


# Components, features, detection, segmentation


def label_components(on: np.ndarray) -> np.ndarray:
    """4-connected components, numbered from 1 by first pixel in raster order: minimum labels spread along rows and columns until nothing changes."""
    h, w = on.shape
    labels = np.where(on, np.arange(1, h * w + 1).reshape(h, w), 0)
    parent = np.arange(h * w + 1)

    def find(x):
        while (parent[x] != parent[parent[x]]).any():
            parent[x] = parent[parent[x]]
        return parent[x]

    pairs = np.concatenate([np.stack([labels[:, :-1], labels[:, 1:]], -1)[on[:, :-1] & on[:, 1:]], np.stack([labels[:-1], labels[1:]], -1)[on[:-1] & on[1:]]])
    while len(pairs):
        a, b = find(pairs[:, 0]), find(pairs[:, 1])
        open_ = a != b
        if not open_.any():
            break
        pairs, a, b = pairs[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    root = find(np.arange(h * w + 1))
    _, out = np.unique(np.where(on, root[labels], 0), return_inverse=True)
    return out.reshape(h, w) + (0 if (~on).any() else 1)


def otsu(g: np.ndarray) -> int:
    h = np.bincount(g.ravel(), minlength=256).astype(float)
    wb, sb = np.cumsum(h), np.cumsum(h * np.arange(256))
    wf, sf = wb[-1] - wb, sb[-1] - sb
    ok = (wb > 0) & (wf > 0)
    if not ok.any():
        return 127
    var = np.full(256, -1.0)
    var[ok] = wb[ok] * wf[ok] * (sb[ok] / wb[ok] - sf[ok] / wf[ok]) ** 2
    return int(var.argmax()) if var.max() > 0 else 127


def saliency(a: np.ndarray, method="saliency") -> np.ndarray:
    if method == "color":
        top, low = a.max(2).astype(np.int64), a.min(2).astype(np.int64)
        return np.where(top == 0, 0, (top - low) * 255 // np.maximum(top, 1)).astype(np.uint8)
    if method == "edge":
        return resample(magnitude(luma(downscale(a, 500))), a.shape[1], a.shape[0])
    smooth = gaussian(a, max(3, min(a.shape[:2]) // 24))
    return luma(np.abs(a.astype(np.int64) - smooth).astype(np.uint8))


def overlap(p, q) -> float:
    w, h = (min(p[k] + p[k + 2], q[k] + q[k + 2]) - max(p[k], q[k]) for k in (0, 1))
    return w * h / (p[2] * p[3] + q[2] * q[3] - w * h) if w > 0 and h > 0 else 0.0


def suppress(boxes: list[tuple[float, tuple]], most: float = 0.5) -> list[tuple[float, tuple]]:
    kept: list[tuple[float, tuple]] = []
    for score, b in sorted(boxes, key=lambda x: -x[0]):
        if all(overlap(b, k) < most for _, k in kept):
            kept.append((score, b))
    return kept


def measured(labels: np.ndarray, v: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Of each label from 1 on: area, inclusive box, and the sum of ``v``; one pass over the sorted labels."""
    n, w = int(labels.max(initial=0)), labels.shape[1]
    flat = labels.ravel()
    area = np.bincount(flat, minlength=n + 1)
    order = np.argsort(flat, kind="stable")[area[0] :]  # places of a label in raster order
    starts = np.concatenate([[0], np.cumsum(area[1:])[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
    y, x = np.divmod(order, w)
    least, most = (lambda q, f=f: f.reduceat(q, starts) if n else starts for f in (np.minimum, np.maximum))
    total = np.bincount(flat, v.ravel(), n + 1)[1:].astype(np.int64) if v is not None else np.zeros(n, np.int64)
    return {"area": area[1:], "x0": least(x), "y0": least(y), "x1": most(x), "y1": most(y), "sum": total}


def box_color(a: np.ndarray) -> list[int]:
    """An image scaled to one pixel: triangle weights along rows, rounded, then along the column, in whole numbers."""
    def one(v):  # the mean over the last axis but one, n values
        n = v.shape[-2]
        w = 2 * n - np.abs(2 * np.arange(n) + 1 - n)
        return (2 * (w[:, None] * v).sum(-2) + w.sum()) // (2 * w.sum())

    return [int(c) for c in one(one(a.astype(np.int64)))]


def color_name(rgb) -> str:
    """As the column expression names it."""
    h, s, v = colorsys.rgb_to_hsv(*(c / 255 for c in rgb))
    if s < 0.15:
        return "white" if v > 0.6 else "dark"
    return next((name for end, name in HUES if h * 360 < end), "colorful")


def detect(a, method="saliency", threshold=None, max_boxes=20, min_size=0.02):
    """(boxes, the threshold used): from a working copy of 360 pixels, boxes with score, label and mean color on the original's coordinates."""
    work = downscale(a, 360)
    ratio = a.shape[1] / work.shape[1]
    s = saliency(work, method)
    cut = otsu(s) if threshold is None else int(threshold)
    m = measured(label_components(s >= cut), s)
    w, h = m["x1"] - m["x0"], m["y1"] - m["y0"]
    score = m["sum"] / np.maximum(m["area"], 1)
    large = np.flatnonzero(w * h >= s.size * min_size**2 * 0.25)
    kept = suppress([(float(score[i]), (int(m["x0"][i]), int(m["y0"][i]), int(w[i]), int(h[i]))) for i in large])[: max(0, int(max_boxes))]
    top = (kept[0][0] if kept else 1.0) or 1.0
    out = []
    for value, (x, y, bw, bh) in kept:
        color = box_color(work[y : y + bh, x : x + bw])
        out.append(dict(zip("xywh", (round(v * ratio) for v in (x, y, bw, bh)))) | {"score": round(min(1.0, value / top), 3), "label": color_name(color), "mean_color": color})
    return out, cut


def median_cut(a: np.ndarray, n: int) -> np.ndarray:
    """Palette index per pixel: the box of the widest band is halved at its median until there are ``n``."""
    flat = a.reshape(-1, 3).astype(np.int64)
    groups = [np.arange(len(flat))]
    while len(groups) < n:
        wide = [np.ptp(flat[g], 0).max() if len(g) > 1 else 0 for g in groups]
        i = int(np.argmax(wide))
        if not wide[i]:
            break
        g = groups.pop(i)
        v = flat[g, np.ptp(flat[g], 0).argmax()]
        cut = np.median(v)
        low = v <= cut if (v > cut).any() else v < cut
        groups += [g[low], g[~low]]
    out = np.zeros(len(flat), np.int64)
    for k, g in enumerate(groups):
        out[g] = k
    return out.reshape(a.shape[:2])


def segment_labels(work: np.ndarray, method="threshold", value=127, colors=6) -> np.ndarray:
    g = luma(work)
    if method == "region":
        return np.ones(g.shape, np.int64)
    if method != "color":
        return label_components(g >= (otsu(g) if value is None else value))
    index = median_cut(work, max(2, int(colors)))
    ids, counts = np.unique(index, return_counts=True)
    out, following = np.zeros(g.shape, np.int64), 1
    for i in ids[np.argsort(-counts, kind="stable")][: int(colors) + 2]:
        parts = label_components(index == i)
        large = np.flatnonzero(np.bincount(parts.ravel())[1:] >= 0.002 * g.size) + 1
        names = np.zeros(int(parts.max(initial=0)) + 1, np.int64)
        names[large] = following + np.arange(len(large))
        out = np.where(names[parts] > 0, names[parts], out)
        following += len(large)
    return out


def segment(a, method="threshold", value=127, block=15, colors=6, alpha=0.45):
    """(overlay, regions by falling area)."""
    work = downscale(a, 360)
    labels = segment_labels(work, method, value, colors)
    ratio = a.shape[1] / work.shape[1]
    m, regions = measured(labels), []
    for i in np.argsort(-m["area"], kind="stable"):
        x0, y0, x1, y1 = (int(m[c][i]) for c in ("x0", "y0", "x1", "y1"))
        box = [round(v * ratio) for v in (x0, y0, x1 - x0, y1 - y0)]  # as wide as its last place is from its first
        regions.append({"id": int(i) + 1, "area": round(int(m["area"][i]) * ratio * ratio), "coverage": round(int(m["area"][i]) / labels.size, 4), "box": box, "mean_color": box_color(work[y0 : y1 + 1, x0 : x1 + 1])})
    paint = np.array([(0, 0, 0), *REGION_COLORS], np.uint8)[np.where(labels > 0, (labels - 1) % len(REGION_COLORS) + 1, 0)]
    edge = gray3(kernel(luma(paint), FIND_EDGES))
    paint = blend(paint, edge, 0.35)
    mixed = np.where((labels > 0)[..., None], blend(work, paint, float(alpha)), work).astype(np.uint8)
    return resample(mixed, a.shape[1], a.shape[0]), regions


def keypoints(a, method="sift", max_points=120):
    """Keypoints with descriptors, on the original's coordinates."""
    work = downscale(a, 360)
    ratio = a.shape[1] / work.shape[1]
    g = luma(work)
    m = magnitude(g).astype(np.int64)
    h, w = m.shape
    r = 3
    found = []
    if h > 2 * r and w > 2 * r:
        peak = np.lib.stride_tricks.sliding_window_view(m, (2 * r + 1, 2 * r + 1)).max((2, 3))
        inner = m[r : h - r, r : w - r]
        y, x = np.nonzero((inner == peak) & (inner >= 40))
        y, x = y + r, x + r
        order = np.lexsort((x, y, -m[y, x]))[: max(0, int(max_points))]
        found = [(int(x[i]), int(y[i])) for i in order]
    gx, gy = np.zeros_like(m), np.zeros_like(m)
    gx[1:-1, 1:-1] = m[1:-1, 2:] - m[1:-1, :-2]
    gy[1:-1, 1:-1] = m[2:, 1:-1] - m[:-2, 1:-1]
    out = []
    for x, y in found:
        near = np.s_[max(0, y - 6) : y + 7, max(0, x - 6) : x + 7]
        angle = math.atan2(int(gy[near].sum()), int(gx[near].sum()))
        d = orb(g, x, y) if method == "orb" else sift(g, x, y, angle)
        out.append({"x": round(x * ratio), "y": round(y * ratio), "size": round(4.0 * ratio, 2), "angle": angle, "response": int(m[y, x]), "descriptor": d})
    return out


def sift(g: np.ndarray, x: int, y: int, angle: float) -> list[int]:
    """Sums of gradient magnitude over 4 by 4 cells and 8 directions of the turned 16 by 16 patch, length 255."""
    h, w = g.shape
    oy, ox = np.mgrid[-8:8, -8:8]
    px, py = x + ox, y + oy
    ok = (px > 0) & (py > 0) & (px < w - 1) & (py < h - 1)
    ox, oy, px, py = ox[ok], oy[ok], px[ok], py[ok]
    v = g.astype(np.int64)
    gx, gy = v[py, px + 1] - v[py, px - 1], v[py + 1, px] - v[py - 1, px]
    turn = np.arctan2(gy, gx) % (2 * np.pi)
    c, s = math.cos(-angle), math.sin(-angle)
    cell = lambda q: np.clip(((q + 8) / 4).astype(int), 0, 3)
    slot = (cell(ox * s + oy * c) * 4 + cell(ox * c - oy * s)) * 8 + (turn / (2 * np.pi) * 8).astype(int) % 8
    bins = np.bincount(slot, np.sqrt(gx * gx + gy * gy), 128)
    norm = math.sqrt((bins**2).sum()) or 1.0
    return np.minimum(255, np.rint(bins / norm * 255)).astype(int).tolist()


@functools.lru_cache(4096)
def orb_pairs(x: int, y: int) -> np.ndarray:
    """The pixel pairs of a position, the same in every image."""
    draw = random.Random(x * 1000003 + y * 99991).randrange
    return np.array([[draw(-8, 9) for _ in range(4)] for _ in range(256)])


def orb(g: np.ndarray, x: int, y: int) -> list[int]:
    """256 comparisons of pixel pairs drawn by a generator that the position seeds."""
    h, w = g.shape  # the seed's factors and the range of the draws are fixed values
    at = orb_pairs(x, y)
    take = lambda i: g[np.clip(y + at[:, i + 1], 0, h - 1), np.clip(x + at[:, i], 0, w - 1)]
    return (take(0) < take(2)).astype(int).tolist()


#: The ring of radius 3, clockwise from above, as (x, y).
RING = ((0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3))


def fast_corners(g: np.ndarray, threshold=40, run=9) -> np.ndarray:
    """Where ``run`` neighbours on the ring, one after the other from above on, are all brighter or all darker by more than ``threshold``. The ring doesn't close; a margin of 3 has none."""
    h, w = g.shape
    out = np.zeros(g.shape, bool)
    if h <= 6 or w <= 6:
        return out
    v = g.astype(np.int64)
    inner = v[3:-3, 3:-3]
    ring = np.stack([v[3 + y : h - 3 + y, 3 + x : w - 3 + x] for x, y in RING])
    for side in (ring > inner + threshold, ring < inner - threshold):
        out[3:-3, 3:-3] |= np.lib.stride_tricks.sliding_window_view(side, run, 0).all(-1).any(0)
    return out


def match(a: np.ndarray, b: np.ndarray, method="sift", max_points=120, max_matches=40, ratio=0.75) -> dict:
    """Keypoints of both images, nearest descriptors by the ratio test, one to one by rising distance, and the canvas."""
    ka, kb = keypoints(a, method, max_points), keypoints(b, method, max_points)
    found = []
    if ka and kb:
        da, db = (np.array([p["descriptor"] for p in ks], np.int64) for ks in (ka, kb))
        for i, d in enumerate(da):
            far = (db != d).sum(1).astype(float) if method == "orb" else np.sqrt(((db - d) ** 2).sum(1))
            order = np.argsort(far, kind="stable")[:2]
            if len(order) < 2 or far[order[0]] < ratio * far[order[1]]:
                found.append((float(far[order[0]]), i, int(order[0])))
    matches, used = [], set()
    for d, i, j in sorted(found):
        if j not in used and len(matches) < max(1, max_matches):
            used.add(j)
            matches.append({"a": {c: ka[i][c] for c in "xy"}, "b": {c: kb[j][c] for c in "xy"}, "distance": round(d, 3)})
    return {"method": method, "count": len(matches), "matches": matches, "count_a": len(ka), "count_b": len(kb), "image": side_by_side(a, b, matches)}


def line(out: np.ndarray, x0: int, y0: int, x1: int, y1: int, color) -> None:
    """A line of one pixel, cut off at the image's edges."""
    n = max(abs(x1 - x0), abs(y1 - y0)) + 1
    x, y = np.rint(np.linspace(x0, x1, n)).astype(int), np.rint(np.linspace(y0, y1, n)).astype(int)
    ok = (x >= 0) & (y >= 0) & (x < out.shape[1]) & (y < out.shape[0])
    out[y[ok], x[ok]] = color


def disc(out: np.ndarray, x: int, y: int, r: int, color, filled=True) -> None:
    dy, dx = np.mgrid[-r : r + 1, -r : r + 1]
    far = dy * dy + dx * dx
    on = (far <= r * r) & (filled | (far > (r - 1) * (r - 1)))
    py, px = y + dy[on], x + dx[on]
    ok = (px >= 0) & (py >= 0) & (px < out.shape[1]) & (py < out.shape[0])
    out[py[ok], px[ok]] = color


def side_by_side(a: np.ndarray, b: np.ndarray, matches: list[dict]) -> np.ndarray:
    """Both images on one canvas; a match is a line with a disc at each end, its hue by its distance."""
    out = np.full((max(a.shape[0], b.shape[0]), a.shape[1] + b.shape[1], 3), 20, np.uint8)
    out[: a.shape[0], : a.shape[1]], out[: b.shape[0], a.shape[1] :] = a, b
    for m in matches:
        color = [int(c * 255) for c in colorsys.hsv_to_rgb(m["distance"] * 137.5 % 1.0, 0.9, 1.0)]
        ends = (m["a"]["x"], m["a"]["y"]), (a.shape[1] + m["b"]["x"], m["b"]["y"])
        line(out, *ends[0], *ends[1], color)
        for x, y in ends:
            disc(out, x, y, 3, color)
    return out


def draw_keypoints(a: np.ndarray, points: list[dict], method="sift") -> np.ndarray:
    """A ring around each point and a line of twice its size in its direction."""
    out, color = a.copy(), (255, 60, 60) if method == "sift" else (60, 160, 255)
    for p in points:
        size = max(2.0, p["size"])
        disc(out, p["x"], p["y"], max(2, int(size)), color, filled=False)
        line(out, p["x"], p["y"], p["x"] + int(2 * size * math.cos(p["angle"])), p["y"] + int(2 * size * math.sin(p["angle"])), color)
    return out


def difference_heat(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, dict]:
    """(heat map, metrics) of ``a``, scaled to the size of ``b``, and ``b``."""
    a = resample(a, b.shape[1], b.shape[0], "lanczos")
    d = luma(np.abs(a.astype(np.int64) - b).astype(np.uint8)).astype(np.int64)
    mse = float(d.sum()) / max(d.size, 1)
    psnr = 100.0 if mse < 1e-9 else 20 * math.log10(255.0 / max(math.sqrt(mse), 1e-6))
    t = np.minimum(255, d * 4) / 255
    low = t < 0.5
    heat = np.stack([np.where(low, t * 2 * 255, 255), np.where(low, 0, (t - 0.5) * 2 * 255), np.where(low, (0.5 - t) * 2 * 255, 0)], 2).astype(np.uint8)
    return heat, {"mse": round(mse, 2), "rmse": round(math.sqrt(mse), 2), "psnr": round(psnr, 2), "changed_ratio": round(float((d > 8).mean()), 4), "mse_true": round(float((d * d).mean()), 2)}


#: Colours of box outlines, by turns.
BOX_COLORS = [(255, 82, 82), (33, 150, 243), (255, 193, 7), (76, 175, 80), (156, 39, 176), (0, 188, 212), (255, 87, 34), (139, 195, 74)]


def draw_boxes(a: np.ndarray, boxes: list[dict]) -> np.ndarray:
    """Outlines as wide as a two-hundredth of the shorter side, two at least, inwards. Labels are data, not drawn."""
    out, wide = a.copy(), max(2, min(a.shape[:2]) // 200)
    for i, b in enumerate(boxes):
        for k in range(wide):
            out = mark(out, [(b["x"] + k, b["y"] + k, b["w"] - 2 * k, b["h"] - 2 * k)], BOX_COLORS[i % len(BOX_COLORS)]) if min(b["w"], b["h"]) >= 2 * k else out
    return out


def mark(a: np.ndarray, boxes: list, color=(255, 64, 64)) -> np.ndarray:
    """Box outlines drawn over a copy."""
    out = a.copy()
    h, w = a.shape[:2]
    for x, y, bw, bh in boxes:
        x0, x1, y0, y1 = max(0, x), min(w - 1, x + bw), max(0, y), min(h - 1, y + bh)
        if x0 <= x1 and y0 <= y1:
            out[[y0, y1], x0 : x1 + 1] = color
            out[y0 : y1 + 1, [x0, x1]] = color
    return out


# Styles


def transfer(a, mean, std):
    out = np.empty(a.shape)
    for k in range(3):
        m, s = a[..., k].mean(), a[..., k].std()
        out[..., k] = (a[..., k] - m) * std[k] / (1 if s < 1e-6 else s) + mean[k]
    return clip8(out)


def sepia(a, amount=1.0):
    g = luma(a).astype(float)
    return np.stack([clip8(g * k * amount) for k in (1.12, 0.95, 0.72)], 2)


def vignette(a, strength=0.5):
    """Darkest at the centre."""
    h, w = a.shape[:2]
    y, x = np.mgrid[0:h, 0:w] + 0.5
    r = np.hypot(x - w / 2, y - h / 2) / math.hypot(w / 2, h / 2)
    return clip8(a * (1 - strength * (1 - np.minimum(1, r)))[..., None])


def pencil(a, strength=1.0):
    v = gray3(255 - kernel(luma(a), FIND_EDGES))
    return contrast_factor(v, 0.5 + strength) if strength < 0.999 else v


def _over_emboss(a, f):
    return blend(a, kernel(a, EMBOSS, 128), f)


def _comic(a):
    lines = kernel(luma(a), FIND_EDGES) >= 60
    return contrast_factor(np.where(lines[..., None], saturation_factor(posterize(a, 5), 1.5), 0).astype(np.uint8), 1.15)


def _cyber(a):
    base = contrast_factor(saturation_factor(transfer(a, (60, 90, 160), (70, 70, 70)), 1.6), 1.3)
    e = resample(magnitude(luma(downscale(a, 600))), a.shape[1], a.shape[0])
    return blend(base, np.stack([e, e // 2, e], 2), 0.35)


#: Each style's means, deviations, factors and strengths.
STYLES = {
    "oil": ("thick warm strokes", lambda a: saturation_factor(_over_emboss(gaussian(transfer(a, (150, 120, 80), (60, 55, 45)), 1), 0.35), 1.25)),
    "watercolor": ("soft pale washes", lambda a: posterize(clip8(gaussian(transfer(a, (210, 215, 225), (45, 45, 50)), 1.6) * 1.08), 6)),
    "sketch": ("pencil lines", lambda a: pencil(gray3(luma(a)), 0.9)),
    "vintage": ("brown and faded", lambda a: vignette(sepia(saturation_factor(contrast_factor(a, 0.9), 0.7), 0.9), 0.45)),
    "comic": ("flat colours, dark lines", _comic),
    "cyber": ("blue and violet glow", _cyber),
    "crayon": ("grainy chalk", lambda a: _over_emboss(saturation_factor(posterize(a, 7), 1.3), 0.45)),
    "noir": ("hard black and white", lambda a: vignette(contrast_factor(gray3(luma(a)), 1.5), 0.6)),
    "autumn": ("warm orange and gold", lambda a: vignette(saturation_factor(transfer(a, (190, 150, 90), (60, 50, 40)), 1.2), 0.3)),
}


def style_transfer(a, style="oil", strength=100):
    """Unknown styles paint oil."""
    work = downscale(a, 900)
    out = STYLES.get(style, STYLES["oil"])[1](work)
    s = strength / 100
    if s < 0.999:
        out = blend(work, out, s)
    return resample(out, a.shape[1], a.shape[0], "lanczos")
