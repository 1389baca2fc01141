"""The node catalogue: types, parameter schemas, kernels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ..functions import kernels as k

CATEGORIES = ["filter", "color", "geometry", "vision"]


@dataclass(frozen=True)
class Param:
    name: str
    kind: str  # range, select, bool, number, color
    default: object
    options: tuple = ()
    low: float | None = None
    high: float | None = None
    step: float | None = None


def span(name, low, high, step, default):
    return Param(name, "range", default, low=low, high=high, step=step)


def select(name, *options):
    return Param(name, "select", options[0], options)


@dataclass(frozen=True)
class Node:
    type: str
    label: str
    category: str
    run: Callable  # (array, **params) -> (array, meta)
    schema: tuple[Param, ...] = ()
    min_inputs: int = 0
    max_inputs: int = 1
    defaults: dict = field(default_factory=dict)


def _image(kernel):
    return lambda a, **p: (kernel(a, **p), {})


def _keypoints(a, method, max_points):
    found = k.keypoints(a, method, int(max_points))
    points = [{key: v for key, v in p.items() if key != "descriptor"} for p in found]
    meta = {"method": method, "count": len(points), "descriptor_dim": 128 if method == "sift" else 256, "sample_descriptor": found[0]["descriptor"] if found else [], "keypoints": points}
    return k.draw_keypoints(a, points, method), meta


def _detect(a, method, auto, threshold, max_boxes):
    """The node takes its threshold whatever ``auto`` says; the analysis entry point honours it."""
    found, used = k.detect(a, method, threshold, max_boxes)
    return k.draw_boxes(a, found), {"method": method, "threshold_used": used, "count": len(found), "boxes": found}


def _segment(a, method, value, block, colors, alpha):
    image, regions = k.segment(a, method, value, block, colors, alpha)
    return image, {"method": method, "region_count": len(regions), "coverage": round(sum(r["area"] for r in regions) / (a.shape[0] * a.shape[1]), 4), "regions": regions}


def _style(a, style, strength):
    return k.style_transfer(a, style, strength), {"style": style}


def _node(type_, label, category, run, *schema):
    return Node(type_, label, category, run, schema, defaults={p.name: p.default for p in schema})


#: Types, categories, and the names, ranges, options and defaults of parameters are the graphs' contract.
NODES: dict[str, Node] = {
    n.type: n
    for n in (
        _node("brightness", "Brightness", "filter", _image(k.brightness), span("amount", -100, 100, 1, 0)),
        _node("contrast", "Contrast", "filter", _image(k.contrast), span("amount", -100, 100, 1, 0)),
        _node("saturation", "Saturation", "filter", _image(k.saturation), span("amount", -100, 100, 1, 0)),
        _node("blur", "Blur", "filter", _image(k.blur), select("mode", "gaussian", "box", "median"), span("radius", 0, 20, 0.5, 2)),
        _node("sharpen", "Sharpen", "filter", _image(k.sharpen), span("amount", 0, 100, 1, 30)),
        _node("noise", "Noise", "filter", _image(k.noise), select("mode", "gaussian", "saltpepper"), span("amount", 0, 100, 1, 10)),
        _node("edges", "Edges", "filter", _image(k.edges), select("method", "sobel", "prewitt", "laplacian", "find"), span("strength", 0, 100, 1, 50)),
        _node("emboss", "Emboss", "filter", _image(k.emboss), span("strength", 0, 100, 1, 40)),
        _node("grayscale", "Grayscale", "color", _image(k.grayscale), select("mode", "luma", "average", "channel"), select("channel", "r", "g", "b")),
        _node("invert", "Invert", "color", _image(k.invert)),
        _node("threshold", "Threshold", "color", _image(k.threshold), select("mode", "binary", "adaptive"), span("value", 0, 255, 1, 127), span("block", 3, 31, 2, 15)),
        _node("histogram_equalize", "Equalize", "color", _image(k.equalize), select("mode", "luminance", "per_channel")),
        _node("color_balance", "Color balance", "color", _image(k.color_balance), span("r", -100, 100, 1, 0), span("g", -100, 100, 1, 0), span("b", -100, 100, 1, 0)),
        _node("posterize", "Posterize", "color", _image(k.posterize), span("levels", 2, 8, 1, 4)),
        _node("false_color", "False color", "color", _image(k.false_color), select("palette", "thermal", "rainbow", "ocean", "fire")),
        _node("solarize", "Solarize", "color", _image(k.solarize), span("threshold", 0, 255, 1, 128)),
        _node("resize", "Resize", "geometry", _image(k.resize), select("mode", "scale", "width", "height"), span("scale", 0.1, 3.0, 0.05, 1.0), Param("width", "number", 800), Param("height", "number", 600)),
        _node("rotate", "Rotate", "geometry", _image(k.rotate), span("angle", -180, 180, 1, 0), Param("expand", "bool", True)),
        _node("crop", "Crop", "geometry", _image(k.crop), span("left", 0, 1, 0.01, 0), span("top", 0, 1, 0.01, 0), span("right", 0, 1, 0.01, 1), span("bottom", 0, 1, 0.01, 1)),
        _node("flip", "Flip", "geometry", _image(k.flip), select("mode", "horizontal", "vertical")),
        _node("border", "Border", "geometry", _image(k.border), span("width", 0, 100, 1, 10), Param("color", "color", "#000000")),
        _node("keypoints", "Keypoints", "vision", _keypoints, select("method", "sift", "orb"), span("max_points", 20, 500, 10, 120)),
        _node("detect", "Detect", "vision", _detect, select("method", "saliency", "color", "edge"), Param("auto", "bool", True), span("threshold", 0, 255, 1, 128), span("max_boxes", 1, 60, 1, 20)),
        _node("segment", "Segment", "vision", _segment, select("method", "threshold", "region", "color"), span("value", 0, 255, 1, 127), span("block", 3, 31, 2, 15), span("colors", 2, 12, 1, 6), span("alpha", 0, 1, 0.05, 0.45)),
        _node("style_transfer", "Style", "vision", _style, select("style", *k.STYLES), span("strength", 0, 100, 1, 100)),
    )
}


def with_defaults(type_: str, params: dict | None) -> dict:
    return NODES[type_].defaults | (params or {}) if type_ in NODES else dict(params or {})


def run_node(type_: str, a: np.ndarray, params: dict | None = None) -> tuple[np.ndarray, dict]:
    """Parameters that the node doesn't declare are ignored."""
    node, full = NODES[type_], with_defaults(type_, params)
    return node.run(a, **{p.name: full[p.name] for p in node.schema})
