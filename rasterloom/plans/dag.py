"""User-built operator graphs: validation, order, fingerprint, rewriting, execution.

A graph is a list of ``{id, type, params, inputs}``. It is planned on the driver; execution over
packed images is one ``mapInPandas`` pass without a shuffle, however many nodes there are, or, for
nodes with a relational form, a fold of DataFrame transforms that Catalyst fuses.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import geometry, points, stencils
from .nodes import CATEGORIES, NODES, run_node, with_defaults


def validate(nodes: list[dict]) -> list[str]:
    """Errors in the order of nodes, then dangling inputs; a cycle is only looked for where nothing else is wrong."""
    errors, seen = [], set()
    for n in nodes:
        id_ = n.get("id")
        if not id_:
            errors.append("node without id")
            continue
        if id_ in seen:
            errors.append(f"duplicate id {id_}")
        seen.add(id_)
        spec = NODES.get(n.get("type"))
        if spec is None:
            errors.append(f"{id_}: unknown type {n.get('type')}")
        elif not spec.min_inputs <= len(n.get("inputs") or []) <= spec.max_inputs:
            errors.append(f"{id_}: takes {spec.min_inputs} to {spec.max_inputs} inputs")
    errors += [f"{n.get('id')}: no node {i}" for n in nodes for i in n.get("inputs") or [] if i not in seen]
    if not errors and len(order(nodes)) < len(nodes):
        errors.append("cycle")
    return errors


def order(nodes: list[dict]) -> list[str]:
    """Topological order, first come first served; nodes on a cycle are left out."""
    open_ = {n["id"]: len(n.get("inputs") or []) for n in nodes}
    users: dict[str, list[str]] = {}
    for n in nodes:
        for i in n.get("inputs") or []:
            users.setdefault(i, []).append(n["id"])
    ready, out = deque(i for i, n in open_.items() if not n), []
    while ready:
        out.append(i := ready.popleft())
        for u in users.get(i, []):
            open_[u] -= 1
            if not open_[u]:
                ready.append(u)
    return out


def levels(nodes: list[dict]) -> dict[str, int]:
    """Longest distance from a source."""
    by = {n["id"]: n for n in nodes}
    out: dict[str, int] = {}
    for i in order(nodes):
        out[i] = 1 + max((out[j] for j in by[i].get("inputs") or []), default=-1)
    return out


def output_node(nodes: list[dict]) -> str | None:
    """The last node, in topological order, that no other consumes."""
    used = {i for n in nodes for i in n.get("inputs") or []}
    return next((i for i in reversed(order(nodes)) if i not in used), None)


def canonical_key(nodes: list[dict]) -> str:
    """Type, full parameters and the places of the inputs, in topological order: equal for graphs that differ in ids and layout only."""
    by, ids = {n["id"]: n for n in nodes}, order(nodes)
    place = {i: k for k, i in enumerate(ids)}
    form = [{"type": by[i]["type"], "params": with_defaults(by[i]["type"], by[i].get("params")), "inputs": [place[j] for j in by[i].get("inputs") or []]} for i in ids]
    return json.dumps(form, sort_keys=True, separators=(",", ":"))


def cache_key(*parts: str) -> str:
    """SHA-256 over the parts, each ended by a zero byte."""
    return hashlib.sha256(b"".join(p.encode() + b"\0" for p in parts)).hexdigest()


def catalogue() -> list[dict]:
    rank = {c: i for i, c in enumerate(CATEGORIES)}
    return [
        {"type": n.type, "label": n.label, "category": n.category, "min_inputs": n.min_inputs, "max_inputs": n.max_inputs, "defaults": json.dumps(n.defaults, sort_keys=True)}
        for n in sorted(NODES.values(), key=lambda n: (rank[n.category], n.type))
    ]


def checked(pipelines: DataFrame) -> DataFrame:
    """``pipelines(id, name, nodes)``, nodes as JSON, with version 1, their errors and whether they are valid; invalid ones stay."""

    @F.pandas_udf("string")
    def errors(nodes: pd.Series) -> pd.Series:
        return nodes.map(lambda x: "; ".join(validate(json.loads(x) if x else [])))

    return pipelines.withColumns({"errors": errors("nodes"), "version": F.lit(1)}).withColumn("valid", F.col("errors") == "")


#: Nodes that undo themselves when they follow each other with the same parameters.
INVOLUTIONS = {"invert", "flip"}


def simplify(nodes: list[dict]) -> list[dict]:
    """The branch that leads to the output, without pairs of nodes that cancel. Results stay the same; node results of what is left out are not made."""
    by = {n["id"]: n for n in nodes}
    chain, i = [], output_node(nodes)
    while i is not None:
        chain.append(by[i])
        i = (by[i].get("inputs") or [None])[0]
    kept: list[dict] = []
    for n in reversed(chain):
        same = kept and n["type"] in INVOLUTIONS and kept[-1]["type"] == n["type"] and with_defaults(n["type"], n.get("params")) == with_defaults(n["type"], kept[-1].get("params"))
        kept.pop() if same else kept.append(n)
    return [{**n, "inputs": [kept[k - 1]["id"]] if k else []} for k, n in enumerate(kept)]


def run_graph(a: np.ndarray, nodes: list[dict]) -> tuple[np.ndarray, dict, list[dict]]:
    """(image, meta, node results) of a valid graph. A node that fails is reported and passes its input on; later keys of meta win."""
    by, packets, results = {n["id"]: n for n in nodes}, {}, []
    for i in order(nodes):
        n = by[i]
        image, meta = packets[n["inputs"][0]] if n.get("inputs") else (a, {})
        try:
            out, more = run_node(n["type"], image, n.get("params"))
            packets[i] = (out, {**meta, **more})
            results.append({"node_id": i, "type": n["type"], "ok": True, "error": None})
        except Exception as e:  # noqa: BLE001 - an error is data here
            packets[i] = (image, meta)
            results.append({"node_id": i, "type": n["type"], "ok": False, "error": f"{type(e).__name__}: {e}"})
    image, meta = packets[output_node(nodes)] if nodes else (a, {})
    return image, meta, results


RESULT = "image_id long, w int, h int, data binary, meta string, node_results array<struct<node_id: string, type: string, ok: boolean, error: string>>, error string"


def execute(packed: DataFrame, nodes: list[dict]) -> DataFrame:
    """Run a graph over packed images, images in parallel. An invalid graph yields its errors and no data."""
    errors = validate(nodes)

    def run(batches):
        for pdf in batches:
            rows = []
            for i, w, h, data in zip(pdf["image_id"], pdf["w"], pdf["h"], pdf["data"]):
                if errors:
                    rows.append((i, None, None, None, None, None, "; ".join(errors)))
                    continue
                out, meta, results = run_graph(np.frombuffer(data, np.uint8).reshape(h, w, 3), nodes)
                rows.append((i, out.shape[1], out.shape[0], np.ascontiguousarray(out, np.uint8).tobytes(), json.dumps(meta, default=float), results, None))
            out = pd.DataFrame(rows, columns=["image_id", "w", "h", "data", "meta", "node_results", "error"])
            yield out.astype({"w": "Int32", "h": "Int32"})

    return packed.mapInPandas(run, RESULT)


#: Nodes with an exact relational form.
RELATIONAL = {
    "brightness": points.brightness, "contrast": points.contrast, "saturation": points.saturation, "grayscale": points.grayscale, "invert": points.invert,
    "threshold": points.threshold, "histogram_equalize": points.equalize, "color_balance": points.color_balance, "posterize": points.posterize,
    "false_color": points.false_color, "solarize": points.solarize, "edges": stencils.edges, "emboss": stencils.emboss, "crop": geometry.crop, "flip": geometry.flip, "border": geometry.border,
}


def compile_pixels(px: DataFrame, nodes: list[dict]) -> DataFrame:
    """The output of a valid graph of relational nodes as one lazy plan; branches that don't feed the output cost nothing."""
    if errors := validate(nodes):
        raise ValueError("; ".join(errors))
    for n in simplify(nodes):
        if n["type"] not in RELATIONAL and not (n["type"] == "blur" and (n.get("params") or {}).get("mode") == "box"):
            raise ValueError(f"{n['type']} has no relational form")
        params = with_defaults(n["type"], n.get("params"))
        px = stencils.box_blur(px, int(params["radius"])) if n["type"] == "blur" else RELATIONAL[n["type"]](px, **params)
    return px
