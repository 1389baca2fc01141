"""The raster engine: queries against DuckDB, relational forms against kernels, algebra, graphs, tables, sources."""

import json
import math

import duckdb
import numpy as np
import pytest

from rasterloom.functions import kernels as k
from rasterloom.plans import dag
from rasterloom.plans.nodes import NODES, run_node

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def normal(pdf):
    cols = sorted(pdf.columns)
    if len(pdf) > 100_000:  # pixels: numbers only
        return pdf[cols].astype("float64").sort_values(cols).reset_index(drop=True)
    return pdf[cols].map(lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v).astype(str).sort_values(cols).reset_index(drop=True)


CHECKED = ["brightness_up", "contrast", "equalize", "false_color_thermal", "noise_saltpepper", "crop", "border", "edges_sobel", "emboss", "blur_box", "keypoints", "threshold_coverage", "connected_components", "region_stats", "color_names", "box_nms", "diff_metrics", "match_one_to_one", "match_hamming", "ingest_dedupe", "catalog_reconcile", "catalog_annotations", "history_newest", "pipeline_versions", "cache_evict", "cache_key", "job_states", "human_bytes", "graph_points", "graph_chain", "graph_key", "node_catalogue", "styles", "detect", "style_channel_transfer", "match_distances", "match_ratio", "cache_get_entry", "cache_list_results", "cache_touch", "cache_delete_result", "cache_operation_key", "images_list", "orphan_files_clean", "history_get", "history_delete", "history_restore", "history_record", "presets_create", "presets_update", "presets_delete", "pipelines_create", "pipelines_list", "pipelines_get", "jobs_enqueue"]


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, name):
    from rasterloom.queries import QUERIES, SQL

    ours, theirs = normal(QUERIES[name](spark, SMALL).toPandas()), normal(duck.execute(SQL[name]).df())
    assert len(ours) and ours.equals(theirs)


def images(n=3, h=12, w=16):
    rng = np.random.default_rng(1)
    return [rng.integers(0, 256, (h, w, 3)).astype(np.uint8) for _ in range(n)]


@pytest.mark.parametrize("node", [{"type": t, "params": p} for t, p in [("brightness", {"amount": 30}), ("contrast", {"amount": -20}), ("saturation", {"amount": 40}), ("edges", {"method": "prewitt", "strength": 70}), ("emboss", {}), ("grayscale", {"mode": "average"}), ("invert", {}), ("threshold", {"value": 90}), ("histogram_equalize", {}), ("color_balance", {"r": 20, "b": -30}), ("posterize", {"levels": 3}), ("false_color", {"palette": "ocean"}), ("solarize", {"threshold": 77}), ("crop", {"left": 0.13, "right": 0.8, "top": 0.5}), ("flip", {"mode": "vertical"}), ("border", {"width": 3, "color": "#abc"}), ("blur", {"mode": "box", "radius": 3})]], ids=lambda n: n["type"])
def test_relational_form_is_the_kernel(spark, node):
    import pandas as pd

    from rasterloom.sources.rasters import image_array, pixel_frame

    some = images()
    px = spark.createDataFrame(pd.concat([pixel_frame(i, a) for i, a in enumerate(some)]), "image_id long, y int, x int, r int, g int, b int")
    got = dag.compile_pixels(px, [{"id": "n", **node, "inputs": []}]).toPandas()
    for i, a in enumerate(some):
        want = run_node(node["type"], a, node["params"])[0]
        assert (image_array(got[got["image_id"] == i]) == want).all()


@pytest.mark.parametrize("type_", list(NODES))
def test_every_node_runs_on_any_image(type_):
    for a in [*images(1), *images(1, 40, 50), np.zeros((1, 1, 3), np.uint8), np.full((9, 2, 3), 200, np.uint8)]:
        out, meta = run_node(type_, a, {"unknown": 1})
        assert out.dtype == np.uint8 and out.ndim == 3 and out.shape[2] == 3 and isinstance(json.dumps(meta, default=float), str)


def test_algebra():
    a = images(1)[0]
    assert (k.invert(k.invert(a)) == a).all() and (k.flip(k.flip(a)) == a).all() and (k.rotate(k.rotate(a, 90), -90) == a).all()
    assert k.crop(k.border(a, 4), 4 / 24, 4 / 20, 20 / 24, 16 / 20).tobytes() == a.tobytes()
    assert (k.gaussian(np.full_like(a, 90), 3) == 90).all() and (k.resample(np.full_like(a, 7), 31, 5, "lanczos") == 7).all()
    assert k.grayscale(a, "average").max() <= 85 and (k.threshold(a, "adaptive") == 255).all()
    assert (k.saliency(np.full_like(a, 33)) == 0).all() and k.otsu(np.full((4, 4), 9, np.uint8)) == 127
    on = np.array([[1, 0, 1], [1, 0, 1], [0, 0, 1]], bool)
    assert k.label_components(on).tolist() == [[1, 0, 2], [1, 0, 2], [0, 0, 2]]
    assert k.label_components(np.ones((3, 4), bool)).tolist() == [[1] * 4] * 3 and not k.label_components(np.zeros((2, 2), bool)).any()
    kept = k.suppress([(0.9, (0, 0, 10, 10)), (0.8, (1, 1, 10, 10)), (0.7, (20, 20, 5, 5))])
    assert [s for s, _ in kept] == [0.9, 0.7]
    labels = k.segment_labels(a, "color", colors=4)
    assert labels.max() >= 1 and len(k.segment(a, "region")[1]) == 1


def test_labels_by_flood_fill():
    rng = np.random.default_rng(5)
    for _ in range(20):
        on = rng.random((13, 17)) < 0.55
        want, n = np.zeros(on.shape, int), 0
        for y, x in zip(*np.nonzero(on)):
            if want[y, x]:
                continue
            n += 1
            stack = [(y, x)]
            while stack:
                p, q = stack.pop()
                if 0 <= p < 13 and 0 <= q < 17 and on[p, q] and not want[p, q]:
                    want[p, q] = n
                    stack += [(p + 1, q), (p - 1, q), (p, q + 1), (p, q - 1)]
        assert (k.label_components(on) == want).all()


def test_graph_planning():
    n = lambda i, t="invert", inputs=(), **p: {"id": i, "type": t, "params": p, "inputs": list(inputs)}
    assert dag.validate([n("a"), n("b", inputs=["a"])]) == []
    assert dag.validate([n("a", inputs=["b"]), n("b", inputs=["a"])]) == ["cycle"]
    assert dag.validate([n("a"), n("a"), n("b", "nothing"), n("c", inputs=["a", "b"]), n("d", inputs=["zz"]), {"type": "invert"}]) == ["duplicate id a", "b: unknown type nothing", "c: takes 0 to 1 inputs", "node without id", "d: no node zz"]
    chain, star = [n("a"), n("b", inputs=["a"]), n("c", inputs=["b"])], [n("a"), n("b", inputs=["a"]), n("c", inputs=["a"])]
    assert dag.canonical_key(chain) != dag.canonical_key(star)
    assert dag.order(star) == ["a", "b", "c"] and dag.output_node(star) == "c" and dag.output_node([]) is None
    assert [x["id"] for x in dag.simplify([n("a"), n("b", inputs=["a"]), n("c", "flip", ["b"])])] == ["c"]
    a = images(1)[0]
    out, meta, results = dag.run_graph(a, [n("a", "brightness", amount="bad"), n("b", inputs=["a"]), n("c", "keypoints", ["b"])])
    assert [r["ok"] for r in results] == [False, True, True] and meta["method"] == "sift"
    assert dag.run_graph(a, [])[0] is a


def test_batch_cache(spark, tmp_path):
    from pyspark.sql import functions as F

    from rasterloom.plans.store import CACHE, Collection, run_batch

    a, b = images(2)
    rows = [(1, 16, 12, bytearray(a.tobytes())), (2, 16, 12, bytearray(b.tobytes())), (3, 16, 12, bytearray(a.tobytes()))]
    table = spark.createDataFrame(rows, "image_id long, w int, h int, data binary").withColumn("id", F.sha2("data", 256))
    cache, nodes = Collection(spark, str(tmp_path / "cache"), CACHE), [{"id": "n", "type": "invert", "inputs": []}]
    first = {r["image_id"]: r for r in run_batch(spark, table, nodes, cache).collect()}
    again = {r["image_id"]: r for r in run_batch(spark, table, nodes, cache).collect()}
    assert not any(r["cache_hit"] for r in first.values()) and all(r["cache_hit"] for r in again.values())
    assert first[1]["result_id"] == first[3]["result_id"] != first[2]["result_id"] and {i: r["result_id"] for i, r in first.items()} == {i: r["result_id"] for i, r in again.items()}
    stored = cache.read().where(F.col("result_id") == first[1]["result_id"]).first()
    assert bytes(stored["data"]) == (255 - a).tobytes()
    assert {r["error"] for r in run_batch(spark, table, [{"id": "n", "type": "x"}], cache).collect()} == {"n: unknown type x"}


def test_collections_fall_back_and_lose_no_update(spark, tmp_path):
    import shutil

    from rasterloom.plans.store import Collection, Conflict, write_bytes

    c = Collection(spark, str(tmp_path / "c"), "id long, n long")
    row = lambda *v: spark.createDataFrame([v], "id long, n long")
    assert c.read().count() == 0
    first = c.write(row(1, 1))
    c.update(lambda old: old.union(row(2, 2)))
    with pytest.raises(Conflict):
        c.write(row(9, 9), after=first)  # another writer has been there
    tries = []

    def change(old):
        if not tries:  # someone else commits between our read and our write
            tries.append(c.update(lambda o: o.union(row(3, 3))))
        return old.union(row(4, 4))

    c.update(change)
    assert sorted(r["id"] for r in c.read().collect()) == [1, 2, 3, 4] and len(c.versions()) == 2
    newest = tmp_path / "c" / c._snapshot(c.versions()[-1])
    for f in newest.glob("*.parquet"):
        f.write_bytes(b"broken")
    assert sorted(r["id"] for r in c.read().collect()) == [1, 2, 3]
    shutil.rmtree(newest)
    assert c.read().count() == 3
    write_bytes(spark, str(tmp_path / "x.bin"), b"one")
    write_bytes(spark, str(tmp_path / "x.bin"), b"two")
    assert (tmp_path / "x.bin").read_bytes() == b"two" and [f.name for f in tmp_path.iterdir() if f.name.startswith(".tmp")] == []


def test_jobs(spark, tmp_path):
    from pyspark.sql import functions as F

    from rasterloom.plans import store

    some = images(3)
    table = spark.createDataFrame([(i, 16, 12, bytearray(a.tobytes())) for i, a in enumerate(some)], "image_id long, w int, h int, data binary").withColumn("id", F.sha2("data", 256))
    jobs, cache = store.Collection(spark, str(tmp_path / "jobs"), store.JOBS), store.Collection(spark, str(tmp_path / "cache"), store.CACHE)
    nodes = [{"id": "n", "type": "invert", "inputs": []}]
    one = store.enqueue_job(spark, jobs, nodes, [0, 1, 1, 2, 7])
    two = store.enqueue_job(spark, jobs, nodes, [0, 1])
    assert store.get_job(jobs, one)["status"] == "queued" and store.get_job(jobs, one)["total"] == 4
    assert store.cancel_job(spark, jobs, two)["status"] == "cancelled"
    assert store.run_job(spark, jobs, table, cache, two)["status"] == "cancelled" and store.run_job(spark, jobs, table, cache, "none") is None
    done = store.run_job(spark, jobs, table, cache, one, part=2)
    assert done["status"] == "partial" and done["done"] == 4 and done["results"][7]["error"] == "no such image" and done["results"][0]["status"] == "ok"
    out = {r["image_id"]: r for r in store.run_operation(spark, table, "detect", {"method": "color"}, cache).collect()}
    again = {r["image_id"]: r for r in store.run_operation(spark, table, "detect", {"method": "color"}, cache).collect()}
    assert not out[0]["cache_hit"] and again[0]["cache_hit"] and json.loads(again[0]["meta"])["boxes"] == k.detect(some[0], "color", 128)[0]
    assert not any(r["cache_hit"] for r in store.run_operation(spark, table, "detect", {"method": "edge"}, cache).collect())


def test_kernels_by_loops():
    a = images(1, 20, 23)[0]
    g = k.luma(a).astype(int)
    corners = k.fast_corners(k.luma(a), 20, 5)
    for y in range(20):
        for x in range(23):
            want = False
            if 3 <= x < 20 and 3 <= y < 17:
                for sign in (1, -1):
                    run = 0
                    for dx, dy in k.RING:
                        run = run + 1 if sign * (g[y + dy, x + dx] - g[y, x]) > 20 else 0
                        want |= run >= 5
            assert corners[y, x] == want
    labels = k.label_components(k.luma(a) >= 127)
    m = k.measured(labels, k.luma(a))
    for n in range(1, labels.max() + 1):
        y, x = np.nonzero(labels == n)
        assert [m[c][n - 1] for c in ("area", "x0", "y0", "x1", "y1", "sum")] == [len(x), x.min(), y.min(), x.max(), y.max(), g[y, x].sum()]
    weigh = lambda n: [1 - abs(i + 0.5 - n / 2) / n for i in range(n)]
    for h, w in ((1, 1), (2, 5), (20, 23)):
        box, wx, wy = a[:h, :w].astype(float), weigh(w), weigh(h)
        rows = [[math.floor(sum(wx[i] * box[j, i, c] for i in range(w)) / sum(wx) + 0.5 + 1e-9) for c in range(3)] for j in range(h)]
        assert k.box_color(a[:h, :w]) == [math.floor(sum(wy[j] * rows[j][c] for j in range(h)) / sum(wy) + 0.5 + 1e-9) for c in range(3)]
    found, used = k.detect(a, "color")
    s = k.saliency(a, "color").astype(int)
    labels, candidates = k.label_components(s >= used), []
    assert used == k.otsu(k.saliency(a, "color"))
    for n in range(1, labels.max() + 1):
        y, x = np.nonzero(labels == n)
        if (x.max() - x.min()) * (y.max() - y.min()) >= s.size * 0.0001:
            candidates.append((s[y, x].mean(), (int(x.min()), int(y.min()), int(x.max() - x.min()), int(y.max() - y.min()))))
    kept = k.suppress(candidates)[:20]
    assert [(b["x"], b["y"], b["w"], b["h"], b["score"]) for b in found] == [(*b, round(v / kept[0][0], 3)) for v, b in kept] and len(found) > 0
    assert all(b["label"] == k.color_name(b["mean_color"]) for b in found)
    _, regions = k.segment(a, "threshold", 127)
    labels = k.label_components(k.luma(a) >= 127)
    assert [r["area"] for r in regions] == sorted((int((labels == n).sum()) for n in range(1, labels.max() + 1)), reverse=True)
    for r in regions:
        y, x = np.nonzero(labels == r["id"])
        assert r["box"] == [x.min(), y.min(), x.max() - x.min(), y.max() - y.min()]


def test_median_and_resampling_by_loops():
    a = images(1, 9, 11)[0]
    got = k.blur(a, "median", 2)
    for y in range(9):
        for x in range(11):
            near = [[a[min(8, max(0, y + j)), min(10, max(0, x + i))] for i in (-1, 0, 1)] for j in (-1, 0, 1)]
            assert (got[y, x] == np.median(np.array(near).reshape(9, 3), 0)).all()

    def one(v, to, f, support):  # along a line of values
        n, out = len(v), []
        scale = n / to
        wide = max(scale, 1.0)
        for i in range(to):
            c = (i + 0.5) * scale
            at = range(max(0, int(c - support * wide + 0.5)), min(n, int(c + support * wide + 0.5)))
            w = [f((j - c + 0.5) / wide) for j in at]
            out.append(min(255, max(0, math.floor(sum(q * v[j] for q, j in zip(w, at)) / sum(w) + 0.5 + 1e-9))))
        return out

    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    for name, f, support in (("bilinear", lambda x: max(0.0, 1 - abs(x)), 1), ("lanczos", lambda x: sinc(x) * sinc(x / 3) if abs(x) < 3 else 0.0, 3)):
        for w, h in ((5, 4), (17, 13), (11, 4)):
            got = k.resample(a, w, h, name)
            for c in range(3):
                rows = [one([int(v) for v in a[y, :, c]], w, f, support) if w != 11 else a[y, :, c].tolist() for y in range(9)]
                want = np.array([one([rows[y][x] for y in range(9)], h, f, support) for x in range(w)]).T
                assert np.abs(got[..., c].astype(int) - want).max() <= 1 and (got[..., c] == want).mean() > 0.99


def test_matching_two_images_and_working_sizes(spark):
    from rasterloom.sources.rasters import fit, gradient_array, load_working, thumbnails

    a = gradient_array(3, 200, 150)
    m = k.match(a, a[:, 8:])
    assert m["count"] == len(m["matches"]) > 0 and m["image"].shape == (150, 392, 3) and m["count_a"] <= 120
    assert len({(x["b"]["x"], x["b"]["y"]) for x in m["matches"]}) == m["count"] and [x["distance"] for x in m["matches"]] == sorted(x["distance"] for x in m["matches"])
    heat, metrics = k.difference_heat(gradient_array(1), gradient_array(1, 32, 24))
    assert heat.shape == (24, 32, 3) and metrics["mse"] > 0 and k.difference_heat(a, a)[1] == {"mse": 0.0, "rmse": 0.0, "psnr": 100.0, "changed_ratio": 0.0, "mse_true": 0.0}
    big = gradient_array(2, 1700, 1100)
    assert k.downscale(big, 1600).shape == (1035, 1600, 3) and fit(big, 220).shape == (142, 220, 3) and fit(a, 220) is a
    packed = spark.createDataFrame([(1, 1700, 1100, bytearray(big.tobytes()), 6)], "image_id long, w int, h int, data binary, orientation int")
    small = load_working(packed.drop("orientation")).first()
    assert (small["w"], small["h"]) == (1600, 1035) and bytes(small["data"]) == k.downscale(big, 1600).tobytes()
    turned = thumbnails(packed).first()
    assert (turned["w"], turned["h"]) == (142, 220)
    for t in ("edges", "detect", "segment", "keypoints", "style_transfer"):
        assert run_node(t, big)[0].shape == big.shape


def test_formats_and_orientation(spark, tmp_path):
    from rasterloom.sources.rasters import orientation, png, read_files, upright

    exif = b"Exif\0\0" + b"MM\0*\0\0\0\x08" + b"\0\x01" + b"\x01\x12\0\x03\0\0\0\x01\0\x06\0\0" + b"\0\0\0\0"
    jpeg = b"\xff\xd8\xff\xe1" + (len(exif) + 2).to_bytes(2, "big") + exif + b"\xff\xda"
    assert orientation(jpeg) == 6 and orientation(b"\xff\xd8\xff\xda") == 1 and orientation(b"") == 1 and orientation(jpeg[:20]) == 1
    a = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    b, c, d, e = a[0, 0], a[0, 1], a[1, 0], a[1, 1]
    seen = {1: [[b, c], [d, e]], 2: [[c, b], [e, d]], 3: [[e, d], [c, b]], 4: [[d, e], [b, c]], 5: [[b, d], [c, e]], 6: [[d, b], [e, c]], 7: [[e, c], [d, b]], 8: [[c, e], [b, d]]}
    for tag, want in seen.items():
        assert (upright(a, tag) == np.array(want)).all(), tag
    files = {"a.png": (png(a), "PNG", 1), "b.jpg": (jpeg, "JPEG", 6), "c.gif": (b"GIF89a", "GIF", 1), "d.webp": (b"RIFF\0\0\0\0WEBP", "WEBP", 1), "e.wav": (b"RIFF\0\0\0\0WAVE", None, 1), "f.txt": (b"text", None, 1)}
    for name, (content, _, _) in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: (bytes(r["content"]), r["format"], r["orientation"]) for r in read_files(spark, str(tmp_path)).collect()}
    assert got == files


def test_png_round_trip_and_sources(spark, tmp_path):
    from rasterloom.sources.rasters import over_white, pack, png, read_images, unpack, with_png
    from rasterloom.streaming.ingest import ingest

    a, b = images(2)
    folder = tmp_path / "in"
    folder.mkdir()
    for name, content in (("a.png", png(a)), ("b.PNG", png(b)), ("same.png", png(a)), ("bad.png", b"no image")):
        (folder / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: r for r in read_images(spark, str(folder)).collect()}
    assert bytes(got["a.png"]["data"]) == a.tobytes() and got["b.PNG"]["w"] == 16 and not got["bad.png"]["valid"]
    packed = spark.createDataFrame([(7, 16, 12, bytearray(a.tobytes()))], "image_id long, w int, h int, data binary")
    assert bytes(pack(unpack(packed)).first()["data"]) == a.tobytes() and bytes(with_png(packed).first()["png"]) == png(a)
    assert over_white(np.array([10, 255]), np.array([0, 128])).tolist() == [255, 255]
    ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_cache_limits_and_matching(spark):
    from pyspark.sql import functions as F

    from rasterloom.operators.catalog import evict
    from rasterloom.operators.matching import nearest_with_ratio, one_to_one

    cache = spark.createDataFrame([(f"k{i}", f"r{i}", i % 7 * 10, float(i)) for i in range(50)], "key string, result_id string, size_bytes long, last_access double")
    kept = evict(cache, 20, 400).collect()
    assert len(kept) <= 20 and sum(r["size_bytes"] for r in kept) <= 400 and {r["key"] for r in kept} == {f"k{i}" for i in range(50 - len(kept), 50)}
    a = spark.createDataFrame([(0, 1, [0.0, 0.0]), (0, 2, [0.0, 0.1]), (0, 3, [9.0, 9.0])], "pair_id long, a_id long, d array<double>")
    b = spark.createDataFrame([(0, 5, [0.0, 0.05]), (0, 6, [5.0, 5.0])], "pair_id long, b_id long, d array<double>")
    matches = one_to_one(nearest_with_ratio(a, b, 0.75))
    assert [(r["a_id"], r["b_id"]) for r in matches.orderBy("rank").collect()] == [(1, 5), (3, 6)]
    assert nearest_with_ratio(a, b.where("b_id = 5")).count() == 3
    assert matches.select(F.max("rank")).first()[0] == 2


@pytest.mark.parametrize("method", ["sift", "orb"])
def test_descriptors_of_all_maxima(spark, method):
    from pyspark.sql import functions as F

    from rasterloom.queries import QUERIES

    got = QUERIES[f"descriptors_{method}"](spark, SMALL).groupBy("image_id").count()
    most = QUERIES["local_maxima"](spark, SMALL).groupBy("image_id").agg(F.least(F.count("*"), F.lit(120)).alias("count"))
    assert got.where("count > 5").count() and normal(got.toPandas()).equals(normal(most.toPandas()))


def test_without_the_training_subpackage():  # with it, a dependency that is missing is an error
    import __spark_entry__ as entry

    from rasterloom.queries import QUERIES, SQL

    assert set(SQL) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def joins(df):
    """The joins of a plan that broadcast or sort pixels."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in ("BroadcastExchange", "SortMergeJoin") if x in plan]


@pytest.mark.parametrize("scale", [0.07, 0.3, 0.5, 1, 1.7, 3])
def test_resize_nearest_takes_the_pixel_under_the_centre(spark, scale):
    import pandas as pd

    from rasterloom.operators.geometry import resize_nearest
    from rasterloom.sources.rasters import image_array, pixel_frame

    some = [*images(1), *images(1, 7, 31), *images(1, 1, 1)]
    px = spark.createDataFrame(pd.concat([pixel_frame(i, a) for i, a in enumerate(some)]), "image_id long, y int, x int, r int, g int, b int")
    resized = resize_nearest(px, scale)
    assert not joins(resized)  # before: pixels were joined by place
    got = resized.toPandas()
    for i, a in enumerate(some):
        h, w = (max(1, round(n * scale)) for n in a.shape[:2])
        y, x = (np.floor((np.arange(n) + 0.5) * o / n).astype(int) for n, o in ((h, a.shape[0]), (w, a.shape[1])))
        mine = got[got["image_id"] == i]
        assert len(mine) == h * w and (image_array(mine) == a[y][:, x]).all()


def test_pixels_of_a_small_file_are_many_tasks(spark):
    from rasterloom.sources.rasters import gradient_images, spread

    assert gradient_images(spark, SMALL).rdd.getNumPartitions() == 4
    assert spread(spark.range(1000).withColumnRenamed("id", "image_id")).rdd.getNumPartitions() == 8


def test_channel_transfer_joins_no_pixels(spark):
    from rasterloom.queries import QUERIES

    assert not joins(QUERIES["style_channel_transfer"](spark, SMALL))


def test_equalize_joins_no_pixels_and_has_whole_tables(spark):
    import pandas as pd

    from rasterloom.operators.points import equalize
    from rasterloom.queries import QUERIES
    from rasterloom.sources.rasters import image_array, pixel_frame

    assert not joins(QUERIES["equalize"](spark, SMALL))
    some = [*images(2, 40, 50), np.full((9, 2, 3), 200, np.uint8), np.zeros((1, 1, 3), np.uint8), np.where(images(1, 60, 60)[0] < 128, 0, 255).astype(np.uint8), images(1, 60, 60)[0] // 4 + 90]
    px = spark.createDataFrame(pd.concat([pixel_frame(i, a) for i, a in enumerate(some)]), "image_id long, y int, x int, r int, g int, b int")
    got = equalize(px).toPandas()
    for i, a in enumerate(some):
        assert (image_array(got[got["image_id"] == i]) == k.equalize(a)).all()


def test_diff_metrics_of_pairs_and_of_two_tables(spark):
    from rasterloom.operators import analysis, points
    from rasterloom.queries import QUERIES
    from rasterloom.sources.rasters import gradient_images

    got = QUERIES["diff_metrics"](spark, SMALL)
    assert not joins(got)
    px = gradient_images(spark, SMALL)
    two = analysis.diff_metrics(px, points.brightness(px, 25))
    assert "BroadcastExchange" not in joins(two)
    assert normal(two.toPandas()).equals(normal(got.toPandas()))


def test_color_names_computes_the_hue_once(spark):
    from rasterloom.queries import QUERIES

    names = QUERIES["color_names"](spark, SMALL)
    plan = names._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("/ 255.0") == 3 and plan.count("* 60.0") == 1  # before: once for each name


def test_orb_draws_a_position_once(spark):
    import random

    from rasterloom.queries import packed_images

    g = k.luma(images(1, 48, 64)[0])
    k.orb_pairs.cache_clear()
    for x, y in [(5, 9), (60, 40), (5, 9)]:
        draw = random.Random(x * 1000003 + y * 99991).randrange
        at = [[draw(-8, 9) for _ in range(4)] for _ in range(256)]
        value = lambda dx, dy: g[min(max(y + dy, 0), 47), min(max(x + dx, 0), 63)]
        assert k.orb(g, x, y) == [int(value(*p[:2]) < value(*p[2:])) for p in at]
    assert k.orb_pairs.cache_info().misses == 2
    assert packed_images(spark, SMALL).rdd.getNumPartitions() == 4
