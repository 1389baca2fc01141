"""The training-data operators against brute force, on cases with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import pathlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from .brute import jaccard_groups, union_find, words

DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    shared = [line(9), line(12)]
    docs = []
    for i in range(60):
        lines = [line(rng.randint(3, 15)) for _ in range(rng.randint(1, 6))]
        if i % 5 == 0:
            lines.insert(rng.randint(0, len(lines)), " " + rng.choice(shared) + "\t")
        docs.append([i, "\n".join(lines), "en", f"src{i % 4}"])
    long = line(400)
    for j in range(12):  # near copies around one text, pairwise further apart than from it
        w = long.split(" ")
        for k in rng.sample(range(len(w)), 2):
            w[k] = f"changed{j}{k}"
        docs.append([100 + j, " ".join(w), "en", "src0"])
    docs.append([99, long, "en", None])
    docs += [[200 + j, docs[3][1], "de", "src1"] for j in range(4)]
    docs += [[300, None, None, None], [301, "", "en", "src2"], [302, " \n\n ", "en", "src2"], [303, "One", "en", "src2"], [304, "one", "en", "src2"]]
    docs += [[400, "x " * 20_000 + "end", "en", "src3"], [401, "ÄÖ é " * 40, "fr", "src3"]]
    return docs


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


def rows(df):
    return df.collect()


# 1


def judged(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        i = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:i]), rest[i:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def test_url_filter(spark):
    from rasterloom.llm.url_filters import RULES, url_filter

    urls = [None, "", "no scheme", "http://", "http://EN.Example.COM/en/7?x", "https://a.example.com/en/70#f", "http://com/en/", "http://xcom/en/1", "http://b.example.com/en/8", "ftp://example.net/de/8", "http://x.net/de/", "http://É.org/es/?q", "http://org?/es/", "a://b://com/en/", "http://com:80/en/"]
    urls += urls + [f"http://h{i}.{d}/{x}/{i}" for i in range(120) for d in ("com", "net", "example.com", "example.net") for x in ("en", "de")]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(url_filter(spark, pages))}
    assert got == {i: judged(u, RULES) for i, u in enumerate(urls)}
    assert rows(url_filter(spark, pages.limit(0))) == []


def test_url_filter_splits_large_rule_lists(spark):
    from rasterloom.llm.url_filters import BLOCK, url_filter

    rules = [(f"h{i}.com", "/a/", BLOCK if i % 2 else "allow") for i in range(300)] + [("h7.com", "/a/b", "allow"), ("com", "/a/b/c", BLOCK)]
    urls = [f"http://{'x.' * (i % 2)}h{i % 400}.com/a/{'b/c'[: i % 4]}{'/long' * (i % 50) * 40}" for i in range(1200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(url_filter(spark, pages, rules, max_bytes=220))}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}


def test_cascade_is_exact(spark):
    from rasterloom.llm.url_filters import build_cascade

    rng = np.random.default_rng(3)
    k = rng.integers(-(2**63), 2**63 - 1, (5000, 2), dtype=np.int64)
    listed = np.arange(5000) % 7 == 0
    keys = spark.createDataFrame([(int(a), int(b), bool(x)) for (a, b), x in zip(k, listed)], "k1 long, k2 long, listed boolean")
    cascade = build_cascade(spark, keys)
    assert len(cascade.levels) > 2
    assert (cascade.listed(k[:, 0].copy(), k[:, 1].copy()) == listed).all()


# 2


def test_quality(spark, corpus):
    from rasterloom.llm.rule_quality import quality

    rng = random.Random(1)
    texts = []
    for i in range(300):
        good = i % 3 > 0
        texts.append((i, " ".join(rng.choice(["the", "river", "bend", "slowly"]) + ("" if good else "###") for _ in range(rng.randint(5, 60))), int(good)))
    extra = [(1000, None, 1), (1001, "", 0), (None, "the river", 1)]
    docs = spark.createDataFrame([(a, b, 9.0) for a, b, _ in [*texts, *extra]], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(a, c) for a, _, c in texts], "doc_id long, quality int")
    out, model = quality(spark, docs, labels)
    got = rows(out)
    assert len(got) == 303 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    truth = {a: c for a, _, c in texts}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got if r["doc_id"] is not None)
    assert np.mean([truth[r["doc_id"]] == r["predicted"] for r in held]) > 0.95
    # the compiled columns are the model
    from rasterloom.llm.rule_quality import with_statistics

    stats, names = with_statistics(docs.select("doc_id", "text"))
    pdf = stats.where("doc_id is not null").toPandas()
    want = dict(zip(pdf["doc_id"], model.score(pdf[names].to_numpy())))
    assert all(abs(want[r["doc_id"]] - r["score"]) < 1e-9 for r in got if r["doc_id"] is not None)
    none, model = quality(spark, docs, labels.limit(0))
    assert {r["score"] for r in rows(none)} == {0.5} and not model.trained
    assert rows(quality(spark, docs.limit(0), labels)[0]) == []


# 3 and 7


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 16))
    x[100:130] = x[7] + 0.02 * rng.standard_normal((30, 16))
    data = [(i, [float(v) for v in x[i]], int(i % 3) if i % 11 else None) for i in range(600)]
    data += [(700 + i, data[0][1], 1) for i in range(30)]
    data += [(i, [float(v) for v in x[7]], 1) for i in range(800, 805)]
    data += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None] * 8, 1), (904, [float("inf")] + [1.0] * 15, 1), (905, [], 1), (906, [1e-200] * 16, 2), (908, [1e200] * 16, 2)]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(3)


def good(v):
    return v is not None and len(v) == 16 and all(c is not None and math.isfinite(c) for c in v) and any(v)


def test_curve_search(spark, vectors):
    from rasterloom.llm.curve_search import curve_search

    got = collections.defaultdict(list)
    for r in sorted(rows(curve_search(spark, vectors.where("vec_id <> 908").withColumn("score", F.lit(1)), F.col("vec_id") % 50 == 0)), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    data = {r["vec_id"]: np.array(r["embedding"], float) for r in rows(vectors) if good(r["embedding"]) and r["vec_id"] != 908}
    hits = total = 0
    for q in (i for i in data if i % 50 == 0):
        all_ = sorted((float(np.sqrt(((x - data[q]) ** 2).sum())), i) for i, x in data.items() if i != q)[:10]
        assert len(got[q]) == 10 and [(s, i) for i, s in got[q]] == sorted((s, i) for i, s in got[q])
        assert all(abs(float(np.sqrt(((data[i] - data[q]) ** 2).sum())) - s) < 1e-12 for i, s in got[q])
        hits, total = hits + len({i for _, i in all_} & {i for i, _ in got[q]}), total + 10
    assert len(got) == len([i for i in data if i % 50 == 0]) and hits / total >= 0.9
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(rows(curve_search(spark, few, F.col("vec_id") == 0)), key=lambda r: r["rank"])] == [(1, 1, 0.0), (2, 2, 2.0)]
    assert rows(curve_search(spark, few.limit(0), F.col("vec_id") == 0)) == []


def test_hilbert_is_a_curve():
    from rasterloom.llm.curve_search import hilbert

    points = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = points[np.argsort(hilbert(points, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_vector_dedup(spark, vectors, monkeypatch):
    from rasterloom.llm import vector_dedup as m

    monkeypatch.setattr(m, "CELL", 50)
    monkeypatch.setattr(m, "BLOCK", 16)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows(m.vector_dedup(spark, vectors.withColumn("kept", F.lit(1))))}
    data = {r["vec_id"]: (np.array(r["embedding"], float) / np.abs(r["embedding"]).max(), r["label"]) for r in rows(vectors) if good(r["embedding"])}
    unit = {i: (x / np.linalg.norm(x), y) for i, (x, y) in data.items() if y is not None}
    pairs = [(a, b) for a in unit for b in unit if a < b and unit[a][1] == unit[b][1] and unit[a][0] @ unit[b][0] >= 0.98]
    links = collections.Counter(i for p in pairs for i in p)
    low = union_find(pairs, [r["vec_id"] for r in rows(vectors)])
    assert len(pairs) > 400 and got == {i: (links[i], low[i], low[i] == i) for i in low}
    assert rows(m.vector_dedup(spark, vectors.limit(0))) == []


def test_vector_dedup_compares_every_length(spark, monkeypatch):
    from rasterloom.llm import vector_dedup as m

    monkeypatch.setattr(m, "CELL", 4)
    monkeypatch.setattr(m, "SAMPLE", 3)
    data = [(2 * d + i, [1.0 + i * 1e-3] * d, 0) for d in range(1, 121) for i in (0, 1)]  # a pair of each of 120 lengths
    data += [(1000 + i, [float(i == j) for j in range(200)], 0) for i in range(60)]
    got = rows(m.vector_dedup(spark, spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")))
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == {(i, int(i < 1000), i - i % 2 if i < 1000 else i) for i, _, _ in data}


# 4


def test_hidden_markov(spark, docs, corpus):
    from rasterloom.llm.hidden_markov import lm_score

    got = {r["doc_id"]: r for r in rows(lm_score(spark, docs.withColumn("score", F.lit(0)), states=3))}
    c = collections.Counter()
    for i, text, *_ in corpus:
        if zlib.crc32(str(i).encode()) % 10:
            c.update([*words(text), None])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(corpus)
    for i, text, *_ in corpus:
        tokens, r = [*words(text), None], got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(c[t] > 0 for t in tokens), n)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens), rel=1e-9)
        assert r["score"] < 0
    assert rows(lm_score(spark, docs.limit(0))) == []


def test_hidden_markov_learns_from_long_documents(spark):
    from rasterloom.llm.hidden_markov import lm_score

    long = spark.createDataFrame([(i, "aa bb " * 4000) for i in range(12)], "doc_id long, text string")  # all over 20,000 characters
    got = rows(lm_score(spark, long, states=2))
    assert len(got) == 12 and all(r["score"] > 0.2 * r["base_score"] for r in got)  # which word comes next is certain


def test_recursion_is_the_sum_over_paths():
    import itertools

    from rasterloom.llm import hidden_markov as m

    rng = np.random.default_rng(0)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    emit = np.zeros((m.CLASSES + 1, 2))
    emit[:3] = norm(rng.random((3, 2)), 0)
    model = m.Hmm(norm(rng.random(2), 0), norm(rng.random((2, 2)), 1), emit)
    some = [np.array([0, 1, 2, 1]), np.array([2, 0]), np.array([1])]
    found, counts = m.recursion(model, some, True)
    for s, f in zip(some, found):
        p = sum(model.start[z[0]] * emit[s[0], z[0]] * math.prod(model.move[a, b] * emit[o, b] for a, b, o in zip(z, z[1:], s[1:])) for z in itertools.product(range(2), repeat=len(s)))
        assert f == pytest.approx(math.log(p))
    assert counts[0].sum() == pytest.approx(3) and counts[1].sum() == pytest.approx(4) and counts[2].sum() == pytest.approx(7)
    # expectation-maximisation never lowers the likelihood
    better = m.Hmm(norm(counts[0], 0), norm(counts[1], 1), norm(counts[2], 0))
    assert m.recursion(better, some, False)[0].sum() >= found.sum()


# 5


def test_license_scan(spark):
    from rasterloom.llm.license_scan import THRESHOLD, license_scan, terms, TEMPLATES

    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/x.py", "code code"), ("a/b/y.py", "# Licensed under the Apache License, Version 2.0.\n" + "code " * 40), ("a/b/z.py", None),
        ("c/d.txt", "nothing"), ("c/licenses.txt", "All rights reserved."), (None, "Released under the MIT License."), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/d/e.py", ""), ("top.py", "x"), ("c/d.txt", "nothing"),
        ("e/long.txt", "Released under the MIT license.\n" + "word " * 5000), ("e/f.txt", "the rights of the license"),
    ]
    got = rows(license_scan(spark, spark.createDataFrame(files, "path string, text string")))
    verdict = collections.Counter((r["path"], r["license"], r["how"], r["from_path"]) for r in got)
    assert verdict == collections.Counter([
        ("a/LICENSE", "MIT", "file", None), ("a/x.py", "MIT", "inherited", "a/LICENSE"), ("a/b/y.py", "Apache-2.0", "header", None), ("a/b/z.py", "GPL-3.0", "inherited", "a/b/COPYING"),
        ("c/d.txt", "Reserved", "inherited", "c/licenses.txt"), ("c/licenses.txt", "Reserved", "file", None), (None, "MIT", "file", None), ("a/b/COPYING", "GPL-3.0", "file", None), ("a/b/c/d/e.py", "GPL-3.0", "inherited", "a/b/COPYING"), ("top.py", None, "none", None), ("c/d.txt", "Reserved", "inherited", "c/licenses.txt"),
        ("e/long.txt", "MIT", "header", None), ("e/f.txt", None, "none", None),
    ])
    # every line against every template
    n = len(files)
    df = collections.Counter(t for _, text in files for t in set(terms(text or "")))
    vocabulary = {t for x in TEMPLATES.values() for t in terms(x)}
    idf = lambda t: math.log((1 + n) / (1 + (df[t] if t in vocabulary else 0))) + 1

    def cosine(a, b):
        x, y = collections.Counter(terms(a)), collections.Counter(terms(b))
        length = lambda v: math.sqrt(sum((c * idf(t)) ** 2 for t, c in v.items()))
        return sum(x[t] * y[t] * idf(t) ** 2 for t in x) / (length(x) * length(y)) if x else 0.0

    for r in got:
        text = next(t for p, t in files if p == r["path"]) or ""
        best = max(cosine(line, x) for line in text.split("\n") for x in TEMPLATES.values())
        assert (best >= THRESHOLD) == (r["n_notices"] > 0)
        if r["n_notices"]:
            assert r["score"] == pytest.approx(best, abs=1e-8)
    assert rows(license_scan(spark, spark.createDataFrame([], "path string, text string"))) == []


def test_license_scan_weighs_every_term_by_the_corpus(spark):
    from rasterloom.llm.license_scan import TEMPLATES, license_scan, terms

    files = [(f"p/{i}.txt", f"en und plain text.. a.b -x- {i}") for i in range(300)] + [("a/LICENSE", "Released under the MIT License en und"), ("a/x.py", "x"), ("b/y.py", "Released under the MIT License quixotic zebra marmalade gnu violin harp")]
    got = {r["path"]: r for r in rows(license_scan(spark, spark.createDataFrame(files, "path string, text string")))}
    n, df = len(files), collections.Counter(t for _, text in files for t in set(terms(text)))
    weigh = lambda s: {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in collections.Counter(terms(s)).items()}
    x, y = weigh(files[300][1]), weigh(TEMPLATES["MIT"])
    cosine = sum(x[t] * y.get(t, 0) for t in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    assert got["a/LICENSE"]["license"] == "MIT" and got["a/LICENSE"]["score"] == pytest.approx(cosine, abs=1e-8)
    assert got["a/x.py"]["from_path"] == "a/LICENSE" and got["b/y.py"]["license"] is None


def test_license_scan_knows_texts_and_headers(spark):
    from rasterloom.llm.license_scan import LONG, license_scan

    folder = pathlib.Path(license_scan.__code__.co_filename).parent / "licences"
    texts = collections.defaultdict(dict)
    for p in folder.glob("*.txt"):
        name, _, kind = p.stem.partition("~")
        texts[name][kind] = p.read_text()
    assert sorted((name, text) for name, x in texts.items() for text in x.values()) == sorted(LONG)
    wrap = lambda text, mark: "\n".join(f"{mark} {x}".rstrip() for x in text.split("\n"))
    code = "\nimport os\n\nclass Handler:\n    def run(self):\n        return os.getcwd()\n" * 80
    files, want = [], {}
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "CC0-1.0"):
        files.append((f"{name}/LICENSE", "Copyright (c) 2019-2024 Jane Q. Author and others\n\n" + texts[name]["text"]))
        files.append((f"{name}/deep/er/code.py", code))
        want[f"{name}/LICENSE"] = (name, "file")
        want[f"{name}/deep/er/code.py"] = (name, "inherited")
    for name in ("Apache-2.0", "MPL-2.0", "GPL-3.0", "AGPL-3.0"):
        for mark in ("#", " *", "//"):
            files.append((f"src/{name}{len(files)}.c", wrap("Copyright 2021 The Authors\n" + texts[name]["header"], mark) + "\n" + code))
            want[files[-1][0]] = (name, "header")
    files += [(f"plain/{i}.txt", f"plain words of document {i}\n\nand a second block of it\n" + "other text " * i) for i in range(200)]
    files += [("src/talk.md", "We talked about the license of the software.\nThe copyright of it is ours.\n\n" + "More talk follows here. " * 50)]
    got = {r["path"]: (r["license"], r["how"]) for r in rows(license_scan(spark, spark.createDataFrame(files, "path string, text string")))}
    assert {p: got[p] for p in want} == want
    assert all(v == (None, "none") for p, v in got.items() if p not in want)


def test_license_scan_leaves_out_no_passage(spark):
    """All lines, blocks and texts against all templates: one-line licences, notices over two lines, texts without marker words, mixtures."""
    from rasterloom.llm.license_scan import BLANK, LONG, TEMPLATES, THRESHOLD, license_scan, terms

    rng = random.Random(7)
    long = dict((name + str(i), text) for i, (name, text) in enumerate(LONG))
    common = [f"common{i}" for i in range(20)]
    files = [("a/one.txt", " ".join(next(t for k, t in long.items() if k.startswith("MIT")).split())), ("a/two.txt", "All rights\nreserved."), ("a/wide.txt", "Redistribution\n" + " ".join(["all rights reserved", *common[:4]]))]
    files += [(f"a/few{k}.txt", "Released under the MIT\nLicense " + " ".join(common[:k])) for k in (8, 12, 16)]
    every = [*TEMPLATES.values(), *long.values()]
    for i in range(60):
        some = terms(rng.choice(every))
        kept = [t for t in some if rng.random() < rng.choice((0.5, 0.8, 1))] + rng.choices(common, k=rng.choice((0, 3, 10, 40)))
        parts = [kept[j : j + 12] for j in range(0, len(kept), 12)] if i % 3 else [kept]
        files.append((f"b/{i}.txt", rng.choice(("\n", "\n\n")).join(" ".join(x) for x in parts)))
    files += [(f"c/{i}.txt", " ".join(common) + f"\nsoftware copy {i}\n\nthe license") for i in range(200)]
    got = {r["path"]: r for r in rows(license_scan(spark, spark.createDataFrame(files, "path string, text string")))}
    n, df = len(files), collections.Counter(t for _, text in files for t in set(terms(text)))
    vector = lambda x: {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in collections.Counter(terms(x)).items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(v, length(v)) for v in map(vector, every)]
    hits = 0
    for path, text in files:
        passages = text.split("\n") + [b for b in re.split(BLANK, text) if "\n" in b] + [text] * bool(re.search("(?s)[^\n]" + BLANK + ".", text))
        scores = [max(sum(x * k.get(t, 0) for t, x in v.items()) / (length(v) * m) for k, m in known) for v in map(vector, passages) if v]
        best = [x for x in scores if round(x, 9) >= THRESHOLD]
        assert got[path]["n_notices"] == len(best), path
        assert not best or got[path]["score"] == pytest.approx(max(best), abs=1e-8), path
        hits += bool(best)
    assert 30 < hits < 70


# 6


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard(spark, docs, corpus, n, percent, monkeypatch):
    from rasterloom.llm import near_jaccard
    from rasterloom.llm.near_jaccard import jaccard_components, one_of_each

    if n == 3:  # large buckets
        monkeypatch.setattr(near_jaccard, "SMALL_BUCKET", 0)
        monkeypatch.setattr(near_jaccard, "BLOCK", 4)

    want = jaccard_groups(corpus, n, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(jaccard_components(spark, docs.withColumn("component_id", F.lit(0)), n, percent))}
    assert got == want
    if n == 5:
        assert {r["doc_id"] for r in rows(one_of_each(spark, docs, n, percent))} == {i for i, (_, c) in want.items() if i == c}
        assert rows(jaccard_components(spark, docs.limit(0))) == []
        odd = spark.createDataFrame([(None, "a b c d e f"), (4, "A B c d e f"), (None, "q r s t u v"), (5, "x y"), (5, "z z"), (None, None)], "doc_id long, text string")
        assert collections.Counter((r["doc_id"], r["component_id"]) for r in rows(jaccard_components(spark, odd))) == collections.Counter([(None, None), (4, 4), (None, None), (5, 5), (5, 5), (None, None)])


def test_shingler_tells_words_apart(monkeypatch):
    from rasterloom.llm import near_jaccard as m

    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abAB\u00e9") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += ["", " \t\n", "x", "\x00 \x00\x00", "word " * 50, "a" * 300, "\r\x0ba\x0c \x85b\xa0c"]
    known = {}
    whole = [m.Shingler(2).words(t.encode()).tolist() for t in texts]
    for t, got in zip(texts, whole):
        assert len(got) == len(words(t))
        assert all(known.setdefault(w, h) == h for w, h in zip(words(t), got))
    assert len(set(known.values())) == len(known)
    monkeypatch.setattr(m, "PIECE", 7)  # words over the ends of pieces
    assert [m.Shingler(2).words(t.encode()).tolist() for t in texts] == whole and m.Shingler(3)(None).tolist() == []


def needed_signatures(features, t, seed):
    from rasterloom.llm.common import mix64
    from rasterloom.llm.near_jaccard import band_signatures

    kept = set()
    for _, spare, sigs in band_signatures(features, t):
        order = np.argsort(mix64(sigs + np.uint64(seed)))
        kept |= set(sigs[order[: len(sigs) - spare]].tolist())
    return kept


def test_partenum_misses_nothing():
    from rasterloom.llm.near_jaccard import bitmap, may_link, signatures

    rng = np.random.default_rng(4)
    for t in (0.8, 0.9):
        for _ in range(400):
            size = int(rng.integers(3, 400))
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            out = int(rng.integers(0, int((1 - t) / (1 + t) * 2 * size) + 2))
            gone = int(rng.integers(0, out + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**63, out - gone, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both >= t * (len(a) + len(b) - both) and len(np.union1d(a, b)) > both:
                assert len(np.intersect1d(signatures(a, t), signatures(b, t)))
                assert may_link(bitmap(a), bitmap(b), len(a), len(b), round(100 * t))
                for seed in range(3):  # whatever the order of frequency is
                    assert needed_signatures(a, t, seed) & needed_signatures(b, t, seed)
    apart = [np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64)) for _ in range(2)]
    assert not may_link(bitmap(apart[0]), bitmap(apart[1]), len(apart[0]), len(apart[1]), 80)


# 8


def test_line_dedup(spark, docs, corpus):
    from rasterloom.llm.line_dedup import line_dedup

    holders = collections.defaultdict(set)
    key = lambda line: line.encode().strip().lower()
    for i, text, *_ in corpus:
        for line in (text or "").split("\n"):
            if len(key(line).decode()) >= 20:
                holders[key(line)].add(i)
    want = {}
    for i, text, *_ in corpus:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        want[i] = ("\n".join(kept) if text is not None or len(kept) < len(lines) else None, len(lines), len(lines) - len(kept))
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in rows(line_dedup(spark, docs.withColumn("n_lines", F.lit("clash"))))}
    assert got == want and sum(w[2] for w in want.values()) > 5
    assert rows(line_dedup(spark, docs.limit(0))) == []
    same = spark.createDataFrame([(None, "the same line of twenty or more")] * 3 + [(7, "the same line of twenty or more")] * 3, "doc_id long, text string")
    assert {r["n_dropped"] for r in rows(line_dedup(spark, same))} == {0}


def test_line_runs_outlive_a_call(spark, tmp_path):
    from rasterloom.llm.line_dedup import LineRuns, line_dedup

    line = lambda k: f"a line of twenty or more, number {k}"
    texts = {i: "\n".join(line(k) for k in {i % 7, 50 + i % 3, 100 + i}) for i in range(60)}
    holders = collections.defaultdict(set)
    for start in (0, 30, 15, 45):  # batches in no order
        some = {i: t for i, t in texts.items() if start <= i < start + 15}
        for i, t in some.items():
            for x in t.split("\n"):
                holders[x].add(i)
        frame = spark.createDataFrame(list(some.items()), "doc_id long, text string")
        got = {r["doc_id"]: r["text"] for r in rows(line_dedup(spark, frame, batches=2, runs=str(tmp_path / "runs")))}
        assert got == {i: "\n".join(x for x in t.split("\n") if len(holders[x]) < 3 or max(holders[x]) == i) for i, t in some.items()}
    runs = LineRuns(spark, str(tmp_path / "runs"))
    assert runs.version == 8 and 1 <= sum(map(len, runs.levels)) <= 4  # eight batches, merged in between
    plan = runs._merge([runs.merged(), runs.merged()])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan  # runs are merged as they lie
    runs.close()


# 9


def test_bpe(spark, docs, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    from rasterloom.llm.bpe import WordBpe, bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    theirs = Tokenizer.from_file(path)
    extra = [(900, "<|endoftext|>Hi<|startoftext|> there's"), (901, "ΟΔΟΣ İ \u0301é ½²Ⅷ१ 中文字 한국어 😀!!"), (902, "a" * 3000), (903, "\u1c89 \ua7dc \U00016ea0 \u088f \x1c\x85\u2003x")]
    table = docs.select("doc_id", "text", F.lit("clash").alias("ids")).union(spark.createDataFrame([(*e, "c") for e in extra], "doc_id long, text string, ids string"))
    texts = {i: t for i, t, *_ in [*corpus, *extra]}
    got = rows(bpe(spark, table, path))
    assert len(got) == len(texts)
    for r in got:
        ids = theirs.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert list(memoryview(bytes(r["ids"])).cast("I")) == ids
        assert r["decoded"] == theirs.decode(ids, skip_special_tokens=False)
    model = WordBpe(open(path).read())
    assert rows(bpe(spark, docs.limit(0), path)) == []
    rng = random.Random(3)
    some = {"".join(rng.choice("etaoinshrdlu'!é") for _ in range(rng.randint(1, 64))) for _ in range(500)}
    model.learn(some)
    assert len(model.memo) > 300 and all(m == b"".join(i.to_bytes(4, "little") for i in model.word(w)) for w, m in model.memo.items())


# 10


def test_mixing(spark, docs, corpus):
    from rasterloom.llm.mixing import mix, targets

    table = docs.withColumns({"sources": F.array("source"), "size": F.lit("clash")})
    first, again = ({r["doc_id"]: r for r in rows(mix(spark, t))} for t in (table, table.repartition(7)))
    size = {i: len(words(t)) for i, t, *_ in corpus}
    by = collections.defaultdict(list)
    for i, _, _, s in corpus:
        by[s].append(i)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    goal = targets({s: sum(size[i] for i in by[s]) for s in names}, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(size.values()), 2)
    for s in names:
        assert all(first[i]["target"] == pytest.approx(goal[s]) and first[i]["source_size"] == sum(size[j] for j in by[s]) for i in by[s])
        taken = sum(first[i]["taken"] for i in by[s])
        assert abs(taken - goal[s]) <= 1 + max(size[i] for i in by[s]) / 2
    assert all(r["size"] == size[i] and r["taken"] in (0, size[i], 2 * size[i]) and r["taken"] == again[i]["taken"] for i, r in first.items())
    assert rows(mix(spark, table.limit(0))) == []


def test_mixing_overlapping_sources(spark, corpus, monkeypatch):
    from rasterloom.llm import mixing as m

    # repeated and null sources, no sources, null doc_ids, repeated rows, a clashing column
    data = [(i if i % 9 else None, text, [["a", "b", "a"], ["b"], ["c", None], None, ["a", "b", "c"], []][i % 6], "x") for i, text, *_ in corpus]
    data += [(7, "one two three four five", ["b"], "x")] * 3
    table = spark.createDataFrame(data, "doc_id long, text string, sources array<string>, taken string").repartition(3)
    pattern = lambda s: tuple(sorted(set(s or [None]), key=lambda x: (x is None, x or "")))
    size = collections.Counter()
    for _, text, s, _ in data:
        size[pattern(s)] += len(words(text))
    want, sizes, goal = m.plan(dict(size), m.WEIGHTS, 1.5, 2)
    got = rows(m.mix(spark, table))
    assert len(got) == len(data)
    taken = collections.Counter()
    for r in got:
        p = pattern(r["sources"])
        taken[p] += r["taken"]
        assert r["size"] == len(words(r["text"])) and r["taken"] in (0, r["size"], 2 * r["size"])
        assert r["source_size"] == sum(sizes[s] for s in p) and r["target"] == pytest.approx(math.fsum(goal[s] for s in p))
    longest = max(len(words(t)) for _, t, *_ in data)
    assert all(abs(taken[p] - want[p]) <= longest / 2 + 1 for p in size)
    monkeypatch.setattr(m, "EDGE_ROWS", 2)  # several steps of the histogram
    monkeypatch.setattr(m, "EDGE_DOCS", 2)
    fine = collections.Counter()
    for r in rows(m.mix(spark, table)):
        fine[pattern(r["sources"])] += r["taken"]
    assert all(abs(fine[p] - want[p]) <= longest + 1 for p in size)
    monkeypatch.setattr(m, "MAX_PATTERNS", 2)  # other patterns go by one of their sources
    few = rows(m.mix(spark, table))
    assert len(few) == len(data) and {r["source_size"] for r in few} <= {sum(sizes[s] for s in p) for p in [*size, *((s,) for s in sizes)]}
    assert abs(sum(r["taken"] for r in few) - sum(goal.values())) <= 6 * longest


def test_targets_and_flow():
    import itertools

    from rasterloom.llm.mixing import min_cost_flow, plan, targets

    assert targets({"a": 10, "b": 100}, {"a": 3, "b": 1}, 165, 2) == {"a": 20.0, "b": 145.0}

    def cost(patterns, taken):  # the r-th repetition of a word costs 2r + 1
        return sum(min(n, max(0, taken[p] - r * n)) * (2 * r + 1) for p, n in patterns.items() for r in range(2))

    def best(patterns, goal):
        """The most words that the sources' targets allow and the least that they cost, by trying everything."""
        found = {}
        arcs = [(p, s) for p in patterns for s in p]
        for flow in itertools.product(*(range(min(2 * patterns[p], round(goal[s])) + 1) for p, s in arcs)):
            taken, into = collections.Counter(), collections.Counter()
            for (p, s), x in zip(arcs, flow):
                taken[p] += x
                into[s] += x
            if all(taken[p] <= 2 * n for p, n in patterns.items()) and all(into[s] <= round(goal[s]) for s in into):
                total = sum(taken.values())
                found[total] = min(found.get(total, math.inf), cost(patterns, taken))
        return max(found), found[max(found)]

    rng = random.Random(8)
    for share in (0.5, 1.0, 1.5):
        for _ in range(4):
            patterns = {p: rng.randint(0, 4) for p in [("a",), ("a", "b"), ("b",)]}
            taken, sizes, goal = plan(patterns, (1, 1), share, 2)
            assert sizes == {"a": patterns[("a",)] + patterns[("a", "b")], "b": patterns[("b",)] + patterns[("a", "b")]}
            assert (sum(taken.values()), cost(patterns, taken)) == best(patterns, goal)
    taken, sizes, goal = plan({("a",): 100, ("a", "b"): 50, ("b",): 10}, (1, 1), 1.0, 2)
    assert sizes == {"a": 150, "b": 60} and goal == {"a": 80.0, "b": 80.0}
    assert sum(taken.values()) == 160 and cost({("a",): 100, ("a", "b"): 50, ("b",): 10}, taken) == 200  # words of "a" alone fill its target: 20 others come twice
    assert min_cost_flow(4, [(0, 1, 5, 1), (0, 2, 5, 3), (1, 3, 4, 0), (2, 3, 4, 0), (1, 2, 9, 0)], 0, 3) == [5, 3, 4, 4, 1]


def test_digests_and_queries(spark):
    from rasterloom.llm.queries import QUERIES, SQL

    assert set(SQL) <= set(QUERIES) and len(QUERIES) == 10
    from rasterloom.llm.bpe import op9_bpe

    r = op9_bpe(spark, "/root/testdata/sf0.001").first()
    assert len(r["ids_sha256"]) == len(hashlib.sha256().hexdigest()) and r["n_tokens"] > 0
