"""Odd input of the training-data operators: repeated and missing ids, clashing columns, several lengths and partitions."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from .brute import words


def rows(df):
    return df.collect()


def test_url_filter_long_and_repeated_urls(spark):
    from rasterloom.llm.url_filters import url_filter

    long = "http://" + "a." * 5000 + "com/en/" + "x" * 50_000
    pages = spark.createDataFrame([(1, long, "clash"), (1, long, "clash"), (None, long, "clash"), (2, "http://example.com/en/7" + "y" * 9000, "clash")], "page_id long, url string, rule string")
    got = collections.Counter((r["page_id"], r["rule"], r["verdict"], len(r["path"])) for r in rows(url_filter(spark, pages)))
    assert got == {(1, "com/en/", "block", 50_004): 2, (None, "com/en/", "block", 50_004): 1, (2, "example.com/en/7", "allow", 9005): 1}


def test_quality_of_repeated_ids_and_contradicting_labels(spark):
    from rasterloom.llm.rule_quality import quality, train

    texts = [(i, "good river bend slowly " * (3 + i % 9) if i % 2 else "### ### !!! " * (3 + i % 7)) for i in range(200)]
    table = spark.createDataFrame([*texts, *texts[:50], (500, "word " * 200_000), (501, "")], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(200)]
    plain = train(spark, spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    contradicted = spark.createDataFrame([*labels, *labels[:20], (500, 0), (500, 1), (501, None), (None, 1)], "doc_id long, quality int")
    out, model = quality(spark, table, contradicted)
    assert model.rules == plain.rules and np.allclose(model.weights, plain.weights)  # repeats and contradictions teach nothing
    got = rows(out)
    assert len(got) == 252 and all(0 <= r["score"] <= 1 for r in got)
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["score"])
    assert all(len(s) == 1 for s in by.values())


def nearest(data, q, k):
    return [i for _, i in sorted((math.dist(x, data[q]), i) for i, x in data.items() if i != q and len(x) == len(data[q]))[:k]]


def test_curve_search_over_many_partitions(spark, monkeypatch):
    from rasterloom.llm import curve_search as m

    rng = np.random.default_rng(9)
    centres = rng.standard_normal((60, 16))
    data = {i: (centres[i % 60] + 0.15 * rng.standard_normal(16)).tolist() for i in range(3000)}
    monkeypatch.setattr(m, "PART_ROWS", 1500)
    monkeypatch.setattr(m, "WINDOWS", (64, 128, 256, 512))
    report = {}
    table = spark.createDataFrame(list(data.items()), "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in rows(m.curve_search(spark, table, F.col("vec_id") % 50 == 0, report=report)):
        got[r["query_id"]].append(r["vec_id"])
    recall = np.mean([len(set(got[q]) & set(nearest(data, q, 10))) / 10 for q in range(0, 3000, 50)])
    use = report[16]
    assert recall >= 0.9 and use["recall"] >= 0.95 and use["orderings"] * use["window"] < 0.6 * 3000  # far from a look at every row
    # windows reach over the ends of partitions: how many there are changes little
    monkeypatch.setattr(m, "PART_ROWS", 10**9)
    whole = collections.defaultdict(list)
    for r in rows(m.curve_search(spark, table, F.col("vec_id") % 50 == 0)):
        whole[r["query_id"]].append(r["vec_id"])
    assert np.mean([len(set(got[q]) & set(whole[q])) / 10 for q in whole]) > 0.99


def test_curve_search_of_repeated_ids_and_several_lengths(spark):
    from rasterloom.llm.curve_search import curve_search

    data = {i: [float(i), 1.0] for i in range(40)} | {100 + i: [float(i), 1.0, 2.0] for i in range(5)} | {200: [1.0]}
    table = [(i, v, 5.0) for i, v in data.items()] + [(0, [0.0, 1.0], 5.0)] * 2 + [(None, [0.5, 1.0], 5.0)]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>, score double").repartition(3)
    got = collections.defaultdict(list)
    for r in sorted(rows(curve_search(spark, frame, F.col("vec_id").isin(0, 17, 100, 102, 200), k=4)), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
    assert dict(got) == {q: nearest(data, q, 4) for q in (0, 17, 100, 102)}


def test_hidden_markov_score_is_the_plain_recursion(spark, monkeypatch):
    from rasterloom.llm import hidden_markov as m

    held = {}
    score = m._score
    monkeypatch.setattr(m, "_score", lambda model, *rest: held.update(model=model) or score(model, *rest))
    texts = [(i, " ".join(["sun moon star"[: 3 + i % 8], "river", "Bend"] * (1 + i % 5))) for i in range(40)] + [(None, "river unseen"), (7, "sun"), (7, "sun"), (50, None), (51, "")]
    got = rows(m.lm_score(spark, spark.createDataFrame(texts, "doc_id long, text string"), states=3))
    count, of_class = collections.Counter(), collections.defaultdict(collections.Counter)
    cls = lambda w: m.CLASSES if w is None else m.word_key(w) & (m.CLASSES - 1)
    for i, t in texts:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            count.update([*words(t), None])
    for w, c in count.items():
        of_class[cls(w)][w] += c
    n, model, want = sum(count.values()), held["model"], collections.Counter()
    for i, t in texts:
        tokens = [*words(t), None]
        a, total = None, 0.0
        for w in tokens:
            a = (model.start if a is None else a @ model.move) * model.emit[cls(w)]
            total += math.log10(a.sum())
            a = a / a.sum()
            own = of_class[cls(w)]
            total += math.log10((count[w] + 0.1) / (sum(own.values()) + 0.1 * (len(own) + 1))) if w is not None else 0.0
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (len(count) + 1))) for w in tokens)
        want[i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(tokens), round(total, 6), round(base, 6)] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], round(r["score"], 6), round(r["base_score"], 6)) for r in got) == want


def test_license_scan_with_clashing_columns(spark):
    from rasterloom.llm.license_scan import license_scan

    files = [("a/LICENSE", "Released under the MIT License.", "x", 1, 2)] * 2 + [("a/b.py", "code", "y", 3, 4)]
    got = collections.Counter(tuple(r) for r in rows(license_scan(spark, spark.createDataFrame(files, "path string, text string, license string, score int, words int"))))
    assert {(p, lic, how): c for (p, lic, _, how, _, _), c in got.items()} == {("a/LICENSE", "MIT", "file"): 2, ("a/b.py", "MIT", "inherited"): 1}


def test_vector_dedup_of_missing_ids_and_several_lengths(spark, monkeypatch):
    from rasterloom.llm import vector_dedup as m

    monkeypatch.setattr(m, "CELL", 8)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 6))
    data = [(i, x[i % 30].tolist() if i % 2 else (x[i % 30] + 1e-3).tolist(), "a") for i in range(60)] + [(i + 100, [1.0, i * 1e-3], "a") for i in range(6)]
    data += [(None, x[3].tolist(), "a"), (None, [0.0, -0.0], "a"), (None, None, None), (7, x[7].tolist(), "a")]
    got = collections.Counter(tuple(r) for r in rows(m.vector_dedup(spark, spark.createDataFrame(data, "vec_id long, embedding array<double>, label string"))))
    unit = [None if v is None or not any(v) else np.array(v) / np.linalg.norm(v) for _, v, _ in data]
    link = [[j for j in range(len(data)) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in range(len(data))]
    want = collections.Counter()
    for i, (id_, _, _) in enumerate(data):
        seen, stack = {i}, [i]
        while stack:
            for j in link[stack.pop()]:
                if j not in seen:
                    seen.add(j), stack.append(j)
        low = min((data[j][0] for j in seen if data[j][0] is not None), default=None)
        want[id_, len(link[i]), low, low is None or id_ == low] += 1
    # a row without an id that reaches one is not kept
    assert {(a, b, c): n for (a, b, c, _), n in got.items()} == {(a, b, c): n for (a, b, c, _), n in want.items()}


def test_bpe_of_missing_and_repeated_ids(spark):
    import public_tokenizers

    from rasterloom.llm.bpe import bpe, digest

    docs = spark.createDataFrame([(None, "one"), (None, "one"), (3, None), (3, None), (4, "")], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_tokens"]) for r in rows(digest(bpe(spark, docs, public_tokenizers.path("word_bpe_49k.json")))))
    assert got == {(None, 1): 2, (3, 0): 2, (4, 0): 1}


def test_a_cluster_must_name_its_shared_folder():
    from rasterloom.llm.common import prepare

    class Conf:
        def set(self, *_):
            pass

        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        prepare(Session())
