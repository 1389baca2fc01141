"""The corpus pipeline against a plain version of each stage, on documents with nulls, copies and shared lines."""

import collections
import hashlib
import random

import pytest

from .brute import jaccard_groups, words

LINES = ["This one line stands in very many documents.", "And this other line is common as well, twice."]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n, junk="": " ".join(rng.choice(vocabulary) + junk for _ in range(n))
    docs, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        body = text(rng.randint(8, 60), "" if good else "###")
        if i % 4 == 0:
            body += "\n" + rng.choice(LINES) + "\n" + text(6)
        docs.append((i, body, "en", f"src{i % 5}"))
        labels.append((i, int(good)))
    base = text(300)
    for j in range(10):  # near copies
        w = base.split(" ")
        w[rng.randrange(len(w))] = f"other{j}"
        docs.append((300 + j, " ".join(w), "en", "src0"))
    docs += [(400 + j, docs[1][1], "en", None) for j in range(3)]
    docs += [(500, None, "en", "src1"), (501, "", None, "src1"), (502, LINES[0], "en", "src2"), (None, text(30), "en", "src3"), (503, "x " * 20_000 + "end", "en", "src4")]
    docs += [(504, text(25), "en", "src4")] * 2
    root = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(*d, len(d[1]) if d[1] else 0, "mine") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, extra string").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def plainly(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    from rasterloom.llm.mixing import mix
    from rasterloom.llm.rule_quality import train, with_statistics

    given = spark.read.parquet(f"{folder}/documents.parquet")
    model = train(spark, given, spark.read.parquet(f"{folder}/labels.parquet"))
    stats, names = with_statistics(given)
    pdf = stats.toPandas()
    score = model.score(pdf[names].to_numpy(float))
    docs = [[None if i != i else int(i), t, s] for i, t, s, x in zip(pdf["doc_id"], pdf["text"], pdf["source"], score) if x >= 0.7]
    assert 100 < len(docs) < len(pdf)

    holders, key = collections.defaultdict(set), lambda line: line.encode().strip().lower()
    for i, t, _ in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line).decode()) >= 20:
                holders[key(line)].add(i)
    for d in docs:
        if d[0] is not None and d[1]:
            d[1] = "\n".join(x for x in d[1].split("\n") if len(holders[key(x)]) < 3 or max(holders[key(x)]) == d[0])

    low = {i: c for i, (_, c) in jaccard_groups([d for d in docs if d[0] is not None], 5, 80).items()}
    docs = [d for d in docs if d[0] is None or low[d[0]] == d[0]]

    frame = spark.createDataFrame([(i, t, [s]) for i, t, s in docs], "doc_id long, text string, sources array<string>")
    copies = [(r["doc_id"], r["text"], r["copies"]) for r in mix(spark, frame).collect()]  # tests of its own hold it to its targets
    theirs, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), collections.Counter()
    for i, t, n in copies:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        out[i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(theirs.decode(ids, skip_special_tokens=False).encode())] += n
    return +out, docs


def test_run_is_the_plain_version(spark, folder):
    import corpus_pipeline

    got = collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).collect())
    want, kept = plainly(spark, folder)
    assert got == want and len(want) > 50
    assert sum(len(words(t)) for _, t, _ in kept) > 0


def test_stages_pass_their_columns_on(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    lines = {r["doc_id"]: r for r in corpus_pipeline.line_stage(spark, docs, folder).collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values() if r["text"] is not None)
    mixed = collections.Counter(r["doc_id"] for r in corpus_pipeline.mixing_stage(spark, docs, folder).collect())
    assert mixed and not {500, 501} & set(mixed) and mixed[504] in (0, 2, 4)  # two equal rows
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == []
