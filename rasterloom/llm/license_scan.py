"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

Everything is a DataFrame expression. A file's passages are its lines, its blocks of several lines (up to a blank
line; comment marks are no terms, so a wrapped header is one block) and the whole text. Every passage is held
against all templates: notices, headers and full licence texts.

Two bounds leave out passages that cannot reach the threshold, and no others. By Cauchy and Schwarz a passage
has to hold terms that make up threshold squared of a template's squared length: one of a notice's heaviest terms for
a line, a share of the terms that are rarest in the corpus for the others. And the terms that it
shares with the template have to make up as much of its own squared length. What is left is compared exactly. All terms,
of templates or not, weigh by their document frequency over the whole corpus: passages' terms are joined with the corpus counts.

A file without a notice inherits from the nearest directory above it that holds a licence file: the
distinct directories are joined with their ancestors' licences by path.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

#: Short notices by licence.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
    "Reserved": "All rights reserved.",
}
#: Headers and full texts, a file of licences/ each: the licence, a tilde and anything, .txt.
LONG = [(p.stem.partition("~")[0], p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))]
THRESHOLD = 0.75
#: A file of whose words at least this share are notices is a licence file whatever its name.
NOTICE_SHARE = 0.3
#: Bounds are relaxed by this share, far more than rounding takes.
SLACK = 1e-8
NAMED = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([._-][^/]*)?$"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
BLANK = r"\n(?:[^a-zA-Z0-9\n]*\n)+"


def terms(text: str) -> list[str]:
    low = "".join(c.lower() if c.isascii() else c for c in text)
    return re.findall(TERM, low)


def anchors(vectors: Iterable[dict[str, float]], threshold: float) -> set[str]:
    """Terms of which a passage needs one to reach the threshold: of each template its heaviest terms, until the rest is shorter than the threshold."""
    out = set()
    for v in vectors:
        total, rest = math.fsum(x * x for x in v.values()), dict(v)
        for t in sorted(v, key=lambda t: (-v[t], t)):
            if math.fsum(x * x for x in rest.values()) < threshold**2 * total * (1 - SLACK):
                break
            out.add(t)
            del rest[t]
    return out


def rarest(v: dict[str, float], counted: dict[str, int], threshold: float) -> tuple[dict[str, float], float]:
    """A template's rarest terms with their shares of its squared length, and how much of these a passage needs to reach the threshold."""
    total, rest = math.fsum(x * x for x in v.values()), {t: x * x for t, x in v.items()}
    need, core = threshold**2 * (1 - SLACK), {}
    for t in sorted(v, key=lambda t: (counted.get(t, 0), -v[t], t)):
        if math.fsum(rest.values()) < need * total / 2:
            break
        core[t] = rest.pop(t) / total
    return core, need - math.fsum(rest.values()) / total


def license_scan(spark: SparkSession, files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, long: list[tuple[str, str]] = LONG) -> DataFrame:
    """Rows (path, license, score, how, from_path, n_notices), one per row of ``files(path, text)``.

    how: ``header`` (a notice in the file), ``file`` (the same in a licence file), ``inherited`` (from the nearest directory above with a
    licence file, whose path is from_path) or ``none``. score is the best cosine of a passage with a
    template over TF-IDF vectors ((1 + ln count) times ln((1 + N) / (1 + df)) + 1, over all of the
    corpus), rounded to 9 digits; ties go to the first licence by name. A licence file is one named so, or one that
    consists of notices to NOTICE_SHARE; in a directory with several, the best score counts, then the
    smallest path. n_notices counts the passages that reach the threshold, a text with a matching block in it twice.
    Null and empty texts hold no notice but may inherit; rows without path inherit
    nothing. Repeated rows come back as often. An empty table gives an empty result; other columns
    are left out.

    ``templates`` are one-line notices by licence; ``long`` are (licence, text) of headers and full texts.
    """
    files = files.select("path", F.coalesce("text", F.lit("")).alias("text"))
    every = sorted([*templates.items(), *long])
    names, lists = [k for k, _ in every], [terms(t) for _, t in every]
    short = [i for i, x in enumerate(every) if templates.get(x[0]) == x[1]]
    vocabulary = sorted({t for v in lists for t in v})
    words_of = lambda terms: F.split(F.lit(" ".join(sorted(terms))), " ")
    found_terms = lambda col: F.regexp_extract_all(ascii_lower(col), F.lit(f"({TERM})"), 1)

    # document frequencies of all terms over the corpus: one row per term
    split_terms = F.array_distinct(F.split(F.regexp_replace(ascii_lower(F.col("text")), r"[.-]+(?=[^a-z0-9]|$)|(?<![a-z0-9])[.-]+", " "), r"[^a-z0-9.-]+"))
    with Scratch(spark) as scratch:
        counts = scratch.table(files.select(F.explode(split_terms).alias("term")).groupBy("term").count())
        templates_terms = F.broadcast(spark.createDataFrame([(t,) for t in vocabulary], "term string"))
        counted = {r["term"]: r["count"] for r in counts.join(templates_terms, "term", "left_semi").collect()}  # at most the templates' terms
        n = files.count()
        idf = {t: math.log((1 + n) / (1 + counted.get(t, 0))) + 1 for t in vocabulary}
        vectors = [{t: (1 + math.log(v.count(t))) * idf[t] for t in set(v)} for v in lists]
        norms = [math.sqrt(math.fsum(x * x for x in v.values())) for v in vectors]
        need = sorted(anchors((vectors[i] for i in short), threshold), key=lambda t: (-len(t), t))
        hint = "(?i)(?<![a-z0-9])(" + "|".join(map(re.escape, need)) + ")(?![a-z0-9])"

        # what bounds take of each template: its terms, the rarest with their shares, how much of these is needed, its largest idf
        most = counts.agg(F.max("count")).first()[0] or 0
        floor = math.log((1 + n) / (1 + most)) + 1  # no term weighs less
        cores = [rarest(v, counted, threshold) for v in vectors]
        core_terms = words_of({t for core, _ in cores for t in core})
        bound = lambda i: F.struct(words_of(vectors[i]).alias("terms"), F.str_to_map(F.lit(" ".join(f"{t}:{x!r}" for t, x in cores[i][0].items())), F.lit(" "), F.lit(":")).cast("map<string,double>").alias("core"), F.lit(cores[i][1]).alias("need"), F.lit(max(idf[t] for t in vectors[i]) ** 2).alias("square"))
        bounds = F.array(*(bound(i) for i in range(len(vectors))))
        bounds_long = F.array(*(bound(i) for i in range(len(vectors)) if i not in short)) if len(short) < len(vectors) else None
        covers = lambda rare, t: F.aggregate(rare, F.lit(0.0), lambda a, x: a + F.coalesce(t["core"][x], F.lit(0.0))) >= t["need"]
        covered = lambda rare, over: F.lit(False) if over is None else (F.size(rare) > 0) & F.exists(over, lambda t: covers(rare, t))

        def prepared(tokens):
            """An array of token lists as structs of the tokens, the distinct ones and the rarest of templates' ones among these."""
            both = F.transform(tokens, lambda x: F.struct(x.alias("tokens"), F.array_distinct(x).alias("distinct")))
            return F.transform(both, lambda p: F.struct(p["tokens"].alias("tokens"), p["distinct"].alias("distinct"), F.array_intersect(core_terms, p["distinct"]).alias("rare")))

        def reaches(p, over):
            """Whether a prepared passage may reach the threshold. Of n tokens, d distinct, s shared ones weigh most if the others come once and the shared ones equally often."""
            d = F.size(p["distinct"])

            def weighs(t):
                shared = F.size(F.array_intersect(t["terms"], p["distinct"]))
                top = t["square"] * shared * F.pow(1 + F.log((F.size(p["tokens"]) - d + shared) / shared), F.lit(2.0))
                return top * (1 - threshold**2) >= (threshold * floor) ** 2 * (1 - SLACK) * (d - shared)

            return F.lit(False) if over is None else (F.size(p["rare"]) > 0) & F.exists(over, lambda t: covers(p["rare"], t) & weighs(t))

        # the file's number of words and its candidate passages' terms: one narrow row
        rare = files.select("path", "text", F.array_intersect(core_terms, split_terms).alias("rare"))
        gates = rare.select("path", "text", covered(F.col("rare"), bounds).alias("any"), covered(F.col("rare"), bounds_long).alias("long"))
        all_lines = F.split("text", "\n")
        long_line = lambda x: F.exists(prepared(F.array(found_terms(x))), lambda p: reaches(p, bounds_long))
        lines = F.when(F.col("long"), F.filter(all_lines, lambda x: x.rlike(hint) | long_line(x))).otherwise(F.filter(all_lines, lambda x: x.rlike(hint)))
        blocks = F.filter(F.split(F.regexp_replace("text", "\r\n?", "\n"), BLANK), lambda x: x.rlike(r"\n"))
        whole = F.filter(F.array("text"), lambda x: x.rlike("(?s)[^\n]" + BLANK + "."))
        several = prepared(F.transform(F.concat(blocks, whole), lambda x: found_terms(x)))
        several = F.when(F.col("any"), F.transform(F.filter(several, lambda p: reaches(p, bounds)), lambda p: p["tokens"])).otherwise(F.expr("cast(array() as array<array<string>>)"))
        passages = F.concat(F.transform(lines, lambda x: found_terms(x)), several)
        words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
        narrow = scratch.table(gates.select(F.monotonically_increasing_id().alias("id"), "path", words.alias("words"), passages.alias("passages")))

        # the candidates' terms with their weights: one row per passage and distinct term
        passages = narrow.select("id", F.posexplode("passages").alias("passage", "tokens"))
        tokens = passages.select("id", "passage", F.size("tokens").alias("n"), F.explode("tokens").alias("term"))
        weight = (F.log(F.col("times")) + 1) * (F.log(F.lit(1.0 + n) / (1 + F.col("count"))) + 1)
        weighed = tokens.groupBy("id", "passage", "n", "term").agg(F.count("*").alias("times")).join(counts, "term")
        weighed = scratch.table(weighed.select("id", "passage", "n", "term", weight.alias("w")))

        # best template of a passage: largest cosine, then the first by name
        known = spark.createDataFrame([(t, i, v[t] / norms[i]) for i, v in enumerate(vectors) for t in sorted(v)], "term string, i int, x double")
        length = weighed.groupBy("id", "passage", "n").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
        dots = weighed.join(F.broadcast(known), "term").groupBy("id", "passage", "i").agg(F.sum(F.col("w") * F.col("x")).alias("dot"))
        scored = dots.join(length, ["id", "passage"]).select("id", "passage", "n", "i", F.round(F.col("dot") / F.col("length"), 9).alias("score")).where(F.col("score") >= threshold)
        best = scored.groupBy("id", "passage").agg(F.max(F.struct("score", (-F.col("i")).alias("order"), F.element_at(F.lit(names), F.col("i") + 1).alias("license"), "n")).alias("notice"))
        notices = best.groupBy("id").agg(F.collect_list("notice").alias("notices"))
        own = narrow.select("id", "path", "words").join(notices, "id", "left").withColumn("notices", F.coalesce("notices", F.expr("cast(array() as array<struct<score: double, order: int, license: string, n: int>>)")))
        top = F.array_max("notices")
        own = own.select(
            "path",
            F.size("notices").cast("long").alias("n_notices"),
            top["license"].alias("own"),
            top["score"].alias("own_score"),
            (F.col("path").rlike(NAMED) | (F.aggregate("notices", F.lit(0), lambda a, x: a + x["n"]) >= NOTICE_SHARE * F.col("words"))).alias("whole"),
        ).withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit("")))
        own = own.checkpoint()  # narrow: paths and verdicts, read by the three steps that follow
    whole = F.col("whole") & F.col("own").isNotNull()
    ranked = own.where(whole & F.col("path").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("low"), "path", "own", "own_score")).alias("x"))
    ranked = ranked.select(F.col("dir").alias("above"), "x")
    parts = F.split("dir", "/")
    ladder = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    dirs = own.where("own IS NULL AND dir IS NOT NULL").select("dir").distinct()
    steps = dirs.select("dir", F.posexplode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(ladder)).alias("depth", "above"))
    nearest = steps.join(ranked, "above").groupBy("dir").agg(F.max_by("x", "depth").alias("x"))
    out = own.join(nearest.select(F.col("dir").alias("d"), "x"), (F.col("dir") == F.col("d")) & F.col("own").isNull(), "left")
    return out.select(
        "path",
        F.coalesce("own", "x.own").alias("license"),
        F.coalesce("own_score", "x.own_score").alias("score"),
        F.when(whole, "file").when(F.col("own").isNotNull(), "header").when(F.col("x").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(F.col("own").isNull(), F.col("x.path")).alias("from_path"),
        "n_notices",
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the file source/lang/doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string"))
    out = license_scan(spark, docs.select(path.alias("path"), "text"))
    return out.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "path", "license", "score", "how", "from_path", "n_notices")
