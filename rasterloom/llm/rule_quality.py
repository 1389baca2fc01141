"""Quality classifier: a sparse ensemble of rules.

Boosted shallow trees over statistics of the text propose rules: every path from a root is a
conjunction of comparisons. A logistic regression with an L1 penalty weighs the rules and leaves
most out. What remains is compiled into Spark column expressions, so scoring is one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, prepare

#: Labelled documents that the model is fitted on, at most: those with the smallest hashes.
SAMPLE = 20_000
TREES, DEPTH, CUTS = 40, 3, 32
#: Penalties tried, strongest first.
PENALTIES = (0.02, 0.01, 0.005, 0.002, 0.001)


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """Adds the statistics of the whole text (null as empty) as columns; returns their names."""
    t = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumns({"__t": t})
    docs = docs.withColumns({
        "__words": F.filter(F.split("__t", r"[\x20\x09-\x0D]+"), lambda w: w != ""),
        "__lines": F.filter(F.split("__t", "\n"), lambda x: F.trim(x) != ""),
        "__chars": F.length("__t"),
        "__upper": F.length(F.regexp_replace("__t", r"[^\p{Lu}]+", "")),
        "__signs": F.length(F.regexp_replace("__t", r"[\p{L}\p{N}\s.,;:'\"-]+", "")),
        "__digits": F.length(F.regexp_replace("__t", r"[^0-9]+", "")),
    })
    kept = lambda c: F.length(F.regexp_replace("__t", rf"[^{c}]+", ""))
    docs = docs.withColumns({"__n": F.size("__words"), "__m": F.size("__lines"), "__bars": kept("|"), "__stops": kept(".!?"), "__commas": kept(","), "__bangs": kept("!")})
    docs = docs.withColumns({"__d": F.size(F.array_distinct("__words")), "__dl": F.size(F.array_distinct("__lines"))})
    n, chars, m = F.greatest("__n", F.lit(1)), F.greatest("__chars", F.lit(1)), F.greatest("__m", F.lit(1))
    stats = {
        "s_log_chars": F.log1p(F.col("__chars").cast("double")),
        "s_log_words": F.log1p(F.col("__n").cast("double")),
        "s_word_length": F.col("__chars") / n,
        "s_upper": F.col("__upper") / chars,
        "s_signs": F.col("__signs") / chars,
        "s_digits": F.col("__digits") / chars,
        "s_bars": F.col("__bars") / n,
        "s_stops": F.col("__stops") / n,
        "s_bangs": F.col("__bangs") / n,
        "s_commas": F.col("__commas") / n,
        "s_distinct_words": F.col("__d") / n,
        "s_distinct_per_root": F.col("__d") / F.sqrt(n.cast("double")),
        "s_distinct_lines": F.col("__dl") / m,
        "s_line_words": F.col("__n") / m,
        "s_log_lines": F.log1p(F.col("__m").cast("double")),
    }
    docs = docs.withColumns({k: v.cast("double") for k, v in stats.items()})
    return docs.drop(*(c for c in docs.columns if c in ("__t", "__words", "__lines", "__chars", "__upper", "__signs", "__digits", "__n", "__m", "__bars", "__stops", "__commas", "__bangs", "__d", "__dl"))), list(stats)


#: A comparison: feature, whether it is above the cut (else at or below), the cut.
Term = tuple[int, bool, float]


@dataclass
class RuleModel:
    names: list[str]
    rules: list[tuple[Term, ...]]
    weights: np.ndarray
    bias: float
    trained: bool = True

    def column(self) -> Column:
        """The score, between 0 and 1."""
        total = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.weights):
            holds = None
            for feature, above, cut in rule:
                c = F.col(self.names[feature])
                one = c > F.lit(cut) if above else c <= F.lit(cut)
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(matrix(self.rules, x) @ self.weights + self.bias)))


def matrix(rules: list[tuple[Term, ...]], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for f, above, cut in rule:
            out[:, j] *= x[:, f] > cut if above else x[:, f] <= cut
    return out


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = 0.3, least: int = 10) -> list[tuple[Term, ...]]:
    """The distinct paths of gradient-boosted trees on the logistic loss."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], 1)  # bin b: at most cut b
    z, rules = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}

    def split(rows: np.ndarray, path: tuple[Term, ...], g: np.ndarray, h: np.ndarray) -> None:
        if path:
            rules.setdefault(path)
        best = None
        if len(path) < depth and len(rows) >= 2 * least:
            gs, hs = g[rows].sum(), h[rows].sum()
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = bins[rows, f]
                gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                i = int(gain.argmax())
                if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
                    best = (gain[i], f, i)
        if best is None:
            z[rows] += rate * g[rows].sum() / (h[rows].sum() + 1)
            return
        _, f, i = best
        low = bins[rows, f] <= i
        cut = float(cuts[f][i])
        split(rows[low], (*path, (f, False, cut)), g, h)
        split(rows[~low], (*path, (f, True, cut)), g, h)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        split(np.arange(len(y)), (), y - p, p * (1 - p))
    return list(rules)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic loss plus an L1 penalty on the weights, by accelerated proximal gradient."""
    n, k = r.shape
    step = 4 * n / (np.linalg.norm(np.hstack([r, np.ones((n, 1))]), 2) ** 2)
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-(r @ v[:k] + v[k]))) - y
        u = v - step * np.append(r.T @ e, e.sum()) / n
        u[:k] = np.sign(u[:k]) * np.maximum(np.abs(u[:k]) - step * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = u + (t - 1) / s * (u - w), u, s
    return w[:k], float(w[k])


def fit(names: list[str], x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Where there are no labels the score is 0.5 throughout; where they are all the same, it is theirs with one of the other kind added."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(names, [], np.zeros(0), float(np.log(p / (1 - p))), trained=False)
    check = np.arange(len(y)) % 5 == 0 if len(y) >= 100 else np.zeros(len(y), bool)
    rules = grow_rules(x[~check], y[~check])
    r = matrix(rules, x)
    best = None
    for penalty in PENALTIES if check.any() else PENALTIES[2:3]:
        w, b = lasso(r[~check], y[~check], penalty)
        z = r[check] @ w + b
        loss = float(np.logaddexp(0, np.where(y[check] == 1, -z, z)).mean()) if check.any() else 0.0
        if best is None or loss < best[0] * 0.98:  # a weaker penalty has to pay for its rules
            best = (loss, penalty)
    w, b = lasso(r, y, best[1], 600)
    used = np.flatnonzero(w)
    return RuleModel(names, [rules[i] for i in used], w[used], b)


def held_out(doc_id, parts: int, which: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == which, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """``labels(doc_id, quality)``; documents with contradicting labels teach nothing.

    Never from documents whose crc32(doc_id as text) mod 4 is 2. The sample's ids, at most
    ``sample``, are broadcast, so the documents are not shuffled; the driver gets the statistics of
    these documents only.
    """
    chosen = labels.where(F.col("quality").isin(0, 1) & ~held_out("doc_id", 4, 2)).groupBy("doc_id").agg(F.min("quality").alias("__y"), F.max("quality").alias("__z"))
    chosen = chosen.where("__y = __z AND doc_id IS NOT NULL")
    chosen = hash_sample(chosen, chosen.count(), sample, 42, "doc_id")
    chosen = spark.createDataFrame(chosen.select(F.col("doc_id").cast("long").alias("__id"), F.col("__y").cast("int").alias("__y")).toPandas(), "__id long, __y int")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    rows, names = with_statistics(rows)
    # rows that repeat a doc_id are one, the smallest by its statistics: at most ``sample`` rows
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(*names, "__y")).alias("__row")).select("doc_id", "__row.*")
    got = rows.select("doc_id", "__y", *names).toPandas().sort_values("doc_id")
    got = got.iloc[np.random.default_rng(42).permutation(len(got))]
    return fit(names, got[names].to_numpy(float), got["__y"].to_numpy(float))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, cut: float = 0.7, sample: int = SAMPLE) -> tuple[DataFrame, RuleModel]:
    """``docs`` with held_out, score (0 to 1) and predicted (1 where score >= ``cut``), and the model.

    Scores see the text's statistics only. Null and empty texts have those of an empty text and are
    scored like others. Rows without doc_id are scored and count as not held out. Ties and repeated
    rows score alike. Without labels every score is 0.5 and ``model.trained`` is false. An empty
    table gives an empty result; input columns with the names of the new ones are replaced.
    """
    prepare(spark)
    model = train(spark, docs, labels, sample)
    docs = docs.drop("held_out", "score", "predicted")
    names = docs.columns
    rows, _ = with_statistics(docs)
    rows = rows.select(*names, held_out("doc_id", 4, 2).alias("held_out"), model.column().alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= cut).cast("int")), model


def op2_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality(spark, docs, labels)[0].select("doc_id", "held_out", "score", "predicted")
