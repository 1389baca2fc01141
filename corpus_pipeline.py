"""A training corpus from raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns documents in the columns they came in; the last
returns their ids. ``run`` applies them to the documents of ``sf_dir``, each result written as
Parquet in the shared folder before the next stage reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.bpe import bpe, digest
from rasterloom.llm.common import Scratch
from rasterloom.llm.line_dedup import line_dedup
from rasterloom.llm.mixing import mix
from rasterloom.llm.near_jaccard import one_of_each
from rasterloom.llm.rule_quality import quality

TOKENIZER = "word_bpe_49k.json"


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules score 0.7 or more; all of them where there are no labels to learn from.

    Null and empty texts are scored like others. Rows without doc_id are scored, and teach nothing.
    Equal texts score alike; repeated rows are kept or go together. Columns of any other name pass
    through, but for held_out, score and predicted, whose names the classifier takes. Empty in, empty out.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored, model = quality(spark, docs, labels)
    kept = scored.where("predicted = 1") if model.trained else scored
    return kept.select(*(c for c in docs.columns if c not in ("held_out", "score", "predicted")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more of them share, but for one copy of each.

    No document goes, however many lines it loses; n_chars is counted anew. Null texts stay null, rows
    without doc_id as they are. Rows that repeat a doc_id count as one document. Columns of any other
    name pass through, but for n_lines and n_dropped. Empty in, empty out.
    """
    return _with_length(line_dedup(spark, docs).drop("n_lines", "n_dropped"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id: five words, similarity 0.8.

    Null and empty texts are like nothing and stay, as do rows without doc_id. Rows that repeat a kept
    doc_id stay. All columns pass through. Empty in, empty out.
    """
    return one_of_each(spark, docs, n=5, threshold=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document comes as often as it is taken, up to twice; those not taken and those without a word go.

    A null source is a source like others. Equal rows come equally often. Columns of any other name pass
    through, but for size, source_size, target, copies and taken. Empty in, empty out.
    """
    mixed = mix(spark, docs.withColumn("__sources", F.array("source")), sources="__sources")
    copies = F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>")))
    taken = ("size", "source_size", "target", "copies", "taken")
    return mixed.withColumn("__copy", copies).select(*(c for c in docs.columns if c not in taken))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's doc_id, number of tokens and digests of its ids and of what they decode to.

    Null and empty texts have no tokens; repeated rows come back as often. Empty in, empty out.
    """
    return digest(bpe(spark, docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: The classifier and the seeded selection aren't expressible in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for _, stage in STAGES:
            before, docs = docs, scratch.table(stage(spark, docs, sf_dir))
            scratch.drop(before)
        return scratch.keep(docs)
