"""The corpus pipeline: language, quality, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. A stage's result is written as
Parquet and read again as the next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonora.llm import language, quality
from sonora.llm.common import n_words, read
from sonora.llm.mixing import mix_documents
from sonora.llm.neardup import without_near_duplicates
from sonora.llm.packing import pack_documents
from sonora.runtime import shared_folder

#: Least confidence of a language prediction, and least quality score.
LANGUAGE_SCORE, QUALITY_SCORE = 0.2, 0.7


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no sure language, go. With nothing to learn from, all without letters go."""
    model = language.fit_on_fold(docs)
    out = language.identify(docs, model, docs.columns, names=("_lang_pred", "_lang_score"))
    if model.families:
        out = out.filter((F.col("_lang_pred") != language.UNDETERMINED) & (F.col("_lang_score") >= LANGUAGE_SCORE))
    else:
        out = out.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return out.select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under QUALITY_SCORE go. Without trusted positives none goes."""
    model = quality.fit_on_fold(docs, read(spark, sf_dir, "labels"))
    if not model.fitted:
        return docs
    return quality.rate(docs, model, docs.columns, name="_quality").filter(F.col("_quality") >= QUALITY_SCORE).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of smallest doc_id.

    Null, empty and blank texts stay; rows that repeat the kept doc_id all stay; a null doc_id goes where its group has another.
    """
    return without_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0, 1 or 2 rows each. Texts without a word are never taken; a null source is a source of its own."""
    return mix_documents(docs, F.array("source"), n_words(F.col("text")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens; null and empty texts are one token, and no documents give no pieces."""
    return pack_documents(docs)


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the models, sketches and tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents in turn."""
    folder, out = shared_folder(spark), read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}_{name}"
        stage(spark, out, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
    return out
