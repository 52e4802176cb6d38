"""The corpus pipeline: five stages from raw documents to packed token windows.

Each stage takes what the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import exact, langid, minhash, packing, quality
from sessionloom.llm.common import materialise, unused, without_duplicates
from sessionloom.session import ship_package

#: Not expressible: trained models decide, and windows are packed by an algorithm.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found, as they have no letters, go."""
    ship_package(spark)
    pred = unused(docs)
    found = langid.with_language(docs, langid.fit(docs), pred_col=pred, score_col=f"{pred}score")
    return found.where(F.col(pred) != langid.UNKNOWN).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality label is likelier 0 than 1 go."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = unused(docs)
    scored = quality.with_quality(docs, quality.fit(docs, labels), score_col=name)
    return scored.where(F.col(name) >= 0.5).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the least id stays."""
    return without_duplicates(docs, exact.exact_dedup)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    ship_package(spark)
    return without_duplicates(docs, minhash.near_duplicates)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token windows."""
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; the result is the packed pieces."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = materialise(stage(spark, out, sf_dir), f"stage-{name}")
    return out
