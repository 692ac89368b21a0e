"""A training-corpus pipeline: language ID, quality, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language_id, near_dedup, packing, quality
from millrace.llm.common import fold, fresh, load, shared_folder, small_batches
from millrace.llm.queries import GOOD_QUALITY, SURE_LANGUAGE


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language; those without letters, as null and empty texts are, or of no clear language, go.

    Each row is judged by its text alone, so repeated rows share their fate; columns of any name are kept as they are.
    """
    small_batches(spark)
    learns = F.coalesce(fold(F.col("doc_id"), 4) != 2, F.lit(False))
    said = fresh(docs, "_said")
    found = language_id.said(docs, language_id.train(docs.where(learns)), said)
    return found.where((F.col(f"{said}.lang_pred") != "und") & (F.col(f"{said}.score") >= SURE_LANGUAGE)).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose quality score is at least GOOD_QUALITY; labels are those of the input folder.

    A null text is scored as an empty one; repeated rows share their fate; columns of any name are kept as they are.
    """
    small_batches(spark)
    learns = F.coalesce(fold(F.col("doc_id"), 4) != 2, F.lit(False))
    model = quality.train(quality.measure(docs.where(learns).select("doc_id", "text")).drop("text"), load(spark, sf_dir, "labels"))
    score = fresh(docs, "_score")
    return quality.rate(docs, model, score).where(F.col(score) >= GOOD_QUALITY).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, the one of least doc_id; of repeated rows one stays, and
    other texts under the same doc_id, or under none, are documents of their own."""
    small_batches(spark)
    return near_dedup.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what was kept into sequences of at most 2048 ids; a null text is the end id alone, repeated rows are packed each."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, size=2048)


STAGES = [("language_id", identify_language), ("quality", keep_quality), ("near_dedup", drop_near_duplicates), ("packing", pack_sequences)]

#: The stages learn models and cut by a tokenizer, which SQL doesn't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result goes to the shared folder, and the one before it is removed."""
    shared, before = f"{shared_folder(spark)}/pipeline-{uuid4().hex}", None
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = f"{shared}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = out
    return docs
