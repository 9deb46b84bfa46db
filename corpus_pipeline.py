"""The corpus pipeline: documents that are good, once each, without repeated passages, mixed and packed.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the next
stage's documents, the last one the packed pieces. `run` writes each stage's result as Parquet and
reads it again, so a stage starts from files and a lost executor costs part of one stage. A stage's
table is deleted once the next one is written; that of the last stage stays, as the result reads it.

Cases: null texts pass every stage as empty ones and stay null until they are packed; documents
without an id are scored, never dropped as near copies, and lose strings that documents with an id
have; null metadata counts as a value of its own; repeated rows of one id are one document from the
near-dedup on; an empty table gives an empty result; further columns pass all stages but the last,
whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import delete_path, shared_path
from weftline.llm.mixing import apply_mix, plan_mix
from weftline.llm.near_dedup import keep_one, near_classes
from weftline.llm.packing import pack
from weftline.llm.quality import keep_good, train
from weftline.llm.queries import SEQUENCE_IDS, WORD_VOCABULARY
from weftline.llm.suffix_dedup import remove_repeats
from weftline.sources import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return keep_good(docs, train(docs, read_table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return keep_one(docs, near_classes(docs))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that documents with smaller ids have; n_chars counts what is left."""
    return remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mix of sources takes them."""
    return apply_mix(docs, plan_mix(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return pack(docs, WORD_VOCABULARY, SEQUENCE_IDS)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: No SQL: training, sketches and random rounding have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table to packed pieces."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"pipeline-{uuid.uuid4().hex}-{k}")
        try:
            stage(spark, docs, sf_dir).write.parquet(path)
        except BaseException:
            delete_path(spark, path)
            raise
        finally:
            if before:
                delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
