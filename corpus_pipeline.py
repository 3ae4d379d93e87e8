"""A training corpus from the documents table: five stages, each an operator of knowntime.llm over all that the one before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; ``run`` writes each one's rows as Parquet to the shared folder and reads
them again. All but the last return the columns of documents. SQL cannot express the stages, so ORACLE_SQL is None and the tests
hold them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knowntime.llm import mixing, ngram_join, packing, quality, suffix_dedup
from knowntime.llm.common import discard, noting, saved, table

#: Working tables of the stage that ran last. The next stage reads that stage's written rows, so it may delete them.
_spent: list[str] = []


def stage(fn: Callable) -> Callable:
    """A stage that first deletes the working tables of the one before."""
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _spent)
        with noting(_spent):
            return fn(spark, docs, sf_dir)
    return run_stage


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or lie outside their language's fertility bands."""
    rated = quality.rate_quality(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"),
                                 public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, drop=())
    return rated.where("kept").select(*COLUMNS)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least doc_id of each class of near copies; texts without words are in no class and stay.

    Repeated rows of one doc_id and text stay once. Rows without a doc_id stay if any of them has no near copy with one.
    """
    classes = ngram_join.similarity_classes(docs.select("doc_id", "text"))
    kept = classes.where("doc_id <=> component_id").select(F.col("doc_id").alias("_id")).distinct()
    once = W.partitionBy("doc_id", "_text").orderBy("lang", "source")
    return (docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
            .withColumn("_text", F.xxhash64("text")).withColumn("_no", F.row_number().over(once)).where("_no = 1").select(*COLUMNS))


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out every 50-byte passage that an earlier document has; documents of which nothing but white space is left go.

    A character that a cut went through goes as a whole. Documents that lose nothing stay as they are.
    """
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS), carry=("lang", "source"), give="text")
    return (cut.where("n_removed = 0 or trim(kept) <> ''")
            .select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars")))


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: none for a rate drawn to 0, repeats above 1."""
    out = mixing.mix(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return out.where("copies > 0").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two sequences, one row each, with their ids."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, name)
    return docs
