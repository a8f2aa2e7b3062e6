"""A corpus pipeline over `documents`: every stage works on all that the one before it kept.

Language ID, near-duplicates, repeated passages, personal data, packing. All stages but the last return the columns that
they were given; columns text and n_chars change where a stage takes something out of a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import langid, neardup, packing, pii, substring_dedup
from terraloom.llm.common import Scratch, fresh, table

#: A document whose distance from the nearest language is beyond this share of the largest is in none of them.
FARTHEST = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones teach; those without a letter or far from all go."""
    language_, _, distance = names = fresh(docs, "_lang_pred", "_score", "_distance")
    found = langid.identify(docs, langid.fit(docs), names=tuple(names))
    return found.where((F.col(language_) != langid.UNKNOWN) & (F.col(distance) <= FARTHEST)).drop(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles, that with the smallest id; a null id stays.

    Rows that share an id are told apart by their texts: each stands or goes by its own text, and of rows that repeat both
    one stays.
    """
    (name,) = fresh(docs, "_text_hash")
    found = neardup.near_duplicates(docs, words=5, percent=80, by_id=False)
    kept = found.where("kept and doc_id is not null").select("doc_id", F.col("text_hash").alias(name)).distinct()
    own = docs.withColumn(name, F.xxhash64("text"))
    one = own.where("doc_id is not null").join(kept, ["doc_id", name], "left_semi").dropDuplicates(["doc_id", name])
    return one.unionByName(own.where("doc_id is null")).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the 13-word windows that one with a smaller id has; all documents stay, if only with what is left.

    Rows that share an id are each judged by their own text.
    """
    text, digest = fresh(docs, "_text", "_text_hash")
    left = substring_dedup.remove_repeats(docs).where("n_removed > 0").select("doc_id", F.col("text_hash").alias(digest), F.col("text").alias(text))
    joined = docs.withColumn(digest, F.xxhash64("text")).join(left.dropDuplicates(["doc_id", digest]), ["doc_id", digest], "left")
    return joined.select(*[new_text(c, F.col(text)) for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced by its kind in brackets."""
    masked = pii.mask(docs)
    return masked.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


def new_text(column: str, text):
    """text, or n_chars of it, where there is one; the column as it was otherwise."""
    if column == "text":
        return F.coalesce(text, F.col("text")).alias("text")
    if column == "n_chars":
        return F.when(text.isNotNull(), F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return F.col(column)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("PII", personal_data),
    ("best-fit packing", packed),
]

#: Language profiles and tokens are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs, f"stage-{k}")
    return docs
