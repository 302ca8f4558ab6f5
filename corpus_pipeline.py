"""Corpus pipeline: quality filter, near-duplicate removal, repeated-passage removal, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import packing, quality, simhash, suffix_dedup
from tidemark.llm.common import join_keys, materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
THRESHOLD = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour classifier scores at THRESHOLD or more."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, COLUMNS, at_least=THRESHOLD).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group.

    Rows with equal id and text are one document (named by a hash of both), different texts under one id are
    different documents.
    Rows without an id can't be the first of a group: of those, one of each text stays."""
    sha = F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit(""))
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", sha).alias("document"))
    ids = materialise(docs.select(F.xxhash64("doc_id", sha).alias("document"), "doc_id", sha.alias("sha")), "near-documents")
    groups = simhash.near_duplicates(rows.where("doc_id is not null").select(F.col("document").alias("doc_id"), "text")).withColumnRenamed("doc_id", "document")
    named = ids.where("doc_id is not null").distinct().join(groups, "document")
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "sha", "document")).alias("c")).select("c.document")
    gone = materialise(named.select("document").join(first, "document", "left_anti"), "near-gone")
    again = materialise(ids.groupBy("document").count().where("count > 1").select("document"), "near-repeated")
    kept = join_keys(rows, gone, "document", "left_anti")
    one, several = join_keys(kept, again, "document", "left_anti"), join_keys(kept, again, "document", "left_semi")
    return one.union(several.dropDuplicates(["document"])).select(*COLUMNS)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes or more that start earlier; what is removed whole goes.

    Where a cut falls inside a character, the rest of the character goes too."""
    texts = suffix_dedup.remove_repeats(docs, as_text=True).where("kept != '' or size(removed) = 0")
    texts = texts.select("doc_id", F.col("kept").alias("text"), F.length("kept").cast("long").alias("n_chars"))
    numbered = texts.where("doc_id is not null").join(docs.select("doc_id", "lang", "source").where("doc_id is not null").dropDuplicates(["doc_id"]), "doc_id")
    return numbered.select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_stage), ("SimHash near-dedup", near_duplicate_stage), ("suffix-array dedup", repeated_passage_stage), ("packing", packing_stage)]

#: No SQL knows the tokenizer or the classifier; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
