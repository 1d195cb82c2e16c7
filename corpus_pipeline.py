"""Training-data pipeline over the documents: toxicity, near-dedup, substring dedup, decontamination, BPE.

Each stage takes the documents its predecessor kept, as written to Parquet, and all but the last return the columns of
``documents``. Rows whose text is null or empty pass the filters unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import bpe, decontamination, neardup, substrings, toxicity
from trackspark.llm.registry import table
from trackspark.plans.lineage import shared_folder


def renamed(docs: DataFrame) -> tuple[DataFrame, list]:
    """The documents with every column but id and text under a name that no operator uses, and the way back."""
    names = {c: c if c in ("doc_id", "text") else f"__{i}_{c}" for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), [F.col(f"`{n}`").alias(c) for c, n in names.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    inner, outer = renamed(docs)
    return toxicity.score(inner, model).where(F.col("score") < toxicity.THRESHOLD).select(outer)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every near-duplicate group; rows without an id stay."""
    kept = neardup.near_duplicates(docs)
    gone = kept.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start in a smaller document too; documents that lose nothing stay as they are."""
    inner, outer = renamed(docs)
    changed = F.col("n_removed") > 0
    cut = substrings.remove_repeats(inner).withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text")))
    out = cut.select(changed.alias("__changed"), *outer)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__changed"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.drop("__changed")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; those with fewer hits stay whole."""
    inner, outer = renamed(docs)
    found = decontamination.contamination(inner, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(outer)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and the check that they decode."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Training of the toxicity model has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
