"""The corpus pipeline: stages over the documents table, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm.common import free_name, one_row_each, removed, shared_dir
from barlight.llm.jaccard import representatives
from barlight.llm.mixing import LEVELS, WEIGHTS, domain_of, mix, mixed_documents
from barlight.llm.packing import digest, pack_documents
from barlight.llm.substrings import without_repeats
from barlight.llm.toxicity import learn

#: Mixing keeps this share of the tokens and reads no source twice, as copies were just removed.
MIX_SHARE = 0.9
MIX_EPOCHS = 1


def columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that are scored toxic (0.5 or more); all labels may be learned from."""
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs.columns, "score")
    return model.score(docs, docs.columns, score).filter(F.col(score) < 0.5).select(*columns(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep exactly one row of each class of near copies: that of the least (doc_id, hash of text, hash of row).

    A null id counts as least. Rows that repeat id and text are copies like others. Texts
    without words are copies only if equal.
    """
    names = [free_name(docs.columns, n) for n in ("id", "null", "tag")]

    def key(doc_id: Column, tag: Column) -> list[Column]:
        values = (F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), tag)
        return [v.alias(n) for v, n in zip(values, names, strict=True)]

    kept = representatives(docs).select(*key(F.col("doc_id"), F.col("tag")))
    # one row for each id and text, then a join in the same partitioning
    one = one_row_each(docs.select("*", *key(F.col("doc_id"), F.xxhash64("text"))), names)
    return one.join(kept, names, "left_semi").select(*columns(docs))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out of the texts; documents of which nothing is left go."""
    gone = free_name(docs.columns, "gone")
    found = without_repeats(docs, name=gone)
    cut = F.size(gone) > 0
    found = found.filter(~(cut & (F.trim("text") == "")))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(cut, length).otherwise(F.col("n_chars")))
    return found.select(*columns(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Select documents by domain, language and source; n_chars follows a cut text."""
    domain = free_name(docs.columns, "domain")
    levels = (domain, *LEVELS[1:])
    grouped = docs.withColumn(domain, domain_of(F.col("source")))
    chosen = mix(grouped, levels, WEIGHTS | {domain: WEIGHTS["domain"]}, MIX_SHARE, MIX_EPOCHS)
    out = mixed_documents(grouped, chosen, levels)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts into windows of at most 2048 tokens; a row per piece."""
    return digest(pack_documents(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("substrings", substrings),
    ("mixing", mixing),
    ("packing", packing),
]

#: Not in SQL: the stages score with trained trees and use a tokenizer; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read by the next.

    A stage's table is removed once the next stage is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = shared_dir(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                removed(spark, before)
            before = path
    return docs
