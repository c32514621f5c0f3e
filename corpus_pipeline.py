"""Corpus pipeline: quality rules, n-gram Jaccard join, substring dedup, mixing, packing.

Each stage takes what the one before it kept and returns a DataFrame; all but the last return the columns of documents,
whatever they are named (n_chars, where there is one, is that of the new text). A stage that gets no rows returns none.
Null texts have no words: quality rules reject them, later stages pass them on. Null doc_ids are judged as rows of their own,
have no duplicates, and lose no spans; repeated rows share their fate, but for packing, which packs each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm import jaccard, mixing, packing, quality, substring
from tidebars.llm.queries import MIX_CLIP, MIX_TARGETS, PACK_END, tokenizer_path
from tidebars.llm.store import materialize


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that are frequent in their source."""
    return _measured(quality.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of the Jaccard join; documents without doc_id stay."""
    groups = jaccard.join(docs)
    keep = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi")
    return kept.unionByName(docs.where("doc_id IS NULL"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that a document with a smaller doc_id has; a text left without words goes."""
    return _measured(substring.deduplicated(docs))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by probabilities raked to the marginals of source, language and topic.

    A language or topic that the documents lack gives its share to the others.
    """
    return mixing.sampled(docs, targets=MIX_TARGETS, strict=False, clip=MIX_CLIP)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path(), PACK_END)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mixing_weights),
    ("packing", pack_sequences),
]

#: Packing needs a tokenizer, so SQL can't give run()'s rows; tests/llm holds them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = before = materialize(docs, f"stage-{i + 1}", instead_of=before)
    return docs
