"""A corpus pipeline over documents: quality, near-duplicates, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, packing, quality, secret_scan, simhash
from tessera.llm.common import stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on labels, doesn't reject; null texts are judged as empty ones. Without labels none is kept, as each scores 0.5."""
    return quality.good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), metadata=("n_chars",))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more.

    Null and empty texts are one group, repeated rows stay once, and rows without a doc_id stay.
    """
    return simhash.one_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; null texts stay null."""
    return secret_scan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts towards their sources' target weights, in random order; null source is a source, rows of one doc_id are repeated alike.

    Columns have other names meanwhile, as documents may have some named as the copies' numbers and keys are.
    """
    plain = docs.toDF(*[c if c in ("doc_id", "text", "source") else f"column_{k}" for k, c in enumerate(docs.columns)])
    return mixing.copies(plain).select(*plain.columns).toDF(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens; a null text is its end id alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Trained models, fingerprints and tokens aren't SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it. An empty table gives no pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
