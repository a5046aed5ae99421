"""The corpus pipeline: quality, near-dedup, decontamination, mixing, token files.

Each stage works on all documents its predecessor kept; its result is written as Parquet in the
shared checkpoint folder and read again as the next stage's documents. All stages but the last
return the columns of ``documents``; the last returns (doc_id, start, n_tokens, ids_crc32) of every
document as it stands in the token files, a document that the mix takes twice as two rows.

Defined cases. Null, empty and wordless texts are scored, resemble nothing, hold no benchmark item
and are mixed as documents of size 0. Rows of null doc_id are documents of their own; of rows with
equal doc_id and text one stays, rows of one doc_id with different texts are judged each by its own.
Of near-duplicates the smallest doc_id stays. Texts of any length are read whole. Extra columns,
whatever their names, pass all stages but the last. Without labels no document is rejected, without
benchmark none is contaminated; an empty table of documents gives an empty result. The tables
between the stages are deleted at the end of ``run``; token files stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, minhash_dedup, mixing, quality, token_files
from quillon.llm.common import materialize, table, tidy


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash_dedup.dedup(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, read back."""
    return token_files.run(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_distinct),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: Signatures, the learned classifier and alignments are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


@tidy("pipeline-result")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
