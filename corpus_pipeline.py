"""A pipeline from raw documents to token ids.

Documents that break quality rules go, one document of each group of near
copies stays, documents with benchmark passages go, personal data is masked,
and what is left is encoded. Every stage but the last returns the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.llm.bpe import ids_digest
from lintmill.llm.common import table, written
from lintmill.llm.decontaminate import drop_contaminated
from lintmill.llm.ngram_join import keep_one
from lintmill.llm.pii import sanitise
from lintmill.llm.quality_rules import keep_good
from lintmill.llm.queries import bpe


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = sanitise(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(dict(docs.dtypes)["n_chars"]), "n_chars"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without text, with their ids and the digest of the decoded bytes."""
    coded = bpe(spark).encode(docs, back=True)
    return coded.select(
        *[c for c in coded.columns if c != "decoded"],
        F.size("ids").cast("long").alias("n_tokens"),
        ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii),
    ("byte_bpe", byte_bpe),
]

#: SQL has no byte-pair encoding; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
