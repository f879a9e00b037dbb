"""From raw documents to tokens in five stages; each stage's rows are a table in the shared folder before the next begins.

Every stage sees all that its predecessor kept, and columns it does not know pass through unread. A null text counts as an
empty one (the rules reject it). Rows are told apart by id and text: rows that share an id but not the text are documents of
their own, and a row without an id that copies another goes like any copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import bpe, decontaminate, near_copies, quality_rules, surrogates
from lorekeep.llm.common import written


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the quality rules keeps."""
    return quality_rules.apply_policy(quality_rules.ledger(docs)).filter("kept").select("row.*")


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash links, or 5-word shingles alike by 0.8) the document with the least id."""
    return near_copies.one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates, n_chars counted anew."""
    key = surrogates.session_key(spark)
    out = surrogates.replaced_texts(surrogates.checked(docs, key), key)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document, as count and digests, and the digest of what they decode to."""
    return bpe.coded_digests(docs)


STAGES = [
    ("quality rules", keep_by_rules),
    ("near copies", keep_one_of_copies),
    ("decontamination", keep_uncontaminated),
    ("personal data", replace_personal_data),
    ("tokens", encode),
]

#: Fingerprints, keyed surrogates and tokens are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
