"""The training-data pipeline: filter by quality, deduplicate, decontaminate, pseudonymise, pack.

Each stage takes the documents that its predecessor kept. All but the last return the columns
of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, neardup, packing, pii, quality
from tessera.llm.common import discard, stored
from tessera.llm.queries import tokenizer_path
from tessera.session import ship


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go; it learns from all labels. A null text is
    judged as an empty one."""
    ship(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of exact and near copies the document of the least id stays; of those without
    an id one does. A null text is an empty one."""
    ship(spark)
    return neardup.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null and empty texts stay."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of their format, keyed by the session; n_chars, where there
    is such a column, follows the text. A null text stays null."""
    out = pii.pseudonymize(docs, pii.session_key(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048: doc_id, start, length, doc_tokens, sequence_id, offset,
    ids. A null text is an empty one, whose only piece is the end id."""
    ship(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", good),
    ("near-duplicates", distinct),
    ("decontamination", decontaminated),
    ("pii", pseudonymised),
    ("packing", packed),
]

#: Learned scores, signatures, keyed permutations and token ids: SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables: list[str] = []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            served = tables.copy()
            docs = stored(docs, f"pipeline-{k + 1}", into=tables)
            discard(spark, served)
    return docs
