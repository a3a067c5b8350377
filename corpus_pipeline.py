"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Quality rules drop what they reject; toxicity drops what it predicts toxic; the n-gram Jaccard join leaves one
document of each group; decontamination drops documents that hold benchmark passages; packing cuts
what is left into sequences. All but the last return the columns that they get.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from momentlake.llm import toxicity
from momentlake.llm.common import shared_folder, table
from momentlake.llm.decontamination import without_contaminated
from momentlake.llm.jaccard_join import one_of_each
from momentlake.llm.packing import pack_documents
from momentlake.llm.quality_rules import quality
from momentlake.llm.queries import SEQUENCE_TOKENS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality(docs, trusted).where("kept").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=SEQUENCE_TOKENS)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]
#: The stages hash, learn and tokenize in ways that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each is written to the shared folder and read from there by the next; the one before last makes room for it."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_name, stage) in enumerate(STAGES):
        path = f"{folder}/{k % 2}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
