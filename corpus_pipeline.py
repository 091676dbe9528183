"""A training corpus from raw documents, in stages that each write Parquet and read it again.

1. toxicity: documents with a toxicity of 0.5 or more go.
2. near duplicates: of each class the document with the least doc_id stays.
3. repeated passages: every string of 200 bytes that occurs elsewhere is cut out (at whole characters); documents of which
   only white space is left after a cut go.
4. secrets: reported spans are replaced by a mask.
5. packing: token windows; the only stage that does not return the columns of `documents`.

All other columns stay as they are; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmesh.llm.common import table, whole_text
from scholarmesh.llm.near_dedup import first_of_each
from scholarmesh.llm.packing import pack
from scholarmesh.llm.secret_scans import redacted
from scholarmesh.llm.suffix_dedup import cut_text
from scholarmesh.llm.token_files import shared_folder
from scholarmesh.llm.tokens import public_path
from scholarmesh.llm.toxicity import without_toxic

ORACLE_SQL = None  # language models, near duplicates and tokenizers have no SQL; tests compare with brute force


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars of the present text, if there is such a column."""
    if "n_chars" not in columns:
        return docs.select(*columns)
    return docs.withColumn("n_chars", F.length(whole_text()).cast(docs.schema["n_chars"].dataType)).select(*columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(cut_text(docs), docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(redacted(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs.select("doc_id", whole_text().alias("text")), public_path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of `documents`; every stage's result is a Parquet table in the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "corpus")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
