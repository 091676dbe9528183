"""What the operators share: reading tables, whole texts, reliable checkpoints."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmesh import session
from scholarmesh.functions.text import let

GAP = r"[\x20\x09-\x0D]+"  # what separates words
PART_ROWS = 100_000  # narrow rows that a partition of a counted table holds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and whole text; other columns are left at the scan."""
    return table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; before it, shuffle files of steps that nothing refers to any more are given back.

    Spark's cleaner removes them when the driver collects its garbage, which may be long after an iterative job has
    filled the executors' disks.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return session.cut_lineage(df)


def parts_for(df: DataFrame) -> int:
    """How many partitions the rows (counted) of a checkpointed table need; not fewer than there are cores."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS))


def compact(df: DataFrame) -> DataFrame:
    """A checkpoint of narrow rows that is read in no more tasks than its rows need."""
    out = cut_lineage(df)
    return out.coalesce(parts_for(out))


def hot_join(big: DataFrame, small: DataFrame, key: str, size: str, most: int = 1000) -> DataFrame:
    """Inner join with unique keys of which `size` tells the rows in `big`; both are read twice.

    Keys with at least 1 in `most` of all rows, so at most `most` keys, are broadcast; no task gets all rows of one of them.
    """
    total = small.agg(F.sum(size)).first()[0] or 0
    hot, rest = small.where(F.col(size) * most >= total), small.where(F.col(size) * most < total)
    others = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return big.join(F.broadcast(hot), key).unionByName(others)


__all__ = ["GAP", "compact", "cut_lineage", "documents", "hot_join", "let", "parts_for", "table", "whole_text"]
