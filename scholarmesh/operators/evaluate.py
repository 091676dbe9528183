"""Retrieval quality against expected persons: Hit@5, Recall@5, MRR, and the ablation over search modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarmesh.operators import retrieval as R
from scholarmesh.operators.scoring import score_persons

TOP = 5

# Search modes of the ablation as (semantic, BM25, profile).
MODES = {
    "bm25": (False, True, False),
    "semantic": (True, False, False),
    "hybrid": (True, True, False),
    "hybrid+profile": (True, True, True),
}


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, modes: list[str] = list(MODES)) -> DataFrame:
    """(mode, n_queries, hit_at_5, recall_at_5, mrr) of rankings (mode, query_id, person_id, rank from 1).

    Every labelled query counts in every mode; one without an expected person in its ranking counts as zero.
    """
    expected = gold.groupBy("query_id").agg(F.count("*").alias("n_expected"))
    found = ranked.join(gold, ["query_id", "person_id"]).groupBy("mode", "query_id").agg(
        F.count_if(F.col("rank") <= TOP).alias("n_top"), F.min("rank").alias("first"))
    per_query = expected.withColumn("mode", F.explode(F.array(*map(F.lit, modes)))).join(
        found, ["mode", "query_id"], "left")
    return per_query.groupBy("mode").agg(
        F.count("*").alias("n_queries"),
        F.round(F.avg(F.when(F.col("n_top") > 0, 1.0).otherwise(0.0)), 6).alias("hit_at_5"),
        F.round(F.avg(F.coalesce(F.col("n_top") / F.col("n_expected"), F.lit(0.0))), 6).alias("recall_at_5"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def mode_rankings(chunks: DataFrame, vectors: DataFrame, profiles: DataFrame, queries: DataFrame) -> DataFrame:
    """Full person rankings of the four modes: (mode, query_id, person_id, rank).

    The two lists and the profile ranking are the same subplans in every mode, which Spark reuses.
    """
    semantic = R._zero_based(R.knn_exact(vectors, queries), "chunk_id")
    lexical = R._zero_based(R.bm25_topk(chunks, queries), "chunk_id")
    ranking = R.profile_ranking(profiles, queries, None)
    owners = chunks.select("chunk_id", "person_id")
    out = None
    for mode, (use_semantic, use_bm25, use_profile) in MODES.items():
        lists = [leg for leg, used in ((semantic, use_semantic), (lexical, use_bm25)) if used]
        hits = R.attach(owners, R.rrf_fuse(*lists), "chunk_id")
        ranked = score_persons(hits, ranking, use_profile, None).select(
            F.lit(mode).alias("mode"), "query_id", "person_id", "rank")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def topk_gold_overlap(ranked: DataFrame, gold: DataFrame, k: int = TOP) -> DataFrame:
    """Expected persons among the first k of each query."""
    return ranked.where(F.col("rank") <= k).join(gold, ["query_id", "person_id"], "left_semi").select(
        "query_id", "person_id")
