"""Per-person scores from chunk hits and profile ranks, percentages, matches of persons to calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarmesh.functions.ranking import top_k
from scholarmesh.operators import retrieval as R
from scholarmesh.session import cut_lineage

CHUNKS_PER_PERSON = 3
RESULT_COUNT = 20
CALLS_PER_PROFILE = 5


def hit_scores(hits: DataFrame, n: int = CHUNKS_PER_PERSON) -> DataFrame:
    """(query_id, person_id, chunk_score): sum of the n best fused scores, always divided by n."""
    best = top_k(hits.select("query_id", "person_id", "chunk_id", "rrf"), ["query_id", "person_id"],
                 [F.desc("rrf"), F.asc("chunk_id")], n)
    return best.groupBy("query_id", "person_id").agg((F.sum("rrf") / n).alias("chunk_score"))


def score_persons(hits: DataFrame, ranking: DataFrame, use_profile: bool = True, limit: int | None = RESULT_COUNT,
                  rrf_k: int = R.RRF_K) -> DataFrame:
    """Ranked persons (query_id, person_id, score, rank): profiles left-joined with their hit scores.

    Hits of persons without a profile drop out; persons without hits keep their profile term.
    """
    profile_term = 1.0 / (rrf_k + F.col("profile_rank")) if use_profile else F.lit(0.0)
    scored = ranking.join(hit_scores(hits), ["query_id", "person_id"], "left").select(
        "query_id", "person_id",
        F.round(F.coalesce("chunk_score", F.lit(0.0)) + profile_term, 12).alias("score"), "profile_rank")
    order = [F.desc("score"), F.asc("profile_rank")]
    if limit is None:
        w = Window.partitionBy("query_id").orderBy(*order)
        return scored.withColumn("rank", F.row_number().over(w)).drop("profile_rank")
    return top_k(scored, ["query_id"], order, limit).drop("profile_rank")


def to_percent(value: Column, best: Column) -> Column:
    """100 * value / best to one digit (half up); 0 where best is not positive."""
    return F.when(best > 0, F.round(100 * value / best, 1)).otherwise(F.lit(0.0))


def with_percent(scored: DataFrame, key: str = "query_id", value: str = "score", name: str = "percent") -> DataFrame:
    """Score as a percentage of the best of its key; the best is a partial maximum, joined back."""
    best = scored.groupBy(key).agg(F.max(value).alias("_best"))
    return scored.join(best, key).withColumn(name, to_percent(F.col(value), F.col("_best"))).drop("_best")


def calls_for_profile(calls: DataFrame, call_vectors: DataFrame, profiles: DataFrame,
                      semantic_limit: int | None, limit: int = CALLS_PER_PROFILE) -> DataFrame:
    """Calls per profile: (query_id, call_id, score, rank, percent).

    `calls` are the candidates (call_id, text), already open, academic and one per title; `profiles` are
    (query_id, keywords, vector). Both lists rank candidates only; the semantic one has the best `semantic_limit` of
    those with a vector (None: all of them). The lexical one goes on with the candidates that share no term, in the order of their (whole
    number) ids.
    """
    own = call_vectors.join(calls.select("call_id"), "call_id", "left_semi")
    most = max(1, own.count()) if semantic_limit is None else semantic_limit
    semantic = R.knn_exact(own, profiles, most, id_col="call_id").select(
        "query_id", "call_id", (F.col("rank") - 1).alias("rank0"))
    scores = R.bm25_scores(calls, R.query_terms(profiles), id_col="call_id", content="text")
    lexical = R.running_total(scores, ["query_id"], [F.desc("bm25"), F.asc("call_id")],
                              -F.ceil(F.col("bm25") * 16), name="_r").select(
        "query_id", "call_id", (F.col("_r") - 1).alias("rank0"))
    lexical = cut_lineage(lexical)
    rest = _unmatched_ranks(calls.select("call_id"), profiles.select("query_id"), lexical, semantic, limit)
    fused = R.rrf_fuse(semantic, lexical, rest, id_col="call_id").withColumnRenamed("rrf", "score")
    return with_percent(top_k(fused, ["query_id"], [F.desc("score"), F.asc("call_id")], limit))


def _unmatched_ranks(calls: DataFrame, queries: DataFrame, lexical: DataFrame, semantic: DataFrame, limit: int) -> DataFrame:
    """Lexical ranks of candidates without a shared term, which follow the others in the order of their ids.

    Wanted are those of the semantic list and, for queries with fewer than `limit` matches, the first ones by id; any
    other is behind `limit` matches in both lists. Its rank is the number of matches plus its place among all candidates
    less the matches before it.
    """
    matched = lexical.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    counts = queries.join(matched, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"))
    first = calls.orderBy("call_id").limit(2 * limit).agg(F.collect_list("call_id"))
    fill = counts.where(F.col("n") < limit).select("query_id", F.explode(first.scalar()).alias("call_id"))
    wanted = semantic.select("query_id", "call_id").unionByName(fill).distinct().join(
        lexical, ["query_id", "call_id"], "left_anti")
    bucket = F.floor(F.col("call_id") / 1024)
    places = R.running_total(calls.withColumn("_one", F.lit(1)), ["_one"], [F.asc("call_id")], bucket, name="_place").select(
        "call_id", "_place")
    seen = lexical.select("query_id", "call_id", F.lit(1).alias("_m")).unionByName(wanted.withColumn("_m", F.lit(0)))
    before = R.running_total(seen, ["query_id"], [F.asc("call_id")], bucket, F.col("_m"), "_before").where("_m = 0")
    return before.join(counts, "query_id").join(places, "call_id").select(
        "query_id", "call_id", (F.col("n") + F.col("_place") - 1 - F.col("_before")).alias("rank0"))
