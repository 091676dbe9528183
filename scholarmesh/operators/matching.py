"""End-to-end matching: calls to persons, with evidence.

The two small results in between, the ranked persons and their evidence, are checkpointed: each is read by several
later steps, and recomputing the retrieval for each of them would cost a pass over the corpus every time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarmesh.operators import evidence as D
from scholarmesh.operators import retrieval as R
from scholarmesh.operators import scoring as S
from scholarmesh.session import cut_lineage


def rank_persons(chunks: DataFrame, vectors: DataFrame, profiles: DataFrame, queries: DataFrame,
                 limit: int = S.RESULT_COUNT) -> DataFrame:
    """(query_id, person_id, score, rank): hybrid hits and profile ranks combined, at most `limit` per query."""
    hits = cut_lineage(R.hybrid_chunk_search(chunks, vectors, queries, with_content=False))
    # a person without hits needs one of the best `limit` profile ranks; persons with hits keep their rank among all
    return cut_lineage(S.score_persons(hits, R.profile_ranking(profiles, queries, limit, hits), limit=limit))


def evidence_of(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, ranked: DataFrame,
                budget: int = R.EVIDENCE_BUDGET) -> DataFrame:
    """Evidence chunks of the ranked persons; at most `budget` characters per query and person."""
    return cut_lineage(R.person_evidence(chunks, vectors, queries, ranked, budget))


def match(ranked: DataFrame, lines: DataFrame, cited: DataFrame) -> DataFrame:
    """Ranked persons with percentages and shown evidence [(section, items, score)], best section first.

    `cited` are the line numbers (query_id, person_id, line_no) the explaining model relied on; without any, the lines
    of the two most similar chunks are shown.
    """
    best = lines.groupBy("query_id").agg(F.max("similarity").alias("best"))
    shown = D.group_evidence(lines, D.resolve_evidence_lines(lines, cited), best)
    nested = shown.groupBy("query_id", "person_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "section", "items", "score"))).alias("evidence"))
    return S.with_percent(ranked).join(nested, ["query_id", "person_id"], "left")
