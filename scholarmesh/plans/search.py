"""Registered queries of retrieval, ranking, evidence and evaluation, each with its SQL check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmesh.functions import text as X
from scholarmesh.operators import evaluate as V
from scholarmesh.operators import evidence as D
from scholarmesh.operators import matching as M
from scholarmesh.operators import people as P
from scholarmesh.operators import retrieval as R
from scholarmesh.operators import scoring as S
from scholarmesh.operators import search_index as IX
from scholarmesh.plans import bindings as B
from scholarmesh.plans import sql as Q
from scholarmesh.session import cut_lineage, shared_folder
from scholarmesh.sources.sinks import match_csv_rows, read_match_csv, write_match_csv


def _parts(s: SparkSession, f: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return B.chunks(s, f), B.vectors(s, f), B.queries(s, f)


def _scored(s: SparkSession, f: str) -> DataFrame:
    c, v, q = _parts(s, f)
    return M.rank_persons(c, v, B.profiles(s, f), q)


def _evidence(s: SparkSession, f: str, scored: DataFrame | None = None) -> DataFrame:
    c, v, q = _parts(s, f)
    return M.evidence_of(c, v, q, _scored(s, f) if scored is None else scored)


def _lines(s: SparkSession, f: str, scored: DataFrame | None = None) -> DataFrame:
    return cut_lineage(D.number_lines(_evidence(s, f, scored).select(
        "query_id", "person_id", "evidence_rank", "section", "similarity", "content")))


def _cited(lines: DataFrame) -> DataFrame:
    """A stand-in for the model's answer: it cites the lines that hold a digit, and one line that does not exist."""
    digits = lines.where(F.col("text").rlike("[0-9]")).select("query_id", "person_id", "line_no")
    return digits.unionByName(digits.withColumn("line_no", F.col("line_no") + 1_000_000))


CITED = """cited AS (SELECT query_id, person_id, line_no FROM lines WHERE regexp_matches(text, '[0-9]'))"""


def _topics(s: SparkSession, f: str, scored: DataFrame) -> DataFrame:
    """Wanted topics: the distinct words of five letters or more of a query, numbered."""
    words = F.array_distinct(F.filter(F.split("keywords", r"\s+"), lambda w: F.length(w) >= 5))
    topics = B.queries(s, f).select("query_id", F.posexplode(words).alias("_p", "topic"))
    return scored.select("query_id", "person_id").join(topics, "query_id").select(
        "query_id", "person_id", (F.col("_p") + 1).alias("topic_no"), "topic")


def _topic_lines(topics: DataFrame, lines: DataFrame) -> DataFrame:
    """Stand-in answer: topic n is met by line n of the pair where that line is longer than 200 characters."""
    long = lines.where(F.length("text") > 200).select("query_id", "person_id", "line_no")
    return topics.select("query_id", "person_id", "topic_no", F.col("topic_no").alias("line_no")).join(
        long, ["query_id", "person_id", "line_no"])


TOPICS = r"""topics AS (SELECT query_id, person_id, i AS topic_no, w[i] AS topic FROM scored
    JOIN (SELECT query_id, list(v ORDER BY first_at) AS w FROM (
        SELECT query_id, v, min(i) AS first_at FROM (
          SELECT query_id, unnest(a) AS v, generate_subscripts(a, 1) AS i FROM (
            SELECT query_id, list_filter(string_split_regex(keywords, '\s+'), lambda w: length(w) >= 5) AS a FROM q))
        GROUP BY ALL) GROUP BY ALL) y USING (query_id) CROSS JOIN range(1, 200) r(i) WHERE i <= len(w)),
missing AS (SELECT t.query_id, t.person_id, t.topic_no, t.topic FROM topics t LEFT JOIN
      (SELECT query_id, person_id, line_no FROM lines WHERE length(text) > 200) l
      ON l.query_id = t.query_id AND l.person_id = t.person_id AND l.line_no = t.topic_no WHERE l.line_no IS NULL)"""


def tokenize(s: SparkSession, f: str) -> DataFrame:
    tokens = B.chunks(s, f).select("chunk_id", X.tokenize(F.col("content")).alias("t"))
    return tokens.select("chunk_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def bm25_topk(s: SparkSession, f: str) -> DataFrame:
    c, _, q = _parts(s, f)
    return R.bm25_topk(c, q)


def index_search(s: SparkSession, f: str) -> DataFrame:
    """BM25 read from a stored index of all documents."""
    path = shared_folder(s, "index")
    IX.build_index(B.chunks(s, f), path)
    return IX.search_index(s, path, B.queries(s, f))


def index_search_after_changes(s: SparkSession, f: str) -> DataFrame:
    """The index of an earlier state, brought to the present documents and searched.

    In the earlier state German and Spanish texts are missing, texts with a digit are reversed, and every French or English
    text exists under one more number that is gone today, so chunks are added, changed and deleted.
    """
    now, path = B.chunks(s, f), shared_folder(s, "index")
    text = F.when(F.col("content").rlike("[0-9]"), F.reverse("content")).otherwise(F.col("content"))
    here = F.col("section").isin("en", "fr")
    gone = now.where(here).withColumn("chunk_id", -1 - F.col("chunk_id"))
    IX.build_index(now.where(here | F.col("section").isNull()).withColumn("content", text).unionByName(gone), path)
    IX.refresh_index(now, path)
    return IX.search_index(s, path, B.queries(s, f))


def bm25_topk_with_zero(s: SparkSession, f: str) -> DataFrame:
    """Queries of the last word only have few matches, so the rest of the list is filled."""
    c, _, q = _parts(s, f)
    one = q.select("query_id", F.element_at(F.split("keywords", " "), -1).alias("keywords"))
    return R.bm25_topk(c, one, include_zero=True)


def knn_exact(s: SparkSession, f: str) -> DataFrame:
    _, v, q = _parts(s, f)
    return R.knn_exact(v, q)


def knn_approx(s: SparkSession, f: str) -> DataFrame:
    """Approximate hits with their membership in the exact result, so that recall can be read off."""
    _, v, q = _parts(s, f)
    exact = R.knn_exact(v, q).select("query_id", "chunk_id", F.lit(True).alias("is_exact_hit"))
    return R.knn_approx(v, q).join(exact, ["query_id", "chunk_id"], "left").na.fill(False, ["is_exact_hit"])


def rrf_fuse(s: SparkSession, f: str) -> DataFrame:
    c, v, q = _parts(s, f)
    return R.rrf_fuse(R._zero_based(R.knn_exact(v, q), "chunk_id"), R._zero_based(R.bm25_topk(c, q), "chunk_id"))


def union_hits(s: SparkSession, f: str) -> DataFrame:
    c, v, q = _parts(s, f)
    semantic = R.knn_exact(v, q).select("query_id", "chunk_id", F.lit("semantic").alias("leg"), "rank")
    return R.union_hits(semantic, R.bm25_topk(c, q).select("query_id", "chunk_id", F.lit("bm25").alias("leg"), "rank"))


def hybrid_chunk_search(s: SparkSession, f: str) -> DataFrame:
    c, v, q = _parts(s, f)
    hits = R.hybrid_chunk_search(c, v, q)
    return hits.select("query_id", "chunk_id", "person_id", "section", F.length("content").alias("n_chars"), "rrf")


def profile_ranking(s: SparkSession, f: str) -> DataFrame:
    return R.profile_ranking(B.profiles(s, f), B.queries(s, f), None)


def score_persons(s: SparkSession, f: str) -> DataFrame:
    return _scored(s, f)


def scores_without_profile(s: SparkSession, f: str) -> DataFrame:
    c, v, q = _parts(s, f)
    hits = R.hybrid_chunk_search(c, v, q, with_content=False)
    return S.score_persons(hits, R.profile_ranking(B.profiles(s, f), q, None), use_profile=False)


def to_percent(s: SparkSession, f: str) -> DataFrame:
    return S.with_percent(_scored(s, f)).select("query_id", "person_id", "percent")


def person_evidence(s: SparkSession, f: str) -> DataFrame:
    return _evidence(s, f).select("query_id", "person_id", "chunk_id", "section", F.length("content").alias("n_chars"),
                                  "evidence_rank", "rrf", "similarity")


def index_signature(s: SparkSession, f: str) -> DataFrame:
    return R.index_signature(B.chunks(s, f))


def number_lines(s: SparkSession, f: str) -> DataFrame:
    return _lines(s, f).select("query_id", "person_id", "evidence_rank", "line_no", F.md5("text").alias("text_md5"))


def resolve_evidence_lines(s: SparkSession, f: str) -> DataFrame:
    lines = _lines(s, f)
    return D.resolve_evidence_lines(lines, _cited(lines)).select("query_id", "person_id", "line_no")


def missing_topics(s: SparkSession, f: str) -> DataFrame:
    scored = _scored(s, f)
    topics, lines = _topics(s, f, scored), _lines(s, f, scored)
    return D.missing_topics(topics, _topic_lines(topics, lines), lines)


def render_rationale(s: SparkSession, f: str) -> DataFrame:
    scored = _scored(s, f)
    topics, lines = _topics(s, f, scored), _lines(s, f, scored)
    sentence = D.missing_sentence(D.missing_topics(topics, _topic_lines(topics, lines), lines))
    text = F.concat(F.lit("Çalışmaları ("), F.lit("S"), F.col("rank").cast("string"), F.lit(", S12) "),
                    F.col("person_id"), F.lit(" , U3 ve U4 ile desteklenir ."))
    return scored.join(sentence, ["query_id", "person_id"], "left").select(
        "query_id", "person_id", D.render_rationale(text, F.col("sentence")).alias("rationale"))


def _groups(lines: DataFrame) -> DataFrame:
    best = lines.groupBy("query_id").agg(F.max("similarity").alias("best"))
    return D.group_evidence(lines, D.resolve_evidence_lines(lines, _cited(lines)), best)


def group_evidence(s: SparkSession, f: str) -> DataFrame:
    return _groups(_lines(s, f)).select("query_id", "person_id", "section", "score", "position",
                                        F.size("items").alias("n_items"), F.md5(F.array_join("items", "\n")).alias("items_md5"))


def assemble_prompts(s: SparkSession, f: str) -> DataFrame:
    scored = _scored(s, f)
    evidence = _evidence(s, f, scored)
    columns = ["query_id", "person_id", "evidence_rank"]
    lines = D.number_lines(evidence.select(*columns, "content"))
    headers = evidence.select(*columns, F.element_at(F.split("content", "\n"), 1).alias("header"))
    persons = scored.select("query_id", "person_id", F.lit(None).cast("string").alias("title"),
                                   F.col("person_id").alias("name"), F.lit(None).cast("string").alias("unit"))
    words = F.array_distinct(F.filter(F.split("keywords", r"\s+"), lambda w: F.length(w) >= 9))
    queries = B.queries(s, f).select("query_id", words.alias("expertise"))
    return D.assemble_prompts(lines, headers, queries, persons).select(
        "query_id", "person_id", "person", F.length("topics").alias("n_topic_chars"),
        F.length("evidence").alias("n_chars"), F.md5("evidence").alias("evidence_md5"))


def match(s: SparkSession, f: str) -> DataFrame:
    """All queries at once: retrieval, scores, evidence, evidence groups, percentages."""
    scored = _scored(s, f)
    lines = _lines(s, f, scored)
    e = F.coalesce("evidence.score", F.array().cast("array<double>"))
    return M.match(scored, lines, _cited(lines)).select(
        "query_id", "rank", "person_id", "score", "percent", F.size(e).alias("n_sections"),
        F.coalesce(F.array_max(e), F.lit(0.0)).alias("best_evidence"))


def match_csv(s: SparkSession, f: str) -> DataFrame:
    """The export, written and read back: matches with the shown evidence of each section as label and items."""
    scored = _scored(s, f)
    lines = _lines(s, f, scored)
    matched = M.match(scored, lines, _cited(lines))
    none = F.lit(None).cast("string")
    shown = F.transform(F.coalesce("evidence", F.array().cast(matched.schema["evidence"].dataType)),
                        lambda e: F.struct(e["section"].alias("label"), e["items"].alias("items")))
    rows = matched.select("query_id", "rank", none.alias("title"), F.col("person_id").alias("name"),
                          none.alias("university"), none.alias("department"), "percent", none.alias("rationale"),
                          shown.alias("evidence"))
    folder = shared_folder(s, "matches")
    write_match_csv(match_csv_rows(rows), folder)
    return read_match_csv(s, folder).select("query_id", "rank", "name", "score", F.md5("evidence").alias("evidence_md5"))


SEMANTIC_CALLS = 1000  # fixed value: length of the semantic list of this query


def calls_for_profile(s: SparkSession, f: str) -> DataFrame:
    from scholarmesh.operators import calls as C

    open_calls = C.open_academic_calls(B.calls(s, f), B.today())
    candidates = C.newest_per_title(open_calls).select("call_id", C.call_text(
        F.col("title"), F.col("program_code"), F.col("program_name"), F.col("summary"), F.col("text")).alias("text"))
    titles = B.table(s, f, "part").select("p_name", "p_brand", "p_type").distinct()
    vecs = B.profiles(s, f)
    # keywords of a person: the part names that hold the last digit of the person's number
    keywords = vecs.select("person_id").join(
        titles.where(F.col("p_name").isNotNull()), F.element_at(F.split("person_id", "c"), 2) == F.element_at(
            F.split("p_brand", "#"), 2)).groupBy("person_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "p_name", "p_type"))), " ").alias("keywords"))
    profiles = vecs.join(keywords, "person_id").select(
        F.col("person_id").alias("query_id"), "keywords", F.col("embedding").alias("vector"))
    return S.calls_for_profile(candidates, B.call_vectors(s, f), profiles, SEMANTIC_CALLS).select(
        F.col("query_id").alias("person_id"), "call_id", "score", "rank", "percent")


def _gold_run(s: SparkSession, f: str) -> tuple[DataFrame, DataFrame]:
    c, v, q = _parts(s, f)
    gold = B.gold(s, f).join(q.select("query_id"), "query_id", "left_semi")
    return V.mode_rankings(c, v, B.profiles(s, f), q), gold


def retrieval_metrics(s: SparkSession, f: str) -> DataFrame:
    ranked = _scored(s, f).withColumn("mode", F.lit("hybrid+profile"))
    return V.retrieval_metrics(ranked, B.gold(s, f).join(B.queries(s, f).select("query_id"), "query_id", "left_semi"),
                               ["hybrid+profile"])


def ablation_run(s: SparkSession, f: str) -> DataFrame:
    ranked, gold = _gold_run(s, f)
    return V.retrieval_metrics(ranked, gold)


def topk_gold_overlap(s: SparkSession, f: str) -> DataFrame:
    return V.topk_gold_overlap(_scored(s, f), B.gold(s, f))


def _baseline(s: SparkSession, f: str) -> tuple[DataFrame, DataFrame]:
    items = B.chunks(s, f).select(F.col("chunk_id").alias("item_id"), "person_id", "section", F.col("content").alias("text"))
    queries = B.table(s, f, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    wanted = queries.select("query_id", F.explode(F.split("text", r"\s+")).alias("term")).where(F.length("term") >= 9)
    expertise = items.select("person_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("term")).distinct()
    return P.overlap_rank(queries, wanted, expertise, items), P.item_overlaps(items, queries)


def overlap_rank(s: SparkSession, f: str) -> DataFrame:
    return _baseline(s, f)[0]


def overlap_evidence(s: SparkSession, f: str) -> DataFrame:
    return P.overlap_evidence(*_baseline(s, f))


STOPS = ", ".join(f"'{w}'" for w in P.BASELINE_STOP_WORDS)


def _stems(x: str) -> str:
    return (f"list_distinct(list_transform(list_filter(regexp_extract_all({Q.tr_lower(x)}, '[a-zçğıöşüâîû]+'), "
            f"lambda w: length(w) > 2 AND w NOT IN ({STOPS})), lambda w: left(w, 5)))")


BASELINE = rf"""bt AS MATERIALIZED (SELECT doc_id AS item_id, source AS person_id, lang AS section, text, {_stems('text')} AS t FROM documents),
bq AS MATERIALIZED (SELECT item_id AS query_id, text, {_stems('text')} AS t FROM benchmark),
ov AS MATERIALIZED (SELECT query_id, item_id, person_id, section, round(n / sqrt(nt), 6) AS item_score FROM (
    SELECT query_id, i.item_id, person_id, section, any_value(nt) AS nt, count(*) AS n
    FROM (SELECT item_id, person_id, section, len(t) AS nt, unnest(t) AS s FROM bt) i
      JOIN (SELECT query_id, unnest(t) AS s FROM bq) q ON q.s = i.s GROUP BY ALL)),
wt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(string_split_regex(text, '\s+')) AS term FROM bq)
    WHERE length(term) >= 9),
ex AS MATERIALIZED (SELECT DISTINCT person_id, unnest(string_split_regex(text, '\s+')) AS term FROM bt),
exact AS (SELECT DISTINCT query_id, person_id, wt.term FROM wt JOIN ex ON {Q.tr_lower('wt.term')} = {Q.tr_lower('ex.term')}),
part_ AS (SELECT DISTINCT query_id, person_id, w.term FROM
    (SELECT query_id, term, unnest({_stems('term')}) AS s FROM wt) w
    JOIN (SELECT person_id, unnest({_stems('term')}) AS s FROM ex) e ON w.s = e.s),
cnt AS (SELECT query_id, person_id, count(*) FILTER (m = 2) AS n_exact, count(*) FILTER (m = 1) AS n_partial FROM (
    SELECT query_id, person_id, term, max(m) AS m FROM (
      SELECT *, 2 AS m FROM exact UNION ALL SELECT *, 1 AS m FROM part_) GROUP BY ALL) GROUP BY ALL),
best AS (SELECT query_id, person_id, sum(item_score) AS i FROM {Q.top('ov', 'query_id, person_id', 'item_score DESC, item_id', 10)} GROUP BY ALL),
raws AS (SELECT query_id, person_id, coalesce(n_exact, 0) AS n_exact, coalesce(n_partial, 0) AS n_partial,
      round(3.0::DOUBLE * coalesce(n_exact, 0) + coalesce(n_partial, 0) + 0.6::DOUBLE * coalesce(i, 0), 6) AS raw
    FROM cnt FULL JOIN best USING (query_id, person_id)),
ranked AS MATERIALIZED {Q.top('raws', 'query_id', 'raw DESC, person_id', 5)}"""

GOLD = r"""items AS MATERIALIZED (SELECT item_id AS query_id, ' ' || array_to_string(string_split_regex(trim(lower(text)), '\s+'), ' ') || ' ' AS p FROM benchmark),
dw AS MATERIALIZED (SELECT source AS person_id, ' ' || array_to_string(string_split_regex(trim(lower(text)), '\s+'), ' ') || ' ' AS t FROM documents),
gold_all AS MATERIALIZED (SELECT DISTINCT query_id, person_id FROM dw JOIN items ON contains(t, p)),
gold AS MATERIALIZED (SELECT * FROM gold_all WHERE query_id IN (SELECT query_id FROM q))"""

METRICS = """SELECT mode, count(*) AS n_queries, round(avg(CASE WHEN n_top > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_5,
  round(avg(coalesce(n_top::DOUBLE / n_expected, 0)), 6) AS recall_at_5, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr
FROM (SELECT * FROM (SELECT query_id, count(*) AS n_expected FROM gold GROUP BY query_id) CROSS JOIN modes) LEFT JOIN (
  SELECT mode, query_id, count(*) FILTER (rank <= 5) AS n_top, min(rank)::DOUBLE AS first FROM ranks JOIN gold USING (query_id, person_id) GROUP BY ALL)
  USING (mode, query_id) GROUP BY mode"""


def _mode(mode: str, legs: list[str], profile: bool) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, chunk_id, rank FROM {leg}" for leg in legs)
    term = "1.0::DOUBLE / (60 + profile_rank)" if profile else "0"
    return f"""SELECT '{mode}' AS mode, query_id, person_id,
      row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(cs, 0) + {term}, 12) DESC, profile_rank) AS rank
    FROM prank LEFT JOIN (SELECT query_id, person_id, sum(rrf) / 3 AS cs FROM (
        SELECT query_id, source AS person_id, rrf, row_number() OVER (PARTITION BY query_id, source ORDER BY rrf DESC, chunk_id) AS r
        FROM (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (59 + rank)) AS rrf FROM ({union}) GROUP BY ALL)
        JOIN documents ON chunk_id = doc_id) WHERE r <= 3 GROUP BY ALL) USING (query_id, person_id)"""


SHOWN = f"""{CITED},
pairs AS (SELECT DISTINCT query_id, person_id FROM cited),
rest AS (SELECT * FROM lines ANTI JOIN pairs USING (query_id, person_id)),
near AS (SELECT query_id, person_id, evidence_rank, c FROM {Q.top('(SELECT DISTINCT query_id, person_id, evidence_rank, similarity FROM rest)', 'query_id, person_id', 'similarity DESC, evidence_rank', 2, 'c')}),
heads AS {Q.top('(SELECT rest.*, c FROM rest JOIN near USING (query_id, person_id, evidence_rank))', 'query_id, person_id, evidence_rank', 'line_no', 3, 'h')},
shown AS (SELECT query_id, person_id, section, text, similarity, line_no, 0 AS o FROM lines SEMI JOIN cited USING (query_id, person_id, line_no)
    UNION ALL SELECT query_id, person_id, section, text, similarity, line_no, c AS o FROM heads),
keyed AS (SELECT *, trim(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS k FROM shown),
uniq AS {Q.top('keyed', 'query_id, person_id, k', 'o, line_no', 1, 'r')},
best AS (SELECT query_id, max(similarity) AS best FROM lines GROUP BY query_id),
groups AS (SELECT query_id, person_id, section, list(text ORDER BY o, line_no) AS items,
      round(100 * max(similarity) / any_value(best), 1) AS raw_score, any_value(best) AS best, min(o * 1000000000 + line_no) AS f
    FROM uniq JOIN best USING (query_id) GROUP BY ALL),
shown_groups AS MATERIALIZED (SELECT query_id, person_id, section, items, CASE WHEN best > 0 THEN raw_score ELSE 0 END AS score,
      row_number() OVER (PARTITION BY query_id, person_id ORDER BY CASE WHEN best > 0 THEN raw_score ELSE 0 END DESC, f) AS position FROM groups)"""

W, BASE, EV = "WITH ", Q.BASE, Q.BASE + ",\n" + Q.EVIDENCE

PERCENT = "round(100 * score / max(score) OVER (PARTITION BY query_id), 1)"

ENTRIES = {
    "tokenize": (tokenize, f"SELECT doc_id AS chunk_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 "
                           f"FROM (SELECT doc_id, {Q.tokens('text')} AS t FROM documents)"),
    "bm25_topk": (bm25_topk, f"{W}{BASE} SELECT query_id, chunk_id, round(bm25, 6) AS bm25, rank FROM lex"),
    "index_search": (index_search, f"{W}{BASE} SELECT query_id, chunk_id, round(bm25, 6) AS bm25, rank FROM lex"),
    "index_search_after_changes": (
        index_search_after_changes, f"{W}{BASE} SELECT query_id, chunk_id, round(bm25, 6) AS bm25, rank FROM lex"),
    "bm25_topk_with_zero": (bm25_topk_with_zero, f"""WITH q AS (SELECT item_id AS query_id, string_split(b.text, ' ')[-1] AS keywords
        FROM benchmark b JOIN embeddings ON item_id = vec_id), {Q.QUERY_TERMS}, {Q.bm25('documents', 'doc_id', 'text')},
        al AS (SELECT q.query_id, d.doc_id, coalesce(bm25, 0) AS bm25 FROM q CROSS JOIN documents d LEFT JOIN bm USING (query_id, doc_id))
        SELECT query_id, doc_id AS chunk_id, round(bm25, 6) AS bm25, rank FROM {Q.top('al', 'query_id', 'bm25 DESC, doc_id', 50)}"""),
    "knn_exact": (knn_exact, f"WITH {Q.QUERIES}, {Q.SEMANTIC} SELECT query_id, chunk_id, round(similarity, 6) AS similarity, "
                             "round(1 - similarity, 6) AS distance, rank FROM sem"),
    "knn_approx": (knn_approx, None),
    "rrf_fuse": (rrf_fuse, f"{W}{BASE} SELECT query_id, chunk_id, round(rrf, 6) AS rrf FROM fused"),
    "union_hits": (union_hits, f"{W}{BASE} SELECT query_id, chunk_id, CASE WHEN lex.rank IS NULL THEN 'semantic' ELSE 'bm25' END AS leg, "
                               "coalesce(lex.rank, sem.rank) AS rank FROM sem FULL JOIN lex USING (query_id, chunk_id)"),
    "hybrid_chunk_search": (hybrid_chunk_search, f"{W}{BASE} SELECT query_id, chunk_id, person_id, section, length(text) AS n_chars, "
                                                 "round(rrf, 6) AS rrf FROM hits JOIN documents ON chunk_id = doc_id"),
    "profile_ranking": (profile_ranking, f"WITH {Q.QUERIES}, {Q.PROFILES} SELECT query_id, person_id, round(similarity, 6) AS similarity, profile_rank FROM prank"),
    "score_persons": (score_persons, f"{W}{BASE} SELECT query_id, person_id, round(score, 6) AS score, rank FROM scored"),
    "scores_without_profile": (scores_without_profile, f"""{W}{BASE}, x AS (SELECT query_id, person_id, profile_rank, round(coalesce(chunk_score, 0), 12) AS score
        FROM prank LEFT JOIN chunk_score USING (query_id, person_id)) SELECT query_id, person_id, round(score, 6) AS score, rank FROM {Q.top('x', 'query_id', 'score DESC, profile_rank', 20)}"""),
    "to_percent": (to_percent, f"{W}{BASE} SELECT query_id, person_id, {PERCENT} AS percent FROM scored"),
    "person_evidence": (person_evidence, f"{W}{EV} SELECT query_id, person_id, chunk_id, section, length(content) AS n_chars, evidence_rank, "
                                         "round(rrf, 6) AS rrf, round(similarity, 6) AS similarity FROM evidence"),
    "index_signature": (index_signature, """SELECT count(*) AS n_chunks, count(*) || ':' || sum(('0x' || substr(h, 1, 12))::BIGINT) || ':' ||
        sum(('0x' || substr(h, 13, 12))::BIGINT) AS signature FROM (SELECT md5(doc_id || chr(31) || md5(text)) AS h FROM documents)"""),
    "number_lines": (number_lines, f"{W}{EV} SELECT query_id, person_id, evidence_rank, line_no, md5(text) AS text_md5 FROM lines"),
    "resolve_evidence_lines": (resolve_evidence_lines, f"{W}{EV}, {CITED} SELECT query_id, person_id, line_no FROM cited"),
    "missing_topics": (missing_topics, f"{W}{EV}, {TOPICS} SELECT query_id, person_id, topic_no, topic FROM missing"),
    "render_rationale": (render_rationale, f"""{W}{EV}, {TOPICS},
        sent AS (SELECT query_id, person_id, 'CV''de karşılığı bulunamayan aranan konular: ' || array_to_string(list(topic ORDER BY topic_no)[1:4], ', ')
          || CASE WHEN count(*) > 4 THEN ' (+' || (count(*) - 4) || ')' ELSE '' END || '.' AS sentence FROM missing GROUP BY ALL)
        SELECT query_id, person_id, concat_ws(' ', 'Çalışmaları ' || person_id || ', ile desteklenir.', sentence) AS rationale
        FROM scored LEFT JOIN sent USING (query_id, person_id)"""),
    "group_evidence": (group_evidence, f"{W}{EV}, {SHOWN} SELECT query_id, person_id, section, score, position, len(items) AS n_items, "
                                       "md5(array_to_string(items, chr(10))) AS items_md5 FROM shown_groups"),
    "assemble_prompts": (assemble_prompts, rf"""{W}{EV},
        topic AS (SELECT query_id, list(v ORDER BY i) AS w FROM (SELECT query_id, v, min(i) AS i FROM (
            SELECT query_id, unnest(a) AS v, generate_subscripts(a, 1) AS i FROM (SELECT query_id,
              list_filter(string_split_regex(keywords, '\s+'), lambda w: length(w) >= 9) AS a FROM q)) GROUP BY ALL) GROUP BY ALL),
        topics AS (SELECT query_id, CASE WHEN w IS NULL THEN '(belirtilmemiş)' ELSE array_to_string(list_transform(w, lambda u, i: 'U' || i || ': ' || u), chr(10)) END AS topics
          FROM q LEFT JOIN topic USING (query_id)),
        block AS (SELECT e.query_id, e.person_id, e.evidence_rank, concat_ws(chr(10), string_split(any_value(content), chr(10))[1],
            string_agg('S' || line_no || ': ' || text, chr(10) ORDER BY line_no)) AS b
          FROM evidence e LEFT JOIN lines USING (query_id, person_id, evidence_rank) GROUP BY ALL),
        blocks AS (SELECT query_id, person_id, string_agg(b, chr(10) || chr(10) ORDER BY evidence_rank) AS evidence FROM block GROUP BY ALL)
        SELECT s.query_id, s.person_id, trim(' ' || s.person_id || ' - ') AS person, length(topics) AS n_topic_chars,
          length(coalesce(evidence, '(eşleşen CV parçası yok)')) AS n_chars, md5(coalesce(evidence, '(eşleşen CV parçası yok)')) AS evidence_md5
        FROM scored s JOIN topics USING (query_id) LEFT JOIN blocks USING (query_id, person_id)"""),
    "match": (match, f"""{W}{EV}, {SHOWN}, n AS (SELECT query_id, person_id, count(*) AS n_sections, max(score) AS best_evidence FROM shown_groups GROUP BY ALL)
        SELECT query_id, rank, person_id, round(score, 6) AS score, {PERCENT} AS percent, coalesce(n_sections, 0) AS n_sections,
          coalesce(best_evidence, 0)::DOUBLE AS best_evidence FROM scored LEFT JOIN n USING (query_id, person_id)"""),
    "write_match_csv": (match_csv, f"""{W}{EV}, {SHOWN}, ev AS (SELECT query_id, person_id, string_agg(section || ': ' || array_to_string(items, '; '), ' | ' ORDER BY position) AS evidence
          FROM shown_groups GROUP BY ALL), p AS (SELECT *, {PERCENT} AS percent FROM scored)
        SELECT query_id, rank, upper(left(person_id, 1)) || lower(substr(person_id, 2)) AS name, floor(percent + 0.5)::BIGINT AS score,
          md5(coalesce(evidence, '')) AS evidence_md5 FROM p LEFT JOIN ev USING (query_id, person_id)"""),
    "calls_for_profile": (calls_for_profile, f"""WITH {Q.CALLS}, {Q.PROFILES.replace(', q)', ', (SELECT NULL AS query_id, NULL::DOUBLE[] AS vector))')},
        open AS (SELECT * FROM calls WHERE audience = 'academic' AND (deadline IS NULL OR deadline >= {Q.TODAY})),
        cand AS MATERIALIZED (SELECT call_id, left(concat_ws(chr(10), nullif(title, ''), nullif(concat_ws(' ', program_code, program_name), ''), nullif(summary, ''), nullif(text, '')), 6000) AS text
          FROM (SELECT *, row_number() OVER (PARTITION BY {Q.fold('title')} ORDER BY publish_date DESC NULLS LAST, call_id) AS r FROM open) WHERE r = 1),
        q AS (SELECT person_id AS query_id, keywords, embedding AS vector FROM pv JOIN (
          SELECT DISTINCT source AS person_id FROM documents) USING (person_id) JOIN (
          SELECT 'src' || string_split(p_brand, '#')[2] AS person_id, string_agg(DISTINCT p_name || ' ' || p_type, ' ' ORDER BY p_name || ' ' || p_type) AS keywords FROM part GROUP BY ALL) USING (person_id)),
        {Q.QUERY_TERMS}, {Q.bm25('cand', 'call_id', 'text')},
        csim AS (SELECT query_id, vec_id AS call_id, round(list_cosine_similarity(embedding::DOUBLE[], vector), 12) AS s FROM embeddings SEMI JOIN cand ON call_id = vec_id, q),
        top1000 AS {Q.top('csim', 'query_id', 's DESC, call_id', 1000)},
        a AS (SELECT query_id, call_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS r FROM top1000),
        b AS (SELECT query_id, call_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(bm25, 0) DESC, call_id) - 1 AS r
          FROM (SELECT query_id, call_id FROM q CROSS JOIN cand) LEFT JOIN bm USING (query_id, call_id)),
        fu AS (SELECT query_id, call_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
        SELECT query_id AS person_id, call_id, round(score, 6) AS score, rank, {PERCENT} AS percent FROM {Q.top('fu', 'query_id', 'score DESC, call_id', 5)}"""),
    "retrieval_metrics": (retrieval_metrics, f"""{W}{BASE}, {GOLD}, modes AS (SELECT 'hybrid+profile' AS mode),
        ranks AS (SELECT 'hybrid+profile' AS mode, query_id, person_id, rank FROM scored) {METRICS}"""),
    "ablation_run": (ablation_run, f"""{W}{BASE}, {GOLD}, modes AS (SELECT unnest(['bm25', 'semantic', 'hybrid', 'hybrid+profile']) AS mode),
        ranks AS MATERIALIZED ({_mode('bm25', ['lex'], False)} UNION ALL {_mode('semantic', ['sem'], False)} UNION ALL
          {_mode('hybrid', ['sem', 'lex'], False)} UNION ALL {_mode('hybrid+profile', ['sem', 'lex'], True)}) {METRICS}"""),
    "topk_gold_overlap": (topk_gold_overlap, f"{W}{BASE}, {GOLD} SELECT query_id, person_id FROM scored SEMI JOIN gold USING (query_id, person_id) WHERE rank <= 5"),
    "overlap_rank": (overlap_rank, f"WITH {BASELINE} SELECT query_id, person_id, n_exact, n_partial, round(raw, 6) AS raw, rank FROM ranked"),
    "overlap_evidence": (overlap_evidence, f"""WITH {BASELINE}, ri AS (SELECT * FROM ov SEMI JOIN ranked USING (query_id, person_id)),
        b AS (SELECT query_id, max(item_score) AS b FROM ri GROUP BY ALL),
        se AS (SELECT query_id, person_id, section, array_to_string(list(item_id ORDER BY r), '|') AS item_ids, round(least(98.0, 35 + 60 * max(item_score) / any_value(b)), 1) AS score
          FROM {Q.top('ri', 'query_id, person_id, section', 'item_score DESC, item_id', 3, 'r')} JOIN b USING (query_id) GROUP BY ALL),
        al AS (SELECT * FROM se UNION ALL SELECT query_id, person_id, 'arastirma', '', round(least(99.0, 70.0 + 8 * n_exact + 3 * n_partial), 1)::DOUBLE FROM ranked WHERE n_exact + n_partial > 0)
        SELECT query_id, person_id, section, item_ids, score, position FROM {Q.top('al', 'query_id, person_id', 'score DESC, section', 4, 'position')}"""),
}
