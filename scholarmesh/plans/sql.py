"""Building blocks of the SQL checks (DuckDB dialect)."""

from __future__ import annotations

from scholarmesh.functions.extraction import MONTHS, TITLE_STOP_STEMS

TODAY = "DATE '1998-01-01'"
SPLIT_DAY = "DATE '1998-07-01'"
WORD = r"[\p{L}\p{N}_]+"
ACCENTED, PLAIN = "äçèéêíñóöü", "aceeeinoou"


def tr_lower(x: str) -> str:
    return f"lower(translate({x}, 'İI', 'iı'))"


def fold(x: str) -> str:
    return rf"regexp_replace(strip_accents(translate({tr_lower(x)}, 'ı', 'i')), '[^\x00-\x7F]', '', 'g')"


def norm_key(x: str) -> str:
    return f"trim(regexp_replace({fold(x)}, '[^a-z0-9]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return (rf"list_transform(list_filter(regexp_extract_all({tr_lower(x)}, '{WORD}'), lambda w: length(w) > 1), "
            "lambda w: left(w, 5))")


def words(x: str) -> str:
    """Distinct five-letter stems of folded words of three letters or more."""
    return f"list_distinct(list_transform(regexp_extract_all({fold(x)}, '[a-z]{{3,}}'), lambda w: left(w, 5)))"


def numbers(x: str) -> str:
    """Distinct numbers without thousands separators, and named months."""
    months = ", ".join(rf"CASE WHEN regexp_matches({fold(x)}, '\b{m}') THEN '{i}' END" for i, m in enumerate(MONTHS, 1))
    digits = rf"list_transform(regexp_extract_all({x}, '\d+(?:[.,\s]\d\d\d\b)*'), lambda n: regexp_replace(n, '[.,\s]', '', 'g'))"
    return (f"list_distinct(list_concat(list_transform({digits}, "
            f"lambda n: CASE WHEN ltrim(n, '0') = '' THEN '0' ELSE ltrim(n, '0') END), "
            f"list_filter([{months}], lambda m: m IS NOT NULL)))")


def title_tokens(x: str) -> str:
    stops = ", ".join(f"'{s}'" for s in TITLE_STOP_STEMS)
    return (f"list_sort(list_filter(list_distinct(list_transform(regexp_extract_all({fold(x)}, '[a-z0-9]+'), "
            f"lambda w: left(w, 5))), lambda w: NOT list_contains([{stops}], w)))")


QUERIES = """q AS (SELECT b.item_id AS query_id, b.text AS keywords, e.embedding::DOUBLE[] AS vector
    FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id)"""

QUERY_TERMS = f"""qt AS (SELECT query_id, term, count(*) AS qtf FROM (
    SELECT query_id, unnest({tokens('keywords')}) AS term FROM q) GROUP BY ALL)"""


def bm25(docs: str, id_: str, text: str, name: str = "bm") -> str:
    """CTEs giving `name`(query_id, id, bm25) over the table or CTE `docs`, with corpus-wide statistics."""
    return f"""{name}_t AS MATERIALIZED (SELECT {id_}, {tokens(text)} AS t FROM {docs}),
{name}_tf AS MATERIALIZED (SELECT {id_}, term, count(*) AS tf FROM (SELECT {id_}, unnest(t) AS term FROM {name}_t) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_n AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM {name}_t),
{name} AS MATERIALIZED (SELECT query_id, {id_}, bm25 FROM (SELECT query_id, {id_},
      round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl)))), 6) AS bm25
    FROM qt JOIN {name}_tf USING (term) JOIN {name}_df USING (term) JOIN {name}_t USING ({id_}), {name}_n
    GROUP BY ALL) WHERE bm25 > 0)"""


def top(source: str, keys: str, order: str, k: int, name: str = "rank") -> str:
    return (f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS {name} "
            f"FROM {source}) WHERE {name} <= {k})")


SEMANTIC = f"""sim AS MATERIALIZED (SELECT query_id, vec_id AS chunk_id,
    round(list_cosine_similarity(embedding::DOUBLE[], vector), 12) AS similarity FROM embeddings, q),
sem AS MATERIALIZED {top('sim', 'query_id', 'similarity DESC, chunk_id', 50)}"""

LEXICAL = bm25("documents", "doc_id", "text") + f""",
lex AS MATERIALIZED (SELECT query_id, doc_id AS chunk_id, bm25, rank FROM {top('bm', 'query_id', 'bm25 DESC, doc_id', 50)})"""

FUSED = """fused AS MATERIALIZED (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank - 1)) AS rrf
    FROM (SELECT query_id, chunk_id, rank FROM sem UNION ALL SELECT query_id, chunk_id, rank FROM lex) GROUP BY ALL),
hits AS MATERIALIZED (SELECT query_id, chunk_id, source AS person_id, lang AS section, rrf
    FROM fused JOIN documents ON chunk_id = doc_id)"""

PROFILES = f"""pv AS (SELECT person_id, list(m ORDER BY i) AS embedding FROM (
    SELECT source AS person_id, i, avg(embedding[i]::DOUBLE) AS m
    FROM embeddings JOIN documents ON vec_id = doc_id, range(1, 65) r(i) GROUP BY ALL) GROUP BY person_id),
psim AS (SELECT query_id, person_id, round(list_cosine_similarity(embedding, vector), 12) AS similarity FROM pv, q),
prank AS MATERIALIZED (SELECT query_id, person_id, similarity,
    row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, person_id) - 1 AS profile_rank FROM psim)"""

SCORED = f"""chunk_score AS (SELECT query_id, person_id, sum(rrf) / 3 AS chunk_score
    FROM {top('hits', 'query_id, person_id', 'rrf DESC, chunk_id', 3)} GROUP BY ALL),
all_scores AS (SELECT query_id, person_id, profile_rank,
      round(coalesce(chunk_score, 0) + 1.0::DOUBLE / (60 + profile_rank), 12) AS score
    FROM prank LEFT JOIN chunk_score USING (query_id, person_id)),
scored AS MATERIALIZED (SELECT query_id, person_id, score, rank
    FROM {top('all_scores', 'query_id', 'score DESC, profile_rank', 20)})"""

BASE = ",\n".join([QUERIES, QUERY_TERMS, SEMANTIC, LEXICAL, FUSED, PROFILES, SCORED])

# evidence: own chunks of the listed persons, those without a vector last in the semantic list, own statistics, both ranks over all of them
EVIDENCE = f"""own AS MATERIALIZED (SELECT doc_id AS chunk_id, source AS person_id, lang AS section, text AS content,
      {tokens('text')} AS t FROM documents),
own_tf AS MATERIALIZED (SELECT chunk_id, person_id, term, count(*) AS tf
    FROM (SELECT chunk_id, person_id, unnest(t) AS term FROM own) GROUP BY ALL),
own_df AS (SELECT person_id, term, count(*) AS df FROM own_tf GROUP BY ALL),
own_n AS (SELECT person_id, count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM own GROUP BY person_id),
own_bm AS (SELECT s.query_id, own_tf.chunk_id,
      round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl)))), 6) AS bm25
    FROM scored s JOIN qt ON qt.query_id = s.query_id JOIN own_tf ON own_tf.term = qt.term AND own_tf.person_id = s.person_id
      JOIN own_df ON own_df.term = qt.term AND own_df.person_id = s.person_id
      JOIN own_n ON own_n.person_id = s.person_id JOIN own ON own.chunk_id = own_tf.chunk_id GROUP BY ALL),
own_ranked AS (SELECT s.query_id, s.person_id, own.chunk_id, section, content, coalesce(similarity, 0) AS similarity,
      row_number() OVER (PARTITION BY s.query_id, s.person_id ORDER BY coalesce(similarity, -2) DESC, own.chunk_id) AS a,
      row_number() OVER (PARTITION BY s.query_id, s.person_id ORDER BY coalesce(bm25, 0) DESC, own.chunk_id) AS b
    FROM scored s JOIN own ON own.person_id = s.person_id
      LEFT JOIN sim ON sim.query_id = s.query_id AND sim.chunk_id = own.chunk_id
      LEFT JOIN own_bm ON own_bm.query_id = s.query_id AND own_bm.chunk_id = own.chunk_id),
own_fused AS (SELECT *, 1.0::DOUBLE / (59 + a) + 1.0::DOUBLE / (59 + b) AS rrf FROM own_ranked),
own_listed AS (SELECT *, row_number() OVER w AS evidence_rank, sum(length(content)) OVER w AS used FROM own_fused
    WINDOW w AS (PARTITION BY query_id, person_id ORDER BY rrf DESC, chunk_id ROWS UNBOUNDED PRECEDING)),
evidence AS MATERIALIZED (SELECT query_id, person_id, chunk_id, section, content, similarity, rrf, evidence_rank
    FROM own_listed WHERE used <= 24000),
lines AS MATERIALIZED (SELECT query_id, person_id, evidence_rank, section, similarity, line AS text,
      row_number() OVER (PARTITION BY query_id, person_id ORDER BY evidence_rank, pos) AS line_no
    FROM (SELECT query_id, person_id, evidence_rank, section, similarity, unnest(string_split(content, chr(10))) AS line,
            generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM evidence)
    WHERE pos > 1 AND trim(line) <> '')"""

NEWS_URL = "concat_ws('-', 'https://news.example/', l_orderkey, l_linenumber, l_partkey, l_suppkey)"

CALLS = """calls AS MATERIALIZED (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL
      WHEN o_orderstatus = 'O' THEN greatest(d1, d2) ELSE d1 END AS deadline FROM (
    SELECT o_orderkey AS call_id, 'https://calls.example/' || o_orderkey AS url,
      concat_ws(' ', p_name, o_orderpriority) AS title, nullif(o_orderstatus, 'P') AS program_code,
      p_type AS program_name, o_orderpriority AS source,
      CASE WHEN o_custkey % 2 = 0 THEN 'academic' ELSE 'industry' END AS audience,
      concat_ws(' ', p_type, p_name) AS summary, concat_ws(' ', p_brand, p_type) AS conditions,
      concat_ws(' ', p_name, p_brand, p_type, o_orderstatus) AS text, o_orderdate::DATE AS publish_date, o_orderstatus,
      o_orderdate::DATE + (30 + o_custkey % 120)::INTEGER AS d1, o_orderdate::DATE + (60 + o_orderkey % 90)::INTEGER AS d2
    FROM orders LEFT JOIN part ON p_partkey = o_custkey)),
cs AS MATERIALIZED (SELECT *, CASE WHEN deadline IS NULL THEN 'belirsiz' WHEN deadline >= DATE '1998-01-01' THEN 'acik'
    ELSE 'gecmis' END AS status FROM calls)"""

ANNOUNCEMENTS = f"""ann AS MATERIALIZED (SELECT {NEWS_URL} AS url,
      concat_ws(' ', p_name, o_orderpriority) AS title, o_orderpriority AS source,
      nullif(o_orderstatus, 'P') AS program_code, l_shipdate::DATE AS publish_date
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey)"""
