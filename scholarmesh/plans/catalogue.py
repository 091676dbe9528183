"""Registered queries of the call catalogue, announcements and their incremental steps, each with its SQL check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmesh.functions import extraction as E
from scholarmesh.functions import hashing as H
from scholarmesh.operators import announcements as A
from scholarmesh.operators import calls as C
from scholarmesh.operators import snapshot as N
from scholarmesh.plans import bindings as B
from scholarmesh.plans import sql as Q
from scholarmesh.streaming import ingest as I

TODAY = Q.TODAY


def _calls(s: SparkSession, f: str) -> DataFrame:
    return B.calls(s, f)


def _dated(s: SparkSession, f: str) -> DataFrame:
    return C.with_deadline(_calls(s, f), B.today())


def filter_calls(s: SparkSession, f: str) -> DataFrame:
    return C.filter_calls(_calls(s, f), B.today(), status="acik", audience="academic", closing_within=120,
                          search="bl_e").select("call_id", "title", "status", "deadline")


def call_status(s: SparkSession, f: str) -> DataFrame:
    return _dated(s, f).select("call_id", "status")


def call_deadline(s: SparkSession, f: str) -> DataFrame:
    return _dated(s, f).select("call_id", "deadline")


def blacklist_titles(s: SparkSession, f: str) -> DataFrame:
    """Library list, and a list for the part names of the tables, on whole texts and titles."""
    docs = B.chunks(s, f).select(F.lit("document").alias("kind"), F.col("chunk_id").alias("id"), F.col("content").alias("t"))
    calls = _calls(s, f).select(F.lit("call").alias("kind"), F.col("call_id").alias("id"), F.col("title").alias("t"))
    stems = [*E.BLACKLIST, "gear", "ring", "auch", "de la"]
    return docs.unionByName(calls).select("kind", "id", E.blacklist_stem(F.col("t"), stems).alias("stem"))


def open_academic_calls(s: SparkSession, f: str) -> DataFrame:
    ids = B.table(s, f, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("call_id"))
    return C.open_academic_calls(_calls(s, f), B.today(), ids).select("call_id", "deadline")


def due_for_recheck(s: SparkSession, f: str) -> DataFrame:
    processed = B.table(s, f, "lineitem").where(F.col("l_returnflag") == "A").select(F.col("l_orderkey").alias("call_id"))
    return C.due_for_recheck(_calls(s, f), processed, B.today()).select("call_id", "deadline")


def _stored_matches(s: SparkSession, f: str) -> DataFrame:
    lines = B.table(s, f, "lineitem")
    suppliers = B.table(s, f, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name"))
    return lines.join(suppliers, "l_suppkey").select(
        F.col("l_orderkey").alias("call_id"), F.col("l_suppkey").alias("person_id"), F.col("l_linenumber").alias("rank"), "name")


def calls_with_matches(s: SparkSession, f: str) -> DataFrame:
    return C.calls_with_matches(_calls(s, f), _stored_matches(s, f)).select("call_id", "title", "matched_names")


def program_facet(s: SparkSession, f: str) -> DataFrame:
    return C.program_facet(_calls(s, f))


def source_facet(s: SparkSession, f: str) -> DataFrame:
    return C.source_facet(_calls(s, f), B.today())


def _runs(s: SparkSession, f: str) -> DataFrame:
    """Events as runs: the kind from the user, the status from the event type."""
    status = F.create_map(*[F.lit(x) for pair in {
        "purchase": "bitti", "view": "bitti", "error": "hata", "click": "bekliyor", "signup": "calisiyor"}.items() for x in pair])
    return B.table(s, f, "events").select(
        F.col("event_id").alias("run_id"), F.when(F.col("value") > 50, "tam").otherwise("hizli").alias("kind"),
        status[F.col("event_type")].alias("status"), F.col("ts").alias("finished_at"))


def run_status(s: SparkSession, f: str) -> DataFrame:
    persons = B.table(s, f, "customer").select((F.col("c_acctbal") > 0).alias("active"))
    return C.run_status(_runs(s, f), persons).withColumns({
        c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("last_success", "last_full_success")})


def run_counters(s: SparkSession, f: str) -> DataFrame:
    outcomes = B.table(s, f, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("outcome"))
    return C.run_counters(outcomes).select("run_id", F.explode("counters").alias("outcome", "n"))


def latest_per_label(s: SparkSession, f: str) -> DataFrame:
    lines = B.table(s, f, "lineitem")
    return C.latest_per_label(lines.select(
        F.col("l_orderkey").alias("call_id"), F.concat(F.lit("İlan "), "l_returnflag").alias("label"),
        F.col("l_shipdate").cast("date").alias("date"), F.col("l_linenumber").alias("pos")))


def filtered_page_count(s: SparkSession, f: str) -> DataFrame:
    return C.filtered_page_count(C.filter_calls(_calls(s, f), B.today(), status="gecmis", search="widget"))


def newest_per_title(s: SparkSession, f: str) -> DataFrame:
    return C.newest_per_title(_calls(s, f)).select("call_id", "title", "publish_date")


def next_deadline(s: SparkSession, f: str) -> DataFrame:
    return _calls(s, f).select("call_id", C.next_deadline(F.col("dates"), B.today()).alias("n")).select("call_id", "n.*")


def order_calls_page(s: SparkSession, f: str) -> DataFrame:
    """Second page of a hundred calls, with the position on the page's order keys."""
    return C.order_calls_page(_dated(s, f), limit=100, offset=100).select("call_id", "status", "deadline", "publish_date")


def _ledger(s: SparkSession, f: str) -> DataFrame:
    """Announcements seen in earlier runs: lines with a return; those of linestatus 'F' and flag 'A' failed."""
    url = B.news_url()
    orders = B.table(s, f, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("source"))
    lines = B.table(s, f, "lineitem").where(F.col("l_returnflag") != "N").join(orders, "l_orderkey")
    failed = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")
    return lines.select(url.alias("url"), "source", F.lit("(kayıtlı)").alias("title"),
                        F.col("l_shipdate").cast("date").alias("publish_date"),
                        F.when(failed, "hata").otherwise("cagri").alias("decision"))


def _listed(s: SparkSession, f: str) -> DataFrame:
    """Listing positions: newest first, as days and line keys."""
    url_parts = F.split("url", "-")
    pos = (40000 - F.datediff("publish_date", F.lit("1990-01-01").cast("date"))).cast("bigint") * 100_000_000 + (
        F.element_at(url_parts, 2).cast("bigint") * 100) + F.element_at(url_parts, 3).cast("bigint")
    return B.announcements(s, f).withColumn("pos", pos).drop("program_code")


def _new(mode: str):
    def query(s: SparkSession, f: str) -> DataFrame:
        today = F.lit("2001-10-01").cast("date")
        return A.new_announcements(_listed(s, f), _ledger(s, f), today, mode).select("url", "retry", "publish_date")
    return query


def processing_order(s: SparkSession, f: str) -> DataFrame:
    """All items of the last year and all failed ones, in the order of processing."""
    today = F.lit("2001-10-01").cast("date")
    items = A.new_announcements(_listed(s, f), _ledger(s, f), today, "unsorted")
    return A.processing_order(items).select("url", "retry", "publish_date")


def _updates(s: SparkSession, f: str) -> DataFrame:
    """Update announcements: shipped lines; the title has the part's words and the priority."""
    return B.announcements(s, f)


def match_update_to_call(s: SparkSession, f: str) -> DataFrame:
    return A.match_update_to_call(_updates(s, f), _calls(s, f))


def find_repeat_call(s: SparkSession, f: str) -> DataFrame:
    return A.find_repeat_call(_updates(s, f), _calls(s, f))


def keep_known_links(s: SparkSession, f: str) -> DataFrame:
    """Pages' addresses as model links of the page with the next number; labels from the first link text."""
    pages = B.table(s, f, "pages")
    model = pages.select("page_id", F.lit(1).alias("pos"), F.lit("tıklayınız").alias("label"), "url").unionByName(
        pages.select("page_id", F.lit(2).alias("pos"), F.concat(F.lit("Çağrı "), F.col("page_id").cast("string")).alias("label"), "url")
    ).unionByName(pages.select("page_id", F.lit(3).alias("pos"), F.lit("Buradan").alias("label"), "url")).unionByName(
        pages.select("page_id", F.lit(4).alias("pos"), F.lit("Detaylı bilgi").alias("label"), F.concat("url", F.lit("#x")).alias("url")))
    return A.keep_known_links(model, pages.select("page_id", "url"))


def detect_content_changes(s: SparkSession, f: str) -> DataFrame:
    """Stored text against the text fetched now, in which one brand has been renamed."""
    calls = _calls(s, f).select("call_id", "text")
    stored = calls.select("call_id", H.content_hash(F.col("text")).alias("content_hash"))
    fetched = calls.select("call_id", F.replace("text", F.lit("Brand#1 "), F.lit("Brand#01 ")).alias("text"))
    return A.detect_content_changes(stored, fetched)


def merge_extension_dates(s: SparkSession, f: str) -> DataFrame:
    """Lines as updates of their order: a later date under one of the stored labels or a new one."""
    calls = _calls(s, f).select("call_id", "dates", F.array().cast("array<string>").alias("update_urls"))
    lines = B.table(s, f, "lineitem")
    label = F.when(F.col("l_linestatus") == "O", "Son Başvuru").otherwise(F.concat(F.lit("Aşama "), "l_returnflag"))
    updates = lines.select(
        F.col("l_orderkey").alias("call_id"), F.concat_ws("-", F.lit("u"), F.col("l_linenumber").cast("string")).alias("url"),
        F.array(F.struct(label.alias("label"), F.col("l_shipdate").cast("date").alias("date"),
                         F.lit(True).alias("is_application"))).alias("dates"))
    out = A.merge_extension_dates(calls, updates)
    return out.select("call_id", F.size("update_urls").alias("n_updates"), F.explode("dates").alias("d")).select(
        "call_id", "n_updates", "d.label", "d.date", "d.is_application")


def invalidate_and_rematch(s: SparkSession, f: str) -> DataFrame:
    """Stored matches; calls with a return are changed and matched anew, calls of status 'P' were deleted."""
    columns = ["call_id", "person_id", "rank"]
    stored = _stored_matches(s, f).select(*columns)
    lines = B.table(s, f, "lineitem")
    changed = lines.where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("call_id"))
    deleted = _calls(s, f).where(F.col("program_code").isNull()).select("call_id")
    fresh = stored.join(changed, "call_id", "left_semi").join(deleted, "call_id", "left_anti").withColumn(
        "rank", F.col("rank") + 100)
    return A.invalidate_and_rematch(stored, fresh, changed=changed, deleted=deleted)


def reclassify_calls(s: SparkSession, f: str) -> DataFrame:
    passes = B.table(s, f, "orders").select(
        F.col("o_orderkey").alias("call_id"), F.when(F.col("o_orderstatus") == "F", "cagri_degil").otherwise("cagri").alias("kind_1"),
        F.when(F.col("o_totalprice") < 100_000, "cagri_degil").otherwise("cagri").alias("kind_2"), F.lit("kural").alias("reason"))
    return A.reclassify_calls(_calls(s, f), passes)


def ingest_announcements(s: SparkSession, f: str) -> DataFrame:
    """One batch of announcements with page text against the known calls; the ledger rows it gives."""
    items = B.announcements(s, f).select(
        "url", F.concat(F.when(F.col("program_code") == "F", F.lit("Süresi uzatıldı: ")).otherwise(F.lit("")), "title").alias("title"),
        "source", "publish_date", F.concat(F.lit("Proje çağrısı başvuru "), "title").alias("text"))
    ledger = _ledger(s, f).select("url", "source", "title", "publish_date", "decision", F.lit("").alias("reason"),
                                  F.lit(None).cast("string").alias("call_id"))
    calls = _calls(s, f).withColumn("call_id", F.col("call_id").cast("string"))
    return I.ingest_batch(items, ledger, calls, blacklist=["gear", "auch"]).ledger


def backfill_window(s: SparkSession, f: str) -> DataFrame:
    today = F.lit("2001-10-01").cast("date")
    return I.backfill_window(_listed(s, f), _ledger(s, f), today).select("url", "retry", "publish_date")


def upsert_latest(s: SparkSession, f: str) -> DataFrame:
    """Order records as stored and shipped versions, the newest version per order."""
    stored = B.table(s, f, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_orderdate").cast("date").alias("version"),
                                            F.lit(0).cast("bigint").alias("line"))
    lines = B.table(s, f, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(
        F.max(F.struct(F.col("l_shipdate").cast("date").alias("version"), F.col("l_linenumber").cast("bigint").alias("line"))).alias("x"))
    return A.upsert_latest(stored, lines.select("call_id", "x.*"), "call_id", "version")


def forget_deleted(s: SparkSession, f: str) -> DataFrame:
    ledger = B.table(s, f, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("url"), F.lit("cagri").alias("decision"), F.lit("ok").alias("reason"),
        F.col("l_orderkey").alias("call_id"))
    deleted = _calls(s, f).where(F.col("program_code").isNull()).select("call_id", F.concat(F.lit("silindi: "), "source").alias("reason"))
    return A.forget_deleted(ledger, deleted)


LISTED = f"""{Q.ANNOUNCEMENTS},
listed AS MATERIALIZED (SELECT *, (40000 - date_diff('day', DATE '1990-01-01', publish_date))::BIGINT * 100000000
    + split_part(url, '-', 2)::BIGINT * 100 + split_part(url, '-', 3)::BIGINT AS pos FROM ann),
ledger AS MATERIALIZED (SELECT {Q.NEWS_URL} AS url, l_shipdate::DATE AS publish_date,
    CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'hata' ELSE 'cagri' END AS decision FROM lineitem WHERE l_returnflag <> 'N'),
known AS (SELECT DISTINCT url FROM ledger WHERE decision <> 'hata'),
marked AS MATERIALIZED (SELECT l.*, k.url IS NOT NULL AS known, publish_date < DATE '2001-10-01' - 365 AS old FROM listed l LEFT JOIN known k USING (url)),
failed AS (SELECT url, true AS retry, publish_date::VARCHAR AS publish_date FROM ledger WHERE decision = 'hata')"""


def _new_sql(condition: str, extra: str = "") -> str:
    return f"""WITH {LISTED}{extra}, fresh AS (SELECT url, false AS retry, arg_min(publish_date, pos)::VARCHAR AS publish_date
      FROM {condition} GROUP BY url)
    SELECT * FROM fresh ANTI JOIN failed USING (url) UNION ALL SELECT * FROM failed"""


UNSORTED = _new_sql("marked WHERE NOT known AND NOT old")
STOPS = """, stops AS (SELECT source, min(pos) FILTER (known) AS fk, min(pos) FILTER (old) AS fo FROM marked GROUP BY source)"""

SIGNATURES = f"""{Q.CALLS}, {Q.ANNOUNCEMENTS},
ct AS MATERIALIZED (SELECT call_id, publish_date, lower(trim(coalesce(program_code, ''))) AS code, {Q.title_tokens('title')} AS t FROM calls),
ct2 AS MATERIALIZED (SELECT array_to_string(t, ' ') AS tk, code, publish_date, min(call_id) AS call_id FROM ct GROUP BY ALL),
cg AS MATERIALIZED (SELECT DISTINCT tk, code, string_split(tk, ' ') AS t FROM ct2),
ag AS MATERIALIZED (SELECT url, publish_date, lower(trim(coalesce(program_code, ''))) AS code, {Q.title_tokens('title')} AS t FROM ann)"""

UPDATE_SQL = f"""WITH {SIGNATURES},
asig AS (SELECT DISTINCT t AS a_t, code AS a_c FROM ag),
pairs AS MATERIALIZED (SELECT a_t, a_c, tk, code, o AS overlap, o + CASE WHEN same THEN 0.5 ELSE 0 END AS score FROM (
    SELECT a_t, a_c, tk, code, len(list_intersect(a_t, t))::DOUBLE / len(t) AS o, a_c <> '' AND a_c = code AS same FROM asig CROSS JOIN cg)
  WHERE o >= 0.7 OR (same AND o >= 0.5)),
ad AS (SELECT DISTINCT t AS a_t, code AS a_c, publish_date AS d FROM ag),
best AS MATERIALIZED (SELECT a_t, a_c, d, score, overlap, call_id, row_number() OVER (PARTITION BY a_t, a_c, d ORDER BY score DESC, ct2.publish_date DESC, call_id) AS r
  FROM ad JOIN pairs USING (a_t, a_c) JOIN ct2 ON ct2.tk = pairs.tk AND ct2.code = pairs.code AND ct2.publish_date <= d)
SELECT url, call_id, round(overlap, 6) AS overlap, round(score, 6) AS score FROM ag JOIN best ON a_t = t AND a_c = ag.code AND d = publish_date WHERE r = 1"""

REPEAT_SQL = f"""WITH {SIGNATURES},
ad AS (SELECT DISTINCT array_to_string(t, ' ') AS tk, publish_date AS d FROM ag WHERE len(t) >= 3),
best AS (SELECT tk, d, ct2.publish_date AS cd, call_id, row_number() OVER (PARTITION BY tk, d ORDER BY ct2.publish_date DESC, call_id) AS r
  FROM ad JOIN ct2 USING (tk) WHERE ct2.publish_date BETWEEN d - 180 AND d + 180)
SELECT url, call_id, cd::VARCHAR AS call_date FROM ag JOIN best ON tk = array_to_string(t, ' ') AND d = publish_date WHERE r = 1"""

DATES = """dates AS (SELECT call_id, 0 AS i, 'Yayın tarihi' AS label, publish_date AS date, false AS is_application FROM calls WHERE o_orderstatus <> 'P'
    UNION ALL SELECT call_id, 1, 'Son başvuru', d1, true FROM calls WHERE o_orderstatus <> 'P'
    UNION ALL SELECT call_id, 2, 'E-imza', d2, o_orderstatus = 'O' FROM calls WHERE o_orderstatus <> 'P')"""

C_ = f"WITH {Q.CALLS} "

ENTRIES = {
    "filter_calls": (filter_calls, f"""{C_} SELECT call_id, title, status, deadline::VARCHAR AS deadline FROM cs WHERE status = 'acik' AND audience = 'academic'
        AND deadline <= {TODAY} + 120 AND (title ILIKE '%bl_e%' OR coalesce(summary ILIKE '%bl_e%', false) OR coalesce(program_name ILIKE '%bl_e%', false)
        OR coalesce(program_code ILIKE '%bl_e%', false) OR conditions ILIKE '%bl_e%' OR text ILIKE '%bl_e%')"""),
    "call_status": (call_status, f"{C_} SELECT call_id, status FROM cs"),
    "call_deadline": (call_deadline, f"{C_} SELECT call_id, deadline::VARCHAR AS deadline FROM cs"),
    "blacklist_titles": (blacklist_titles, f"""{C_}, x AS (SELECT 'document' AS kind, doc_id AS id, text AS t FROM documents UNION ALL SELECT 'call', call_id, title FROM calls)
        SELECT kind, id, nullif(regexp_extract({Q.fold('t')}, '\\b({"|".join([*E.BLACKLIST, "gear", "ring", "auch", "de la"])})', 1), '') AS stem FROM x"""),
    "open_academic_calls": (open_academic_calls, f"{C_} SELECT call_id, deadline::VARCHAR AS deadline FROM cs WHERE audience = 'academic' AND (deadline IS NULL OR deadline >= {TODAY}) AND call_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    "due_for_recheck": (due_for_recheck, f"{C_} SELECT call_id, deadline::VARCHAR AS deadline FROM cs WHERE (deadline >= {TODAY} OR (deadline IS NULL AND publish_date >= {TODAY} - 90)) AND call_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')"),
    "calls_with_matches": (calls_with_matches, f"""{C_}, m AS (SELECT l_orderkey AS call_id, string_agg(s_name, '|' ORDER BY l_linenumber, s_name) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
        SELECT call_id, title, coalesce(n, '') AS matched_names FROM calls LEFT JOIN m USING (call_id)"""),
    "program_facet": (program_facet, f"{C_} SELECT program_code AS code, max(program_name) AS name, count(*) AS n_calls FROM calls WHERE program_code IS NOT NULL GROUP BY ALL ORDER BY n_calls DESC, code"),
    "source_facet": (source_facet, f"{C_} SELECT source, count(*) AS n_calls, count(*) FILTER (status = 'acik') AS n_open FROM cs GROUP BY source ORDER BY n_calls DESC, source"),
    "run_status": (run_status, """WITH r AS (SELECT event_id AS run_id, CASE WHEN value > 50 THEN 'tam' ELSE 'hizli' END AS kind, ts AS finished_at,
          CASE event_type WHEN 'error' THEN 'hata' WHEN 'click' THEN 'bekliyor' WHEN 'signup' THEN 'calisiyor' ELSE 'bitti' END AS status FROM events)
        SELECT max(run_id) AS last_run_id, arg_max(status, run_id) AS last_status, strftime(max(finished_at) FILTER (status = 'bitti'), '%Y-%m-%d %H:%M:%S') AS last_success,
          min(run_id) FILTER (status IN ('bekliyor', 'calisiyor')) AS oldest_active_id,
          strftime(max(finished_at) FILTER (status = 'bitti' AND kind = 'tam'), '%Y-%m-%d %H:%M:%S') AS last_full_success,
          max(run_id) FILTER (status IN ('bitti', 'hata')) AS last_ended_id, arg_max(status, run_id) FILTER (status IN ('bitti', 'hata')) AS last_ended_status,
          (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS n_active_persons FROM r"""),
    "run_counters": (run_counters, "SELECT user_id AS run_id, event_type AS outcome, count(*) AS n FROM events GROUP BY ALL"),
    "latest_per_label": (latest_per_label, """SELECT l_orderkey AS call_id, 'ilan ' || lower(l_returnflag) AS label_key, 'İlan ' || l_returnflag AS label,
        max(l_shipdate)::DATE::VARCHAR AS date FROM lineitem GROUP BY ALL"""),
    "filtered_page_count": (filtered_page_count, f"{C_} SELECT count(*) AS total FROM cs WHERE status = 'gecmis' AND (title ILIKE '%widget%' OR coalesce(summary ILIKE '%widget%', false) OR text ILIKE '%widget%')"),
    "newest_per_title": (newest_per_title, f"{C_} SELECT call_id, title, publish_date::VARCHAR AS publish_date FROM {Q.top('calls', Q.fold('title'), 'publish_date DESC NULLS LAST, call_id', 1)}"),
    "next_deadline": (next_deadline, f"""{C_}, {DATES}, a AS (SELECT * FROM dates WHERE is_application),
        n AS (SELECT call_id, coalesce(min(struct_pack(date, label)) FILTER (date >= {TODAY}), max(struct_pack(date, label))) AS c FROM a GROUP BY call_id)
        SELECT call_id, c.label AS label, c.date::VARCHAR AS date, date_diff('day', {TODAY}, c.date) AS days_left,
          CASE WHEN c.date < {TODAY} THEN 'Süresi doldu' WHEN c.date = {TODAY} THEN 'Bugün son gün' WHEN c IS NOT NULL THEN date_diff('day', {TODAY}, c.date) || ' gün kaldı' END AS text,
          date_diff('day', {TODAY}, c.date) >= 0 AND date_diff('day', {TODAY}, c.date) < 7 AS urgent, CASE WHEN c IS NOT NULL THEN 2 END::BIGINT AS other_dates
        FROM calls LEFT JOIN n USING (call_id)"""),
    "order_calls_page": (order_calls_page, f"""{C_} SELECT call_id, status, deadline::VARCHAR AS deadline, publish_date::VARCHAR AS publish_date FROM cs
        ORDER BY CASE status WHEN 'acik' THEN 0 WHEN 'belirsiz' THEN 1 ELSE 2 END, CASE WHEN status = 'acik' THEN cs.deadline END NULLS LAST, cs.deadline DESC NULLS LAST, cs.publish_date DESC NULLS LAST, call_id LIMIT 100 OFFSET 100"""),
    "new_announcements": (_new("incremental"), _new_sql("marked JOIN stops USING (source) WHERE NOT known AND pos < coalesce(CASE WHEN fk IS NULL THEN fo ELSE fk END, 9223372036854775807)", STOPS)),
    "new_announcements_backfill": (_new("backfill"), _new_sql("marked JOIN stops USING (source) WHERE NOT known AND pos < coalesce(fo, 9223372036854775807)", STOPS)),
    "new_announcements_unsorted": (_new("unsorted"), UNSORTED),
    "backfill_window": (backfill_window, UNSORTED),
    "processing_order": (processing_order, f"SELECT * FROM ({UNSORTED}) ORDER BY retry, publish_date NULLS LAST, url"),
    "match_update_to_call": (match_update_to_call, UPDATE_SQL),
    "find_repeat_call": (find_repeat_call, REPEAT_SQL),
    "keep_known_links": (keep_known_links, r"SELECT page_id, url, 1::BIGINT AS pos, regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') AS label FROM pages"),
    "detect_content_changes": (detect_content_changes, f"""{C_} SELECT call_id, CASE WHEN contains(text, 'Brand#1 ') THEN 'changed' ELSE 'same' END AS action,
        sha256(replace(text, 'Brand#1 ', 'Brand#01 ')) AS new_hash FROM calls"""),
    "merge_extension_dates": (merge_extension_dates, f"""{C_}, {DATES}, u AS (SELECT l_orderkey AS call_id, l_linenumber AS ln, CASE WHEN l_linestatus = 'O' THEN 'Son Başvuru' ELSE 'Aşama ' || l_returnflag END AS label, l_shipdate::DATE AS date FROM lineitem),
        al AS (SELECT call_id, i AS p, label, date, is_application FROM dates UNION ALL SELECT call_id, 100, label, date, true FROM u),
        nu AS (SELECT call_id, count(DISTINCT ln) AS n FROM u GROUP BY ALL)
        SELECT call_id, coalesce(n, 0) AS n_updates, label, date::VARCHAR AS date, is_application FROM {Q.top('(SELECT *, ' + Q.fold('label') + ' AS k FROM al)', 'call_id, k', 'date DESC, p', 1)} LEFT JOIN nu USING (call_id)
        WHERE call_id IN (SELECT call_id FROM calls)"""),
    "invalidate_and_rematch": (invalidate_and_rematch, f"""{C_}, m AS (SELECT l_orderkey AS call_id, l_suppkey AS person_id, l_linenumber::BIGINT AS rank FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
        ch AS (SELECT DISTINCT l_orderkey AS call_id FROM lineitem WHERE l_returnflag = 'R'), de AS (SELECT call_id FROM calls WHERE program_code IS NULL)
        SELECT call_id, person_id, CASE WHEN call_id IN (SELECT call_id FROM ch) THEN rank + 100 ELSE rank END AS rank FROM m WHERE call_id NOT IN (SELECT call_id FROM de)"""),
    "reclassify_calls": (reclassify_calls, None),
    "ingest_announcements": (ingest_announcements, None),
    "upsert_latest": (upsert_latest, """WITH x AS (SELECT o_orderkey AS call_id, o_orderdate::DATE AS version, 0::BIGINT AS line, 0 AS n FROM orders
        UNION ALL SELECT l_orderkey, l_shipdate::DATE, l_linenumber, 1 FROM lineitem)
        SELECT call_id, version::VARCHAR AS version, line FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY version DESC, n DESC, line DESC) AS r FROM x) WHERE r = 1"""),
    "forget_deleted": (forget_deleted, f"""{C_} SELECT l_orderkey || '-' || l_linenumber AS url, CASE WHEN c.call_id IS NOT NULL THEN 'cagri_degil' ELSE 'cagri' END AS decision,
        CASE WHEN c.call_id IS NOT NULL THEN 'silindi: ' || source ELSE 'ok' END AS reason, CASE WHEN c.call_id IS NULL THEN l_orderkey END AS call_id
        FROM lineitem LEFT JOIN (SELECT call_id, source FROM calls WHERE program_code IS NULL) c ON c.call_id = l_orderkey"""),
}
