"""Registered queries of persons, registry snapshots, sections and synchronisation, each with its SQL check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmesh.functions import hashing as H
from scholarmesh.functions import text as X
from scholarmesh.operators import people as P
from scholarmesh.operators import sections as T
from scholarmesh.operators import snapshot as N
from scholarmesh.plans import bindings as B
from scholarmesh.plans import sql as Q
from scholarmesh.sources import readers as S

FIELDS = ["ad_soyad", "unvan", "fakulte", "bolum", "anahtar_kelimeler"]


def _snapshot(s: SparkSession, f: str, new: bool) -> DataFrame:
    """Customers with orders before (old) or from (new) the split day; fields from their largest order there."""
    day = F.lit(B.SPLIT_DAY).cast("date")
    ordered = F.col("o_orderdate").cast("date")
    orders = B.table(s, f, "orders").where(ordered >= day if new else ordered < day)
    largest = orders.groupBy("o_custkey").agg(
        F.max(F.struct("o_totalprice", "o_orderkey", "o_orderpriority", "o_orderstatus")).alias("l"))
    customers = B.table(s, f, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    name = F.upper("c_name") if new else F.col("c_name")
    keywords = F.array(F.col("l.o_orderpriority"), F.col("c_mktsegment"))
    return largest.join(customers, "o_custkey").select(
        F.col("o_custkey").cast("string").alias("author_id"), name.alias("ad_soyad"),
        F.col("l.o_orderpriority").alias("unvan"), F.col("c_mktsegment").alias("fakulte"),
        F.nullif(F.col("l.o_orderstatus"), F.lit("P")).alias("bolum"),
        (F.reverse(keywords) if new else keywords).alias("anahtar_kelimeler"))


def _items(s: SparkSession, f: str, new: bool) -> DataFrame:
    """Section items: one per order of the customer, the section is the order's status."""
    day = F.lit(B.SPLIT_DAY).cast("date")
    ordered = F.col("o_orderdate").cast("date")
    orders = B.table(s, f, "orders").where(ordered >= day if new else ordered < day)
    text = F.concat(F.lit("Öncelik: "), F.col("o_orderpriority"), F.lit("!" if new else ""))
    return orders.select(F.col("o_custkey").cast("string").alias("author_id"), F.col("o_orderstatus").alias("section"),
                         F.col("o_orderkey").alias("pos"), text.alias("text"))


def list_quality_gate(s: SparkSession, f: str) -> DataFrame:
    known = B.table(s, f, "customer").agg(F.count("*")).scalar()
    return N.list_quality_gate(_snapshot(s, f, True), _snapshot(s, f, False), known)


def snapshot_diff(s: SparkSession, f: str) -> DataFrame:
    return N.snapshot_diff(_snapshot(s, f, False), _snapshot(s, f, True), FIELDS)


def multiset_diff(s: SparkSession, f: str) -> DataFrame:
    diff = N.multiset_diff(_items(s, f, False), _items(s, f, True))
    return diff.groupBy("author_id", "section", "change", "text").agg(F.count("*").alias("n"))


def _report(s: SparkSession, f: str) -> tuple[DataFrame, DataFrame]:
    changes = N.snapshot_diff(_snapshot(s, f, False), _snapshot(s, f, True), FIELDS)
    return changes, N.diff_report(changes, N.multiset_diff(_items(s, f, False), _items(s, f, True)))


def diff_report(s: SparkSession, f: str) -> DataFrame:
    return _report(s, f)[1]


def change_report(s: SparkSession, f: str) -> DataFrame:
    """The merged report, its nested fields and sections written out."""
    changes = N.snapshot_diff(_snapshot(s, f, False), _snapshot(s, f, True), FIELDS)
    report = N.change_report(_snapshot(s, f, True), changes, N.multiset_diff(_items(s, f, False), _items(s, f, True)), fields=FIELDS)
    return report.select("author_id", "ad_soyad", "unvan", "bolum", F.transform("fields", lambda x: F.concat_ws(
        ": ", x["field"], F.coalesce(x["old"], F.lit("-")), F.coalesce(x["new"], F.lit("-")))).alias("fields"), F.transform(
        "sections", lambda x: F.concat(x["section"], F.lit(" +"), F.array_join(x["added"], ","), F.lit(" -"), F.array_join(
            x["removed"], ","))).alias("sections"))


def diff_summary(s: SparkSession, f: str) -> DataFrame:
    return N.diff_summary(*_report(s, f))


def load_snapshot(s: SparkSession, f: str) -> DataFrame:
    """Customers as JSON person records; only those of one segment carry all section keys."""
    base = F.struct(F.col("c_custkey").cast("string").alias("author_id"), F.col("c_name").alias("ad_soyad"),
                    F.array(F.struct(F.col("c_mktsegment").alias("baslik"))).alias("makaleler"))
    empty = F.array().cast("array<string>")
    full = F.struct(F.col("c_custkey").cast("string").alias("author_id"), F.col("c_name").alias("ad_soyad"),
                    F.array(F.struct(F.col("c_mktsegment").alias("baslik"))).alias("makaleler"),
                    *[empty.alias(k) for k in N.DETAIL_SECTIONS if k != "makaleler"])
    rows = B.table(s, f, "customer").select(F.when(
        F.col("c_mktsegment") == "BUILDING", F.to_json(full)).otherwise(F.to_json(base)).alias("json"))
    parsed = S.snapshot_from_json(rows, "json", "author_id STRING, ad_soyad STRING, makaleler ARRAY<STRUCT<baslik: STRING>>")
    return parsed.select("author_id", "ad_soyad", F.col("makaleler.baslik").alias("articles"), "has_details")


def _stored(s: SparkSession, f: str) -> DataFrame:
    return _snapshot(s, f, False).select(
        "author_id", "ad_soyad", "unvan", F.col("fakulte").alias("detail"), (F.col("bolum").isNotNull()).alias("has_details"),
        (F.col("fakulte") != "MACHINERY").alias("active"), F.lit("1998-06-30").cast("date").alias("last_seen"))


def apply_snapshot(s: SparkSession, f: str) -> DataFrame:
    return N.apply_snapshot(_stored(s, f), _snapshot(s, f, True), ["ad_soyad", "unvan"], F.lit(B.SPLIT_DAY).cast("date"))


def detail_targets(s: SparkSession, f: str) -> DataFrame:
    return N.detail_targets(_snapshot(s, f, True), _stored(s, f), full_scan=True)


def resume_progress(s: SparkSession, f: str) -> DataFrame:
    done = B.table(s, f, "orders").where(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").cast("string").alias("author_id"))
    return N.resume_progress(_snapshot(s, f, True), done).select("author_id")


def _hashed(s: SparkSession, f: str, new: bool) -> DataFrame:
    return _snapshot(s, f, new).select(F.col("author_id").alias("id"), F.sha2(F.concat_ws("|", "unvan", "fakulte"), 256).alias("hash"))


def sync_by_hash(s: SparkSession, f: str) -> DataFrame:
    return N.sync_actions(_hashed(s, f, True), _hashed(s, f, False))


def replace_by_key(s: SparkSession, f: str) -> DataFrame:
    """Item rows after the synchronisation: unchanged persons keep theirs, processed ones get the new ones."""
    actions = N.sync_actions(_hashed(s, f, True), _hashed(s, f, False))
    process = actions.where(F.col("action") == "process").select("id")
    old = _items(s, f, False).select(F.col("author_id").alias("id"), "pos", "text")
    fresh = _items(s, f, True).select(F.col("author_id").alias("id"), "pos", "text").join(process, "id", "left_semi")
    return N.replace_by_key(old, fresh, actions)


def ids_to_delete(s: SparkSession, f: str) -> DataFrame:
    registered = B.table(s, f, "customer").select(
        F.concat(F.when(F.col("c_mktsegment") == "FURNITURE", F.lit("YOK_")).otherwise(F.lit("C")), "c_custkey").alias("person_id"),
        F.when(F.col("c_nationkey") < 5, F.concat(F.lit("data/uploads/"), "c_name")).otherwise(F.col("c_name")).alias("path"))
    listed = _snapshot(s, f, True).select(F.concat(F.lit("C"), "author_id").alias("person_id"))
    return N.ids_to_delete(registered, listed, "data/uploads/", "YOK_")


def identity_upsert(s: SparkSession, f: str) -> DataFrame:
    """Customers as registered persons, suppliers as uploads with the e-mail of the customer of their number."""
    persons = B.table(s, f, "customer").select(
        F.concat(F.lit("C"), "c_custkey").alias("person_id"), F.when(F.col("c_acctbal") > 0, F.concat(
            F.lit("m"), "c_custkey", F.lit("@example.org"))).alias("email"))
    uploads = B.table(s, f, "supplier").select(
        F.col("s_suppkey").alias("upload_id"), F.concat(F.col("s_name"), F.lit(" İnci")).alias("name"),
        F.concat(F.lit("m"), "s_suppkey", F.lit("@example.org")).alias("email"), F.col("s_acctbal").cast("decimal(12,2)").cast("string").alias("content"))
    return P.identity_upsert(uploads, persons)


def _persons(s: SparkSession, f: str) -> DataFrame:
    """Customers as persons; title and university from segment and nation."""
    nations = B.table(s, f, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("university"))
    titles = F.create_map(*[F.lit(x) for pair in zip(
        ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], [*P.TITLE_ORDER[:4], "Uzman"]) for x in pair])
    return B.table(s, f, "customer").join(nations, "c_nationkey").select(
        F.col("c_custkey").alias("person_id"), F.coalesce(titles[F.col("c_mktsegment")], F.lit("Arş. Gör. Dr.")).alias("title"),
        F.col("c_name").alias("name"), "university", F.col("c_mktsegment").alias("faculty"), F.lit(None).cast("string").alias("department"),
        F.array("c_mktsegment", "university").alias("areas"))


def filter_persons(s: SparkSession, f: str) -> DataFrame:
    return P.filter_persons(_persons(s, f), q="MACHİNERY 1", area="MACHINERY").select("person_id", "name", "university")


def project_person_summary(s: SparkSession, f: str) -> DataFrame:
    rows = _persons(s, f).withColumn("profile", F.when(F.col("faculty") != "BUILDING", F.struct("areas")))
    return P.project_person_summary(rows)


def facet_values(s: SparkSession, f: str) -> DataFrame:
    return P.facet_values(_persons(s, f))


def _publications(s: SparkSession, f: str) -> DataFrame:
    """Order lines as publications of the supplier: type from the return flag, year from the ship date."""
    parts = B.table(s, f, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return B.table(s, f, "lineitem").join(parts, "l_partkey").select(
        F.col("l_suppkey").alias("person_id"), F.col("l_returnflag").alias("type"), F.year("l_shipdate").alias("year"),
        F.concat(F.when(F.col("l_linestatus") == "O", F.upper("p_name")).otherwise(F.col("p_name"))).alias("title"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("pos"))


def publications_by_year(s: SparkSession, f: str) -> DataFrame:
    """Publications of a supplier as a list, newest year first; order lines of even orders have no year."""
    rows = _publications(s, f).withColumn("year", F.when(F.col("pos.l_orderkey") % 2 == 1, F.col("year")))
    lists = rows.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("pos", "year", "title"))).alias("p"))
    ordered = lists.select("person_id", P.publications_by_year(F.col("p")).alias("p"))
    line = F.transform("p", lambda x: F.concat_ws(" ", x["year"].cast("string"), x["title"]))
    return ordered.select("person_id", F.size("p").alias("n"), F.element_at("p", 1)["year"].alias("newest"), F.md5(
        F.array_join(line, "\n")).alias("list_md5"))


def publication_counts(s: SparkSession, f: str) -> DataFrame:
    return P.publication_counts(_publications(s, f), ["A", "N", "R"])


def dedupe_publications(s: SparkSession, f: str) -> DataFrame:
    return P.dedupe_publications(_publications(s, f)).select("person_id", "title_key", "year", "type", "title", F.col("pos.l_orderkey").alias("first_order"))


def group_courses(s: SparkSession, f: str) -> DataFrame:
    """Order lines as courses of the supplier: level from the status, name from the part, term from the year."""
    parts = B.table(s, f, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    courses = B.table(s, f, "lineitem").join(parts, "l_partkey").select(
        F.col("l_suppkey").alias("person_id"), F.col("l_linestatus").alias("level"),
        F.when(F.col("l_returnflag") == "R", F.upper("p_name")).otherwise(F.col("p_name")).alias("name"),
        F.col("p_brand").alias("language"), F.year("l_shipdate").cast("string").alias("term"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("pos"))
    return P.group_courses(courses)


def resolve_person_name(method: str):
    def query(s: SparkSession, f: str) -> DataFrame:
        """Part names as person names, asked for with the last letter missing."""
        parts = B.table(s, f, "part")
        persons = parts.select(F.col("p_partkey").alias("person_id"), F.col("p_name").alias("name"))
        asked = parts.select(F.col("p_partkey").alias("query_id"), F.expr("left(p_name, length(p_name) - 1)").alias("name"))
        return P.resolve_person_name(asked, persons, method)
    return query


# --- records with nested sections: every document is one, its lines are the items ---------------------------

def _records(s: SparkSession, f: str) -> DataFrame:
    lines = B.table(s, f, "documents").select("doc_id", "text", "lang", "source", "n_chars", F.split("text", "\n").alias("l"))

    def paper(x: Column) -> Column:
        return F.struct(x.alias("baslik"), F.when(F.length(x) > 99, F.lit("01.02.2019 / 2021")).otherwise(F.lit("")).alias("yil"),
                        F.when(F.length(x) > 49, F.col("source")).otherwise(F.lit("")).alias("yayin_yeri"))

    c = F.col
    return lines.select(
        c("doc_id").alias("author_id"), F.upper("source").alias("ad_soyad"),
        F.when(c("lang") == "en", "PROFESÖR").when(c("lang") == "fr", "ARAŞTIRMA GÖREVLİSİ").otherwise("UZMAN").alias("unvan"),
        F.lit("PİRİ ÜNİVERSİTESİ").alias("universite"), F.concat(F.lit("GEMİ VE "), F.upper("lang")).alias("fakulte"), c("lang").alias("bolum"),
        F.lit("").alias("anabilim_dali_program"), F.lit("").alias("temel_alan"), c("source").alias("bilim_alani"),
        F.array("lang", "source").alias("anahtar_kelimeler"), F.lit("").alias("eposta"), F.lit(None).cast("string").alias("orcid"),
        F.transform(F.filter("l", lambda x: F.length(x) < 200), paper).alias("makaleler"),
        F.transform(F.filter("l", lambda x: F.length(x) >= 200), paper).alias("bildiriler"),
        F.transform(F.filter("l", lambda x: x.contains("a")), lambda x: F.struct(
            F.left(x, F.lit(20)).alias("baslik"), F.when(F.length(x) > 150, F.left(x, F.lit(5))).otherwise(F.lit("")).alias("bolum_adi"),
            F.lit("2020").alias("yil"), F.lit("Yayınevi").alias("yayin_yeri"))).alias("kitaplar"),
        F.array(F.struct(c("source").alias("baslik"), F.lit("01.03.2022").alias("baslangic"), F.lit("01.03.2024").alias("bitis"),
                         F.lit("ARAŞTIRMA PROJESİ").alias("tur"), F.lit("Yürütücü").alias("rol"), c("text").alias("proje_konusu"))).alias("projeler"),
        F.transform("l", lambda x: F.struct(F.left(x, F.lit(3)).alias("ders_adi"), F.lit("Lisans").alias("duzey"))).alias("dersler"),
        F.array(F.struct(c("source").alias("tez_adi"), F.when(c("lang") == "de", "Doktora").otherwise("Yüksek Lisans").alias("duzey"),
                         F.when(c("lang") != "es", F.upper("source")).alias("hazirlayan"), F.lit("2020").alias("yil"))).alias("yonetilen_tezler"),
        F.concat(F.lit("https://example.org/"), c("doc_id")).alias("profil_url"),
        F.when(c("lang") != "fr", c("doc_id").cast("string")).otherwise("").alias("arastirmaci_id"),
        F.transform(F.filter("l", lambda x: F.length(x) > 60), lambda x: F.struct(
            F.upper("source").alias("unvan"), F.left(x, F.lit(12)).alias("kurum"), F.when(c("lang") == "de", "").otherwise(F.upper("lang")).alias(
                "birim"), F.when(F.length(x) > 99, "2010-2014").otherwise("").alias("yil"))).alias("akademik_gorevler"),
        F.array(F.struct(c("lang").alias("baslik"), F.lit("2021/0042").alias("basvuru_no"), F.lit("").alias("ozet"))).alias("patentler"),
        F.array(F.struct(F.lit("Doktora").alias("derece"), F.when(c("lang") == "fr", "2014-2019").otherwise("2014").alias("yil"),
                         c("source").alias("kurum"), F.when(c("lang") == "en", "Deniz").otherwise("").alias("birim"), c("lang").alias("tez_adi"))).alias("ogrenim"))


def registry_sections(s: SparkSession, f: str) -> DataFrame:
    out = T.registry_sections()
    names = ["arastirma", "egitim", "yayinlar", "projeler", "yonetilen_tezler", "patentler", "dersler"]
    return _records(s, f).select("author_id", *[out[n].alias(n) for n in names]).select(
        "author_id", "arastirma", "egitim", "projeler", "yonetilen_tezler", "patentler", "dersler",
        F.size("yayinlar").alias("n_publications"), F.md5(F.array_join("yayinlar", "\n")).alias("publications_md5"))


def common_cv(s: SparkSession, f: str) -> DataFrame:
    c = T.to_common_cv()
    rows = _records(s, f).select("author_id", *[v.alias(k) for k, v in c.items()])
    types = F.transform("publications", lambda p: F.concat_ws(":", p["type"], p["year"].cast("string"), p["venue"]))
    posts = F.transform("posts", lambda g: F.concat_ws(":", g["post"], g["institution"], g["period"]))
    return rows.select("author_id", "title", "name", "university", "faculty", "email", "web", "registry_id", F.col("education.unit").alias(
        "units"), F.col("theses.student").alias("students"), F.md5(F.array_join(posts, "|")).alias("posts_md5"), F.col("education.degree").alias("degrees"),
                       F.col("education.year").alias("years"), F.col("projects.program").alias("programs"),
                       F.col("projects.period").alias("periods"), F.col("theses.level").alias("levels"),
                       F.size("publications").alias("n_publications"), F.md5(F.array_join(types, "|")).alias("types_md5"))


def cv_sections(s: SparkSession, f: str) -> DataFrame:
    cv = T.to_common_cv()
    rows = _records(s, f).select("author_id", *[cv[k].alias(k) for k in ("areas", "education", "publications", "projects", "theses")])
    out = T.cv_sections(F.col("areas"), F.lit(""), F.col("education"), F.col("publications"), F.col("projects"), F.col("theses"))
    return rows.where(T.has_content(out)).select(
        "author_id", out["arastirma"].alias("arastirma"), out["egitim"].alias("egitim"), out["projeler"].alias("projeler"),
        out["yonetilen_tezler"].alias("yonetilen_tezler"), F.md5(F.array_join(out["yayinlar"], "\n")).alias("publications_md5"))


def chunk_sections(s: SparkSession, f: str) -> DataFrame:
    """Chunks of whole documents and of their keyword section."""
    records = B.table(s, f, "documents").select(
        F.col("doc_id").alias("person_id"), F.array("source", "lang").alias("arastirma"), F.split("text", "\n").alias("yayinlar"))
    return T.chunk_sections(records, ["arastirma", "yayinlar"]).select(
        "person_id", "section", "seq", T.word_count(F.col("content")).alias("n_words"), F.md5("content").alias("content_md5"))


def pack_lines(s: SparkSession, f: str) -> DataFrame:
    pieces = B.table(s, f, "documents").select("doc_id", F.posexplode(T.pack_lines(F.col("text"))).alias("piece", "t"))
    return pieces.select("doc_id", "piece", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


def profile_text(s: SparkSession, f: str) -> DataFrame:
    return B.table(s, f, "documents").select("doc_id", F.md5(T.profile_text(
        F.col("text"), F.array("lang", "source"), F.array("source"), F.array("lang"))).alias("text_md5"))


OLD_NEW = f"""orders_old AS (SELECT * FROM orders WHERE o_orderdate::DATE < {Q.SPLIT_DAY}), orders_new AS (SELECT * FROM orders WHERE o_orderdate::DATE >= {Q.SPLIT_DAY}),
snap_old AS MATERIALIZED (SELECT o_custkey::VARCHAR AS author_id, c_name AS ad_soyad, l.p AS unvan, c_mktsegment AS fakulte, nullif(l.s, 'P') AS bolum, [l.p, c_mktsegment] AS anahtar_kelimeler
  FROM (SELECT o_custkey, max({{'t': o_totalprice, 'k': o_orderkey, 'p': o_orderpriority, 's': o_orderstatus}}) AS l FROM orders_old GROUP BY ALL) JOIN customer ON c_custkey = o_custkey),
snap_new AS MATERIALIZED (SELECT o_custkey::VARCHAR AS author_id, upper(c_name) AS ad_soyad, l.p AS unvan, c_mktsegment AS fakulte, nullif(l.s, 'P') AS bolum, [c_mktsegment, l.p] AS anahtar_kelimeler
  FROM (SELECT o_custkey, max({{'t': o_totalprice, 'k': o_orderkey, 'p': o_orderpriority, 's': o_orderstatus}}) AS l FROM orders_new GROUP BY ALL) JOIN customer ON c_custkey = o_custkey),
changes AS MATERIALIZED (
  SELECT author_id, 'added' AS change, NULL::VARCHAR AS field, NULL::VARCHAR AS old, NULL::VARCHAR AS new FROM snap_new ANTI JOIN snap_old USING (author_id)
  UNION ALL SELECT author_id, 'left', NULL, NULL, NULL FROM snap_old ANTI JOIN snap_new USING (author_id)
  UNION ALL SELECT author_id, 'changed', 'unvan', o.unvan, n.unvan FROM snap_old o JOIN snap_new n USING (author_id) WHERE o.unvan <> n.unvan
  UNION ALL SELECT author_id, 'changed', 'bolum', o.bolum, n.bolum FROM snap_old o JOIN snap_new n USING (author_id) WHERE coalesce(o.bolum, '') <> coalesce(n.bolum, '')
  UNION ALL SELECT author_id, 'changed', 'anahtar_kelimeler', '["' || array_to_string(o.anahtar_kelimeler, '","') || '"]', '["' || array_to_string(n.anahtar_kelimeler, '","') || '"]'
    FROM snap_old o JOIN snap_new n USING (author_id) WHERE list_sort(o.anahtar_kelimeler) <> list_sort(n.anahtar_kelimeler)),
net AS MATERIALIZED (SELECT author_id, section, p, sum(s)::BIGINT AS n FROM (
    SELECT o_custkey::VARCHAR AS author_id, o_orderstatus AS section, o_orderpriority AS p, -1 AS s FROM orders_old
    UNION ALL SELECT o_custkey::VARCHAR, o_orderstatus, o_orderpriority, 1 FROM orders_new) GROUP BY ALL HAVING sum(s) <> 0),
report AS MATERIALIZED (SELECT author_id, sum(f)::BIGINT AS n_fields, sum(a)::BIGINT AS n_added, sum(r)::BIGINT AS n_removed FROM (
    SELECT author_id, 1 AS f, 0 AS a, 0 AS r FROM changes WHERE change = 'changed' UNION ALL
    SELECT author_id, 0, greatest(n, 0), greatest(-n, 0) FROM net) GROUP BY ALL)"""
O_ = f"WITH {OLD_NEW} "
STORED = """stored AS (SELECT author_id, ad_soyad, unvan, fakulte AS detail, bolum IS NOT NULL AS has_details, fakulte <> 'MACHINERY' AS active FROM snap_old)"""
ACTIONS = """act AS MATERIALIZED (SELECT coalesce(n.author_id, o.author_id) AS id, CASE WHEN n.author_id IS NULL THEN 'delete' WHEN o.author_id IS NULL OR n.unvan <> o.unvan OR n.fakulte <> o.fakulte THEN 'process' ELSE 'skip' END AS action
  FROM snap_new n FULL JOIN snap_old o ON n.author_id = o.author_id)"""
PERSONS = """persons AS (SELECT c_custkey AS person_id, c_name AS name, n_name AS university, c_mktsegment AS faculty,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Prof. Dr.' WHEN 'BUILDING' THEN 'Doç. Dr.' WHEN 'FURNITURE' THEN 'Dr. Öğr. Üyesi' WHEN 'HOUSEHOLD' THEN 'Öğr. Gör. Dr.' WHEN 'MACHINERY' THEN 'Uzman' ELSE 'Arş. Gör. Dr.' END AS title
  FROM customer JOIN nation ON n_nationkey = c_nationkey)"""
PUBS = """pubs AS (SELECT l_suppkey AS person_id, l_returnflag AS type, year(l_shipdate) AS year, CASE WHEN l_linestatus = 'O' THEN upper(p_name) ELSE p_name END AS title, l_linestatus AS level, p_brand AS language,
    CASE WHEN l_returnflag = 'R' THEN upper(p_name) ELSE p_name END AS name, row(l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS pos, l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey)"""
LINES = "string_split(text, chr(10))"
PAPER = "x || CASE WHEN length(x) > 99 THEN ' (01.02.2019 / 2021)' ELSE '' END || CASE WHEN length(x) > 49 THEN ' — ' || source ELSE '' END"
FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
TOPIC = rf"(CASE WHEN length({FLAT}) <= 800 THEN {FLAT} ELSE regexp_extract(left({FLAT}, 800), '^(.*) ', 1) || '…' END)"
TITLED = "'Gemi ve ' || CASE WHEN lang = 'de' THEN 'de' ELSE upper(left(lang, 1)) || substr(lang, 2) END"

ENTRIES = {
    "list_quality_gate": (list_quality_gate, f"""{O_} SELECT n AS n_rows, p AS n_previous, n = 0 OR n < (SELECT count(*) FROM customer) * 0.9 OR (p > 0 AND n < p * 0.45) AS refused
        FROM (SELECT count(*) AS n FROM snap_new), (SELECT count(*) AS p FROM snap_old)"""),
    "snapshot_diff": (snapshot_diff, f"{O_} SELECT * FROM changes"),
    "multiset_diff": (multiset_diff, f"{O_} SELECT author_id, section, CASE WHEN n > 0 THEN 'added' ELSE 'removed' END AS change, 'Öncelik: ' || p || CASE WHEN n > 0 THEN '!' ELSE '' END AS text, abs(n) AS n FROM net"),
    "diff_report": (diff_report, f"{O_} SELECT * FROM report"),
    "change_report": (change_report, f"""{O_}, fs AS (
          SELECT author_id, string_agg(field || ': ' || coalesce(old, '-') || ': ' || coalesce(new, '-'), '|' ORDER BY list_position({FIELDS}, field)) AS fields
          FROM changes WHERE change = 'changed' GROUP BY ALL),
        texts AS (SELECT author_id, section, n > 0 AS gain, unnest(list_transform(range(abs(n)), lambda i: 'Öncelik: ' || p || CASE WHEN n > 0 THEN '!' ELSE '' END)) AS text FROM net),
        ss AS (SELECT author_id, section, coalesce(string_agg(text, ',' ORDER BY text) FILTER (gain), '') AS a, coalesce(string_agg(text, ',' ORDER BY text) FILTER (NOT gain), '') AS r
          FROM texts GROUP BY ALL),
        sections AS (SELECT author_id, string_agg(section || ' +' || a || ' -' || r, '|' ORDER BY section) AS sections FROM ss GROUP BY ALL)
        SELECT author_id, ad_soyad, unvan, bolum, coalesce(fields, '') AS fields, coalesce(sections, '') AS sections
        FROM fs FULL JOIN sections USING (author_id) LEFT JOIN snap_new USING (author_id)"""),
    "diff_summary": (diff_summary, f"{O_} SELECT count(*) FILTER (change = 'added') AS n_added, count(*) FILTER (change = 'left') AS n_left, (SELECT count(*) FROM report) AS n_changed FROM changes"),
    "load_snapshot": (load_snapshot, "SELECT c_custkey::VARCHAR AS author_id, c_name AS ad_soyad, c_mktsegment AS articles, c_mktsegment = 'BUILDING' AS has_details FROM customer"),
    "apply_snapshot": (apply_snapshot, f"""{O_}, {STORED} SELECT author_id, coalesce(n.ad_soyad, s.ad_soyad) AS ad_soyad, coalesce(n.unvan, s.unvan) AS unvan, detail, coalesce(has_details, false) AS has_details,
        n.author_id IS NOT NULL AS active, CASE WHEN n.author_id IS NOT NULL THEN '1998-07-01' ELSE '1998-06-30' END AS last_seen FROM stored s FULL JOIN snap_new n USING (author_id)"""),
    "detail_targets": (detail_targets, f"{O_}, {STORED} SELECT author_id, CASE WHEN author_id IN (SELECT author_id FROM stored WHERE has_details AND active) THEN 'refresh' ELSE 'missing' END AS reason FROM snap_new"),
    "resume_progress": (resume_progress, f"{O_} SELECT author_id FROM snap_new WHERE author_id NOT IN (SELECT o_custkey::VARCHAR FROM orders WHERE o_orderstatus = 'F')"),
    "sync_by_hash": (sync_by_hash, f"{O_}, {ACTIONS} SELECT * FROM act"),
    "replace_by_key": (replace_by_key, f"""{O_}, {ACTIONS} SELECT o_custkey::VARCHAR AS id, o_orderkey AS pos, 'Öncelik: ' || o_orderpriority AS text FROM orders_old WHERE o_custkey::VARCHAR NOT IN (SELECT id FROM act WHERE action <> 'skip')
        UNION ALL SELECT o_custkey::VARCHAR, o_orderkey, 'Öncelik: ' || o_orderpriority || '!' FROM orders_new WHERE o_custkey::VARCHAR IN (SELECT id FROM act WHERE action = 'process')"""),
    "ids_to_delete": (ids_to_delete, f"{O_} SELECT 'C' || c_custkey AS person_id FROM customer WHERE c_mktsegment <> 'FURNITURE' AND c_nationkey >= 5 AND c_custkey::VARCHAR NOT IN (SELECT author_id FROM snap_new)"),
    "identity_upsert": (identity_upsert, f"""SELECT s_suppkey AS upload_id, 'm' || s_suppkey || '@example.org' AS email, CASE WHEN c_custkey IS NOT NULL THEN 'C' || c_custkey ELSE
          'U' || left(sha256(s_name || ' İnci' || chr(31) || s_acctbal::DECIMAL(12,2)::VARCHAR), 6) || '_Supplier_Inci' END AS person_id,
          CASE WHEN c_custkey IS NOT NULL THEN 'update' ELSE 'insert' END AS action FROM supplier LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_custkey = s_suppkey"""),
    "filter_persons": (filter_persons, f"WITH {PERSONS} SELECT person_id, name, university FROM persons WHERE faculty = 'MACHINERY' AND contains(name || university, '1')"),
    "project_person_summary": (project_person_summary, f"WITH {PERSONS} SELECT person_id, title, name, university, faculty, NULL::VARCHAR AS department, CASE WHEN faculty <> 'BUILDING' THEN faculty || '|' || university ELSE '' END AS areas FROM persons"),
    "facet_values": (facet_values, f"""WITH {PERSONS} SELECT DISTINCT 'area' AS facet, unnest([faculty, university]) AS value, 0::BIGINT AS _rank FROM persons UNION ALL SELECT DISTINCT 'university', university, 0 FROM persons
        UNION ALL SELECT DISTINCT 'title', title, coalesce(list_position(['Prof. Dr.', 'Doç. Dr.', 'Dr. Öğr. Üyesi', 'Öğr. Gör. Dr.', 'Arş. Gör. Dr.'], title), 99) FROM persons"""),
    "publications_by_year": (publications_by_year, f"""WITH {PUBS}, y AS (SELECT person_id, title, pos, CASE WHEN l_orderkey % 2 = 1 THEN year END AS year FROM pubs)
        SELECT person_id, count(*) AS n, max(year)::BIGINT AS newest, md5(string_agg(concat_ws(' ', year::VARCHAR, title), chr(10) ORDER BY coalesce(year, 0) DESC, pos)) AS list_md5
        FROM y GROUP BY ALL"""),
    "publication_counts": (publication_counts, 'SELECT l_suppkey AS person_id, count(*) FILTER (l_returnflag = \'A\') AS "A", count(*) FILTER (l_returnflag = \'N\') AS "N", count(*) FILTER (l_returnflag = \'R\') AS "R" FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL'),
    "dedupe_publications": (dedupe_publications, f"WITH {PUBS} SELECT person_id, lower(title) AS title_key, year, type, arg_max(title, pos) AS title, min(pos)[1] AS first_order FROM pubs GROUP BY person_id, lower(pubs.title), year, type"),
    "group_courses": (group_courses, f"""WITH {PUBS}, t AS (SELECT person_id, level, lower(name) AS name_key, year::VARCHAR AS term, min(pos) AS p FROM pubs GROUP BY ALL)
        SELECT person_id, level, name_key, any_value(n) AS name, any_value(la) AS language, string_agg(term, '|' ORDER BY p) AS terms FROM t JOIN (
          SELECT person_id, level, lower(name) AS name_key, arg_min(name, pos) AS n, arg_min(language, pos) AS la FROM pubs GROUP BY person_id, level, lower(pubs.name)) USING (person_id, level, name_key) GROUP BY ALL"""),
    "resolve_person_name": (resolve_person_name("sequence"), None),
    "resolve_person_name_levenshtein": (resolve_person_name("levenshtein"), None),
    "registry_sections": (registry_sections, rf"""SELECT doc_id AS author_id, lang || '|' || source || '|Bilim alanı: ' || source || '|Birim: ' || {TITLED} || ' / ' || lang AS arastirma,
        'Doktora tezi: ' || lang AS egitim, source || ' (2022–2024): ' || {TOPIC} AS projeler,
        CASE WHEN lang = 'de' THEN 'Doktora: ' ELSE 'Yüksek Lisans: ' END || source AS yonetilen_tezler, lang AS patentler,
        (SELECT string_agg(v, '|' ORDER BY i) FROM (SELECT left(x, 3) AS v, min(i) AS i FROM (SELECT unnest({LINES}) AS x, generate_subscripts({LINES}, 1) AS i) GROUP BY 1)) AS dersler,
        len({LINES}) + len(list_filter({LINES}, lambda x: contains(x, 'a'))) AS n_publications,
        md5(array_to_string(list_concat(list_transform(list_filter({LINES}, lambda x: length(x) < 200), lambda x: {PAPER}), list_transform(list_filter({LINES}, lambda x: length(x) >= 200), lambda x: {PAPER}),
          list_transform(list_filter({LINES}, lambda x: contains(x, 'a')), lambda x: CASE WHEN length(x) > 150 THEN left(x, 5) || ' (Kitap: ' || left(x, 20) || ')' ELSE left(x, 20) END || ' (2020)')), chr(10))) AS publications_md5
        FROM documents"""),
    "to_common_cv": (common_cv, rf"""SELECT doc_id AS author_id, CASE lang WHEN 'en' THEN 'Prof. Dr.' WHEN 'fr' THEN 'Arş. Gör. Dr.' ELSE 'Uzman' END AS title,
        'S' || substr(source, 2) AS name, 'Piri Üniversitesi' AS university, {TITLED} AS faculty, NULL::VARCHAR AS email,
        'https://example.org/' || doc_id AS web, CASE WHEN lang <> 'fr' THEN doc_id::VARCHAR END AS registry_id, CASE WHEN lang = 'en' THEN 'Deniz' ELSE '' END AS units,
        CASE WHEN lang <> 'es' THEN 'S' || substr(source, 2) ELSE '' END AS students,
        md5(array_to_string(list_transform(list_filter({LINES}, lambda x: length(x) > 60), lambda x: 'S' || substr(source, 2) || ':' || left(x, 12) ||
          CASE WHEN lang = 'de' THEN '' ELSE ' · ' || upper(left(lang, 1)) || substr(lang, 2) END || CASE WHEN length(x) > 99 THEN ':2010-2014' ELSE '' END), '|')) AS posts_md5,
        CASE WHEN lang = 'fr' THEN 'Doktora' ELSE 'Doktora (devam ediyor)' END AS degrees, CASE WHEN lang = 'fr' THEN '2019' ELSE '' END AS years, 'Araştırma Projesi' AS programs,
        '01.03.2022 – 01.03.2024' AS periods, CASE WHEN lang = 'de' THEN 'doktora' ELSE 'yuksek_lisans' END AS levels, len({LINES}) + len(list_filter({LINES}, lambda x: contains(x, 'a'))) + 1 AS n_publications,
        md5(array_to_string(list_concat(list_transform(list_filter({LINES}, lambda x: length(x) < 200), lambda x: concat_ws(':', 'makale', CASE WHEN length(x) > 99 THEN '2021' END, CASE WHEN length(x) > 49 THEN source END)),
          list_transform(list_filter({LINES}, lambda x: length(x) >= 200), lambda x: concat_ws(':', 'bildiri', '2021', source)),
          list_transform(list_filter({LINES}, lambda x: contains(x, 'a')), lambda x: CASE WHEN length(x) > 150 THEN 'kitap_bolumu:2020:' || left(x, 20) ELSE 'kitap:2020:Yayınevi' END), ['diger:2021:Patent 2021/0042']), '|')) AS types_md5
        FROM documents"""),
    "cv_sections": (cv_sections, rf"""SELECT doc_id AS author_id, lang || '|' || source AS arastirma, CASE WHEN lang = 'fr' THEN 'Doktora' ELSE 'Doktora (devam ediyor)' END || ' tezi: ' || lang AS egitim,
        source || ' (01.03.2022 – 01.03.2024)' AS projeler, CASE WHEN lang = 'de' THEN 'Doktora: ' ELSE 'Yüksek Lisans: ' END || source AS yonetilen_tezler,
        md5(array_to_string(list_concat(list_transform(list_filter({LINES}, lambda x: length(x) < 200), lambda x: x || CASE WHEN length(x) > 99 THEN ' (2021)' ELSE '' END),
          list_transform(list_filter({LINES}, lambda x: length(x) >= 200), lambda x: x || ' (2021)'),
          list_transform(list_filter({LINES}, lambda x: contains(x, 'a')), lambda x: CASE WHEN length(x) > 150 THEN left(x, 5) ELSE left(x, 20) END || ' (2020)'), [lang || ' (2021)']), chr(10))) AS publications_md5 FROM documents"""),
    "chunk_sections": (chunk_sections, None),
    "pack_lines": (pack_lines, f"""WITH l AS (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN {LINES}[:-2] ELSE {LINES} END AS ls FROM documents),
        p AS (SELECT doc_id, list_reduce(list_transform(ls, lambda x: {{'done': []::VARCHAR[], 'cur': x || chr(10)}}),
          lambda a, b: CASE WHEN length(a.cur) + length(b.cur) - 1 > 5000 THEN {{'done': list_append(a.done, a.cur), 'cur': b.cur}} ELSE {{'done': a.done, 'cur': a.cur || b.cur}} END) AS s FROM l),
        q AS (SELECT doc_id, list_append(s.done, s.cur) AS ps FROM p)
        SELECT doc_id, i - 1 AS piece, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, unnest(ps) AS t, generate_subscripts(ps, 1) AS i FROM q)"""),
    "profile_text": (profile_text, "SELECT doc_id, md5(text || chr(10) || 'Araştırma alanları: ' || lang || ', ' || source || chr(10) || 'Yöntemler: ' || source || chr(10) || 'Anahtar kelimeler: ' || lang) AS text_md5 FROM documents"),
}
