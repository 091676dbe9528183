"""Registry snapshots: quality gate, diff, report, apply; keyed synchronisation by content hash.

Relation: snapshot(author_id, <list fields>, <sections array<string>>). Field names are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarmesh.functions import text as X

MIN_LIST_RATIO = 0.9

# List fields that are compared, and sections whose items are compared.
LIST_FIELDS = ["ad_soyad", "unvan", "fakulte", "bolum", "anabilim_dali_program",
               "temel_alan", "bilim_alani", "anahtar_kelimeler", "eposta", "orcid"]
SECTIONS = ["makaleler", "bildiriler", "kitaplar", "projeler", "dersler", "yonetilen_tezler", "patentler",
            "akademik_gorevler", "ogrenim"]
DETAIL_SECTIONS = ["kitaplar", "makaleler", "bildiriler", "projeler", "dersler", "yonetilen_tezler", "patentler"]


def display_text(section: str) -> "callable":
    """Display text of a section's item (a struct), from which its comparison key is made."""
    def joined(*names: str):
        return lambda i: F.concat_ws(" · ", *[F.nullif(i[n], F.lit("")) for n in names])

    def with_suffix(main: str, extra: str):
        return lambda i: F.when(F.coalesce(i[extra], F.lit("")) != "",
                                F.concat(i[main], F.lit(" ("), i[extra], F.lit(")"))).otherwise(i[main])

    return {
        "kitaplar": lambda i: F.when(F.coalesce(i["bolum_adi"], F.lit("")) != "", F.concat(
            i["bolum_adi"], F.lit(" ("), i["baslik"], F.lit(")"))).otherwise(i["baslik"]),
        "dersler": with_suffix("ders_adi", "duzey"),
        "yonetilen_tezler": lambda i: i["tez_adi"],
        "akademik_gorevler": joined("yil", "unvan", "kurum"),
        "ogrenim": joined("derece", "kurum"),
    }.get(section, lambda i: i["baslik"])


def list_quality_gate(listed: DataFrame, previous: DataFrame, expected: Column) -> DataFrame:
    """One row (n_rows, n_previous, refused): refused when empty, below 0.9 of the expected number (a constant, or one
    row's count as a scalar) or below 0.45 of the previous one. Nothing is to be applied when refused."""
    counts = listed.agg(F.count("*").alias("n_rows")).withColumn(
        "n_previous", previous.agg(F.count("*")).scalar())
    n, prev = F.col("n_rows"), F.col("n_previous")
    refused = ((n == 0) | ((expected > 0) & (n < expected * MIN_LIST_RATIO))
               | ((prev > 0) & (n < prev * MIN_LIST_RATIO / 2)))
    return counts.withColumn("refused", refused)


def comparable(c: Column, data_type: str) -> Column:
    """Comparison form of a field: normalised text, or the sorted normalised items of a list; null equals empty."""
    if data_type.startswith("array"):
        items = F.array_sort(F.transform(F.coalesce(c, F.array().cast("array<string>")), X.norm_key))
        return F.to_json(items)
    return X.norm_key(F.coalesce(c.cast("string"), F.lit("")))


def snapshot_diff(old: DataFrame, new: DataFrame, fields: list[str] = LIST_FIELDS, key: str = "author_id") -> DataFrame:
    """(key, change, field, old, new): change is 'added', 'left' or 'changed' (one row per changed field, raw values).

    One full outer join on the key; the comparison is row-level.
    """
    types = {f: new.schema[f].dataType.simpleString() for f in fields}

    def raw(c: Column, data_type: str) -> Column:
        return F.to_json(c) if data_type.startswith("array") else c.cast("string")

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select(F.col(key), F.struct(*[F.col(f).alias(f) for f in fields]).alias(s), F.lit(True).alias(f"in_{s}"))

    both = side(old, "o").join(side(new, "n"), key, "full_outer")
    changed = F.filter(F.array(*[F.when(
        comparable(F.col(f"o.{f}"), t) != comparable(F.col(f"n.{f}"), t),
        F.struct(F.lit(f).alias("field"), raw(F.col(f"o.{f}"), t).alias("old"), raw(F.col(f"n.{f}"), t).alias("new")))
        for f, t in types.items()]), lambda d: d.isNotNull())
    marker = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old"),
                              F.lit(None).cast("string").alias("new")))
    change = F.when(F.col("in_o").isNull(), F.lit("added")).when(F.col("in_n").isNull(), F.lit("left")).otherwise(
        F.lit("changed"))
    return both.select(key, change.alias("change"), F.explode(
        F.when(change == "changed", changed).otherwise(marker)).alias("d")).select(key, "change", "d.*")


def multiset_diff(old_items: DataFrame, new_items: DataFrame, keys: tuple[str, ...] = ("author_id", "section")) -> DataFrame:
    """(keys, change, text) of items (keys, pos, text): 'added' and 'removed' texts, each as often as its count differs.

    Items compare by normalised text. Both sides are counted per key before anything is shuffled further; the text
    shown is the first occurrence's on the side it comes from.
    """
    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*keys, X.norm_key(F.col("text")).alias("_k"), F.lit(sign).alias("_s"),
                         F.struct("pos", "text").alias("_t"))

    both = side(old_items, -1).unionByName(side(new_items, 1))
    net = both.groupBy(*keys, "_k").agg(
        F.sum("_s").alias("n"), F.min(F.when(F.col("_s") > 0, F.col("_t"))).alias("_new"),
        F.min(F.when(F.col("_s") < 0, F.col("_t"))).alias("_old")).where(F.col("n") != 0)
    text = F.when(F.col("n") > 0, F.col("_new.text")).otherwise(F.col("_old.text"))
    return net.select(*keys, F.when(F.col("n") > 0, F.lit("added")).otherwise(F.lit("removed")).alias("change"),
                      F.explode(F.array_repeat(text, F.abs("n").cast("int"))).alias("text"))


def section_items(snapshot: DataFrame, section: str, key: str = "author_id") -> DataFrame:
    """Items of a section column (array of structs) as rows (key, section, pos, text)."""
    return snapshot.select(key, F.lit(section).alias("section"), F.posexplode(section).alias("pos", "_i")).select(
        key, "section", "pos", display_text(section)(F.col("_i")).alias("text"))


def diff_report(field_changes: DataFrame, item_changes: DataFrame, key: str = "author_id") -> DataFrame:
    """Per changed person: the number of changed fields, added and removed items. Persons without a change are absent."""
    fields = field_changes.where(F.col("change") == "changed").select(
        key, F.lit(1).alias("f"), F.lit(0).alias("a"), F.lit(0).alias("r"))
    items = item_changes.select(key, F.lit(0).alias("f"), (F.col("change") == "added").cast("int").alias("a"),
                                (F.col("change") == "removed").cast("int").alias("r"))
    return fields.unionByName(items).groupBy(key).agg(
        F.sum("f").alias("n_fields"), F.sum("a").alias("n_added"), F.sum("r").alias("n_removed"))


def change_report(persons: DataFrame, field_changes: DataFrame, item_changes: DataFrame, summary: list[str] = ("ad_soyad", "unvan", "bolum"),
                  fields: list[str] = LIST_FIELDS, key: str = "author_id") -> DataFrame:
    """The merged report, one row per changed person: key, summary columns, fields [(field, old, new)], sections
    [(section, added, removed)].

    Fields come in the order of `fields`, sections and their texts in text order; equal texts are listed as often as they
    changed. Persons without a change are absent, those that only joined or left too. Both inputs are grouped before they
    meet, so the join has one row per person; `persons` is the new snapshot.
    """
    order = F.array_position(F.array(*map(F.lit, fields)), F.col("field"))
    changed = field_changes.where(F.col("change") == "changed").groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct(order.alias("place"), "field", "old", "new"))).alias("_f")).select(
        key, F.transform("_f", lambda x: F.struct(x["field"].alias("field"), x["old"].alias("old"), x["new"].alias("new"))).alias("fields"))

    def texts(change: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("change") == change, F.col("text")))).alias(change)

    sections = item_changes.groupBy(key, "section").agg(texts("added"), texts("removed")).groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct("section", "added", "removed"))).alias("sections"))
    both = changed.join(sections, key, "full_outer")
    empty = {c: F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c) for c in ("fields", "sections")}
    return both.join(persons.select(key, *summary), key, "left").select(key, *summary, empty["fields"], empty["sections"])


def diff_summary(field_changes: DataFrame, report: DataFrame) -> DataFrame:
    """One row (n_added, n_left, n_changed) of persons."""
    counts = field_changes.agg(F.count_if(F.col("change") == "added").alias("n_added"),
                               F.count_if(F.col("change") == "left").alias("n_left"))
    return counts.withColumn("n_changed", report.agg(F.count("*")).scalar())


def upsert_by_key(stored: DataFrame, loaded: DataFrame, key: str = "author_id", order: str | None = None) -> DataFrame:
    """Stored rows with the loaded ones in their place, one row per key.

    Of several loaded rows of a key the one with the greatest `order` counts (ties: the greatest row); without an order
    the greatest row. Both tables have the same columns.
    """
    rest = [c for c in loaded.columns if c != key]
    rank = F.struct(*([order] if order else []), *rest)
    newest = loaded.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(key, "_r.*")
    return stored.join(newest, key, "left_anti").unionByName(newest)


def apply_snapshot(stored: DataFrame, listed: DataFrame, fields: list[str], today: Column,
                   key: str = "author_id") -> DataFrame:
    """Stored rows after a list scan: listed rows take the list fields (details kept), are active and seen today;
    absent rows turn inactive and stay; returning rows become active again."""
    new = listed.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_listed"))
    both = stored.join(new, key, "full_outer")
    listed_now = F.coalesce("_listed", F.lit(False))
    columns = []
    for c in stored.columns:
        if c in fields:
            columns.append(F.coalesce(f"_new_{c}", c).alias(c))
        elif c == "active":
            columns.append(listed_now.alias(c))
        elif c == "last_seen":
            columns.append(F.when(listed_now, today).otherwise(F.col(c)).alias(c))
        elif c == "has_details":
            columns.append(F.coalesce(c, F.lit(False)).alias(c))
        else:
            columns.append(F.col(c))
    return both.select(*columns)


def detail_targets(listed: DataFrame, stored: DataFrame, full_scan: bool, limit: int | None = None,
                   key: str = "author_id") -> DataFrame:
    """Persons whose details are to be fetched: those without details; on a full scan the others too, up to `limit`."""
    known = stored.where(F.col("has_details") & F.col("active")).select(key)
    missing = listed.select(key).join(known, key, "left_anti").withColumn("reason", F.lit("missing"))
    if not full_scan:
        return missing
    others = listed.select(key).join(known, key, "left_semi").withColumn("reason", F.lit("refresh"))
    return missing.unionByName(others if limit is None else others.orderBy(key).limit(limit))


def resume_progress(targets: DataFrame, done: DataFrame, key: str = "author_id") -> DataFrame:
    """Targets not yet in the progress table."""
    return targets.join(done.select(key).distinct(), key, "left_anti")


# --- synchronisation by hash -------------------------------------------------------------------

def sync_actions(source: DataFrame, stored: DataFrame, key: str = "id", hash_: str = "hash", force: bool = False) -> DataFrame:
    """(key, action) with action 'process' (new, changed or forced), 'skip' or 'delete'."""
    both = source.select(key, F.col(hash_).alias("_s"), F.lit(True).alias("_in")).join(
        stored.select(key, F.col(hash_).alias("_t")), key, "full_outer")
    action = (F.when(F.col("_in").isNull(), F.lit("delete"))
              .when(F.lit(force) | ~F.col("_s").eqNullSafe(F.col("_t")), F.lit("process")).otherwise(F.lit("skip")))
    return both.select(key, action.alias("action"))


def replace_by_key(stored: DataFrame, fresh: DataFrame, actions: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows with all rows of processed and deleted keys replaced by the fresh rows of processed keys."""
    touched = actions.where(F.col("action") != "skip").select(key)
    return stored.join(touched, key, "left_anti").unionByName(fresh)


def ids_to_delete(registered: DataFrame, listed: DataFrame, upload_prefix: str, other_prefix: str,
                  key: str = "person_id") -> DataFrame:
    """Registered ids that are no longer listed, except uploaded ones (by path) and those of the other source (by id)."""
    own = registered.where(~F.coalesce(F.col("path"), F.lit("")).startswith(upload_prefix)
                           & ~F.col(key).startswith(other_prefix))
    return own.select(key).join(listed.select(key), key, "left_anti")
