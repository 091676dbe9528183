"""The call catalogue: filters, facets, order, status, next dates, stored matches.

Relation: call(call_id, url, title, program_code, program_name, source, audience, summary, conditions, text,
publish_date, first_seen, dates array<struct<label,date,is_application>>). `today` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarmesh.functions import extraction as E
from scholarmesh.functions import text as X
from scholarmesh.functions.ranking import top_k

PAGE_LIMIT = 50
MAX_PAGE_LIMIT = 200
RECHECK_DAYS = 90
CALL_TEXT_CHARS = 6000
URGENT_DAYS = 7


def with_deadline(calls: DataFrame, today: Column) -> DataFrame:
    """Adds `deadline` (latest application date) and `status`; both row-level, so filters push below nothing else."""
    return calls.withColumn("deadline", E.deadline(F.col("dates"))).withColumn(
        "status", E.call_status(F.col("deadline"), today))


def filter_calls(calls: DataFrame, today: Column, status: str | None = None, audience: str | None = None,
                 source: str | None = None, program: str | None = None, closing_within: int | None = None,
                 search: str | None = None) -> DataFrame:
    """Conjunction of the given filters. The search text is a case-insensitive substring of any text field;
    '%' and '_' in it act as wildcards; null fields never match."""
    out = with_deadline(calls, today)
    for column, wanted in (("audience", audience), ("source", source), ("program_code", program), ("status", status)):
        if wanted:
            out = out.where(F.col(column) == wanted)
    if closing_within is not None:
        out = out.where((F.col("status") == "acik") & (F.col("deadline") <= F.date_add(today, closing_within)))
    if search and search.strip():
        pattern = f"%{search.strip()}%"
        fields = [F.col(c) for c in ("title", "summary", "program_name", "program_code")]
        fields += [F.array_join("conditions", " "), F.col("text")]
        match = F.lit(False)
        for f in fields:
            match = match | F.coalesce(f.ilike(pattern), F.lit(False))
        out = out.where(match)
    return out


def order_calls_page(calls: DataFrame, limit: int = PAGE_LIMIT, offset: int = 0) -> DataFrame:
    """One page: open calls by nearest deadline, then undated, then past ones; newest first inside; id breaks ties."""
    limit = max(1, min(limit, MAX_PAGE_LIMIT))
    group = F.when(F.col("status") == "acik", 0).when(F.col("status") == "belirsiz", 1).otherwise(2)
    return calls.orderBy(group, F.when(F.col("status") == "acik", F.col("deadline")).asc_nulls_last(),
                         F.col("deadline").desc_nulls_last(), F.col("publish_date").desc_nulls_last(),
                         F.col("call_id")).offset(offset).limit(limit)


def filtered_page_count(filtered: DataFrame) -> DataFrame:
    """Size of the filtered set, whatever page is shown."""
    return filtered.agg(F.count("*").alias("total"))


def calls_with_matches(calls: DataFrame, matches: DataFrame) -> DataFrame:
    """Calls with the names of their stored matches in rank order, [] where none; a call stores at most 20."""
    names = matches.groupBy("call_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("_m")).select(
        "call_id", F.col("_m.name").alias("matched_names"))
    return calls.join(names, "call_id", "left").withColumn(
        "matched_names", F.coalesce("matched_names", F.array().cast("array<string>")))


# --- facets -------------------------------------------------------------------------------

def program_facet(calls: DataFrame, source: str | None = None) -> DataFrame:
    rows = calls.where(F.col("program_code").isNotNull())
    if source:
        rows = rows.where(F.col("source") == source)
    return (rows.groupBy(F.col("program_code").alias("code"))
            .agg(F.max("program_name").alias("name"), F.count("*").alias("n_calls"))
            .orderBy(F.desc("n_calls"), "code"))


def source_facet(calls: DataFrame, today: Column) -> DataFrame:
    return (with_deadline(calls, today).groupBy("source")
            .agg(F.count("*").alias("n_calls"), F.count_if(F.col("status") == "acik").alias("n_open"))
            .orderBy(F.desc("n_calls"), "source"))


def run_status(runs: DataFrame, persons: DataFrame | None = None) -> DataFrame:
    """One row about a run log (run_id, kind, status, finished_at): latest, oldest active, last finished, last successes.

    A run is finished when it succeeded or failed. With `persons` (active) also how many are active.
    """
    ended = F.col("status").isin("bitti", "hata")
    active_persons = [] if persons is None else [
        persons.agg(F.count_if(F.coalesce("active", F.lit(False)))).scalar().alias("n_active_persons")]
    done = F.col("status") == "bitti"
    active = F.col("status").isin("bekliyor", "calisiyor")
    return runs.agg(
        F.max("run_id").alias("last_run_id"),
        F.max_by("status", "run_id").alias("last_status"),
        F.max(F.when(done, F.col("finished_at"))).alias("last_success"),
        F.min(F.when(active, F.col("run_id"))).alias("oldest_active_id"),
        F.max(F.when(done & (F.col("kind") == "tam"), F.col("finished_at"))).alias("last_full_success"),
        F.max(F.when(ended, F.col("run_id"))).alias("last_ended_id"),
        F.max_by(F.when(ended, F.col("status")), F.when(ended, F.col("run_id"))).alias("last_ended_status")).select("*", *active_persons)


def run_counters(outcomes: DataFrame) -> DataFrame:
    """Counters per run as a map outcome -> count; the map has one entry per kind of outcome."""
    per = outcomes.groupBy("run_id", "outcome").agg(F.count("*").alias("n"))
    return per.groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("counters"))


# --- one per title, recheck, dates ------------------------------------------------------------

def newest_per_title(calls: DataFrame) -> DataFrame:
    """One call per folded title: newest publish date (undated last), then smallest id.

    The limit to one row per title is applied before the shuffle, so a title published very often is not one task.
    """
    keyed = calls.withColumn("_t", X.fold(F.col("title")))
    return top_k(keyed, ["_t"], [F.col("publish_date").desc_nulls_last(), F.col("call_id").asc()], 1, "_r").drop(
        "_t", "_r")


def open_academic_calls(calls: DataFrame, today: Column, ids: DataFrame | None = None,
                        academic: str = "academic") -> DataFrame:
    """Academic calls that are undated or not past, optionally only those whose id is in `ids`."""
    rows = calls.where(F.col("audience") == academic).withColumn("deadline", E.deadline(F.col("dates")))
    rows = rows.where(F.col("deadline").isNull() | (F.col("deadline") >= today))
    return rows if ids is None else rows.join(ids.select("call_id"), "call_id", "left_semi")


def due_for_recheck(calls: DataFrame, processed: DataFrame, today: Column, source: str | None = None) -> DataFrame:
    """Open calls, and undated ones first seen in the last 90 days, unless processed in this run."""
    rows = calls.withColumn("deadline", E.deadline(F.col("dates")))
    if source:
        rows = rows.where(F.col("source") == source)
    fresh = F.col("deadline").isNull() & (F.col("first_seen") >= F.date_sub(today, RECHECK_DAYS))
    return rows.where((F.col("deadline") >= today) | fresh).join(processed.select("call_id"), "call_id", "left_anti")


def next_deadline(dates: Column, today: Column) -> Column:
    """Struct (label, date, days_left, text, urgent, other_dates) of the first application date from today,
    else the last one; null without application dates."""
    applying = F.filter(dates, lambda t: F.coalesce(t["is_application"], F.lit(True)))
    ordered = F.array_sort(F.transform(applying, lambda t: F.struct(t["date"].alias("date"), t["label"].alias("label"))))
    upcoming = F.filter(ordered, lambda t: t["date"] >= today)
    chosen = F.coalesce(F.try_element_at(upcoming, F.lit(1)), F.try_element_at(ordered, F.lit(-1)))
    days = F.datediff(chosen["date"], today)
    words = (F.when(days < 0, F.lit("Süresi doldu")).when(days == 0, F.lit("Bugün son gün"))
             .otherwise(F.concat(days.cast("string"), F.lit(" gün kaldı"))))
    return F.when(chosen.isNotNull(), F.struct(
        chosen["label"].alias("label"), chosen["date"].alias("date"), days.alias("days_left"), words.alias("text"),
        ((days >= 0) & (days < URGENT_DAYS)).alias("urgent"), (F.size(dates) - 1).alias("other_dates")))


def latest_per_label(entries: DataFrame, keys: tuple[str, ...] = ("call_id",)) -> DataFrame:
    """Per folded label the entry with the latest date; the first entry on ties."""
    best = entries.groupBy(*keys, X.fold(F.col("label")).alias("label_key")).agg(
        F.max_by(F.struct("label", "date"), F.struct("date", (-F.col("pos")).alias("p"))).alias("_b"))
    return best.select(*keys, "label_key", "_b.label", "_b.date")


def latest_per_label_array(dates: Column) -> Column:
    """The same on one array of dates, sorted by date; entries compare by the folded label."""
    def key(t: Column) -> Column:
        return X.fold(t["label"])

    indexed = F.transform(dates, lambda t, i: F.struct(t.alias("t"), i.alias("i"), key(t).alias("k")))
    kept = X.let(indexed, lambda rows: F.filter(rows, lambda a: ~F.exists(rows, lambda b: (b["k"] == a["k"]) & (
        (b["t"]["date"] > a["t"]["date"]) | ((b["t"]["date"] == a["t"]["date"]) & (b["i"] < a["i"]))))))
    ordered = F.array_sort(F.transform(kept, lambda a: F.struct(
        a["t"]["date"].alias("date"), a["i"].alias("i"), a["t"].alias("t"))))
    return F.transform(ordered, lambda a: a["t"])


def call_text(title: Column, code: Column, name: Column, summary: Column, text: Column) -> Column:
    """Text for the call index: title, program, summary and page text, nulls and empty parts skipped."""
    def kept(*parts: Column) -> list[Column]:
        return [F.nullif(p, F.lit("")) for p in parts]

    program = F.concat_ws(" ", *kept(code, name))
    return F.left(F.concat_ws("\n", *kept(title, program, summary, text)), F.lit(CALL_TEXT_CHARS))
