"""Announcements: new ones, updates and repeats of known calls, decisions, ledger, reclassification.

Relations: announcement(url, title, source, program_code, publish_date), ledger(url, decision), call(...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarmesh.functions import extraction as E
from scholarmesh.functions.hashing import content_hash
from scholarmesh.functions.ranking import bounded_join, is_small, top_k
from scholarmesh.operators.calls import latest_per_label_array
from scholarmesh.session import cut_lineage

BACKFILL_DAYS = 365
REPEAT_DAYS = 180
MIN_OVERLAP = 0.7
MIN_OVERLAP_SAME_CODE = 0.5
SAME_CODE_BONUS = 0.5
MIN_TITLE_TOKENS = 3
FOREVER = 2**30  # day number behind all dates
HOT_ROWS = 1_000_000  # announcements of one title and day from which their step is broadcast


# --- which announcements are new -----------------------------------------------------------

def new_announcements(listed: DataFrame, ledger: DataFrame, today: Column, mode: str = "incremental") -> DataFrame:
    """Listed items (source, pos, url, title, publish_date) to process, first occurrence per url, with `retry`.

    Known are ledger rows with a decision other than 'hata'; 'hata' rows are queued again after the new ones.
    Modes: 'incremental' stops at the first known url of a source's list, without a date bound; 'backfill' stops at
    the first item older than 365 days; 'unsorted' skips known and too old items anywhere. A source without any
    known url is a backfill.
    """
    known = ledger.where(F.col("decision") != "hata").select("url").distinct()
    old = F.coalesce(F.col("publish_date") < F.date_sub(today, BACKFILL_DAYS), F.lit(False))
    marked = listed.join(known.withColumn("_known", F.lit(True)), "url", "left").withColumn(
        "_known", F.coalesce("_known", F.lit(False))).withColumn("_old", old)
    if mode == "unsorted":
        fresh = marked.where(~F.col("_known") & ~F.col("_old"))
    else:
        # one bound per source, not a window over a source's whole list
        stops = marked.groupBy("source").agg(
            F.min(F.when(F.col("_known"), F.col("pos"))).alias("_first_known"),
            F.min(F.when(F.col("_old"), F.col("pos"))).alias("_first_old"))
        backfill = F.col("_first_known").isNull() | F.lit(mode == "backfill")
        stop = F.when(backfill, F.col("_first_old")).otherwise(F.col("_first_known"))
        fresh = marked.join(stops, "source").where(
            ~F.col("_known") & (F.col("pos") < F.coalesce(stop, F.lit(2**62))))
    first = fresh.groupBy("url").agg(F.min_by(F.struct("source", "title", "publish_date"), "pos").alias("_f"))
    fresh = first.select("url", "_f.*", F.lit(False).alias("retry"))
    failed = ledger.where(F.col("decision") == "hata").select(
        "url", "source", "title", "publish_date", F.lit(True).alias("retry"))
    return fresh.join(failed.select("url"), "url", "left_anti").unionByName(failed)


def processing_order(items: DataFrame) -> DataFrame:
    """Oldest first, undated last, earlier errors at the very end."""
    return items.orderBy(F.col("retry"), F.col("publish_date").asc_nulls_last(), F.col("url"))


# --- calls grouped by title -------------------------------------------------------------------

def _signature(title: Column) -> Column:
    """Title stems as one text: join and group keys are text, not arrays."""
    return F.array_join(E.title_tokens(title), " ")


def _signed(rows: DataFrame, name: str, spread: str) -> DataFrame:
    """Adds the signature of `title`; every distinct title is folded once."""
    titles = rows.select("title").distinct().withColumn(name, _signature(F.col("title")))
    return bounded_join(rows, cut_lineage(titles), ["title"], [spread])


def _code(code: str) -> Column:
    return F.lower(F.trim(F.coalesce(code, F.lit(""))))


def _title_dates(calls: DataFrame) -> DataFrame:
    """(sig, code, day, a, n, b): the two smallest (id, url) of each title signature and day; -1 for undated.

    Everything after this works on signatures and days, so a title that holds a third of all calls has no more rows
    than the calendar has days.
    """
    keys = ["sig", "code", "day"]
    rows = cut_lineage(_signed(calls, "sig", "call_id").select(
        "call_id", "url", "sig", _code("program_code").alias("code"),
        F.coalesce(_day(F.col("publish_date")), F.lit(-1)).alias("day")).where(F.col("sig") != ""))
    first = rows.groupBy(*keys).agg(F.min(F.struct("call_id", "url")).alias("a"), F.count("*").alias("n"))
    # second smallest: the minimum of what is left
    second = (rows.join(first.select(*keys, F.col("a.call_id").alias("_f")), keys).where(F.col("call_id") != F.col("_f"))
              .groupBy(*keys).agg(F.min(F.struct("call_id", "url")).alias("b")))
    return cut_lineage(first.join(second, keys, "left"))  # at most a calendar per title; read often


def _with_previous(days: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `prev`, the call (id) of the title's day before; at most a calendar of rows per title."""
    w = Window.partitionBy(*keys).orderBy("day")
    return days.withColumn("prev", F.lag(F.struct("day", F.col("a.call_id").alias("call_id"))).over(w))


def _newest_until(points: DataFrame, days: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bound, day): the newest call day of a title not after each bound. One running maximum per title over
    distinct bounds and days, so at most two calendars of rows."""
    union = points.select(*keys, F.col("bound").alias("_at"), F.lit(1).alias("_p"), F.lit(None).cast("int").alias("_d")).unionByName(
        days.select(*keys, F.col("day").alias("_at"), F.lit(0).alias("_p"), F.col("day").alias("_d")))
    w = Window.partitionBy(*keys).orderBy("_at", "_p").rowsBetween(Window.unboundedPreceding, 0)
    return union.withColumn("day", F.max("_d").over(w)).where((F.col("_p") == 1) & F.col("day").isNotNull()).select(
        *keys, F.col("_at").alias("bound"), "day")


def _chosen(url: Column, lowest: Column) -> Column:
    """Struct (day, call_id) of the day's first call that is not the announcement's own, else of the day before."""
    own = F.col("a.url") == url
    here = F.struct(F.col("day").alias("day"), F.when(own, F.col("b.call_id")).otherwise(F.col("a.call_id")).alias("call_id"))
    return (F.when(~own | (F.col("n") > 1), F.when(F.col("day") >= lowest, here))
            .otherwise(F.when(F.col("prev.day") >= lowest, F.col("prev"))))


def _day(date: Column) -> Column:
    return F.datediff(date, F.lit("1900-01-01").cast("date"))


def match_update_to_call(announcements: DataFrame, calls: DataFrame) -> DataFrame:
    """Best call per update announcement: (url, call_id, overlap, score); announcements without one are absent.

    overlap = shared title stems / stems of the call; kept from 0.7, or from 0.5 with the same program code, which
    adds 0.5 to the score. Best score wins, then the newest call not after the announcement, then the smallest id.

    Titles are first reduced to distinct signatures. A call signature with t stems that reaches an overlap of 0.5
    shares at least one of its floor(t / 2) + 1 rarest stems, so only those are indexed: frequent stems do not
    bring unrelated titles together, and nothing is lost. For each announcement signature the best call is then a step
    function of the date, with one row per day that has a call; announcements look their day up in it, so the work on
    pairs of titles does not grow with the announcements. Only announcements with the address of a call, which must not
    match itself, look at their pairs one by one.
    """
    days = _title_dates(calls)
    dates = cut_lineage(announcements.groupBy("title", "program_code", "publish_date").agg(F.count("*").alias("n")))
    titles = cut_lineage(dates.select("title").distinct().withColumn("a_sig", _signature(F.col("title"))))
    small = is_small(titles)

    def placed(rows: DataFrame, column: str) -> DataFrame:
        return bounded_join(rows, titles, ["title"], [column], small_enough=small).select(
            column, "a_sig", _code("program_code").alias("a_code"), F.coalesce(_day(F.col("publish_date")), F.lit(FOREVER)).alias("bound"))

    points = cut_lineage(placed(dates, "n").groupBy("a_sig", "a_code", "bound").agg(F.sum("n").alias("n")))
    call_sigs = days.select("sig", "code").distinct()
    pairs = cut_lineage(_signature_pairs(points.select("a_sig", "a_code").distinct(), call_sigs))
    pairs = cut_lineage(_undominated(pairs, days))
    # the announcements are read anew, not checkpointed: there are far more of them than of titles and days
    own = cut_lineage(announcements.join(calls.select("url").distinct(), "url", "left_semi"))
    gone = own.select("url").distinct()
    alone = _one_by_one(placed(own, "url"), pairs, days)
    others = placed(announcements.join(F.broadcast(gone) if is_small(gone) else gone, "url", "left_anti"), "url")
    keys = ["a_sig", "a_code", "bound"]
    steps = cut_lineage(_steps(pairs, days, points.drop("n")).join(points, keys))
    hot = cut_lineage(steps.where(F.col("n") > HOT_ROWS))
    columns = ["url", "call_id", "overlap", "score"]
    if is_small(steps):
        found = others.join(F.broadcast(steps), keys).select(*columns)
    elif hot.isEmpty():
        found = others.join(steps, keys).select(*columns)
    else:  # one title and day may hold a large share of the announcements
        rest = others.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(steps, keys)
        found = others.join(F.broadcast(hot), keys).select(*columns).unionByName(rest.select(*columns))
    return found.unionByName(alone)


def _steps(pairs: DataFrame, days: DataFrame, points: DataFrame) -> DataFrame:
    """(a_sig, a_code, bound, call_id, overlap, score): the best call not after each bound."""
    keys = ["a_sig", "a_code"]
    each = pairs.join(days.select("sig", "code", "day", "a.call_id"), ["sig", "code"]).where(
        F.col("until").isNull() | (F.col("day") < F.col("until")))
    best = each.groupBy(*keys, "day").agg(F.min(F.struct((-F.col("score")).alias("s"), "call_id", "overlap")).alias("x"))
    steps = best.select(*keys, F.col("day").alias("_at"), F.lit(0).alias("_p"), F.struct(
        "x.s", (-F.col("day")).alias("d"), "x.call_id", "x.overlap").alias("_x"))
    union = steps.unionByName(points.select(*keys, F.col("bound").alias("_at"), F.lit(1).alias("_p"), F.lit(None).cast(
        steps.schema["_x"].dataType).alias("_x")))
    w = Window.partitionBy(*keys).orderBy("_at", "_p").rowsBetween(Window.unboundedPreceding, 0)
    return union.withColumn("_b", F.min("_x").over(w)).where((F.col("_p") == 1) & F.col("_b").isNotNull()).select(
        *keys, F.col("_at").alias("bound"), "_b.call_id", "_b.overlap", (-F.col("_b.s")).alias("score"))


def _one_by_one(ann: DataFrame, pairs: DataFrame, days: DataFrame) -> DataFrame:
    """The same for announcements with the address of a call: each pair of titles, two calls deep per day."""
    keys = ["sig", "code"]
    candidates = bounded_join(ann, pairs, ["a_sig", "a_code"], ["url"])
    newest = _newest_until(candidates.select(*keys, "bound").distinct(), days, keys)
    found = (candidates.join(newest, [*keys, "bound"])
             .join(_with_previous(days, keys), [*keys, "day"])
             .withColumn("c", _chosen(F.col("url"), F.lit(-1))).where(F.col("c").isNotNull()))
    return top_k(found.select("url", "overlap", "score", "c.day", "c.call_id"), ["url"],
                 [F.desc("score"), F.desc("day"), F.asc("call_id")], 1).select("url", "call_id", "overlap", "score")


def _undominated(pairs: DataFrame, days: DataFrame) -> DataFrame:
    """Pairs that can be the best one for some announcement date, with `until`, the first day of a pair of a higher score: from
    then on this one is the best of no announcement without an address of a call.

    A pair is dropped when a pair of the same announcement title with a higher score has two calls no later than this
    pair's first: whenever this one is possible, that one is too, even if one of its calls is the announcement's own.
    """
    w = Window.partitionBy("sig", "code").orderBy("day")
    second = F.when(F.col("n") > 1, F.col("day")).otherwise(F.lead("day").over(w))
    spans = days.select("sig", "code", "day", second.alias("_s")).groupBy("sig", "code").agg(
        F.min("day").alias("_first"), F.min_by("_s", "day").alias("_second"))
    higher = Window.partitionBy("a_sig", "a_code").orderBy(F.col("_order")).rangeBetween(Window.unboundedPreceding, -1)
    scored = pairs.join(spans, ["sig", "code"]).withColumn("_order", (-F.round(F.col("score") * 1_000_000)).cast("bigint"))
    bound = F.min("_second").over(higher)
    return scored.withColumns({"_b": bound, "until": F.min("_first").over(higher)}).where(
        F.col("_b").isNull() | (F.col("_b") > F.col("_first"))).drop(
        "_first", "_second", "_order", "_b")


def _signature_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a_sig, a_code, sig, code, overlap, score) of title signatures that match."""
    stems = right.select("sig").distinct().select("sig", F.explode(F.split("sig", " ")).alias("t"))
    freq = stems.groupBy("t").agg(F.count("*").alias("f"))
    rare_first = bounded_join(stems, freq, ["t"], ["sig"]).groupBy("sig").agg(
        F.array_sort(F.collect_list(F.struct("f", "t"))).alias("r"))
    index = rare_first.select("sig", F.explode(F.slice(
        F.col("r.t"), F.lit(1), F.floor(F.size("r") / 2).cast("int") + 1)).alias("t"))
    probes = left.select("a_sig").distinct().select("a_sig", F.explode(F.split("a_sig", " ")).alias("t"))
    met = bounded_join(probes, index, ["t"], ["a_sig"]).select("a_sig", "sig").distinct()
    b = F.split("sig", " ")
    overlap = F.size(F.array_intersect(F.split("a_sig", " "), b)) / F.size(b)
    close = met.withColumn("overlap", overlap).where(F.col("overlap") >= MIN_OVERLAP_SAME_CODE)
    coded = close.join(left, "a_sig").join(right, "sig")
    same = (F.col("a_code") != "") & (F.col("a_code") == F.col("code"))
    return coded.where((F.col("overlap") >= MIN_OVERLAP) | same).withColumn(
        "score", F.col("overlap") + F.when(same, SAME_CODE_BONUS).otherwise(0.0))


def find_repeat_call(announcements: DataFrame, calls: DataFrame) -> DataFrame:
    """Known call that an announcement repeats: (url, call_id, day of the call).

    Same set of at least three title stems, another address, call date within 180 days of the announcement's date
    (dated announcements only); the newest call wins, then the smallest id.
    """
    long_enough = F.size(F.split("key", " ")) >= MIN_TITLE_TOKENS
    days = _title_dates(calls.withColumn("program_code", F.lit(None).cast("string"))).withColumnRenamed(
        "sig", "key").where(long_enough)
    ann = _signed(announcements, "key", "url").select("url", "key", _day(F.col("publish_date")).alias("a_day")).where(long_enough).withColumns({
        "bound": F.coalesce(F.col("a_day") + REPEAT_DAYS, F.lit(FOREVER)),
        "lowest": F.coalesce(F.greatest(F.col("a_day") - REPEAT_DAYS, F.lit(0)), F.lit(-1))})
    newest = _newest_until(ann.select("key", "bound").distinct(), days, ["key"])
    found = (ann.join(newest, ["key", "bound"]).join(_with_previous(days, ["key"]), ["key", "day"])
             .withColumn("c", _chosen(F.col("url"), F.col("lowest"))).where(F.col("c").isNotNull()))
    return found.select("url", F.col("c.call_id").alias("call_id"), F.when(F.col("c.day") >= 0, F.date_add(
        F.lit("1900-01-01").cast("date"), F.col("c.day"))).alias("call_date"))


# --- links ---------------------------------------------------------------------------------------

def keep_known_links(model_links: DataFrame, page_links: DataFrame) -> DataFrame:
    """Model links (page_id, pos, label, url) whose url is on the page; one per url, first position, last label."""
    known = model_links.join(page_links.select("page_id", "url").distinct(), ["page_id", "url"], "left_semi")
    return known.groupBy("page_id", "url").agg(
        F.min("pos").alias("pos"), E.link_label(F.max_by("label", "pos"), F.col("url")).alias("label"))


# --- incremental catalogue steps --------------------------------------------------------------------

def detect_content_changes(calls: DataFrame, pages: DataFrame) -> DataFrame:
    """(call_id, action): 'changed' where the fetched text hashes differently, else 'same'; unfetched calls absent."""
    fetched = pages.select("call_id", content_hash(F.col("text")).alias("new_hash"))
    return calls.select("call_id", "content_hash").join(fetched, "call_id").select(
        "call_id", F.when(F.col("content_hash").eqNullSafe(F.col("new_hash")), F.lit("same"))
        .otherwise(F.lit("changed")).alias("action"), "new_hash")


def merge_extension_dates(calls: DataFrame, updates: DataFrame) -> DataFrame:
    """Calls with the dates of their updates merged: stored dates kept, announced ones added, latest per label.

    `updates` is (call_id, url, dates). Rows with the update's address appended to `update_urls`. The announced dates
    are reduced per (call, label) before they are gathered, so a call with very many updates gathers labels only.
    """
    entries = updates.select("call_id", "url", F.explode_outer("dates").alias("d"))
    labels = entries.where(F.col("d").isNotNull()).groupBy("call_id", E.fold(F.col("d.label")).alias("k")).agg(
        F.max_by("d", F.struct("d.date", "d.label")).alias("d"))
    merged = labels.groupBy("call_id").agg(F.array_sort(F.collect_list("d")).alias("announced"))
    urls = updates.groupBy("call_id").agg(F.array_sort(F.collect_set("url")).alias("new_urls"))
    out = calls.join(urls, "call_id", "left").join(merged, "call_id", "left")
    both = F.concat("dates", F.coalesce("announced", F.array().cast(calls.schema["dates"].dataType)))
    changed = F.col("new_urls").isNotNull()
    return out.withColumn("dates", F.when(changed, latest_per_label_array(both)).otherwise(F.col("dates"))).withColumn(
        "update_urls", F.array_union("update_urls", F.coalesce("new_urls", F.array().cast("array<string>")))).drop(
        "announced", "new_urls")


def invalidate_and_rematch(stored: DataFrame, fresh: DataFrame, pool_changed: bool = False,
                           changed: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Stored matches after a change: all dropped when the pool changed, else those of changed and deleted calls;
    fresh rows are added. `fresh` is the output of `match` for the affected open academic calls."""
    kept = stored.limit(0) if pool_changed else stored
    for gone in (changed, deleted, fresh):
        if gone is not None and not pool_changed:
            kept = kept.join(gone.select("call_id").distinct(), "call_id", "left_anti")
    return kept.unionByName(fresh)


def forget_deleted(ledger: DataFrame, deleted: DataFrame) -> DataFrame:
    """Ledger after calls were deleted: their rows become 'cagri_degil' with the reason and lose the call."""
    gone = deleted.select("call_id", F.col("reason").alias("_why"))
    out = ledger.join(gone, "call_id", "left")
    hit = F.col("_why").isNotNull()
    return out.select(
        "url", F.when(hit, F.lit("cagri_degil")).otherwise(F.col("decision")).alias("decision"),
        F.when(hit, F.col("_why")).otherwise(F.col("reason")).alias("reason"),
        F.when(~hit, F.col("call_id")).alias("call_id"))


def upsert_latest(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both, the one with the highest version per key (incoming on ties)."""
    both = existing.withColumn("_n", F.lit(0)).unionByName(incoming.withColumn("_n", F.lit(1)))
    rest = [c for c in existing.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(version, "_n")).alias("_r")).select(key, "_r.*")


def reclassify_calls(calls: DataFrame, passes: DataFrame) -> DataFrame:
    """Plan of a re-evaluation: (call_id, action, reason, old_deadline, new_deadline, merge_into).

    `passes` holds two independent classifications (call_id, kind_1, kind_2, reason). A call is deleted only if both
    say 'cagri_degil'; application flags are recomputed on the stored dates; repeats of one title within 180 days
    are merged into the oldest anchor. Nothing is written: applying the plan is the caller's step.
    """
    judged = calls.join(passes, "call_id", "left")
    drop = F.coalesce((F.col("kind_1") == "cagri_degil") & (F.col("kind_2") == "cagri_degil"), F.lit(False))
    flagged = F.transform("dates", lambda t: F.struct(
        t["label"].alias("label"), t["date"].alias("date"),
        E.is_application_date(t["label"], F.coalesce(t["is_application"], F.lit(True))).alias("is_application")))
    rows = judged.select(
        "call_id", "title", "publish_date", "first_seen", drop.alias("drop"), "reason",
        E.deadline(F.col("dates")).alias("old_deadline"), E.deadline(flagged).alias("new_deadline"))
    anchors = merge_anchors(rows.where(~F.col("drop")))
    out = rows.join(anchors, "call_id", "left")
    action = (F.when(F.col("drop"), F.lit("delete")).when(F.col("merge_into").isNotNull(), F.lit("merge"))
              .when(~F.col("old_deadline").eqNullSafe(F.col("new_deadline")), F.lit("deadline_changed"))
              .otherwise(F.lit("keep")))
    return out.select("call_id", action.alias("action"), F.when(F.col("drop"), F.col("reason")).alias("reason"),
                      "old_deadline", "new_deadline", "merge_into")


def merge_anchors(calls: DataFrame) -> DataFrame:
    """(call_id, merge_into) of calls that repeat an older call with the same title stems within 180 days.

    Calls are taken oldest first (undated last). A call joins the oldest anchor within reach and is otherwise an
    anchor itself; an undated call is within reach of any. Only the days of a title are folded, in day order: calls
    of one day share their fate except the first, which may found the anchor, so the fold is bounded by the calendar.
    """
    rows = _signed(calls, "key", "call_id").where(
        (F.col("key") != "") & (F.size(F.split("key", " ")) >= MIN_TITLE_TOKENS)).select(
        "call_id", "key", F.coalesce(_day(F.col("publish_date")), F.lit(2**30)).alias("day"), "first_seen")
    first = rows.groupBy("key", "day").agg(F.min_by("call_id", F.struct("first_seen", "call_id")).alias("head"))
    days = first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("day", "head"))).alias("days"))
    kind = "array<struct<day:int,head:" + calls.schema["call_id"].dataType.simpleString() + ">>"
    undated = F.lit(2**30)

    def step(anchors: Column, d: Column) -> Column:
        reach = F.exists(anchors, lambda a: (d["day"] == undated) | (F.abs(d["day"] - a["day"]) <= REPEAT_DAYS))
        return F.when(reach, anchors).otherwise(F.concat(anchors, F.array(d)))

    anchors = days.select("key", F.aggregate("days", F.array().cast(kind), step).alias("anchors"))
    joined = bounded_join(rows, anchors, ["key"], ["call_id"])
    target = F.try_element_at(F.filter("anchors", lambda a: (F.col("day") == undated) | (
        F.abs(F.col("day") - a["day"]) <= REPEAT_DAYS)), F.lit(1))
    return joined.select("call_id", target["head"].alias("merge_into")).where(F.col("call_id") != F.col("merge_into"))


def refresh_budgets(calls: DataFrame, extracted: DataFrame) -> DataFrame:
    """Budget changes: (call_id, old and new project and program budget) where either differs; nulls compare equal."""
    pair = calls.select("call_id", "project_budget", "program_budget").join(
        extracted.select("call_id", F.col("project_budget").alias("new_project_budget"),
                         F.col("program_budget").alias("new_program_budget")), "call_id")
    same = F.col("project_budget").eqNullSafe(F.col("new_project_budget")) & F.col("program_budget").eqNullSafe(
        F.col("new_program_budget"))
    return pair.where(~same)
