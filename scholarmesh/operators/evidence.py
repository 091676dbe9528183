"""Numbered evidence lines, verification of cited lines, evidence groups, prompts and rationales.

Relations: evidence chunk (query_id, person_id, evidence_rank, section, content, similarity), line
(query_id, person_id, line_no, section, text, similarity, evidence_rank), cited (query_id, person_id, line_no).
All are bounded per (query, person) by the evidence budget.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarmesh.functions import text as X
from scholarmesh.functions.ranking import running_total, top_k
from scholarmesh.operators.scoring import to_percent
from scholarmesh.operators.sections import split_lines

SHOWN_TOPICS = 4
FALLBACK_CHUNKS = 2
FALLBACK_LINES = 3
LINE_KEYS = ["query_id", "person_id"]


def content_lines(content: Column) -> Column:
    """Non-blank lines after the header line, as structs (pos, line)."""
    lines = split_lines(content)
    indexed = F.transform(lines, lambda line, i: F.struct(i.alias("pos"), line.alias("line")))
    return F.filter(indexed, lambda x: (x["pos"] > 0) & x["line"].rlike(r"(?U)\S"))


def number_lines(chunks: DataFrame, keys: list[str] = LINE_KEYS, order: str = "evidence_rank",
                 bucket: int = 1024) -> DataFrame:
    """One row per content line with a running number from 1 across the chunks of a key, in chunk order.

    Each chunk's first number comes from a bucketed running count of lines, so nothing is gathered per key.
    """
    rows = chunks.withColumn("_lines", content_lines(F.col("content")))
    counted = running_total(rows, keys, [F.asc(order)], F.floor(F.col(order) / bucket), F.size("_lines"), "_end")
    start = F.col("_end") - F.size("_lines")
    kept = [c for c in chunks.columns if c != "content"]
    return counted.select(*kept, start.alias("_start"), F.posexplode("_lines").alias("_i", "_l")).select(
        *kept, (F.col("_start") + F.col("_i") + 1).cast("int").alias("line_no"), F.col("_l.line").alias("text"))


def resolve_evidence_lines(lines: DataFrame, cited: DataFrame) -> DataFrame:
    """Lines that are cited for the rationale or a topic; numbers without a line drop out."""
    return lines.join(cited.select(*LINE_KEYS, "line_no").distinct(), [*LINE_KEYS, "line_no"], "left_semi")


def missing_topics(topics: DataFrame, topic_lines: DataFrame, lines: DataFrame) -> DataFrame:
    """Wanted topics (query_id, person_id, topic_no, topic) without an existing cited line.

    `topic_lines` is (query_id, person_id, topic_no, line_no).
    """
    valid = topic_lines.join(lines.select(*LINE_KEYS, "line_no"), [*LINE_KEYS, "line_no"], "left_semi")
    return topics.join(valid.select(*LINE_KEYS, "topic_no"), [*LINE_KEYS, "topic_no"], "left_anti")


def missing_sentence(missing: DataFrame) -> DataFrame:
    """(query_id, person_id, sentence): the first four missing topics by number, then '(+N)'.

    Only four topics per pair are gathered; the rest is counted.
    """
    first = top_k(missing, LINE_KEYS, [F.asc("topic_no")], SHOWN_TOPICS, "_r")
    shown = first.groupBy(*LINE_KEYS).agg(F.array_sort(F.collect_list(F.struct("topic_no", "topic"))).alias("_t"))
    counts = missing.groupBy(*LINE_KEYS).agg(F.count("*").alias("_n"))
    more = F.when(F.col("_n") > SHOWN_TOPICS, F.concat(
        F.lit(" (+"), (F.col("_n") - SHOWN_TOPICS).cast("string"), F.lit(")"))).otherwise(F.lit(""))
    sentence = F.concat(F.lit("CV'de karşılığı bulunamayan aranan konular: "),
                        F.array_join(F.col("_t.topic"), ", "), more, F.lit("."))
    return shown.join(counts, LINE_KEYS).select(*LINE_KEYS, sentence.alias("sentence"))


def render_rationale(rationale: Column, sentence: Column) -> Column:
    """Rationale without leaked markers, followed by the sentence on missing topics where there is one."""
    return F.concat_ws(" ", X.strip_markers(rationale), sentence)


def group_evidence(lines: DataFrame, selected: DataFrame, best: DataFrame) -> DataFrame:
    """Shown evidence (query_id, person_id, section, items, score, position).

    Selected lines are made unique by simplified text (first wins) and grouped by section, in the order of first
    use; the score is the best similarity as a percentage of the query's best; sections by score. Pairs without a
    selected line show the first three lines of their two most similar chunks. `best` is (query_id, best).
    """
    pairs = selected.select(*LINE_KEYS).distinct()
    rest = lines.join(pairs, LINE_KEYS, "left_anti")
    chunks = rest.select(*LINE_KEYS, "evidence_rank", "similarity").distinct()
    near = top_k(chunks, LINE_KEYS, [F.desc("similarity"), F.asc("evidence_rank")], FALLBACK_CHUNKS, "_c")
    heads = top_k(rest.join(near.select(*LINE_KEYS, "evidence_rank", "_c"), [*LINE_KEYS, "evidence_rank"]),
                  [*LINE_KEYS, "evidence_rank"], [F.asc("line_no")], FALLBACK_LINES, "_h")
    columns = [*LINE_KEYS, "section", "text", "similarity", "line_no", "_o"]
    shown = selected.withColumn("_o", F.lit(0)).select(*columns).unionByName(
        heads.withColumn("_o", F.col("_c")).select(*columns))
    unique = top_k(shown.withColumn("_k", X.simplify(F.col("text"))), [*LINE_KEYS, "_k"],
                   [F.asc("_o"), F.asc("line_no")], 1, "_r")
    groups = unique.groupBy(*LINE_KEYS, "section").agg(
        F.array_sort(F.collect_list(F.struct("_o", "line_no", "text"))).alias("_i"),
        F.max("similarity").alias("_s"), F.min(F.struct("_o", "line_no")).alias("_f"))
    scored = groups.join(best, "query_id").withColumn("score", to_percent(F.col("_s"), F.col("best")))
    w = Window.partitionBy(*LINE_KEYS).orderBy(F.desc("score"), F.asc("_f"))  # one row per section
    return scored.select(*LINE_KEYS, "section", F.col("_i.text").alias("items"), "score",
                         F.row_number().over(w).alias("position"))


def assemble_prompts(lines: DataFrame, headers: DataFrame, queries: DataFrame, persons: DataFrame) -> DataFrame:
    """(query_id, person_id, topics, person, evidence): text blocks for the explaining model.

    Lines are numbered 'S1: …' under their chunk's header, topics 'U1: …'; placeholders stand for empty blocks.
    `headers` is (query_id, person_id, evidence_rank, header); the text per pair is bounded by the evidence budget.
    """
    numbered = lines.groupBy(*LINE_KEYS, "evidence_rank").agg(F.array_sort(F.collect_list(F.struct(
        "line_no", F.concat(F.lit("S"), F.col("line_no").cast("string"), F.lit(": "), F.col("text")).alias("t")))).alias("_l"))
    blocks = headers.join(numbered, [*LINE_KEYS, "evidence_rank"], "left").select(
        *LINE_KEYS, "evidence_rank", F.concat_ws("\n", "header", F.col("_l.t")).alias("_b"))
    evidence = blocks.groupBy(*LINE_KEYS).agg(
        F.array_sort(F.collect_list(F.struct("evidence_rank", "_b"))).alias("_e")).select(
        *LINE_KEYS, F.array_join(F.col("_e._b"), "\n\n").alias("evidence"))
    topics = F.array_join(F.transform("expertise", lambda u, i: F.concat(
        F.lit("U"), (i + 1).cast("string"), F.lit(": "), u)), "\n")
    return (persons.join(queries.select("query_id", F.when(F.size("expertise") == 0, F.lit("(belirtilmemiş)"))
                                        .otherwise(topics).alias("topics")), "query_id")
            .join(evidence, LINE_KEYS, "left")
            .select(*LINE_KEYS, "topics", person_line(F.col("title"), F.col("name"), F.col("unit")).alias("person"),
                    F.coalesce("evidence", F.lit("(eşleşen CV parçası yok)")).alias("evidence")))


def person_line(title: Column, name: Column, unit: Column) -> Column:
    """'<title> <name> - <unit>', missing parts left out as empty text."""
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), name, F.lit(" - "), F.coalesce(unit, F.lit(""))))


def apply_model(rows: DataFrame, prompt: str, strict: Callable[[list[str]], list[str | None]],
                fallback: Callable[[list[str]], list[str | None]] | None = None,
                valid: Callable[[str], bool] | None = None) -> DataFrame:
    """Adds `value`, `error` and `attempts`: a user-supplied model applied to a prompt column, batch by batch.

    Rows whose first answer is missing, invalid or holds NULs are sent once to the fallback. A failing batch is
    repeated row by row, so one bad row never fails its batch or the job.
    """
    check = valid or (lambda v: True)
    extra = [("value", T.StringType()), ("error", T.StringType()), ("attempts", T.IntegerType())]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, t) for n, t in extra]])
    names = schema.names

    def ask(model: Callable[[list[str]], list[str | None]], texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            return [(v, None) for v in model(texts)]
        except Exception as exc:
            if len(texts) == 1:
                return [(None, f"{type(exc).__name__}: {exc}"[:500])]
            return [answer for t in texts for answer in ask(model, [t])]

    def good(value: str | None) -> bool:
        return value is not None and "\x00" not in value and check(value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch[prompt].tolist()
            answers = ask(strict, texts) if texts else []
            attempts = [1] * len(texts)
            again = [i for i, (v, _) in enumerate(answers) if not good(v)]
            if again:
                for i, answer in zip(again, ask(fallback or strict, [texts[i] for i in again])):
                    answers[i], attempts[i] = answer, 2
            batch["value"] = [v if good(v) else None for v, _ in answers]
            batch["error"] = [e or (None if good(v) else "invalid output") for v, e in answers]
            batch["attempts"] = attempts
            yield batch[names]

    return rows.mapInPandas(run, schema)


def chat_context(conversations: DataFrame, last: int = 6, chars: int = 600, key: str = "conv_id",
                 user_role: str = "user") -> DataFrame:
    """(conv_id, context): the last six messages, each cut to 600 characters, labelled by role, oldest first.

    Only six messages per conversation leave a task, so a very long conversation stays cheap. Conversations
    without messages are the caller's to add as '(yok)'.
    """
    recent = top_k(conversations, [key], [F.desc("turn")], last, "_r")
    label = F.when(F.col("role") == user_role, F.lit("Kullanıcı")).otherwise(F.lit("Asistan"))
    line = F.concat(label, F.lit(": "), F.left("text", F.lit(chars)))
    return recent.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("_l")).select(
        key, F.coalesce(F.nullif(F.array_join(F.col("_l.l"), "\n"), F.lit("")), F.lit("(yok)")).alias("context"))
