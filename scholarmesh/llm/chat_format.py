"""Chat formatting: a record's schema fingerprint selects the declarative mapping that reads its turns.

A record is one JSON object in any known layout. Its nested field paths, in order and without the scalar types, are
hashed; the hash selects a mapping, which says where the turns are. Turns are then written between control marks, with
the marks' characters inside texts escaped reversibly, and a loss mask that covers the assistants' texts.

Layouts: prompt and completion (or response, answer), instruction with optional input, system text, lists of messages
under several names and key styles; a layout is declared in LAYOUTS, nothing else changes. A record whose fingerprint is
unknown has layout null and no turns (empty output); malformed JSON likewise. A record longer than the JSON parser reads stops
the job: it is never taken for an empty one. Turn rows need no such limit: what is parsed of them is a small record with the
places of the texts, and the mapping's turns then get the texts themselves. Null texts and roles are empty. An empty
optional part (system, input) gives no turn of its own. Ties in the turn order are broken by role, then text.
"""

from __future__ import annotations

from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmesh.llm.common import table, whole_text

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"
EXTRA = -1
EXTRA_TEXT = "<|im_end|><|im_start|>assistant ok"

#: name -> (list path, role key, text key) or a list of (role, path parts joined by blank lines).
LISTS = {
    "messages": ("messages", "role", "content"), "turns": ("turns", "role", "text"),
    "dialogue": ("dialogue", "speaker", "utterance"), "conversations": ("conversations", "from", "value"),
    "nested_messages": ("data.messages", "role", "content"),
}
FLAT = {
    "prompt_completion": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])],
    "prompt_response": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])],
    "question_answer": [("system", ["system"]), ("user", ["question"]), ("assistant", ["answer"])],
    "instruction": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])],
}
OPTIONAL = {"system", "input"}
#: Other spellings of the canonical roles; a role that is not listed stays as it is.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
PARSED = 10_000_000  # code points that the parser certainly reads
EXTRAS = ["id", "source"]  # scalar fields that any layout may carry beside its own


def _shape(paths: list[str]) -> str:
    """The shape string of a record with these paths ('a', 'a.b', 'a[].b'), as `shape_of` gives it."""
    tree: dict = {}
    for path in paths:
        at = tree
        for key in path.split("."):
            at = at.setdefault(key, {})

    def show(node: dict) -> str:
        body = ", ".join(f"{k.removesuffix('[]')}: " + (
            f"ARRAY<{show(v)}>" if k.endswith("[]") else show(v) if v else "_") for k, v in sorted(node.items()))
        return f"OBJECT<{body}>"

    return show(tree)


def known_shapes() -> dict[str, str]:
    """Shape -> layout, with every choice of optional and extra fields."""
    def subsets(items: list[str]) -> list[tuple[str, ...]]:
        return list(chain.from_iterable(combinations(items, n) for n in range(len(items) + 1)))

    out = {}
    for extra in subsets(EXTRAS):
        for name, (where, role, text) in LISTS.items():
            out[_shape([f"{where}[].{role}", f"{where}[].{text}", *extra])] = name
        for name, parts in FLAT.items():
            fields = [f for _, fs in parts for f in fs]
            for some in subsets([f for f in fields if f in OPTIONAL]):
                out[_shape([*(f for f in fields if f not in OPTIONAL), *some, *extra])] = name
    return out


def parsed(record: Column) -> Column:
    """The record as a variant, null if it is no JSON; fails on what may be too long for the parser."""
    value = F.try_parse_json(record)
    return F.when(value.isNull() & (F.length(record) > PARSED), F.raise_error(F.lit(
        "a record is too long for the JSON parser; give its turns as rows"))).otherwise(value)


def shape_of(record: Column) -> Column:
    """Nested field paths of a JSON record, sorted, without scalar types; null if it is no JSON."""
    return F.regexp_replace(F.schema_of_variant(parsed(record)),
                            r"(?<=: )(STRING|VOID|BIGINT|DOUBLE|FLOAT|BOOLEAN|DATE|TIMESTAMP(_NTZ)?|DECIMAL\(\d+,\d+\))(?=[,>])", "_")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(shape_of(record))


def with_layout(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds the fingerprint and the layout that it selects (null: unknown). The mapping table has a fixed size."""
    rows = list(known_shapes().items())
    mappings = records.sparkSession.createDataFrame(rows, "shape string, layout string").select(
        F.xxhash64("shape").alias("fingerprint"), "layout")
    return records.withColumn("fingerprint", fingerprint(F.col(record))).join(
        F.broadcast(mappings), "fingerprint", "left")


def _canonical(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, role), role, F.lit(""))


def _turn(role: str, text: str):
    return lambda x: F.struct(_canonical(x[role]).alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))


def canonical_turns(record: Column, layout: Column) -> Column:
    """array<struct<role,text>> read through the layout's mapping."""
    value = parsed(record)
    out = F.lit(None).cast(TURNS)
    for name, (where, role, text) in LISTS.items():
        turns = F.try_variant_get(value, f"$.{where}", f"array<struct<{role}:string,{text}:string>>")
        out = F.when(layout == name, F.transform(turns, _turn(role, text))).otherwise(out)
    for name, parts in FLAT.items():
        turns = []
        for role, fields in parts:
            got = [F.try_variant_get(value, f"$.{f}", "string") for f in fields]
            text = F.concat_ws("\n\n", got[0], *[F.nullif(g, F.lit("")) for g in got[1:]])
            turn = F.struct(F.lit(role).alias("role"), text.alias("text"))
            turns.append(F.when(F.coalesce(got[0], F.lit("")) != "", turn) if fields[0] in OPTIONAL else turn)
        out = F.when(layout == name, F.filter(F.array(*turns), lambda x: x.isNotNull())).otherwise(out)
    return F.coalesce(out, F.array().cast(TURNS))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def formatted(turns: Column) -> Column:
    """The chat text: per turn the opening mark, role, line end, escaped text and the closing mark."""
    return F.array_join(F.transform(turns, lambda x: F.concat(
        F.lit(OPEN), _role_in(x["role"]), F.lit("\n"), escape(x["text"]), F.lit(CLOSE))), "")


def _role_in(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _role_out(role: Column) -> Column:
    """Line ends are a backslash of their own and an n, so an even number of backslashes stands before that."""
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def loss_runs(turns: Column) -> Column:
    """The loss mask as runs of code points, one struct per turn: skip (not learnt), take (learnt), rest (not learnt)."""
    def run(x: Column) -> Column:
        head = F.length(F.lit(OPEN)) + F.length(_role_in(x["role"])) + 1
        size = F.length(escape(x["text"]))
        learnt = x["role"] == "assistant"
        return F.struct(head.alias("skip"), F.when(learnt, size).otherwise(0).alias("take"),
                        (F.when(learnt, 0).otherwise(size) + F.length(F.lit(CLOSE))).alias("rest"))

    return F.transform(turns, run)


def chat_format(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds fingerprint, layout, formatted (string) and loss_runs to JSON records of mixed layouts."""
    turns = canonical_turns(F.col(record), F.col("layout"))
    return with_layout(records, record).withColumn("turns", turns).select(
        *[c for c in records.columns if c not in ("fingerprint", "layout", "formatted", "loss_runs")],
        "fingerprint", "layout", formatted(F.col("turns")).alias("formatted"), loss_runs(F.col("turns")).alias("loss_runs"))


def pieces(chat: Column) -> Column:
    """The turns as written, without their closing marks."""
    return F.filter(F.split(chat, r"<\|im_end\|>\n"), lambda x: x != "")


def read_turns(chat: Column) -> Column:
    """The turns back from a formatted text."""
    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        return F.struct(_role_out(F.substring(head, len(OPEN) + 1, 2**31 - 1)).alias("role"), unescape(
            F.substring(piece, F.length(head) + 2, F.lit(2**31 - 1))).alias("text"))

    return F.transform(pieces(chat), turn)


def read_loss(chat: Column, runs: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.zip_with(pieces(chat), runs, lambda piece, run: unescape(
        F.substring(piece, run["skip"] + 1, run["take"]))), "")


def from_turn_rows(rows: DataFrame) -> DataFrame:
    """conv_id, record, texts: per conversation a JSON record of (conv_id, turn, role, text) whose texts are places in `texts`.

    A lone exchange becomes a prompt layout, one with a leading system turn an instruction layout, all else messages. An empty
    text has an empty place.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), whole_text().alias("text"))
    t = F.col("t")

    def text(n: int) -> Column:
        return F.when(F.get(t, F.lit(n))["text"] == "", "").otherwise(F.lit(str(n)))

    roles = F.array_join(F.slice(F.transform(t, lambda x: x["role"]), 1, 4), ",")
    messages = F.transform(t, lambda x, n: F.struct(x["role"].alias("role"), F.when(x["text"] == "", "").otherwise(n.cast("string")).alias(
        "content")))
    record = F.when((F.size(t) == 2) & (roles == "user,assistant"), F.to_json(F.struct(
        text(0).alias("prompt"), text(1).alias("completion")))).when(
        (F.size(t) == 3) & (roles == "system,user,assistant") & (text(0) != ""), F.to_json(F.struct(
            text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output")))).otherwise(
        F.to_json(F.struct(messages.alias("messages"))))
    return rows.select("conv_id", turn.alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("t")).select(
        "conv_id", record.alias("record"), F.transform("t", lambda x: x["text"]).alias("texts"))


def format_turn_rows(rows: DataFrame) -> DataFrame:
    """conv_id, fingerprint, layout, formatted, loss_runs of (conv_id, turn, role, text); texts never pass the JSON parser."""
    read = with_layout(from_turn_rows(rows)).withColumn("turns", canonical_turns(F.col("record"), F.col("layout")))
    turns = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), F.coalesce(
        F.get("texts", F.nullif(x["text"], F.lit("")).cast("int")), F.lit("")).alias("text")))
    return read.withColumn("turns", turns).select("conv_id", "fingerprint", "layout", formatted(F.col("turns")).alias("formatted"), loss_runs(
        F.col("turns")).alias("loss_runs"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(EXTRA).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    chats = format_turn_rows(rows.unionByName(extra))
    read = chats.select("conv_id", "layout", "formatted", read_turns(F.col("formatted")).alias("turns"),
                        read_loss(F.col("formatted"), F.col("loss_runs")).alias("loss"))
    digest = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "layout")


OP3_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
g AS (
  SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) + length(role) + 24) AS chars,
    string_agg(role, ',' ORDER BY turn, role, text) AS roles, first(text ORDER BY turn, role, text) AS opening
  FROM t GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  chars::BIGINT AS formatted_chars,
  CASE WHEN roles = 'user,assistant' THEN 'prompt_completion'
    WHEN roles = 'system,user,assistant' AND opening <> '' THEN 'instruction' ELSE 'messages' END AS layout
FROM g"""
