"""Secret scans: base patterns, and weak parts of credentials that count only next to their complements.

Parts have a role: identifier (access key ids, client ids, user names), secret (assigned values, hex and base64 runs) or
endpoint (addresses, hosts). Base kinds are always reported. A weak part is reported only if an interval join finds the
complementary role within `SCOPE` code points of its start in the same document: an identifier needs a secret, a base64
run needs an identifier or an endpoint, an endpoint needs a secret and an identifier. The join meets, per document, cell
of SCOPE code points and role, the first and last start, so its rows do not grow with the pairs.

Defined cases: a null text is empty; every input row gives one result row, repeated rows too; no match gives zero counts
and empty spans. Positions are code points, ends exclusive; `spans` is ordered by start, then by kind as in KINDS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarmesh.llm.common import cut_lineage, documents, whole_text

SCOPE = 300
#: Fixed values of the contract: kind, pattern, group whose length counts, least length.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # the runs of [0-9a-f]+ that are long enough
]
WEAK = [
    ("identifier", r"""(?i:client_?id|access_?key_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", 1, 3),
    ("blob", r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{40,}={0,2}", 0, 40),
    ("endpoint", r"""(?:https?|jdbc:[a-z]+|amqp|redis|mongodb)://[^\s"'<>]+|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+""", 0, 8),
]
KINDS = [k for k, *_ in BASE + WEAK]
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "blob": "secret",
        "endpoint": "endpoint"}
#: Any text with a match has one of these.
HINT = r"(?i:password|passwd|secret|token|api_?key|client_?id|access_?key|user_?name|login|host|endpoint|server)|AKIA|://|[0-9a-f]{24}|[A-Za-z0-9+/]{40}"
PART = "array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>"


def _found(text: Column, number: int, pattern: str, group: int, least: int) -> Column:
    """All matches of a pattern with the code points before each of them since the last one."""
    whole, part = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    zipped = F.arrays_zip(whole.alias("m"), part.alias("p"), F.slice(
        F.split(text, pattern, -1), 1, F.size(whole)).alias("g"))
    return F.transform(zipped, lambda x, i: F.struct(
        F.lit(number).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"),
        (F.length(x["p"]) >= least).alias("ok"))).cast(PART)


def parts(docs: DataFrame) -> DataFrame:
    """row, doc_id, kind (number), start, end of every part; rows of texts without parts have nulls there.

    `row` tells input rows apart; the result is checkpointed, so it stays the same.
    """
    text = F.col("t")
    found = F.when(text.rlike(HINT), F.filter(F.concat(*[
        F.when(text.rlike(p), _found(text, n, p, g, least)).otherwise(F.array().cast(PART))
        for n, (_, p, g, least) in enumerate(BASE + WEAK)]), lambda x: x.isNotNull())).otherwise(F.array().cast(PART))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", whole_text().alias("t")).select(
        "row", "doc_id", F.explode_outer(found).alias("x")).select("row", "doc_id", "x.*")
    so_far = Window.partitionBy("row", "kind").orderBy("i")
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far)).withColumn(
        "start", F.col("end") - F.col("len"))
    return cut_lineage(placed.select("row", "doc_id", "kind", "start", "end", "ok"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts that have their complementary roles within the scope."""
    role = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("kind") + 1)
    good = found.where("ok").withColumn("role", role).withColumn("cell", F.floor(F.col("start") / scope))
    cells = good.groupBy("row", "cell", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    weak = good.where(F.col("kind") >= len(BASE)).select(
        "row", "doc_id", "kind", "start", "end", F.explode(F.array(*[F.col("cell") + d for d in (-1, 0, 1)])).alias("cell"))
    near = weak.join(cells, ["row", "cell"]).where(
        (F.col("first") - F.col("start") <= scope) & (F.col("start") - F.col("last") <= scope))
    sets = near.groupBy("row", "doc_id", "kind", "start", "end").agg(F.collect_set("role").alias("roles"))

    def has(name: str) -> Column:
        return F.array_contains("roles", name)

    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    return sets.where(F.when(kind == "identifier", has("secret")).when(
        kind == "blob", has("identifier") | has("endpoint")).otherwise(has("secret") & has("identifier"))).drop("roles")


def secret_scans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per input row: row, doc_id, spans array<struct<start,kind,end>> in order; kind is a number of KINDS."""
    found = parts(docs)
    base = found.where(F.col("ok") & (F.col("kind") < len(BASE))).drop("ok")
    marks = found.select("row", "doc_id").distinct().select(
        "*", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("long").alias("start"),
        F.lit(None).cast("long").alias("end"))
    spans = F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))))
    return marks.unionByName(base).unionByName(linked(found, scope)).groupBy("row", "doc_id").agg(spans.alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    def number(kind: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    return secret_scans(documents(spark, sf_dir)).select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(_joined(F.filter("spans", lambda x: x["kind"] < len(BASE))).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, mask: str = "[REDACTED]") -> DataFrame:
    """The documents with every reported span (overlaps merged) replaced by the mask; other columns stay."""
    keyed = docs.withColumn("_redacted_key", F.md5(F.concat_ws("\x00", F.col("doc_id").cast("string"), whole_text()).cast("binary")))
    one = keyed.where(F.col("text").rlike(HINT)).select(F.col("_redacted_key").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    hits = secret_scans(one).where(F.size("spans") > 0).select(F.col("doc_id").alias("_redacted_key"), F.col("spans").alias("_redacted_spans"))
    text = F.col("text")

    def cut(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        return F.struct(
            F.when(fresh, F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast(
                "int")), F.lit(mask))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], x["end"]).alias("at"))

    clean = F.aggregate("_redacted_spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), cut, lambda acc: F.concat(
        acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return keyed.join(hits, "_redacted_key", "left").withColumn(
        "text", F.when(F.col("_redacted_spans").isNotNull(), clean).otherwise(text)).drop("_redacted_key", "_redacted_spans")
