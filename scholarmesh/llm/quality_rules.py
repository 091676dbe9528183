"""Quality rules whose cutoffs are chosen from labelled holdouts under a proven bound on false rejections.

Each rule rejects a document when a rate exceeds its cutoff. For every stratum, rule and cutoff of a fixed grid the good
holdout documents that it would reject are counted; the cutoff is admissible if the exact binomial tail
P(Bin(n, alpha / rules) <= rejected) is at most delta / (rules * cutoffs * strata). That is the exact upper confidence
bound on its false rejection rate, corrected for all tests made. Among admissible cutoffs the one that rejects the most
bad documents net of good ones wins; a rule without one is not used in that stratum.

Defined cases: a null or blank text has no words and fails the base rules; a null stratum is the stratum ''; a document
with several labels is good only if all say so; without labels only the base rules decide. Repeated rows give repeated
results. Windows of three words are compared by their 64-bit hash within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarmesh.functions.ranking import bounded_join
from scholarmesh.llm.common import GAP, cut_lineage, let, table, whole_text

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\x0c\r"
ALPHA, DELTA = 0.05, 0.05
GRID = {
    "symbol_rate": [0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3],
    "dup_line_rate": [0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9],
    "repeat_rate": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.45],
    "capital_rate": [0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8],
    "shout_rate": [0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3],
    "mean_word": [8.0, 10.0, 12.0, 15.0, 20.0, 40.0, 80.0],
}


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Window hashes are sorted with their places; equal neighbours are repeats. The words covered by windows that start at
    places r1 < r2 < ... are the sum of min(3, next place - place).
    """
    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(
            F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def same(s: Column, x: Column, j: Column) -> Column:
        return F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))

    def repeats(s: Column) -> Column:
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1)), lambda x: x["i"]))

    def covered(r: Column) -> Column:
        return F.aggregate(F.transform(r, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(r, k + 1) - x, F.lit(3)))),
                           F.lit(0), lambda a, b: a + b)

    return let(words, lambda w: let(F.sort_array(windows(w)), lambda s: let(repeats(s), covered))).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts that the rules look at, of whole texts."""
    text = whole_text()
    words = F.array_remove(F.split(F.col("t"), GAP), "")
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(F.col("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("stratum"), text.alias("t")).select(
        "doc_id", "stratum",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        _count_of(F.col("t"), SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (
            F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        repeat_words(words).alias("n_repeat_words"),
        _count_of(F.col("t"), CAPITALS).alias("n_capitals"), _count_of(F.col("t"), "!").alias("n_shouts"),
    ).select("*", "l.*").drop("l")


def rates() -> dict[str, Column]:
    def per(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return {"symbol_rate": per("n_symbols", "word_chars"), "dup_line_rate": per("n_dup_lines", "n_lines"),
            "repeat_rate": per("n_repeat_words", "n_words"), "capital_rate": per("n_capitals", "word_chars"),
            "shout_rate": per("n_shouts", "word_chars"), "mean_word": per("word_chars", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k <= n * p, summed in logarithms."""
    step = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("l"), F.exp(n * F.log(F.lit(1 - p))).alias("s"))

    def add(acc: Column, i: Column) -> Column:
        log_mass = acc["l"] + F.log((n - i + 1) / i) + step
        return F.struct(log_mass.alias("l"), (acc["s"] + F.exp(log_mass)).alias("s"))

    return F.when(k <= n * F.lit(p), F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(
        F.array().cast("array<bigint>")), start, add, lambda acc: acc["s"]))


def calibrate(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff: the chosen cutoffs. labels: doc_id, quality (1 is good)."""
    good = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    held = measured.where(~base_failed()).join(good, "doc_id").select("stratum", "good", *[
        c.alias(name) for name, c in rates().items()])
    per_rule, tests = alpha / len(GRID), sum(map(len, GRID.values()))
    counts = [F.array(*[F.sum(F.when((F.col("good") == want) & (F.col(name) > cut), 1).otherwise(0))
                        for name, cuts in GRID.items() for cut in cuts]).alias(label)
              for want, label in ((1, "lost"), (0, "caught"))]
    strata = held.groupBy("stratum").agg(F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("n"), *counts)
    grid = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(cut).alias("cutoff"))
                     for name, cuts in GRID.items() for cut in cuts])
    n_strata = strata.agg(F.count(F.lit(1)).alias("n_strata"))  # one row
    tested = (strata.join(F.broadcast(n_strata)).select("stratum", "n", "n_strata", F.explode(F.arrays_zip(
        grid.alias("g"), F.col("lost"), F.col("caught"))).alias("x"))
        .select("stratum", "n", "n_strata", "x.g.rule", "x.g.cutoff", "x.lost", "x.caught"))
    admissible = tested.where((F.col("n") > 0) & (F.col("caught") > F.col("lost")) & (
        binomial_tail(F.col("n"), F.col("lost"), per_rule) <= F.lit(delta / tests) / F.col("n_strata")))
    best = Window.partitionBy("stratum", "rule").orderBy((F.col("caught") - F.col("lost")).desc(), F.col("cutoff").desc())
    return admissible.withColumn("r", F.row_number().over(best)).where("r = 1").select(
        "stratum", "rule", "cutoff", "n", "lost", "caught")


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The measures with base_failed, the broken rule cutoffs and kept."""
    maps = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut"))
    joined = bounded_join(measured, maps, ["stratum"], ["doc_id"], "left")
    broken = F.filter(F.array(*[F.when(c > F.try_element_at(F.col("cut"), F.lit(name)), F.lit(name))
                                for name, c in rates().items()]), lambda x: x.isNotNull())
    return joined.select("*", base_failed().alias("base_failed"), broken.alias("broken")).select(
        "*", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept")).drop("cut")


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Measures and verdict of every document; docs: doc_id, text, lang; labels: doc_id, quality."""
    measured = cut_lineage(measures(docs))  # narrow; read for the calibration and for the verdicts
    return judge(measured, cut_lineage(calibrate(measured, labels, alpha, delta)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_rules(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("broken", ",").alias("broken_rules"))
