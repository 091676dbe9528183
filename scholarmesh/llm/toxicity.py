"""Toxicity from class-conditional counts of words and word pairs with a shared backoff, after Kneser-Ney.

It is not the named model itself, which ranks held-out rows much worse (README, departures): no continuation counts per
context and no absolute discount. Counts are of types, not tokens, here the distinct training texts that hold an expression, so that copies
and repetition do not count. Every class count loses a discount, and the discounted mass goes to a backoff distribution
that both classes share, n(w) + K. As the classes differ in size, the discount depends on the shared count: what an
expression of n texts would get by its shared rate plus Z standard deviations (Z and K differ for words and pairs). Rare and neutral expressions therefore
have the shared backoff in both classes and do not speak for either; pairs back off to words, words to the shared counts:

    r_c(w)    = (n(w) + K + excess_c(w)) / (n(w) + K)
    r_c(w|v)  = excess_c(v, w) / (n(v, w) + K) + r_c(w)

The score of a text is the mean over its words of log r_toxic - log r_ordinary (the difference of its length-normalised
log-likelihoods), made a probability by a logistic curve fitted to the training rows' histogram of its inverse
hyperbolic sine.

Words and pairs are named by 64-bit hashes. Counts and model are Spark tables that grow with the input; a text's distinct
expressions are joined with the model. A bit table of at most 2^SIEVE_BITS bits only keeps most expressions that are not
in the model from travelling to that join, and most unlabelled texts from travelling to their label; it loses none.
All labelled rows outside the held-out fold are used. Defined cases: null texts are empty and score at mean 0;
several labels of a document count as toxic if one does; null labels are no labels; without both classes the score is the
smoothed share of toxic labels; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmesh.functions.ranking import bounded_join
from scholarmesh.llm import shingles as S
from scholarmesh.llm.common import cut_lineage, documents, table, whole_text
from scholarmesh.llm.token_files import shared_folder

DISCOUNT = ((4.0, 0.25), (8.0, 3.0))  # Z and K of words and of pairs: a pair must stand out more
SCALE = 0.01  # the curve is fitted on asinh(mean / SCALE), as toxic texts differ in how dense they are
FOLDS = 5
SIEVE_BITS, PROBES = 26, 4
BLOCK_BYTES = 256 << 10  # text looked at at once
HELD = 500_000  # expressions of texts that a task holds before it passes on their counts
UNIT = 2.0**-28  # weights are whole multiples, so that sums do not depend on the order of rows
BINS, LOW, HIGH = 4000, -6.0, 6.0  # of the scaled mean
GAPS = np.ones(256, dtype=bool)  # words are runs of letters and digits; other alphabets count as letters
GAPS[np.r_[48:58, 65:91, 97:123, 128:256]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def expressions(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, pair, row) of every word."""
    word, counts = S.words(LOWER[data], offsets, GAPS)
    row = np.repeat(np.arange(len(counts)), counts)
    before = np.concatenate([np.zeros(1, np.uint64), word[:-1]])[:len(word)]
    first = (np.cumsum(counts) - counts)[counts > 0]
    before[first] = S.PRIME  # the beginning of a text
    return word, S.mix(before * S.STEP + word), row


def once(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first, number) of every distinct (row, key)."""
    _, at, counts = np.unique(key ^ S.mix(row.astype(np.uint64) * S.PRIME + np.uint64(1)), return_index=True, return_counts=True)
    return at, counts


def sieve(keys: DataFrame, most: int = SIEVE_BITS) -> np.ndarray:
    """A Bloom filter (64-bit parts) of the evenly spread column `key`; at most 2^(most - 6) rows reach the driver."""
    bits = min(most, max(10, (16 * keys.count()).bit_length()))
    low, high = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("key", 32)
    place = F.explode(F.array(*[(low + high * n).bitwiseAND(F.lit((1 << bits) - 1)) for n in range(PROBES)])).alias("place")
    found = keys.select(place).select(F.shiftright("place", 6).alias("part"), F.col("place").bitwiseAND(F.lit(63)).alias("bit"))
    found = found.groupBy("part").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[found["part"].to_numpy()] = found["set"].to_numpy().view(np.uint64)
    return out


def maybe(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """False where a key is certainly not in the sieve."""
    low, high = key & np.uint64(0xFFFFFFFF), key >> np.uint64(32)
    out = np.ones(len(key), dtype=bool)
    for n in range(PROBES):
        place = (low + high * np.uint64(n)) & np.uint64(64 * len(bits) - 1)
        out &= (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)) > 0
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, text: one row per distinct labelled text outside the held-out fold."""
    marked = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    digest = F.md5(whole_text().cast("binary"))
    chosen = docs.where(~held_out()).select("doc_id", digest.alias("digest")).join(marked, "doc_id").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    bits = sieve(marked.select(F.xxhash64("doc_id").alias("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe(bits, batch.column(0).to_numpy().view(np.uint64)))).select([1, 2])

    near = docs.where(~held_out() & F.col("doc_id").isNotNull()).select(
        F.xxhash64("doc_id"), "doc_id", whole_text().alias("text")).mapInArrow(run, "doc_id long, text string")
    return near.join(chosen, "doc_id").where(F.md5(F.col("text").cast("binary")) == F.col("digest")).select("toxic", "text")


def counted(texts: DataFrame) -> DataFrame:
    """level (0 words, 1 pairs), hash, ordinary, toxic: numbers of texts with an expression."""
    def summed(level: int, key: list[np.ndarray], toxic: list[np.ndarray]) -> pa.RecordBatch:
        value, at = np.unique(np.concatenate(key), return_inverse=True)
        total = np.bincount(at, minlength=len(value))
        bad = np.bincount(at[np.concatenate(toxic)], minlength=len(value))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(value), level)), pa.array(value.view(np.int64)), pa.array(
            total - bad), pa.array(bad)], names=["level", "hash", "ordinary", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [([], [], 0), ([], [], 0)]
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False) > 0
            for lo, hi, data, offsets in S.blocks(batch.column(1), BLOCK_BYTES):
                word, pair, row = expressions(data, offsets)
                for level, value in enumerate((word, pair)):
                    at, _ = once(row, value)
                    key, of, n = held[level]
                    key.append(value[at])
                    of.append(toxic[lo:hi][row[at]])
                    held[level] = (key, of, n + len(at))
                    if n + len(at) >= HELD:
                        yield summed(level, key, of)
                        held[level] = ([], [], 0)
        for level, (key, of, n) in enumerate(held):
            if n:
                yield summed(level, key, of)

    return texts.select("toxic", "text").mapInArrow(run, "level long, hash long, ordinary long, toxic long").groupBy(
        "level", "hash").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def fit(counts: DataFrame, discount: tuple = DISCOUNT) -> DataFrame:
    """level, hash, o, t (excess over the shared backoff of ordinary, of toxic); only expressions where one is positive.

    Counts are brought to the size of the toxic class.
    """
    folder = shared_folder(counts.sparkSession, "counts")
    counts.write.option("compression", "zstd").parquet(folder)
    counts = counts.sparkSession.read.schema("level long, hash long, ordinary long, toxic long").parquet(folder)
    sums = {r["level"]: r for r in counts.groupBy("level").agg(F.sum("ordinary").alias("o"), F.sum("toxic").alias("t")).collect()}
    if not sums or any(not r["o"] or not r["t"] for r in sums.values()):
        return counts.sparkSession.createDataFrame([], "level long, hash long, o double, t double")
    to_toxic = F.when(F.col("level") == 0, sums[0]["t"] / sums[0]["o"]).otherwise(sums[1]["t"] / sums[1]["o"])
    share = F.when(F.col("level") == 0, sums[0]["t"] / (sums[0]["o"] + sums[0]["t"])).otherwise(
        sums[1]["t"] / (sums[1]["o"] + sums[1]["t"]))
    z, k = (F.when(F.col("level") == 0, discount[0][i]).otherwise(discount[1][i]) for i in (0, 1))
    n = (F.col("ordinary") + F.col("toxic")) * share
    excess = [F.greatest(c - n - z * F.sqrt(n + k), F.lit(0.0)) / (n + k) for c in (F.col("ordinary") * to_toxic, F.col("toxic"))]
    return cut_lineage(counts.select("level", "hash", excess[0].alias("o"), excess[1].alias("t")).where("o > 0 or t > 0"))


FOUND = "id long, doc_id long, digest string, words long, level long, hash long, word long, n long"


def means(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, digest, mean (of the log ratio over the words of the whole text) for (doc_id, digest, text).

    One row per text (hash null) and one per distinct expression of it that the sieve lets pass are written; the latter meet
    the model. A pair's weight is what it adds to the weight of its word.
    """
    bits = sieve(model.select(F.col("hash").alias("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId() << 40, 0
        names, kinds = zip(*[c.split() for c in FOUND.split(", ")])

        def rows(size: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [columns[c] if c in columns else pa.nulls(size, pa.string() if k == "string" else pa.int64())
                 for c, k in zip(names, kinds)], names=list(names))

        for batch in batches:
            for lo, hi, data, offsets in S.blocks(batch.column(2), BLOCK_BYTES):
                word, pair, row = expressions(data, offsets)
                first, nth = part + nth, nth + hi - lo
                yield rows(hi - lo, id=pa.array(first + np.arange(hi - lo)), doc_id=batch.column(0).slice(lo, hi - lo),
                           digest=batch.column(1).slice(lo, hi - lo), words=pa.array(np.bincount(row, minlength=hi - lo)))
                for level, value in enumerate((word, pair)):
                    hit = np.nonzero(maybe(bits, value))[0]
                    at, n = once(row[hit], value[hit])
                    at = hit[at]
                    yield rows(len(at), id=pa.array(first + row[at]), level=pa.array(np.full(len(at), level)), hash=pa.array(
                        value[at].view(np.int64)), word=pa.array(word[at].view(np.int64)), n=pa.array(n.astype(np.int64)))

    spark = docs.sparkSession
    folder = shared_folder(spark, "expressions")
    docs.select("doc_id", "digest", whole_text().alias("text")).mapInArrow(run, FOUND).write.option(
        "compression", "zstd").parquet(folder)
    written = spark.read.schema(FOUND).parquet(folder)
    heads, found = written.where("hash is null"), written.where("hash is not null")
    ratio = F.log((1 + F.col("t")) / (1 + F.col("o")))
    words = model.where("level = 0").select(F.col("hash").alias("word"), F.col("o").alias("wo"), F.col("t").alias("wt"))
    pairs = found.where("level = 1").select("level", "hash", "word").distinct().join(model, ["level", "hash"]).join(
        words, "word", "left").na.fill(0.0, ["wo", "wt"])
    added = F.log((1 + F.col("wt") + F.col("t")) / (1 + F.col("wo") + F.col("o"))) - F.log((1 + F.col("wt")) / (1 + F.col("wo")))
    weights = cut_lineage(model.where("level = 0").select("level", "hash", ratio.alias("w")).unionByName(
        pairs.select("level", "hash", added.alias("w"))).select("level", "hash", F.round(F.col("w") / UNIT).cast("long").alias("w")))
    total = bounded_join(found.select("id", "level", "hash", "n"), weights, ["level", "hash"], ["id"]).groupBy("id").agg(
        F.sum(F.col("n") * F.col("w")).alias("total"))
    return heads.join(total, "id", "left").select("doc_id", "digest", (
        F.coalesce("total", F.lit(0)) * F.lit(UNIT) / F.greatest("words", F.lit(1))).alias("mean"))


def logistic(bins: list[tuple[int, int, int]], ridge: float = 1e-3) -> tuple[float, float]:
    """(slope, intercept) of the logistic curve for (bin, rows, toxic rows); the slope is held by a small ridge."""
    if not bins:
        return 0.0, 0.0
    at, n, t = np.array(bins, dtype=np.float64).T
    if not 0 < t.sum() < n.sum():
        return 0.0, float(np.log((t.sum() + 0.5) / (n.sum() - t.sum() + 0.5)))
    x = np.stack([LOW + (at + 0.5) * (HIGH - LOW) / BINS, np.ones(len(at))], axis=1)
    beta, penalty = np.zeros(2), np.diag([ridge, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p) + 1e-12)) @ x + penalty, x.T @ (t - n * p) - penalty @ beta)
        beta = beta + np.clip(step, -50, 50)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def toxicity(docs: DataFrame, labels: DataFrame, digest: Column | None = None) -> DataFrame:
    """doc_id, digest (if one is given), held_out, mean, score for every row of (doc_id, text); labels: doc_id, toxic."""
    docs = docs.select("doc_id", "text", (F.lit(None).cast("string") if digest is None else digest).alias("digest"))
    scored = cut_lineage(means(docs, fit(counted(training_texts(docs, labels)))))
    marked = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    scaled = F.least(F.greatest(F.asinh(F.col("mean") / SCALE), F.lit(LOW)), F.lit(HIGH))
    place = F.floor((scaled - LOW) / ((HIGH - LOW) / BINS))
    bins = scored.join(marked, "doc_id").groupBy(place.alias("bin")).agg(F.count(F.lit(1)), F.sum("toxic")).collect()
    slope, intercept = logistic([tuple(r) for r in bins])  # at most BINS + 1 rows
    score = 1 / (1 + F.exp(-(F.lit(slope) * scaled + F.lit(intercept))))
    return scored.select("doc_id", "digest", held_out().alias("held_out"), "mean", score.alias("score"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold; all columns stay, repeated rows are judged alike.

    Rows are joined to the rejected (doc_id, digest of the text).
    """
    digest = F.md5(whole_text().cast("binary"))
    scored = toxicity(docs, labels, digest)
    out = scored.where(F.col("score") >= threshold).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    return docs.withColumn("_own", digest).join(
        out, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_digest")), "left_anti").drop("_own")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity(documents(spark, sf_dir), labels).select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
