"""Document fingerprints: MinHash signatures over five-word shingles, banded candidates, verified Jaccard.

A signature is the least value of each of PERMUTATIONS universal hash functions (multiply and add, high bits) over the
distinct shingles of a text, kept to 16 bits each. The likeness of two fingerprints is the share of equal places, set
right for chance agreement: (equal - 2^-16) / (1 - 2^-16), at least 0. `near_links` joins signatures by bands and
verifies the Jaccard similarity of the shingle sets; op9 carries the least doc_id of the class that such links make.
Equal texts (first 64 bits of the MD5) meet once. A pair of similarity 0.8 shares one of the BANDS with a probability of
0.992; within a band nothing is lost, and no group is compared pair by pair (`jaccard_join.linked_in_cells`).

Defined cases: null texts are empty; a text without words has the fingerprint of zeros, is fully like another such text
and not like any other; texts of one to four words have one shingle; repeated rows are ordered by text and each get their
result; null document ids come first in the order of documents. The last document is followed by the first; a lone
document is followed by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarmesh.llm import shingles as S
from scholarmesh.llm.common import compact, cut_lineage, documents, hot_join, whole_text
from scholarmesh.llm.jaccard_join import SEEN, BLOCK_BYTES, SETS, distinct_sets, linked_in_cells, of_different_members, set_rows
from scholarmesh.llm.token_files import shared_folder
from scholarmesh.llm.toxicity import maybe, sieve

PERMUTATIONS, BITS = 64, 16
BANDS, ROWS = 12, 5
BYTES = np.arange(256, dtype=np.uint8)  # texts as they are
PERCENT = 80  # least Jaccard similarity


def factors(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(19970101)
    return (rng.integers(0, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 2**63, permutations, dtype=np.uint64))


def signatures(shingle: np.ndarray, sizes: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """(rows, permutations) 16-bit signatures; rows without shingles are zeros, others have no zero row by chance."""
    out = np.zeros((len(sizes), permutations), dtype=np.uint16)
    has = np.nonzero(sizes > 0)[0]
    if not len(has):
        return out
    starts = (np.cumsum(sizes) - sizes)[has]
    value = np.empty_like(shingle)
    for n, (a, b) in enumerate(zip(*factors(permutations))):
        np.multiply(shingle, a, out=value)
        value += b
        least = np.minimum.reduceat(value, starts)
        out[has, n] = (S.mix(least) & np.uint64(2**BITS - 1)).astype(np.uint16)
    return out


def text_signatures(texts: list[str], permutations: int = PERMUTATIONS) -> np.ndarray:
    out = [np.zeros((0, permutations), np.uint16)]
    for _, _, data, offsets in S.blocks(pa.array(texts, pa.large_string()), BLOCK_BYTES):
        out.append(signatures(*S.shingles(*S.words(data, offsets)), permutations))
    return np.concatenate(out)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of paired rows of signatures."""
    chance = 2.0**-BITS
    out = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    empty_a, empty_b = ~a.any(axis=1), ~b.any(axis=1)
    out[empty_a != empty_b] = 0
    return out


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the next one."""
    n = len(text) // 4
    return text[:len(text) - n] + after[:n]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
          "near_edited double, near_next double, key long")


def compare(rows: list[tuple], permutations: int) -> pa.RecordBatch:
    """Results of rows (doc_id, text, next text)."""
    texts, after = [r[1] for r in rows], [r[2] for r in rows]
    changed = [edited(t, a) for t, a in zip(texts, after)]
    chained = all(a is t for a, t in zip(after[:-1], texts[1:]))  # then only the last next text is new
    own, new = text_signatures(texts, permutations), text_signatures(changed, permutations)
    following = np.concatenate([own[1:], text_signatures(after[-1:], permutations)]) if chained else text_signatures(
        after, permutations)
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array([s.astype(">u2").tobytes() for s in own], pa.binary()),
        pa.array([s.astype(">u2").tobytes() for s in new], pa.binary()),
        pa.array(likeness(own, new)), pa.array(likeness(own, following)),
        pa.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big", signed=True) for t in texts], pa.int64())],
        names=[c.split()[0] for c in RESULT.split(", ")])


def with_next(docs: DataFrame, permutations: int = PERMUTATIONS, rows_at_once: int = 256) -> DataFrame:
    """Fingerprints of every text and its edited text; docs: doc_id, text.

    Texts are dealt out by ranges of doc_id once. A task compares neighbours as they come; the first and the last text
    of every range are passed on and paired over the seams of the ranges, one pair per task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first, last = TaskContext.get().partitionId(), [], None, None

        def out(batch: pa.RecordBatch | None, seam: str | None = None, row: tuple = (None, None)) -> pa.RecordBatch:
            n = len(batch) if batch is not None else 1
            columns = batch.columns if batch is not None else [
                pa.array([row[0]], pa.int64()), *[pa.nulls(1, f.type) for f in result[1:]]]
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int64()), pa.array([seam] * n, pa.string()), pa.array([row[1]] * n, pa.string()), *columns],
                names=["part", "seam", "seam_text", *[f.name for f in result]])

        result = [f for f in compare([(0, "", "")], permutations).schema]
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if last is None:
                    first = (doc, text)
                else:
                    held.append((*last, text))
                last = (doc, text)
                if len(held) >= rows_at_once:
                    yield out(compare(held, permutations))
                    held.clear()
        if held:
            yield out(compare(held, permutations))
        if last is not None:
            yield out(None, "first", first)
            yield out(None, "last", last)

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    done = cut_lineage(ordered.mapInArrow(run, f"part long, seam string, seam_text string, {RESULT}"))
    firsts = done.where("seam = 'first'").select("part", F.col("seam_text").alias("after"))
    lasts = done.where("seam = 'last'").select("part", "doc_id", "seam_text")
    in_order = Window.orderBy("part")  # one narrow row per task
    following = firsts.select("part").select(
        "part", F.coalesce(F.lead("part").over(in_order), F.min("part").over(Window.partitionBy())).alias("next"))
    pairs = lasts.join(following, "part").join(firsts.select(F.col("part").alias("next"), "after"), "next").select(
        "doc_id", "seam_text", "after")

    def over_seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield compare(list(zip(*[c.to_pylist() for c in batch.columns])), permutations)

    rest = pairs.mapInArrow(over_seams, RESULT)
    return done.where("seam is null").drop("part", "seam", "seam_text").unionByName(rest)


def fingerprints(docs: DataFrame, permutations: int = PERMUTATIONS) -> DataFrame:
    """doc_id, fingerprint (binary, 16 bits a place), shingle set size of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in S.blocks(batch.column(1), BLOCK_BYTES):
                signature = signatures(*S.shingles(*S.words(data, offsets)), permutations)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(
                    [s.astype(">u2").tobytes() for s in signature], pa.binary())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, "doc_id long, fingerprint binary")


def banded(prints: DataFrame) -> DataFrame:
    """doc_id, band (hash of a band's number and places) of (doc_id, fingerprint); texts without words have none."""
    width = ROWS * BITS // 4
    digits = F.hex("fingerprint")
    return prints.where(~digits.rlike("^0*$")).select("doc_id", F.explode(F.array(*[
        F.xxhash64(F.lit(n), F.substring(digits, n * width + 1, width)) for n in range(BANDS)])).alias("band"))


def band_members(prints: DataFrame) -> DataFrame:
    """cell, node of (doc_id, fingerprint): bands with several documents; of bands with the same documents one stays."""
    bands = banded(prints)
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("band")
    inside = compact(bands.join(shared, "band").select(F.col("band").alias("cell"), F.col("doc_id").alias("node")))
    return compact(of_different_members(inside, "node"))


def near_links(members: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """u, v: documents and the least one of their class, the least left out: all similar enough that share a band are linked.

    members: cell, node; docs: doc_id, text, of which equal ids have equal texts.
    """
    bits = sieve(members.select(F.col("node").alias("key")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # a task sends the set of equal texts once
        for batch in batches:
            near = batch.filter(pa.array(maybe(bits, batch.column(0).to_numpy().view(np.uint64))))
            ids = near.column(0).to_pylist()
            if len(sent) > SEEN:
                sent.clear()
            near = near.filter(pa.array([not (i in sent or sent.add(i)) for i in ids], pa.bool_()))
            for lo, hi, data, offsets in S.blocks(near.column(1), BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([near.column(0).slice(lo, hi - lo), *set_rows(*distinct_sets(
                    data, offsets, S.WIDTH, BYTES))], names=[c.split()[0] for c in SETS.split(", ")])

    folder = shared_folder(docs.sparkSession, "sets")
    sets = docs.where(F.col("doc_id").isNotNull()).select("doc_id", whole_text().alias("text")).mapInArrow(run, SETS)
    sets.join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]).write.parquet(folder)
    return linked_in_cells(members, docs.sparkSession.read.schema(SETS).parquet(folder), percent)


def near_pairs(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, leader of (doc_id, text): every document with the least doc_id of its class; lone documents are left out."""
    docs = docs.select("doc_id", "text")
    members = band_members(cut_lineage(fingerprints(docs)))
    return near_links(members, docs, percent).select(F.col("u").alias("doc_id"), F.col("v").alias("leader"))


def with_class(done: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Results of with_next with near_class: the least doc_id of the texts that near_links joins; docs: doc_id, text."""
    key = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 16), 16, -10).cast("long")
    prints = compact(done.groupBy("key").agg(F.min("doc_id").alias("least_id"), F.first("fingerprint").alias("fingerprint"), F.count(
        F.lit(1)).alias("c")))
    members = band_members(prints.select(F.col("key").alias("doc_id"), "fingerprint"))
    roots = near_links(members, docs.select(key.alias("doc_id"), "text"), percent)
    placed = prints.select("key", "least_id", "c").join(roots.select(F.col("u").alias("key"), F.col("v").alias("root")), "key", "left")
    placed = placed.select("key", "least_id", "c", F.coalesce("root", "key").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least_id").alias("near_class"), F.count(F.lit(1)).alias("size"))
    found = compact(hot_join(placed.select("key", "c", "root"), ids, "root", "size").select("key", "near_class", "c"))
    return hot_join(done, found, "key", "c").drop("key", "c")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return with_class(with_next(docs), docs).select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next", "near_class")
