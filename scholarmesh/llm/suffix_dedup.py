"""Repeated byte strings by distributed prefix doubling.

Every byte covered by a string of `length` bytes that also starts at another place of the corpus is removed. The rank of
a position at offset 1, 2, 4, ... is named from the pair of ranks at half the offset (64-bit names; equal strings have
equal names); the offsets grow up to the threshold, and what turns out unique on the way is dropped:

1. Names of 64-byte strings. Each window of `length` bytes is represented by the least 64-byte name in it. Consecutive
   windows with the same representative form a run. Spark sorts the runs by representative and by the name of the whole
   run: a representative at one place only is unique, and so are all windows of its run; a run that occurs twice is
   repeated as a whole. Both ends here for all but the runs at the edges of repeats.
2. Names at the threshold, of the windows of the runs left open and of one copy of each repeated run with the same
   representative. Spark sorts them by representative; windows that occur twice are repeated.

A representative with very many open runs is split by window name, so no group of equal keys grows with the corpus; equal
runs of one task travel once. Texts meet their runs in one join, and only texts with a repeat travel further.

Defined cases: null texts are empty; texts shorter than `length` bytes lose nothing; repeated rows and copies are other
places of the same string, so both are removed; document ids may be null or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarmesh.llm import shingles as S
from scholarmesh.llm.common import documents, whole_text
from scholarmesh.llm.token_files import shared_folder

LENGTH = 200
GRAM = 64
BLOCK_BYTES = 256 << 10
HOT = 2000  # open runs of a representative that one group holds at most
FIRST = S.mix(np.arange(1, 257, dtype=np.uint64))
ODD = S.mix(np.arange(1000, 1064, dtype=np.uint64)) | np.uint64(1)


def _double(rank: np.ndarray, shift: int, level: int) -> np.ndarray:
    """Names of the pairs (rank at p, rank at p + shift)."""
    out = rank.copy()
    out[:len(out) - shift] += rank[shift:] * ODD[level]
    out ^= out >> np.uint64(32)
    out *= ODD[level + 32]
    out ^= out >> np.uint64(29)
    return out


def ranks(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(names of the gram, names of the string of `length`) at every byte; valid where the string ends inside the text."""
    rank, size, level, grams = FIRST[data], 1, 0, None
    while 2 * size <= length:
        if size == gram:
            grams = rank
        rank = _double(rank, min(size, len(rank)), level)
        size, level = 2 * size, level + 1
    if size == gram:
        grams = rank
    if size < length:
        rank = _double(rank, min(length - size, len(rank)), level)
    return grams, rank


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of x[p : p + width] at every p, by doubling."""
    out, size = x.copy(), 1
    while size < width:
        step = min(size, width - size)
        if step < len(out):
            out[:-step] = best(out[:-step], out[step:])
        size += step
    return out


def _valid(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of whole windows, row of each)."""
    n = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n), row


def _runs(start: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) index of every run of consecutive starts with one value."""
    new = np.ones(len(start), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.nonzero(new)[0]
    return first, np.append(first[1:], len(start)) - 1


def run_names(names: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """Names of the whole runs: of the windows at every `length`-th start, which cover all bytes, the last one and the extent."""
    count = (hi - lo) // length + 1
    first = np.cumsum(count) - count
    nth = np.arange(int(count.sum())) - np.repeat(first, count)
    steps = S.mix(names[np.repeat(lo, count) + nth * length] * ODD[60] + nth.astype(np.uint64) * S.STEP)
    return S.mix(np.add.reduceat(steps, first) + names[hi] * ODD[61] + (hi - lo).astype(np.uint64))


def block_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of a block: row, lo, hi (window starts in the row), value, name, places (of the value in the block, on its first
    run), copies (equal runs in the block, on the first of them; 0 on the others)."""
    start, row = _valid(offsets, length)
    if not len(start):
        return {}
    grams, names = ranks(data, length, gram)
    width = length - gram + 1
    least = _slide(grams, width, np.minimum)
    value = least[start]
    first, last = _runs(start, value)
    reach = np.zeros(len(data), dtype=np.uint64)
    reach[start] = value
    place = np.zeros(len(data), dtype=bool)
    for_end = _slide(reach[::-1], width, np.maximum)[::-1]
    np.equal(for_end, grams, out=place)
    values, places = np.unique(grams[place], return_counts=True)
    v, lo, hi = value[first], start[first], start[last]
    name = run_names(names, lo, hi, length)
    _, at, copies = np.unique(S.mix(v) + name * S.STEP, return_index=True, return_counts=True)
    n = np.zeros(len(v), dtype=np.int64)
    n[at] = copies
    own = np.zeros(len(v), dtype=np.int64)
    _, once = np.unique(v, return_index=True)
    own[once] = places[np.minimum(np.searchsorted(values, v[once]), len(values) - 1)]
    base = offsets[row[first]]
    return {"row": row[first], "lo": lo - base, "hi": hi - base, "value": v, "name": name, "places": own, "copies": n}


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), text)


def runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """value, name, key, doc_id, lo, hi, places, copies of all runs of (doc_id, key, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in S.blocks(batch.column(2), BLOCK_BYTES):
                found = block_runs(data, offsets, length, gram)
                if found:
                    row = pa.array(found["row"] + lo)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found["value"].view(np.int64)), pa.array(found["name"].view(np.int64)),
                         batch.column(1).take(row), batch.column(0).take(row),
                         *[pa.array(found[c]) for c in ("lo", "hi", "places", "copies")]],
                        names=["value", "name", "key", "doc_id", "lo", "hi", "places", "copies"])

    return docs.select("doc_id", "key", "text").mapInArrow(
        run, "value long, name long, key long, doc_id long, lo long, hi long, places long, copies long")


def sorted_out(found: DataFrame) -> DataFrame:
    """key, doc_id, runs (lo, hi, value, groups, state) of texts with repeats; state: 0 repeated, 1 open, 2 repeated and
    needed to compare with open runs."""
    by_value = Window.partitionBy("value")
    by_run = Window.partitionBy("value", "name")
    ranked = found.withColumn("same", F.sum("copies").over(by_run)).withColumn(
        "nth", F.row_number().over(by_run.orderBy(F.col("copies").desc(), "key", "lo"))).withColumn(
        "everywhere", F.sum("places").over(by_value)).withColumn(
        "open", F.sum(F.when(F.col("same") == 1, 1).otherwise(0)).over(by_value)).where("everywhere > 1")
    state = F.when(F.col("same") == 1, 1).when((F.col("nth") == 1) & (F.col("open") > 0), 2).otherwise(0)
    groups = F.ceil((F.col("open") + 1) / HOT)
    return ranked.select("key", "doc_id", F.struct("lo", "hi", "value", groups.alias("groups"), state.cast("long").alias(
        "state")).alias("r")).groupBy("key", "doc_id").agg(F.collect_list("r").alias("runs"))


PARTS = ("key long, doc_id long, text binary, lo array<bigint>, hi array<bigint>, open boolean, value long, part long, "
         "at long, wanted boolean, payload binary, places binary")


def parts(docs: DataFrame, repeats: DataFrame, length: int = LENGTH) -> DataFrame:
    """Two kinds of rows: texts with their repeated ranges (value null), and open or comparable strings (text null).

    A string's payload is the bytes of its windows, or the names of those windows that fall to its part of a hot value.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, texts, lists = (c.to_pylist() for c in batch.columns)
            out = []
            for key, doc, text, found in zip(keys, ids, texts, lists):
                done = [(r["lo"], r["hi"]) for r in found if r["state"] != 1]
                rest = [r for r in found if r["state"] != 0]
                out.append((key, doc, text, [d[0] for d in done], [d[1] for d in done],
                            any(r["state"] == 1 for r in rest), None, None, None, None, None, None))
                names = None
                for r in rest:
                    head = (key, doc, None, None, None, None, r["value"])
                    if r["groups"] == 1:
                        out.append((*head, 0, r["lo"], r["state"] == 1, text[r["lo"]:r["hi"] + length], None))
                        continue
                    if names is None:
                        names = ranks(np.frombuffer(text, np.uint8), length)[1]
                    own = names[r["lo"]:r["hi"] + 1]
                    to = S.mix(own) % np.uint64(r["groups"])
                    for part in np.unique(to):
                        at = np.nonzero(to == part)[0]
                        out.append((*head, int(part), r["lo"], r["state"] == 1, own[at].tobytes(), at.astype(np.int32).tobytes()))
                if len(out) >= 2000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    text = docs.select(F.col("key"), F.col("doc_id"), F.col("text").cast("binary").alias("text"))
    near = repeats.withColumnRenamed("doc_id", "_id")
    return text.join(near, (text["key"] == near["key"]) & text["doc_id"].eqNullSafe(near["_id"])).select(
        text["key"], text["doc_id"], "text", "runs").mapInArrow(run, PARTS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_(), pa.int64(),
             pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=[c.split()[0] for c in PARTS.split(", ")])


def compared(strings: DataFrame, length: int = LENGTH) -> DataFrame:
    """key, doc_id, lo, hi: ranges of repeated window starts in open runs. Groups (value, part) come sorted."""
    def solve(group: list[tuple]) -> pa.RecordBatch:
        texts = [n for n, r in enumerate(group) if r[7] is None]
        owner, start, name = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for lo, hi, data, offsets in S.blocks(pa.array([group[n][6] for n in texts], pa.large_binary()), BLOCK_BYTES) if texts else []:
            at, row = _valid(offsets, length)
            own = np.array(texts[lo:hi], dtype=np.int64)[row]
            owner.append(own)
            start.append(at - offsets[row])
            name.append(ranks(data, length)[1][at])
        for n, r in enumerate(group):
            if r[7] is not None:
                names, at = np.frombuffer(r[6], np.uint64), np.frombuffer(r[7], np.int32)
                owner.append(np.full(len(at), n))
                start.append(at.astype(np.int64))
                name.append(names)
        owner, start, name = map(np.concatenate, (owner, start, name))
        value = np.array([r[2] for r in group], dtype=np.int64).view(np.uint64)
        full = name ^ S.mix(value)[owner]
        _, inverse, counts = np.unique(full, return_inverse=True, return_counts=True)
        wanted = np.array([r[5] for r in group], dtype=bool)
        hit = (counts[inverse] > 1) & wanted[owner]
        owner, start = owner[hit], start[hit]
        order = np.lexsort((start, owner))
        owner, start = owner[order], start[order]
        first, last = _runs(start, owner) if len(start) else (np.zeros(0, int), np.zeros(0, int))
        at = np.array([r[4] for r in group], dtype=np.int64)[owner[first]] if len(first) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([group[n][0] for n in owner[first]], pa.int64()), pa.array([group[n][1] for n in owner[first]], pa.int64()),
             pa.array(start[first] + at, pa.int64()), pa.array(start[last] + at, pa.int64())], names=["key", "doc_id", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*[c.to_pylist() for c in batch.columns])
            if len(held) < 2000:
                continue
            cut = next((n for n in range(len(held) - 1, 0, -1) if held[n][2:4] != held[n - 1][2:4]), 0)
            if cut:
                yield solve(held[:cut])
                held = held[cut:]
        if held:
            yield solve(held)

    return strings.repartition("value", "part").sortWithinPartitions("value", "part").select(
        "key", "doc_id", "value", "part", "at", "wanted", "payload", "places").mapInArrow(
        run, "key long, doc_id long, lo long, hi long")


def cut(texts: DataFrame, length: int = LENGTH, whole_characters: bool = False) -> DataFrame:
    """key, doc_id, kept (binary), n_removed, n_spans of rows (key, doc_id, text, lo, hi).

    With whole_characters the bytes that are left of cut characters go too.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, spans = [], [], []
            for text, lo, hi in zip(*[batch.column(n).to_pylist() for n in (2, 3, 4)]):
                data = np.frombuffer(text, np.uint8)
                edge = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(edge, np.array(lo, dtype=np.int64), 1)
                np.add.at(edge, np.array(hi, dtype=np.int64) + length, -1)
                out = np.cumsum(edge[:-1]) > 0
                rest = data[~out].tobytes()
                kept.append(rest.decode("utf-8", "ignore").encode() if whole_characters else rest)
                removed.append(int(out.sum()))
                spans.append(int((out[1:] & ~out[:-1]).sum() + out[:1].sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(
                    spans, pa.int64())], names=["key", "doc_id", "kept", "n_removed", "n_spans"])

    return texts.select("key", "doc_id", "text", "lo", "hi").mapInArrow(
        run, "key long, doc_id long, kept binary, n_removed long, n_spans long")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key (of document id and text), text (whole)."""
    return docs.select("doc_id", whole_text().alias("text")).select("doc_id", _key(F.col("text")).alias("key"), "text")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, whole_characters: bool = False) -> DataFrame:
    """key, doc_id, kept, n_removed, n_spans of the texts that lose bytes, one row per (doc_id, text); docs: as `keyed`."""
    folder = shared_folder(docs.sparkSession, "repeats")
    parts(docs, sorted_out(runs(docs, length, gram)), length).write.option("compression", "zstd").parquet(folder)
    written = docs.sparkSession.read.schema(PARTS).parquet(folder)
    more = compared(written.where("value is not null"), length).groupBy("key", "doc_id").agg(
        F.collect_list("lo").alias("lo2"), F.collect_list("hi").alias("hi2"))
    whole = written.where("value is null").select("key", "doc_id", "text", "lo", "hi", "open")
    near = more.withColumnRenamed("key", "_key").withColumnRenamed("doc_id", "_id")
    rest = whole.where("open").join(near, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    empty = F.array().cast("array<bigint>")
    rest = rest.select("key", "doc_id", "text", F.concat("lo", F.coalesce("lo2", empty)).alias("lo"),
                       F.concat("hi", F.coalesce("hi2", empty)).alias("hi"))
    return cut(whole.where("not open").drop("open").unionByName(rest), length, whole_characters).where("n_removed > 0").dropDuplicates(
        ["key", "doc_id"])


def cut_text(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents without their repeated strings; bytes of cut characters go with them. All columns stay.

    Documents of which a cut leaves nothing but white space are dropped. Nulls stay null.
    """
    own = docs.withColumn("_key", _key(whole_text()))
    lost = without_repeats(keyed(docs), length, whole_characters=True).select(
        F.col("key").alias("_other"), F.col("doc_id").alias("_id"), F.col("kept").cast("string").alias("_kept"))
    joined = own.join(lost, (F.col("_key") == F.col("_other")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.where(F.col("_kept").isNull() | F.col("_kept").rlike(r"\S")).withColumn(
        "text", F.coalesce("_kept", "text")).drop("_key", "_other", "_id", "_kept")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed(documents(spark, sf_dir))
    lost = without_repeats(docs).select(
        F.col("key").alias("_key"), F.col("doc_id").alias("_id"), "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    whole = docs.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("whole_sha"))
    return whole.join(lost, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "whole_sha").alias("kept_sha256"))
