"""Byte-level BPE of chunks that overlap, stitched where their pre-token boundaries resynchronise; and decoding.

A long text is cut into chunks that share `overlap` code points. Every chunk is pre-tokenised by itself, in parallel. In
the shared zone the boundaries of both neighbours are compared: the first one that both have, at least a few code points
after the right chunk's start and before the left one's last pre-token, and that follows a visible character, is the
seam. (No pre-token of the public pattern spans a visible character and the white space after it, so two neighbours agree
at the first such place, whatever stood before.) If a zone has no seam, its two chunks are joined and encoded as one
piece: a text without any white space becomes one piece. Each piece is encoded by itself; its ids follow those before.
Texts of one chunk need no seam. Decoding concatenates the raw bytes of the ids.

Defined cases: a null text is empty, with no ids and no bytes; repeated rows (told apart by a row number that is written
before it is used) each get their result; null document ids stay null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarmesh.llm.common import cut_lineage, documents
from scholarmesh.llm.tokens import public_path, rank_encoder

CHUNK, OVERLAP = 65_536, 256
ROWS = 500  # rows that a task turns into Python objects at once


def boundaries(text: str) -> np.ndarray:
    """Ends of the pre-tokens of a text."""
    import public_tokenizers
    import regex

    return np.array([m.end() for m in regex.finditer(public_tokenizers.PATTERN, text)], dtype=np.int64)


def chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """row, doc_id, n_chunks, no, piece: chunk no of each text with the overlap after it."""
    n = F.greatest(F.ceil(F.length("text") / chunk), F.lit(1)).cast("int")
    no = F.col("no")
    return docs.withColumn("row", F.monotonically_increasing_id()).withColumn("n_chunks", n).withColumn(
        "no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))).select(
        "row", "doc_id", "n_chunks", "no", F.when(F.col("n_chunks") == 1, F.col("text")).otherwise(
            F.substring("text", no * chunk + 1, F.lit(chunk + overlap))).alias("piece"))


def zones(parts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """row, no, head, tail: boundaries of a chunk in the zones that it shares, counted from the zone's start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for text in batch.column(2).to_pylist():
                ends = boundaries(text)
                seam = ends[[e > 0 and not text[e - 1].isspace() for e in ends.tolist()]] if len(ends) else ends
                heads.append(seam[seam < overlap].tolist())
                inner = seam[(seam >= chunk) & (seam < len(text))] - chunk  # the last pre-token may be cut short
                tails.append(inner.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, pa.list_(pa.int64())),
                                              pa.array(tails, pa.list_(pa.int64()))], names=["row", "no", "head", "tail"])

    return parts.select("row", "no", "piece").mapInArrow(run, "row long, no int, head array<bigint>, tail array<bigint>")


def seams(found: DataFrame) -> DataFrame:
    """row, no, begin (code points into the zone at the chunk's start; null: no seam), next (the same of the next chunk)."""
    w = Window.partitionBy("row").orderBy("no")
    shared = F.array_min(F.filter(F.array_intersect("head", F.lag("tail").over(w)), lambda x: x > 0))
    return found.select("row", "no", F.when(F.col("no") == 0, F.lit(0).cast("bigint")).otherwise(shared).alias("begin")).select(
        "row", "no", "begin", F.lead("begin").over(w).alias("next"))


def pieces(parts: DataFrame, joints: DataFrame, chunk: int) -> DataFrame:
    """row, doc_id, no, n_chunks, piece: what each chunk encodes; chunks without a seam hang on to the one before."""
    w = Window.partitionBy("row").orderBy("no")
    text = F.col("piece")
    own = parts.where("n_chunks > 1").join(joints, ["row", "no"])
    last = F.col("no") == F.col("n_chunks") - 1
    begin = F.coalesce("begin", F.lit(0))
    stop = F.when(last, F.length(text)).otherwise(chunk + F.coalesce("next", F.lit(0)))
    cut = own.select("row", "doc_id", "n_chunks", "no", F.sum(F.when(F.col("begin").isNotNull(), 1).otherwise(0)).over(
        w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        F.substring(text, (begin + 1).cast("int"), (stop - begin).cast("int")).alias("piece"))
    return cut.groupBy("row", "doc_id", "n_chunks", "run").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "piece"))), lambda x: x["piece"]), "").alias("piece")
    ).select("row", "doc_id", "n_chunks", F.col("run").cast("int").alias("no"), "piece")


def encoded(parts: DataFrame, path: str) -> DataFrame:
    """row, doc_id, n_chunks, no, ids (binary, little-endian unsigned 32-bit) and the bytes decoded from them, by piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(path)
        last: tuple = (None, None, None)
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                some, out = batch.slice(lo, ROWS), []
                for text in some.column(4).to_pylist():
                    if text != last[0]:
                        ids = np.asarray(encoder.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
                        last = (text, ids.tobytes(), encoder.decode_bytes(ids.tolist()))
                    out.append(last[1:])
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:4], *[pa.array([x[n] for x in out], pa.binary()) for n in (0, 1)]],
                    names=["row", "doc_id", "n_chunks", "no", "ids", "decoded"])

    return parts.select("row", "doc_id", "n_chunks", "no", "piece").mapInArrow(
        run, "row long, doc_id long, n_chunks int, no int, ids binary, decoded binary")


def _hex_of(name: str):
    return lambda x: F.hex(x[name])


def encode(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids (binary) and the bytes decoded from them, for every row of (doc_id, text)."""
    all_parts = chunks(docs, chunk, overlap)
    long_parts = cut_lineage(all_parts.where("n_chunks > 1"))  # read for the seams and for the pieces
    joints = seams(zones(long_parts, chunk, overlap))
    short = encoded(all_parts.where("n_chunks = 1"), path).select("doc_id", "ids", "decoded")
    long = encoded(pieces(long_parts, joints, chunk), path).groupBy("row", "doc_id").agg(
        F.sort_array(F.collect_list(F.struct("no", "ids", "decoded"))).alias("x")).select("doc_id", *[
        F.unhex(F.array_join(F.transform("x", _hex_of(c)), "")).alias(c) for c in ("ids", "decoded")])
    return short.unionByName(long)


def op8_byte_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(documents(spark, sf_dir), public_path("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
