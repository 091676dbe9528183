"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents. Blocks of 1024 ids subtract the block's minimum and are packed at the
width that holds the given percentile of the differences; the few larger ones stand in an exception list (place and
value). The footer indexes where each block starts, its minimum, width and exceptions, and lists documents with their
numbers of ids, so that any document can be read without decoding the blocks before it.

Files are written by tasks under temporary names and renamed, so a repeated task replaces its own file; the folder is in
`spark.checkpoint.dir`, which all executors share. Defined cases: null texts are empty and get the end id alone;
repeated rows stand in the files as often as they come; null ids of documents sort first.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarmesh.llm.common import documents
from scholarmesh.llm.tokens import public_path, word_bpe
from scholarmesh.session import ensure_checkpoint_dir

MAGIC = b"PFOR0001"
BLOCK, LANES = 1024, 32
PERCENTILE = 98
FILE_IDS = 4_000_000  # a task goes on to its next file beyond this many ids
END_ID = 1


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 32, 32) values below 2^width -> (blocks, width, 32) words; row r takes bits r * width onward."""
    out = np.zeros((len(rows), width, LANES), dtype=np.uint32)
    for r in range(BLOCK // LANES):
        word, shift = divmod(r * width, 32)
        if width:
            out[:, word] |= rows[:, r] << np.uint32(shift)
            if shift + width > 32:
                out[:, word + 1] |= rows[:, r] >> np.uint32(32 - shift)
    return out


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), BLOCK // LANES, LANES), dtype=np.uint32)
    mask = np.uint32((1 << width) - 1)
    for r in range(BLOCK // LANES):
        word, shift = divmod(r * width, 32)
        if width:
            value = words[:, word] >> np.uint32(shift)
            if shift + width > 32:
                value = value | words[:, word + 1] << np.uint32(32 - shift)
            out[:, r] = value & mask
    return out


def encode_file(ids: np.ndarray, doc_ids: list, lengths: list[int], percentile: float = PERCENTILE) -> bytes:
    """The bytes of one file; ids are those of all documents, one after the other."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    values = np.zeros(blocks * BLOCK, dtype=np.uint32)
    values[:n] = ids
    if n:
        values[n:] = ids[-1]
    values = values.reshape(blocks, BLOCK)
    least = values.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = values - least[:, None]
    top = np.partition(diff, int(BLOCK * percentile / 100) - 1, axis=1)[:, int(BLOCK * percentile / 100) - 1] if blocks else least
    width = np.zeros(blocks, dtype=np.uint8)
    for w in range(32):
        width[top >> np.uint32(w) > 0] = w + 1
    large = (diff >> np.minimum(width, 31).astype(np.uint32)[:, None] > 0) & (width < 32)[:, None]
    where = np.nonzero(large)
    exceptions, places = diff[where], where[1].astype(np.uint16)
    diff[where] = 0
    body = io.BytesIO()
    size = width.astype(np.int64) * LANES * 4
    start = np.concatenate([[0], np.cumsum(size)[:-1]]) if blocks else np.zeros(0, np.int64)
    packed = np.zeros(int(size.sum()), dtype=np.uint8)
    for w in np.unique(width[width > 0]):
        of = np.nonzero(width == w)[0]
        words = _pack(diff[of].reshape(len(of), BLOCK // LANES, LANES), int(w)).view(np.uint8).reshape(len(of), -1)
        packed[(start[of][:, None] + np.arange(words.shape[1])).ravel()] = words.ravel()
    body.write(MAGIC + packed.tobytes())
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    parts = [start.astype("<u4"), least.astype("<u4"), width, np.bincount(where[0], minlength=blocks).astype("<u2"),
             places.astype("<u2"), exceptions.astype("<u4"), known,
             np.array([d or 0 for d in doc_ids], dtype="<i8"), np.array(lengths, dtype="<u4")]
    blobs = [zlib.compress(p.tobytes(), 1) for p in parts]
    head = json.dumps({"ids": n, "parts": [len(b) for b in blobs]}).encode()
    body.write(b"".join(blobs) + head + struct.pack("<I", len(head)) + MAGIC)
    return body.getvalue()


def decode_file(data: bytes) -> tuple[np.ndarray, list, np.ndarray]:
    """(ids, document ids, numbers of ids) of one file."""
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a token file")
    size = struct.unpack("<I", data[-12:-8])[0]
    head = json.loads(data[-12 - size:-12])
    at, parts = len(data) - 12 - size - sum(head["parts"]), []
    kinds = ["<u4", "<u4", "u1", "<u2", "<u2", "<u4", "u1", "<i8", "<u4"]
    footer = at
    for n, kind in zip(head["parts"], kinds, strict=True):
        parts.append(np.frombuffer(zlib.decompress(data[at:at + n]), dtype=kind))
        at += n
    start, least, width, count, places, exceptions, known, doc_ids, lengths = parts
    packed = np.frombuffer(data, dtype=np.uint8, count=footer - 8, offset=8)
    out = np.zeros((len(start), BLOCK), dtype=np.uint32)
    for w in np.unique(width[width > 0]):
        of = np.nonzero(width == w)[0]
        rows = packed[start[of].astype(np.int64)[:, None] + np.arange(int(w) * LANES * 4)]
        out[of] = _unpack(rows.view("<u4").reshape(len(of), int(w), LANES), int(w)).reshape(len(of), BLOCK)
    out[np.repeat(np.arange(len(start)), count), places] = exceptions
    out += least[:, None]
    return out.ravel()[:head["ids"]], [int(d) if k else None for d, k in zip(doc_ids, known)], lengths


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def file_system(folder: str):
    """(file system, path) of a folder address, for use inside tasks."""
    from pyarrow import fs

    address = "file://" + folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith(
        "file://") else folder
    return fs.FileSystem.from_uri(address)


def write_files(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, percentile: float = PERCENTILE,
                file_ids: int = FILE_IDS) -> list[tuple[int, int, int, int]]:
    """Encode (doc_id, text) and write the ids in ascending doc_id order; returns (part, file, documents, ids) per file."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_bpe(path), TaskContext.get().partitionId()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        done: list[tuple[int, int, int]] = []
        docs_, ids = [], []

        def flush() -> None:
            name = f"{base}/part-{part:07d}-{len(done):05d}.pfor"
            temporary = f"{base}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary) as out:
                all_ids = np.concatenate(ids)
                out.write(encode_file(all_ids, docs_, [len(x) for x in ids], percentile))
            fs.move(temporary, name)
            done.append((len(done), len(docs_), len(all_ids)))
            docs_.clear()
            ids.clear()

        held, last = 0, (None, None)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text != last[0]:
                    last = (text, np.append(encoder.ids(text), np.uint32(end_id)))
                docs_.append(doc)
                ids.append(last[1])
                held += len(last[1])
                if held >= file_ids:
                    flush()
                    held = 0
        if ids:
            flush()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part] * len(done), pa.int64()), **{k: pa.array([d[n] for d in done], pa.int64())
            for n, k in enumerate(("file", "docs", "ids"))}})

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(write, "part long, file long, docs long, ids long")
    return sorted(tuple(r) for r in written.collect())  # one row per file, as a commit message


def read_files(spark: SparkSession, folder: str, manifest: list[tuple[int, int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of all documents in the files."""
    schema = "part long, file long, doc_id long, local long, n_tokens long, ids binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, doc_ids, lengths = decode_file(data.as_py())
                part, file = map(int, name.rsplit("/", 1)[-1].removesuffix(".pfor").split("-")[1:])
                ends = np.cumsum(lengths, dtype=np.int64)
                for lo in range(0, len(doc_ids), 2000):
                    hi = min(lo + 2000, len(doc_ids))
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([part] * (hi - lo), pa.int64()), "file": pa.array([file] * (hi - lo), pa.int64()),
                        "doc_id": pa.array(doc_ids[lo:hi], pa.int64()),
                        "local": pa.array(ends[lo:hi] - lengths[lo:hi], pa.int64()),
                        "n_tokens": pa.array(lengths[lo:hi].astype(np.int64)),
                        "ids": pa.array([ids[e - n:e].astype("<u4").tobytes() for e, n in zip(ends[lo:hi], lengths[lo:hi])],
                                        pa.binary())})

    if not manifest:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("path", "content")
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = spark.createDataFrame([(p, f, n) for p, f, _, n in manifest], "part long, file long, n long").select(
        "part", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # one row per file
    return files.mapInArrow(read, schema).join(F.broadcast(starts), ["part", "file"]).select(
        "doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    manifest = write_files(documents(spark, sf_dir), folder, public_path("word_bpe_49k.json"))
    return read_files(spark, folder, manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
