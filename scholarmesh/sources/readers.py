"""Readers with declared schemas."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmesh.functions import text as X
from scholarmesh.operators.snapshot import DETAIL_SECTIONS

ANNOUNCEMENT_PAGE = (
    "state BOOLEAN, status BOOLEAN, data ARRAY<STRUCT<redirect_url: STRING, name: STRING, date_to_show: STRING, "
    "publish_start_date: STRING>>")
DOCUMENT_EXTENSIONS = ("pdf", "docx")
WHOLE_BYTES = 16 << 20  # files up to this size are read as one value
BLOCK_BYTES = 4096  # some thousands of blocks are in memory at once
PACKED_FILES = r"\.(gz|bz2|deflate|snappy|lz4|zst|zstd)$"  # the line reader would unpack these
BLOCK = pa.schema([("file", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("number", pa.int64()), ("goes_on", pa.bool_()), ("data", pa.binary())])


def announcements_from_pages(pages: DataFrame) -> DataFrame:
    """(url, title, publish_date) of listing pages; a page with a false state fails the job when it is read.

    `state` counts wherever the page has it, else `status`; pages read from text say so in `has_state`.
    The date is the first non-empty of `date_to_show` and `publish_start_date`; text that is no ISO date gives null.
    """
    has_state = F.col("has_state") if "has_state" in pages.columns else F.col("state").isNotNull()
    ok = F.coalesce(F.when(has_state, F.col("state")).otherwise(F.col("status")), F.lit(False))
    data = F.when(ok, F.col("data")).otherwise(F.raise_error(F.lit("announcement page reports an error state")))
    d = F.col("d")
    date = F.coalesce(F.nullif(d["date_to_show"], F.lit("")), F.nullif(d["publish_start_date"], F.lit("")))
    return pages.select(F.explode(data).alias("d")).select(
        d["redirect_url"].alias("url"), X.collapse_spaces(d["name"]).alias("title"),
        F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(date, "yyyy-MM-dd")).alias("publish_date"))


def read_announcements_json(spark: SparkSession, path: str) -> DataFrame:
    """Announcements of a folder of paged JSON answers, one JSON object per file."""
    text = spark.read.text(path, wholetext=True)
    return announcements_from_pages(text.select(
        F.from_json("value", ANNOUNCEMENT_PAGE).alias("p"),
        F.coalesce(F.array_contains(F.json_object_keys("value"), "state"), F.lit(False)).alias("has_state")).select("p.*", "has_state"))


def snapshot_from_json(rows: DataFrame, json: str, schema: str, sections: list[str] = DETAIL_SECTIONS,
                       key: str = "author_id") -> DataFrame:
    """Keyed rows of JSON person records: the parsed columns and `has_details`, true iff every section key is there."""
    record = F.from_json(F.col(json), schema)
    keys = F.json_object_keys(json)
    has_details = F.lit(True)
    for s in sections:
        has_details = has_details & F.array_contains(keys, s)
    return rows.select(record.alias("_r"), has_details.alias("has_details")).select("_r.*", "has_details")


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Snapshot of a folder of JSON-lines person records; text is read first, so that absent keys can be told apart."""
    return snapshot_from_json(spark.read.text(path), "value", schema)


def scan_documents(spark: SparkSession, folder: str, extensions: tuple[str, ...] = DOCUMENT_EXTENSIONS) -> DataFrame:
    """(path, name, person_id, n_bytes, content_hash) of all documents below a folder; temporary and hidden files skipped.

    Call `assert_unique_ids` before use: two files with one id must not silently overwrite each other.
    """
    pattern = "*.{" + ",".join(x for e in extensions for x in sorted({e.lower(), e.upper()})) + "}"
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).load(folder))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    files = files.where(~name.startswith("~$") & ~name.startswith("."))
    columns = ["path", name.alias("name"), X.id_from_filename(stem).alias("person_id"), F.col("length").alias("n_bytes")]
    packed = F.lower("_metadata.file_name").rlike(PACKED_FILES)
    over = F.col("length") > WHOLE_BYTES
    large = over & ~packed
    digest = F.sha2("content", 256).alias("content_hash")
    whole = files.where(F.col("length") <= WHOLE_BYTES).select(*columns, digest)  # a bound that the reader keeps to
    if not files.where(over & packed).select("path").isEmpty():
        whole = whole.unionByName(files.where(over & packed).select(*columns, digest))
    if files.where(large).select("path").isEmpty():
        return whole
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n").text(folder)
             .where((F.col("_metadata.file_size") > WHOLE_BYTES) & ~F.lower("_metadata.file_name").rlike(PACKED_FILES)))
    found = streamed_hashes(lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line")))
    named = files.where(large).select(*columns, F.col("_metadata.file_path").alias("file"))
    return whole.unionByName(named.join(found, "file", "left").select("path", "name", "person_id", "n_bytes", F.coalesce(
        "content_hash", F.raise_error(F.concat(F.lit("file changed while it was read: "), "file"))).alias("content_hash")))


def streamed_hashes(lines: DataFrame) -> DataFrame:
    """(file, content_hash) of files given by their lines in order (file, size, start of the split, line).

    Lines are put together, or cut, to blocks of at most BLOCK_BYTES, which reach one task a file in the order of the file and are
    hashed one after the other, so memory holds some blocks (and the reader's batch of lines) whatever the size of the file. The reader
    drops a byte order mark; whether there was one, and a line end at the end, is seen from the size.
    """
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n, number, out = None, [], 0, 0, []

        def put() -> None:
            nonlocal held, n, number
            data = b"\n".join(held)
            for at in range(0, max(1, len(data)), BLOCK_BYTES):
                out.append({"file": key[0], "size": key[1], "start": key[2], "number": number, "goes_on": at > 0, "data": data[at:at + BLOCK_BYTES]})
                number += 1
            held, n = [], 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                line = row[3].as_buffer().to_pybytes()
                if held and (row[:3] != key or n + len(line) >= BLOCK_BYTES):
                    put()
                key = row[:3]
                held.append(line)
                n += len(line) + 1
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, BLOCK)
                    out = []
        if held:
            put()
        if out:
            yield pa.RecordBatch.from_pylist(out, BLOCK)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states, n = None, [], 0

        def result() -> pa.RecordBatch:
            rest = key[1] - n  # 1: a line end at the end, 3: a byte order mark
            if rest not in (0, 1, 3, 4):
                raise ValueError(f"{key[0]}: {n} of {key[1]} bytes were read")
            state = states[rest >= 3]
            state.update(b"\n" * (rest % 3))
            return pa.RecordBatch.from_pylist([{"file": key[0], "content_hash": state.hexdigest()}])

        for batch in batches:
            for i in range(len(batch)):
                file, size, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(5)[i].as_buffer()
                if key != (file, size):
                    if key:
                        yield result()
                    key, states, n = (file, size), [hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf")], 0
                elif not batch.column(4)[i].as_py():
                    n += 1
                    [s.update(b"\n") for s in states]
                [s.update(data) for s in states]
                n += len(data)
        if key:
            yield result()

    put = lines.mapInArrow(blocks, "file string, size long, start long, number long, goes_on boolean, data binary")
    return put.repartition("file").sortWithinPartitions("file", "start", "number").mapInArrow(hashes, "file string, content_hash string")


def duplicate_ids(files: DataFrame, key: str = "person_id") -> DataFrame:
    return files.groupBy(key).agg(F.count("*").alias("n_files")).where(F.col("n_files") > 1)


def assert_unique_ids(files: DataFrame, key: str = "person_id") -> DataFrame:
    if duplicate_ids(files, key).limit(1).count():
        raise ValueError("several documents give the same id; check the file names")
    return files


# --- records by declarative patterns --------------------------------------------------------------------

def extract_records(pages: DataFrame, html: str, row_pattern: str, fields: dict[str, str],
                    required: tuple[str, ...] = ("url", "title"), keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per repeated card or table row of a page: (keys, pos, fields). Patterns are configuration.

    `row_pattern` finds rows, each field pattern has one group and is applied to the row; markup inside a field is
    removed and spaces collapsed. Rows lacking a required field are skipped.
    """
    rows = pages.select(*keys, F.posexplode(F.regexp_extract_all(html, F.lit(row_pattern), F.lit(0))).alias("pos", "_row"))

    def field(pattern: str) -> Column:
        raw = F.regexp_replace(F.regexp_extract("_row", pattern, 1), r"<[^>]*>", "")
        return F.nullif(X.collapse_spaces(X.html_unescape(raw)), F.lit(""))

    out = rows.select(*keys, "pos", *[field(p).alias(n) for n, p in fields.items()])
    for r in required:
        out = out.where(F.col(r).isNotNull())
    return out


# --- attachments ------------------------------------------------------------------------------------------

# Which documents belong to a call, on the folded label and file name.
ATTACHMENT_INCLUDE = r"cagri|call|duyuru|kural|surec|basvuru.?dok|announcement"
ATTACHMENT_EXCLUDE = r"kilavuz|rehber|yardim|konu.?baslik|yatirim.?plan|guideline|form\b|sablon|template"
MAX_ATTACHMENTS = 2
MAX_ATTACHMENT_CHARS = 20_000


def select_attachments(links: DataFrame, domain: str, include: str = ATTACHMENT_INCLUDE,
                       exclude: str = ATTACHMENT_EXCLUDE, limit: int = MAX_ATTACHMENTS,
                       extension: str = "pdf") -> DataFrame:
    """(page_id, url, attachment_rank): a page's documents on the domain, national before international, in page order.

    `links` is (page_id, pos, label, url).
    """
    from scholarmesh.functions.ranking import top_k

    path = F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit(""))
    host = F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit(""))
    file_name = F.regexp_extract(path, r"([^/]*)$", 1)
    name = X.fold(F.concat_ws(" ", "label", F.coalesce(F.try_url_decode(file_name), file_name)))
    international = (name.contains("uluslararasi") | name.contains("call")) & ~name.contains("ulusal ")
    chosen = links.where(host.endswith(domain) & F.lower(path).endswith("." + extension)
                         & name.rlike(include) & ~name.rlike(exclude)).withColumn("_i", international)
    return top_k(chosen, ["page_id"], [F.asc("_i"), F.asc("pos")], limit, "attachment_rank").select(
        "page_id", "url", "attachment_rank")


def attach_documents(pages: DataFrame, chosen: DataFrame, texts: DataFrame,
                     max_chars: int = MAX_ATTACHMENT_CHARS) -> DataFrame:
    """Pages with the text of their chosen attachments (url, text) appended under '## Ek: <file>'; unread ones skipped."""
    read = chosen.join(texts.select("url", F.left("text", F.lit(max_chars)).alias("_t")), "url")
    block = F.concat(F.lit("\n\n## Ek: "), F.regexp_extract("url", r"([^/]*)$", 1), F.lit("\n"), F.col("_t"))
    blocks = read.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("attachment_rank", block.alias("b")))).alias("_b"))
    return pages.join(blocks, "page_id", "left").withColumn(
        "text", F.concat("text", F.coalesce(F.array_join(F.col("_b.b"), ""), F.lit("")))).drop("_b")
