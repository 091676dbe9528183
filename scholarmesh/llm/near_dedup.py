"""Near-duplicate classes by Order MinHash over five-word shingles.

Shingles are labelled with their occurrence. For each of BANDS hash functions the SAMPLE smallest labelled shingles of a
text are taken and kept in text order; their combined hash is one band value. Such values meet with a probability that
falls with both missing and moved shingles. Texts that share a band value are candidates, and a banded alignment of their
words verifies them: the longest common subsequence within the shifts that the least similarity allows; similarity is
common / (words of both - common), at least 0.8. An edit costs the words it touches, not the five shingles around each.

Equal texts are one node from the start. Per band value all members are first aligned with two leaders (the member that
shares most band values, and one by hash); what this links is contracted by connected components. Left are band values
with several components. A word (with the number of its occurrence) that only one of their members has can meet no other;
the others' words are sets of the R-tree join (`jaccard_join.tree_pairs`), whose bound of what two sets share is also one of
what can be aligned, so that pairs below the least similarity are never rows of a table. Of the pairs above it a first pass
aligns those that would connect the components; when that is contracted, a second pass aligns all that still lie between
different components. Thus no link between different texts that share a band value is lost, while a group of copies costs
a few alignments per member. Band groups are joined and aggregated, never collected. What the bands miss: a pair whose five-word shingles have similarity J shares
none with a probability of about (1 - J^3)^16; texts with 5 % of the words of one replaced have J = 0.63 and miss 1 in 80.

Defined cases: null texts are empty; texts without words are equal only to the same text; texts of one to four words
have one shingle; repeated rows are copies. The class id is the least doc_id of the class (null if all are null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmesh.llm import shingles as S
from scholarmesh.llm.common import compact, cut_lineage, documents, whole_text
from scholarmesh.llm.components import components
from scholarmesh.llm.jaccard_join import BLOCK_BYTES, SETS, of_different_members, placed, set_rows, tree_pairs, with_company

BANDS, SAMPLE, LEAST = 16, 3, 0.8


def order_minhash(key: np.ndarray, sizes: np.ndarray, bands: int = BANDS, sample: int = SAMPLE) -> np.ndarray:
    """(rows, bands) sketch values of rows with at least one labelled shingle each."""
    starts = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(20240229)
    out = np.empty((len(sizes), bands), dtype=np.uint64)
    top = np.uint64(2**64 - 1)
    for band, factor in enumerate(rng.integers(0, 2**63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)):
        value = key * factor  # bijective: no ties between the different keys of a row
        places = np.full((len(sizes), sample), len(key), dtype=np.int64)
        for n in range(sample):
            least = np.minimum.reduceat(value, starts)
            at = np.nonzero(value == np.repeat(least, sizes))[0] if n < 1 or sizes.min() >= sample else np.nonzero(
                (value == np.repeat(least, sizes)) & (value != top))[0]
            places[np.searchsorted(starts, at, side="right") - 1, n] = at
            value[at] = top
        places.sort(axis=1)
        total = np.zeros(len(sizes), dtype=np.uint64)
        padded = np.append(key, np.uint64(0))
        for n in range(sample):
            total = S.mix(total * S.STEP + padded[places[:, n]])
        out[:, band] = total
    return out


def sketches(docs: DataFrame, bands: int = BANDS, sample: int = SAMPLE) -> DataFrame:
    """doc_id, node (digest of the whole text), n (words), sketch (empty without words) for (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in S.blocks(batch.column(2), BLOCK_BYTES):
                word, counts = S.words(data, offsets)
                shingle, sizes = S.shingles(word, counts)
                has = np.nonzero(sizes > 0)[0]
                key = S.numbered(shingle, sizes)
                sketch = order_minhash(key, sizes[has], bands, sample) if len(has) else np.zeros((0, bands), np.uint64)
                ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(counts.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(sketch.ravel().view(np.int64)))],
                    names=["doc_id", "node", "n", "sketch"])

    return docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), "text").mapInArrow(
        run, "doc_id long, node binary, n long, sketch array<bigint>")


def aligned(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """common / (words of both - common) for the longest common subsequence of two rows of words; 0 if below `least`.

    The least similarity bounds how far an alignment can leave the diagonal, so only that band is looked at: a window of
    rows as the bits of an integer, in which one column is one addition. Rows below the window are final.
    """
    na, nb = len(a), len(b)
    need = least / (1 + least) * (na + nb) - 1e-9  # of common words
    short = min(na, nb)
    if short < need:
        return 0.0
    head = int(np.argmin(np.append(a[:short] == b[:short], False)))
    tail = int(np.argmin(np.append(a[na - short + head:][::-1] == b[nb - short + head:][::-1], False)))
    x, y = a[head:na - tail], b[head:nb - tail]
    keys, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    counts = [np.bincount(v, minlength=len(keys)) for v in (at[:len(x)], at[len(x):])]
    if head + tail + int(np.minimum(*counts).sum()) < need:
        return 0.0
    common = head + tail
    reach = int(max(na, nb) - need)
    step = max(1024, 2 * reach)
    rows, columns = at[:len(x)].tolist(), at[len(x):].tolist()
    low = high = 0
    state = 0  # bit i: row low + i does not add to the common words so far
    for first in range(0, len(columns), step):
        bottom, top = min(len(rows), max(low, first - reach)), min(len(rows), first + step + reach)
        state |= ((1 << (top - high)) - 1) << (high - low)
        gone = state & ((1 << (bottom - low)) - 1)
        common += bottom - low - gone.bit_count()
        state >>= bottom - low
        low, high = bottom, max(high, top)
        places: dict[int, int] = {}
        for i in range(low, high):
            places[rows[i]] = places.get(rows[i], 0) | 1 << (i - low)
        full = (1 << (high - low)) - 1
        for word in columns[first:first + step]:
            met = state & places.get(word, 0)
            state = ((state + met) | (state - met)) & full
    common += high - low - state.bit_count()
    return common / (na + nb - common) if common >= need else 0.0


def worded(texts: DataFrame) -> DataFrame:
    """node, keys (binary: words in text order) of (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in S.blocks(batch.column(1), BLOCK_BYTES):
                word, sizes = S.words(data, offsets)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo),
                     pa.array([word[e - n:e].tobytes() for e, n in zip(ends, sizes)], pa.binary())], names=["node", "keys"])

    return texts.select("node", "text").mapInArrow(run, "node binary, keys binary")


def labelled(key: bytes) -> np.ndarray:
    """The words with the number of their occurrence, so that all differ: common ones bound what can be aligned."""
    word = np.frombuffer(key, np.uint64)
    return S.numbered(word, np.array([len(word)]))


def verified(pairs: DataFrame, keys: DataFrame, least: float = LEAST) -> DataFrame:
    """u, v of the pairs whose alignment reaches the least similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n in range(len(batch)):  # one pair's words at a time
                a, b = (np.frombuffer(batch.column(c)[n].as_buffer(), np.uint64) for c in (2, 3))
                keep.append(aligned(a, b, least) >= least)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    left = keys.select(F.col("node").alias("u"), F.col("keys").alias("ku"))
    right = keys.select(F.col("node").alias("v"), F.col("keys").alias("kv"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "ku", "kv").mapInArrow(run, "u binary, v binary")


def labelled_sets(keys: DataFrame) -> DataFrame:
    """node (number), n, point, shingles of (number, keys): the labelled words of a text as a set of the R-tree join."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):  # one text's words at a time
                word = labelled(batch.column(1)[n].as_buffer())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(n, 1), *set_rows(word, np.array([len(word)]))],
                                                 names=[c.split()[0] for c in SETS.split(", ")])

    return keys.select("number", "keys").mapInArrow(run, SETS)


def _ratio(a: Column, b: Column, least: float) -> Column:
    """Texts whose numbers of words differ more than this cannot be similar enough."""
    return F.least(a, b) >= F.lit(least) * F.greatest(a, b) - 1e-9


def classes(docs: DataFrame, bands: int = BANDS, sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """doc_id, node, root, class_id, class_size (rows) for every row of (doc_id, text)."""
    docs = docs.select("doc_id", whole_text().alias("text"))
    known = cut_lineage(sketches(docs, bands, sample))
    nodes = known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"),
                                      F.first("sketch").alias("sketch"))
    entries = nodes.select("node", "doc_id", "n", F.posexplode("sketch").alias("band", "value"))
    groups = entries.groupBy("band", "value").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = compact(entries.join(groups, ["band", "value"]))
    central = members.groupBy("node").agg(F.sum("c").alias("weight"))
    weighed = members.join(central, "node")
    leaders = weighed.groupBy("band", "value").agg(
        F.max(F.struct("weight", "node"))["node"].alias("hub"),
        F.max(F.struct(F.xxhash64("band", "value", "node"), "node"))["node"].alias("other"))

    needed = members.select("node", F.col("doc_id").alias("d")).distinct()
    texts = docs.join(needed, docs["doc_id"].eqNullSafe(needed["d"])).where(
        F.unhex(F.md5(F.col("text").cast("binary"))) == F.col("node")).select("node", "text")
    keys = cut_lineage(worded(texts).dropDuplicates(["node"])).withColumn(
        "number", F.monotonically_increasing_id())  # numbers of checkpointed rows

    size = members.select("node", "n").distinct()
    stars = members.join(leaders, ["band", "value"]).select(
        F.col("node").alias("u"), F.explode(F.array("hub", "other")).alias("v")).where(
        "u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    stars = compact(stars.join(size.select(F.col("node").alias("u"), F.col("n").alias("nu")), "u").join(
        size.select(F.col("node").alias("v"), F.col("n").alias("nv")), "v").where(
        _ratio(F.col("nu"), F.col("nv"), least)).select("u", "v"))
    first = components(verified(stars, keys, least))

    names = keys.select("node", "number")
    u, v = (names.select(F.col("node").alias(c), F.col("number").alias(f"n{c}")) for c in "uv")
    percent = int(100 * least + 1e-9)

    def by_number(links: DataFrame) -> DataFrame:
        return links.join(u, "u").join(v, "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"))

    cells = members.select(F.xxhash64("band", "value").alias("cell"), "node").join(names, "node").select(
        "cell", F.col("number").alias("node"))
    apart = compact(placed(cells, by_number(first)))
    inside = keys.join(apart.select(F.col("node").alias("number")).distinct(), "number")
    apart = of_different_members(compact(with_company(apart, labelled_sets(inside), percent)), "node")
    left = keys.join(apart.select(F.col("node").alias("number")).distinct(), "number")
    points = cut_lineage(labelled_sets(left).select("node", "n", "point"))
    links, tried = first, stars
    for spanning in (True, False):
        apart = compact(placed(apart, by_number(links)))
        if apart.isEmpty():
            break
        near = tree_pairs(apart, points, percent, spanning=spanning).select(F.col("u").alias("nu"), F.col("v").alias("nv"))
        pairs = compact(near.join(u, "nu").join(v, "nv").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias(
            "v")).join(tried, ["u", "v"], "left_anti"))
        links, tried = components(links.unionByName(verified(pairs, keys, least))), tried.unionByName(pairs)

    rooted = known.select("doc_id", "node").join(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node",
                                                 "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rooted.join(ids, "root").select("doc_id", "node", "root", "class_id", "class_size")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of the document with the least doc_id of each class; of repeated rows one stays. All columns stay."""
    marked = classes(docs)
    best = marked.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("b")).select(
        F.col("b.doc_id").alias("_id"), F.col("b.node").alias("_node"))
    keyed = docs.withColumn("_digest", F.unhex(F.md5(whole_text().cast("binary"))))
    return keyed.join(best, keyed["doc_id"].eqNullSafe(best["_id"]) & (keyed["_digest"] == best["_node"])).dropDuplicates(
        ["_id", "_node"]).select(*docs.columns)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size")
