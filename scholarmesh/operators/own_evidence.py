"""Ranks of a person's own chunks per query, for evidence lists that end after a few chunks.

The chunks of the chosen persons are dealt out once into blocks of about BLOCK_ROWS chunks of one person, each kept as one
compressed Arrow batch (ids, lengths, term counts, vectors). A task scores a block for the person's queries by matrix
products; no row per chunk and query leaves it.

- A person of one block: both ranks are known in the task, which returns the list itself.
- More blocks: each gives the first `head` chunks of either ranking. The first `head` of all blocks are candidates, and a
  second pass counts in every block how many chunks come before each of them, so their ranks are exact. A chunk that is no
  candidate is behind `head` others in both rankings, so its fused score is at most 2 / (rrf_k + head): a list that ends at
  a better score is settled. For the other pairs the heads grow fourfold, until all chunks are candidates.

Chunk ids are unique; chunks without an id or a person are left out. Chunks without text (null) count in the ranks, but
are not listed and have no part in the lexical statistics. Equal scores are ordered by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarmesh.functions.ranking import bounded_join, is_small
from scholarmesh.operators import retrieval as R
from scholarmesh.session import cut_lineage

BLOCK_ROWS = 8192
HEAD = 128
SCORE_CELLS = 1 << 20  # chunks x queries scored at once (8 MB)
KEYS = ["query_id", "person_id"]


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()


def _block(table: pa.Table) -> pa.Table:
    """The chunks of a block in the order of their ids, each with its vector or null."""
    text = table.filter(table["is_text"])
    text = text.take(pc.sort_indices(text["id"]))
    known = table.filter(pc.invert(table["is_text"]))
    vector = known["vector"].combine_chunks().take(pc.index_in(text["id"].combine_chunks(), value_set=known["id"].combine_chunks()))
    return text.select(["id", "chars", "len", "terms", "counts"]).append_column("vector", vector)


def blocks_of(chunks: DataFrame, vectors: DataFrame, persons: DataFrame, vocabulary: list[str],
              tokenizer: Callable[[Column], Column], rows: int = BLOCK_ROWS) -> DataFrame:
    """(person_id, block, n, data): the persons' chunks, n per person, in blocks of about `rows`; a checkpointed table."""
    known = pa.array(vocabulary, pa.string())
    chunks, vectors = chunks.where("chunk_id is not null"), vectors.where("embedding is not null")
    sizes = cut_lineage(bounded_join(chunks.select("person_id", "chunk_id"), persons, ["person_id"], ["chunk_id"]).groupBy(
        "person_id").agg(F.count("*").alias("n")))
    small = is_small(sizes)
    block = F.pmod(F.xxhash64("chunk_id"), F.ceil(F.col("n") / rows)).cast("int").alias("block")
    place = ["person_id", block, "n", F.col("chunk_id").alias("id")]
    owned = chunks.select("chunk_id", "person_id", F.length("content").alias("chars"), tokenizer(F.col("content")).alias("t"))
    tokens = bounded_join(owned, sizes, ["person_id"], ["chunk_id"], small_enough=small).select(*place, "chars", "t")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.cast(batch.column(5).value_lengths(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], lengths, *R.term_counts(batch.column(5), known)], names=[
                "person_id", "block", "n", "id", "chars", "len", "terms", "counts"])

    person, id_type = (chunks.schema[c].dataType.simpleString() for c in ("person_id", "chunk_id"))
    texts = tokens.mapInArrow(counted, f"person_id {person}, block int, n long, id {id_type}, chars int, len long, terms binary, "
                                       "counts binary").withColumn("is_text", F.lit(True))
    held = bounded_join(vectors.select("chunk_id", "embedding").join(chunks.select("chunk_id", "person_id"), "chunk_id"), sizes,
                        ["person_id"], ["chunk_id"], small_enough=small)
    both = texts.unionByName(held.select(*place, F.col("embedding").alias("vector"), F.lit(False).alias("is_text")),
                             allowMissingColumns=True)

    def packed(table: pa.Table) -> pa.Table:
        first = table.select(["person_id", "block", "n"]).slice(0, 1)
        return first.append_column("data", pa.array([_pack(_block(table))], pa.binary()))

    return cut_lineage(both.groupBy("person_id", "block").applyInArrow(packed, f"person_id {person}, block int, n long, data binary"))


def _postings(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(chunk, term, count) of a block."""
    terms, counts = (table[c].combine_chunks() for c in ("terms", "counts"))
    row = np.repeat(np.arange(len(table)), pc.binary_length(terms).to_numpy() // 4)
    return row, *(np.frombuffer(b"".join(x.to_pylist()), np.int32) for x in (terms, counts))


def _statistics(table: pa.Table, n_terms: int) -> np.ndarray:
    """Texts with each term, texts, total length."""
    length = table["len"].drop_null().to_numpy()
    return np.concatenate([np.bincount(_postings(table)[1], minlength=n_terms), [len(length), length.sum()]]).astype(np.int64)


def person_statistics(blocks: DataFrame, n_terms: int) -> DataFrame:
    """(person_id, stats): the counts of `_statistics` that are not 0, of persons with more than one block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for person, data in zip(batch.column(0), batch.column(1)):
                total = _statistics(_unpack(data), n_terms)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([person.as_py()] * len(at), person.type), pa.array(at), pa.array(total[at])],
                                                 names=["person_id", "at", "n"])

    person = blocks.schema["person_id"].dataType.simpleString()
    many = blocks.join(F.broadcast(blocks.groupBy("person_id").agg(F.count("*").alias("_b")).where("_b > 1").drop("_b")), "person_id")
    return many.select("person_id", "data").mapInArrow(run, f"person_id {person}, at long, n long").groupBy("person_id", "at").agg(
        F.sum("n").alias("n")).groupBy("person_id").agg(F.collect_list(F.struct("at", "n")).alias("stats"))


class Scores:
    """The queries' vectors and term counts, and the scores of a block's chunks (rows) for some of them (columns)."""

    def __init__(self, query_ids: pa.Array, vectors: list, qtf: tuple[np.ndarray, ...], n_terms: int):
        self.query_ids, self.n_terms = query_ids, n_terms
        self.has = np.array([v is not None for v in vectors], dtype=bool)
        self.matrix = R._unit(np.array([v for v in vectors if v is not None], dtype=np.float64)) if self.has.any() else None
        self.place, self.qtf = np.cumsum(self.has) - 1, qtf  # qtf: (term, query, count)

    def of(self, table: pa.Table, stats: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(codes, similarities, bm25) for groups of the queries `codes`."""
        df, n, total = stats[:-2], int(stats[-2]), int(stats[-1])
        row, term, count = _postings(table)
        length = table["len"].fill_null(0).to_numpy()
        idf, average = np.log(1 + (n - df + 0.5) / (df + 0.5)), max(total, 1) / max(n, 1)
        dense = np.zeros((self.n_terms, int(codes.max()) + 1))
        some = self.qtf[1] <= codes.max()
        dense[self.qtf[0][some], self.qtf[1][some]] = self.qtf[2][some] * idf[self.qtf[0][some]]
        weights = dense[:, codes]
        vector = table["vector"].combine_chunks()
        held = vector.is_valid().to_numpy(zero_copy_only=False)
        unit = R._matrix(pd.Series(vector.drop_null().to_pandas())) if held.any() else None
        bm25, step = np.zeros((len(table), len(codes))), max(1, R.GAIN_CELLS // self.n_terms)
        starts = np.searchsorted(row, np.arange(0, len(table) + step, step))
        for i, at in enumerate(range(0, len(table), step)):
            part = slice(starts[i], starts[i + 1])
            size = min(step, len(table) - at)
            gains = R._gains(size, row[part] - at, term[part], count[part], length[row[part]], self.n_terms, average)
            bm25[at:at + size] = np.round(gains @ weights, R.SCORE_DIGITS)
        width = max(1, SCORE_CELLS // max(1, len(table)))
        for at in range(0, len(codes), width):
            part = codes[at:at + width]
            sims = np.full((len(table), len(part)), R.NO_VECTOR)
            has = self.has[part]
            if unit is not None and has.any():
                sims[np.ix_(held, has)] = np.round(unit @ self.matrix[self.place[part[has]]].T, 12)
            yield part, sims, bm25[:, at:at + width]


def _listed(rrf: np.ndarray, chars: np.ndarray, budget: int) -> tuple[np.ndarray, float]:
    """Places of the chunks listed, best first, while their lengths fit; the score of the first that does not, or -1.

    Chunks are given in the order of their ids; those without text (length NaN) are passed over.
    """
    some = np.flatnonzero(~np.isnan(chars))
    order = some[np.argsort(-rrf[some], kind="stable")]
    n = int(np.searchsorted(np.cumsum(chars[order]), budget, side="right"))
    return order[:n], float(rrf[order[n]]) if n < len(order) else -1.0


def _fused(semantic: np.ndarray, lexical: np.ndarray, rrf_k: int) -> np.ndarray:
    """Of ranks from 1."""
    return 1.0 / (rrf_k - 1 + semantic) + 1.0 / (rrf_k - 1 + lexical)


def _ranks(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank from 1) of one column."""
    order = np.argsort(-scores, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    return order, rank


def _before(scores: np.ndarray, own: np.ndarray, at: np.ndarray, self_at: np.ndarray) -> np.ndarray:
    """How many chunks of a block (one column of scores, in the order of ids) come before each candidate.

    own: the candidates' scores; at: chunks of the block with a smaller id; self_at: the candidate's own row here, or -1. Its
    score may differ in the last place from the one that was computed before, so it is not counted.
    """
    order = np.argsort(-scores, kind="stable")
    falling = -scores[order]
    low, high = (np.searchsorted(falling, -own, side) for side in ("left", "right"))
    place = np.searchsorted(falling, falling) * (len(scores) + 1) + order
    out = np.where(high > low, np.searchsorted(place, low * (len(scores) + 1) + at), low)
    here = self_at >= 0
    out[here] -= scores[self_at[here]] > own[here]
    return out


def evidence_hits(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, chosen: DataFrame, terms: pd.DataFrame, vocabulary: list[str],
                  budget: int, rrf_k: int, tokenizer: Callable[[Column], Column], rows: int = BLOCK_ROWS, head: int = HEAD) -> DataFrame:
    """(query_id, person_id, chunk_id, evidence_rank, rrf, similarity) of the listed chunks.

    `chosen` (query_id, person_id) is checkpointed and distinct, `queries` (query_id, vector) are few (counted), `terms`
    (query_id, t, qtf) their terms as places in `vocabulary`.
    """
    asked = queries.select("query_id", "vector").toArrow().combine_chunks()
    query_ids = asked["query_id"].combine_chunks()
    n_terms = max(1, len(vocabulary))
    code = pc.index_in(pa.array(terms["query_id"], query_ids.type), value_set=query_ids).to_numpy()
    scores = Scores(query_ids, asked["vector"].to_pylist(), (terms["t"].to_numpy(), code, terms["qtf"].to_numpy()), n_terms)
    persons = chosen.select("person_id").distinct()
    blocks = blocks_of(chunks, vectors, persons, vocabulary, tokenizer, rows)
    stats = cut_lineage(person_statistics(blocks, n_terms))
    kinds = {c: chosen.schema[c].dataType.simpleString() for c in KEYS} | {"id": chunks.schema["chunk_id"].dataType.simpleString()}
    listed = f"query_id {kinds['query_id']}, person_id {kinds['person_id']}, id {kinds['id']}, evidence_rank long, rrf double, similarity double"

    def told(query: pa.Scalar, person: pa.Scalar, ids: pa.Array, rrf: np.ndarray, sims: np.ndarray) -> list[pa.Array]:
        return [pa.repeat(query, len(ids)), pa.repeat(person, len(ids)), ids, pa.array(np.arange(1, len(ids) + 1)), pa.array(rrf),
                pa.array(np.where(sims == R.NO_VECTOR, 0.0, sims))]

    def jobs(wanted: DataFrame) -> DataFrame:
        """A row per block of the wanted pairs: (person_id, n, data, queries, stats)."""
        per = wanted.groupBy("person_id").agg(F.collect_list("query_id").alias("queries")).join(stats, "person_id", "left")
        return blocks.join(F.broadcast(per) if is_small(persons) else per, "person_id")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                table = _unpack(row["data"])
                total = np.zeros(n_terms + 2, dtype=np.int64)
                if row["stats"].is_valid:
                    found = row["stats"].values
                    total[found.field("at").to_numpy()] = found.field("n").to_numpy()
                else:
                    total = _statistics(table, n_terms)
                yield row, table, total, table["id"].combine_chunks()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists of persons of one block."""
        for row, table, total, ids in opened(batches):
            chars = table["chars"].cast(pa.float64()).fill_null(np.nan).to_numpy()
            codes = pc.index_in(row["queries"].values, value_set=query_ids).to_numpy()
            for part, sims, bm25 in scores.of(table, total, codes):
                for q, code in enumerate(part):
                    rrf = _fused(_ranks(sims[:, q])[1], _ranks(bm25[:, q])[1], rrf_k)
                    at, _ = _listed(rrf, chars, budget)
                    yield pa.RecordBatch.from_arrays(told(query_ids[code], row["person_id"], ids.take(pa.array(at)), rrf[at], sims[at, q]),
                                                     names=[*KEYS, "id", "evidence_rank", "rrf", "similarity"])

    def heads(k: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The first k chunks of either ranking in each block; `in_s` and `in_l` tell of which."""
            for row, table, total, ids in opened(batches):
                chars, codes = table["chars"].combine_chunks(), pc.index_in(row["queries"].values, value_set=query_ids).to_numpy()
                for part, sims, bm25 in scores.of(table, total, codes):
                    for q, code in enumerate(part):
                        s, l = (_ranks(x[:, q])[1] <= k for x in (sims, bm25))
                        at = np.flatnonzero(s | l)
                        yield pa.RecordBatch.from_arrays([
                            pa.repeat(query_ids[code], len(at)), pa.repeat(row["person_id"], len(at)), ids.take(pa.array(at)), chars.take(pa.array(at)),
                            pa.array(sims[at, q]), pa.array(bm25[at, q])], names=[*KEYS, "id", "chars", "sim", "bm25"])
        return run

    def chosen_heads(k: int) -> Callable:
        def run(table: pa.Table) -> pa.Table:
            """One row per pair: the first k chunks of either ranking among all blocks, in the order of their ids."""
            first = table.select(KEYS).slice(0, 1)
            some = table.take(pc.sort_indices(table["id"])).select(["id", "chars", "sim", "bm25"])
            s, l = (_ranks(some[c].to_numpy())[1] <= k for c in ("sim", "bm25"))
            return first.append_column("heads", pa.array([_pack(some.filter(pa.array(s | l)))], pa.binary()))
        return run

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per pair and block, how many of the block's chunks come before each candidate in either ranking (int32)."""
        for row, table, total, ids in opened(batches):
            codes = pc.index_in(row["heads"].values.field("query_id"), value_set=query_ids).to_numpy()
            own_ids = ids.to_numpy(zero_copy_only=False)
            at_of = {int(c): i for i, c in enumerate(codes)}
            for part, sims, bm25 in scores.of(table, total, codes):
                for q, code in enumerate(part):
                    some = _unpack(row["heads"].values.field("heads")[at_of[int(code)]])
                    other = some["id"].combine_chunks()
                    at = np.searchsorted(own_ids, other.to_numpy(zero_copy_only=False))
                    self_at = pc.index_in(other, value_set=ids).fill_null(-1).to_numpy()
                    n = [_before(x[:, q], some[c].to_numpy(), at, self_at).astype(np.int32).tobytes() for x, c in ((sims, "sim"), (bm25, "bm25"))]
                    yield pa.RecordBatch.from_arrays([pa.repeat(query_ids[code], 1), pa.repeat(row["person_id"], 1), pa.repeat(row["n"], 1),
                                                      *(pa.array([x], pa.binary()) for x in n)], names=[*KEYS, "n", "s", "l"])

    def settled(k: int) -> Callable:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            """The list of a pair, or one row without an id where chunks beyond the candidates could be in it."""
            some, first = _unpack(left["heads"].combine_chunks()[0]), (left["query_id"][0], left["person_id"][0])
            s, l = (1 + sum(np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in right[c]) for c in ("s", "l"))
            rrf = _fused(s, l, rrf_k)
            at, missed = _listed(rrf, some["chars"].cast(pa.float64()).fill_null(np.nan).to_numpy(), budget)
            ids = some["id"].combine_chunks()
            if missed <= 2.0 / (rrf_k + k) and len(some) < right["n"][0].as_py():
                columns = told(*first, pa.nulls(1, ids.type), np.zeros(1), np.zeros(1))
            else:
                columns = told(*first, ids.take(pa.array(at)), rrf[at], some["sim"].to_numpy()[at])
            return pa.Table.from_arrays(columns, names=[*KEYS, "id", "evidence_rank", "rrf", "similarity"])
        return run

    single = jobs(chosen.join(stats.select("person_id"), "person_id", "left_anti"))
    done = cut_lineage(single.where(F.col("stats").isNull()).mapInArrow(whole, listed))
    open_pairs = cut_lineage(chosen.join(stats.select("person_id"), "person_id", "left_semi"))
    while not open_pairs.isEmpty():
        found = jobs(open_pairs).mapInArrow(heads(head), ", ".join(f"{c} {kinds[c]}" for c in (*KEYS, "id")) + ", chars int, sim double, bm25 double")
        candidates = cut_lineage(found.groupBy(*KEYS).applyInArrow(
            chosen_heads(head), ", ".join(f"{c} {kinds[c]}" for c in KEYS) + ", heads binary"))
        bundles = candidates.groupBy("person_id").agg(F.collect_list(F.struct("query_id", "heads")).alias("heads"))
        # each bundle goes to every block of its person, so that the blocks of a person are not one task
        per = blocks.select("person_id", "block").join(bundles, "person_id").join(stats, "person_id")
        counts = blocks.join(per, ["person_id", "block"]).mapInArrow(
            before, ", ".join(f"{c} {kinds[c]}" for c in KEYS) + ", n long, s binary, l binary")
        lists = cut_lineage(candidates.groupBy(*KEYS).cogroup(counts.groupBy(*KEYS)).applyInArrow(settled(head), listed))
        done = done.unionByName(lists.where("id is not null"))
        open_pairs = cut_lineage(lists.where("id is null").select(*KEYS))
        head *= 4
    return done.withColumnRenamed("id", "chunk_id")
