"""Lexical, vector and hybrid retrieval for many queries over many chunks.

Relations: chunk(chunk_id, person_id, section, content, ...), vector(chunk_id, embedding),
query(query_id, keywords string, vector array). Ranks inside a fusion are 0-based.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarmesh.functions.ranking import bounded_join, is_small, running_total, top_k
from scholarmesh.functions.text import tokenize
from scholarmesh.session import cut_lineage

BM25_TOP_K = 50
SEMANTIC_TOP_K = 50
RRF_K = 60
EVIDENCE_BUDGET = 24_000
SCORE_DIGITS = 6  # scores equal to this many digits count as ties, broken by id
K1, B = 1.5, 0.75
QUERY_BLOCK = 2048
VECTOR_BLOCK = 8192
WEIGHT_CELLS = 4 << 20  # terms x queries up to which BM25 is a product with a matrix of weights (32 MB)
GAIN_CELLS = 1 << 20  # chunks x terms multiplied at once (8 MB)
NO_VECTOR = -2.0  # below any cosine
CORPUS = ""  # pseudo term: one posting per chunk, so that chunk counts and lengths need no second pass


# --- lexical -----------------------------------------------------------------------------

def query_terms(queries: DataFrame, text: str = "keywords", tokenizer: Callable[[Column], Column] = tokenize,
                keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(query, term, qtf): repeated query terms count repeatedly."""
    return (queries.select(*keys, F.explode(tokenizer(F.col(text))).alias("term"))
            .groupBy(*keys, "term").agg(F.count("*").alias("qtf")))


def bm25_scores(chunks: DataFrame, terms: DataFrame, scope: tuple[str, ...] = (), id_col: str = "chunk_id",
                content: str = "content", tokenizer: Callable[[Column], Column] = tokenize) -> DataFrame:
    """Positive BM25 scores (query_id, *scope, chunk, bm25).

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)), k1 = 1.5, b = 0.75. With `scope` (person_id) the statistics N, df
    and the mean length are those of the scope, and `terms` carries the scope columns.

    Only tokens that occur in a query are shuffled, once, by chunk; term frequencies and scores are then
    aggregated where the chunk's postings already are, so a hot term or a hot person is never one task.
    """
    scope = list(scope)
    small = is_small(terms)
    vocabulary = terms.select("term").distinct()
    corpus_row = chunks.sparkSession.range(1).select(F.lit(CORPUS).alias("term"))
    vocabulary = vocabulary.unionByName(corpus_row)
    tokens = chunks.select(id_col, *scope, tokenizer(F.col(content)).alias("_tokens"))
    tokens = tokens.select(id_col, *scope, F.size("_tokens").alias("_len"),
                           F.explode(F.concat(F.array(F.lit(CORPUS)), "_tokens")).alias("term"))
    matched = bounded_join(tokens, vocabulary, ["term"], [id_col], small_enough=small)
    postings = (matched.repartition(id_col)
                .groupBy(id_col, *scope, "_len", "term").agg(F.count("*").alias("_tf")))

    by_term = postings.groupBy(*scope, "term").agg(F.count("*").alias("_df"), F.sum("_len").alias("_total"))
    return score_postings(postings, by_term, terms, tuple(scope), id_col, small)


def score_postings(postings: DataFrame, by_term: DataFrame, terms: DataFrame, scope: tuple[str, ...], id_col: str,
                   small: bool) -> DataFrame:
    """BM25 of postings (chunk, *scope, term, _tf, _len) with counts by term (*scope, term, _df, _total).

    The pseudo term's counts are the number of chunks and their total length.
    """
    corpus = F.col("term") == CORPUS
    totals = [F.max(F.when(corpus, F.col("_df"))).alias("_n"), F.max(F.when(corpus, F.col("_total"))).alias("_sum")]
    if scope:
        stats = by_term.groupBy(*scope).agg(*totals)
        weights = terms.join(by_term, [*scope, "term"]).join(stats, [*scope])
    else:
        one = by_term.agg(F.struct(*totals))
        weights = (terms.join(by_term, "term").withColumn("_s", one.scalar())
                   .withColumns({"_n": F.col("_s._n"), "_sum": F.col("_s._sum")}))
    weights = weights.select("query_id", *scope, "term", (F.col("_sum") / F.col("_n")).alias("_avg"), (
        F.col("qtf") * F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))).alias("_w"))

    gain = F.col("_tf") * (K1 + 1) / (F.col("_tf") + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return (bounded_join(postings, weights, [*scope, "term"], [id_col], small_enough=small)
            .groupBy("query_id", *scope, id_col)
            .agg(F.round(F.sum(F.col("_w") * gain), SCORE_DIGITS).alias("bm25"))
            .where(F.col("bm25") > 0))


def term_counts(tokens: pa.ListArray, known: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Per text, as int32, the places in `known` and the counts of its terms."""
    n_terms, sizes = max(1, len(known)), tokens.value_lengths().fill_null(0).to_numpy()
    code = pc.index_in(tokens.flatten(), value_set=known).fill_null(-1).to_numpy()
    place = (np.repeat(np.arange(len(tokens)), sizes) * n_terms + code)[code >= 0]
    place, count = np.unique(place, return_counts=True)
    ends = pa.py_buffer((4 * np.searchsorted(place, np.arange(len(tokens) + 1) * n_terms)).astype(np.int32))
    return tuple(pa.Array.from_buffers(pa.binary(), len(tokens), [None, ends, pa.py_buffer(x.astype(np.int32))])
                 for x in (place % n_terms, count))


def packed_postings(chunks: DataFrame, vocabulary: list[str], id_col: str, content: str,
                    tokenizer: Callable[[Column], Column]) -> DataFrame:
    """One row (id, parts) per chunk; a part has the length and, as int32, the places in `vocabulary` and the counts of the terms.

    Terms are counted in the task that reads the text, so no occurrence is shuffled. Rows of one id come together.
    """
    known = pa.array(vocabulary, pa.string())
    tokens = chunks.select(F.col(id_col).alias("id"), tokenizer(F.col(content)).alias("t")).where("t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.cast(batch.column(1).value_lengths(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), lengths, *term_counts(batch.column(1), known)],
                                             names=["id", "len", "terms", "counts"])

    id_type = tokens.schema["id"].dataType.simpleString()
    return tokens.mapInArrow(run, f"id {id_type}, len long, terms binary, counts binary").groupBy("id").agg(
        F.collect_list(F.struct("len", "terms", "counts")).alias("parts"))


def _unpacked(parts: pa.ListArray) -> tuple[np.ndarray, ...]:
    """(row, length) of every text and (text, term, count) of its postings; texts of one row and length are one text."""
    flat, row = parts.flatten(), np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy())
    length, terms, counts = (flat.field(n) for n in range(3))
    size = pc.binary_length(terms).to_numpy() // 4
    text = np.repeat(np.arange(len(flat)), size)
    term, count = (np.frombuffer(b"".join(x.to_pylist()), np.int32) for x in (terms, counts))
    length = length.to_numpy()
    if len(row) > len(parts):
        pairs, text_of = np.unique(np.stack([row, length], axis=1), axis=0, return_inverse=True)
        row, length, text = pairs[:, 0], pairs[:, 1], text_of.ravel()[text]
        pairs, at = np.unique(np.stack([text, term], axis=1), axis=0, return_inverse=True)
        text, term, count = pairs[:, 0], pairs[:, 1], np.bincount(at.ravel(), count, len(pairs))
    return row, length, text, term, count


def _collection(packed: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """(texts with each term, texts, total length); one row per task and term is summed up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 2, dtype=np.int64)
        for batch in batches:
            _, length, _, term, _ = _unpacked(batch.column(0))
            total += np.concatenate([np.bincount(term, minlength=n_terms), [len(length), length.sum()]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_terms + 2)), pa.array(total)], names=["at", "n"])

    rows = packed.select("parts").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(n_terms + 2, dtype=np.int64)
    total[rows["at"]] = rows["n"]
    return total[:-2], int(total[-2]), int(total[-1])


def _weights(terms: pd.DataFrame, df: np.ndarray, n: int) -> np.ndarray:
    """(term, query) matrix of qtf * idf; the columns `q` and `t` of `terms` are their places."""
    out = np.zeros((len(df), int(terms["q"].max()) + 1 if len(terms) else 0))
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    out[terms["t"], terms["q"]] = terms["qtf"] * idf[terms["t"]]
    return out


def _gains(rows: int, row: np.ndarray, term: np.ndarray, count: np.ndarray, length: np.ndarray, n_terms: int, average: float) -> np.ndarray:
    gain = count * (K1 + 1) / (count + K1 * (1 - B + B * length / average))
    return np.bincount(row * n_terms + term, gain, rows * n_terms).reshape(rows, n_terms)


def small_terms(terms: DataFrame) -> tuple[pd.DataFrame, list[str]] | None:
    """Terms (query_id, term, qtf; a checkpointed table) with their places `t` and `q`, and the distinct terms, if they fit a
    matrix of WEIGHT_CELLS (counted)."""
    n_terms, n_queries, missing = terms.agg(F.countDistinct("term"), F.countDistinct("query_id"), F.count_if(
        F.col("query_id").isNull())).first()
    if missing or not 0 < n_terms * n_queries <= WEIGHT_CELLS:
        return None
    found = terms.toPandas()
    found["t"], vocabulary = pd.factorize(found["term"])
    found["q"] = pd.factorize(found["query_id"])[0]
    return found, list(vocabulary)


def best_of_packed(packed: DataFrame, found: pd.DataFrame, query_type: str, df: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """Best k (query_id, id, bm25) per query and task of packed postings (id, parts); found: terms with places.

    df: texts with each term; n, total: texts and their length.
    """
    query_ids, n_terms = found["query_id"].unique(), len(df)
    weights, average = _weights(found, df, n), max(total, 1) / max(n, 1)
    step = max(1, GAIN_CELLS // n_terms)
    id_type = packed.schema["id"].dataType.simpleString()

    def result(query, ids: pa.Array, scores) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(query), ids, pa.array(scores, pa.float64())], names=["query_id", "id", "bm25"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = id_arrow = None
        for whole in batches:
            id_arrow = whole.schema.field(0).type
            for batch in (whole.slice(at, step) for at in range(0, len(whole), step)):
                row, length, text, term, count = _unpacked(batch.column(1))
                scores = np.round(_gains(len(batch), row[text], term, count, length[text], n_terms, average) @ weights, SCORE_DIGITS)
                named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                for text_scores in scores[~named]:  # all rows without an id are one
                    at = np.nonzero(text_scores > 0)[0]
                    yield result(query_ids[at], pa.nulls(len(at), id_arrow), text_scores[at])
                if named.any():
                    some = _best(query_ids, batch.column(0).drop_null().to_numpy(zero_copy_only=False), scores[named], k)
                    best = _better(best, some[some["similarity"] > 0], k)
        if best is not None:
            yield result(best["query_id"], pa.array(best["id"], id_arrow), best["similarity"])

    return packed.mapInArrow(search, f"query_id {query_type}, id {id_type}, bm25 double")


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int = BM25_TOP_K, include_zero: bool = False,
              id_col: str = "chunk_id", content: str = "content", text: str = "keywords",
              tokenizer: Callable[[Column], Column] = tokenize) -> DataFrame:
    """Best k chunks per query by BM25 (ties by id): (query_id, chunk, bm25, rank from 1).

    With `include_zero`, queries with fewer than k matches are filled with other chunks in id order, score 0.

    Up to WEIGHT_CELLS (counted) the query weights are shipped as a matrix of terms and queries: a task multiplies blocks of its
    chunks with it and keeps k rows per query, so no row per chunk and query is made. Beyond that chunks and terms are joined.
    """
    terms = cut_lineage(query_terms(queries, text, tokenizer))
    if (asked := small_terms(terms)) is not None:
        packed = cut_lineage(packed_postings(chunks, asked[1], id_col, content, tokenizer))
        scores = best_of_packed(packed, asked[0], terms.schema["query_id"].dataType.simpleString(), *_collection(
            packed, len(asked[1])), k).withColumnRenamed("id", id_col)
    else:
        scores = bm25_scores(chunks, terms, (), id_col, content, tokenizer)
    best = top_k(scores, ["query_id"], [F.desc("bm25"), F.asc(id_col)], k)
    if asked is not None:
        best = cut_lineage(best)  # k rows per query, read by several steps
    if not include_zero:
        return best
    # fewer than k matches: the missing ones are among the 2k smallest ids
    first_ids = chunks.select(id_col).orderBy(id_col).limit(2 * k).agg(F.collect_list(id_col))
    filler = (queries.select("query_id", F.explode(first_ids.scalar()).alias(id_col))
              .join(best, ["query_id", id_col], "left_anti")
              .select("query_id", id_col, F.lit(0.0).alias("bm25")))
    both = best.drop("rank").unionByName(filler)
    return top_k(both, ["query_id"], [F.desc("bm25"), F.asc(id_col)], k)


# --- vectors -------------------------------------------------------------------------------

def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1, norm)


def _matrix(column: pd.Series) -> np.ndarray:
    return _unit(np.stack(column.to_numpy()).astype(np.float64))


def _first(column: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each column number, ties by id; best first."""
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], -sims, column))
    starts = np.searchsorted(column[order], column[order])
    return order[np.arange(len(order)) - starts < k]


def _best(query_ids: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> pd.DataFrame:
    """Per query (column of sims) the k best rows, ties at the k-th place by id."""
    keep = np.ones(sims.shape, dtype=bool)
    if len(sims) > k:
        keep = sims >= np.partition(sims, len(sims) - k, axis=0)[len(sims) - k]
    row, column = np.nonzero(keep)
    at = _first(column, ids[row], sims[row, column], k)
    return pd.DataFrame({"query_id": query_ids[column[at]], "id": ids[row[at]], "similarity": sims[row[at], column[at]]})


def _better(best: pd.DataFrame | None, found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows per query of both."""
    if best is None:
        return found
    both = pd.concat([best, found], ignore_index=True)
    return both.iloc[_first(pd.factorize(both["query_id"])[0], both["id"].to_numpy(), both["similarity"].to_numpy(), k)]


def knn_exact(vectors: DataFrame, queries: DataFrame, k: int = SEMANTIC_TOP_K, id_col: str = "chunk_id",
              embedding: str = "embedding", query_vector: str = "vector",
              max_queries: int = QUERY_BLOCK) -> DataFrame:
    """Best k vectors per query by cosine similarity: (query_id, id, similarity, distance, rank from 1).

    Vectors stay where they are: each task multiplies its Arrow batches by the query matrix and keeps k rows per
    query, so that only those are shuffled. The matrix is shipped only up to `max_queries` rows (counted); beyond
    that queries and vectors are cut into blocks that meet in a cogroup, still without emitting all pairs.
    """
    q = queries.select("query_id", F.col(query_vector).alias("_q"))
    v = vectors.select(F.col(id_col).alias("id"), F.col(embedding).alias("_v"))
    q_type = q.schema["query_id"].dataType.simpleString()
    id_type = v.schema["id"].dataType.simpleString()
    schema = f"query_id {q_type}, id {id_type}, similarity double"
    if is_small(q, max_queries):
        rows = q.toPandas()
        if rows.empty:
            partial = q.sparkSession.createDataFrame([], schema)
        else:
            matrix, query_ids = _matrix(rows["_q"]), rows["query_id"].to_numpy()

            def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                best = None
                for batch in batches:
                    if batch.empty:
                        continue
                    sims = np.round(_matrix(batch["_v"]) @ matrix.T, 12)
                    found = _best(query_ids, batch["id"].to_numpy(), sims, k)
                    best = _better(best, found, k)
                if best is not None:
                    yield best

            partial = v.mapInPandas(search, schema)
    else:
        partial = _knn_blocks(v, q, k, schema, max_queries)
    ranked = top_k(partial, ["query_id"], [F.desc("similarity"), F.asc("id")], k)
    return ranked.select("query_id", F.col("id").alias(id_col), "similarity",
                         (1 - F.col("similarity")).alias("distance"), "rank")


def _knn_blocks(v: DataFrame, q: DataFrame, k: int, schema: str, block: int) -> DataFrame:
    """Block-wise search: query block i meets vector block j in one task; a task keeps k rows per query."""
    n_q = max(1, -(-q.count() // block))
    n_v = max(1, -(-v.count() // VECTOR_BLOCK))
    qs = (q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q)))
          .withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1)).cast("array<bigint>"))))
    vs = (v.withColumn("vb", F.pmod(F.xxhash64("id"), F.lit(n_v)))
          .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)).cast("array<bigint>"))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        sims = np.round(_matrix(right["_v"]) @ _matrix(left["_q"]).T, 12)
        return _best(left["query_id"].to_numpy(), right["id"].to_numpy(), sims, k)

    return qs.groupBy("qb", "vb").cogroup(vs.groupBy("qb", "vb")).applyInPandas(meet, schema)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double, inside the JVM; for chosen pairs only."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def knn_approx(vectors: DataFrame, queries: DataFrame, k: int = SEMANTIC_TOP_K, cells: int = 16, probes: int = 4,
               seed: int = 7, id_col: str = "chunk_id", embedding: str = "embedding",
               query_vector: str = "vector") -> DataFrame:
    """Approximate search: k-means cells, each query looks into its `probes` nearest cells only.

    Vectors are assigned to one cell, queries to `probes`; they meet in an equi-join on the cell, which is salted
    so that a large cell is spread over tasks. Exact similarities rank what was found.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = vectors.select(F.col(id_col).alias("id"), F.col(embedding).cast("array<double>").alias("_v"))
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="_x", predictionCol="cell").fit(
        unit.select(array_to_vector("_v").alias("_x")))
    centres = [list(map(float, c)) for c in model.clusterCenters()]  # `cells` rows, a parameter
    placed = model.transform(unit.withColumn("_x", array_to_vector("_v"))).select("id", "_v", "cell")
    table = queries.sparkSession.createDataFrame(list(enumerate(centres)), "cell int, _c array<double>")
    near = top_k(
        queries.select("query_id", F.col(query_vector).cast("array<double>").alias("_q"),
                       F.explode(table.agg(F.collect_list(F.struct("cell", "_c"))).scalar()).alias("c"))
        .select("query_id", "_q", "c.cell", cosine(F.col("_q"), F.col("c._c")).alias("_near")),
        ["query_id"], [F.desc("_near"), F.asc("cell")], probes).select("query_id", "_q", "cell")
    found = bounded_join(placed, near, ["cell"], ["id"]).select(
        "query_id", "id", F.round(cosine(F.col("_q"), F.col("_v")), 12).alias("similarity"))
    ranked = top_k(found, ["query_id"], [F.desc("similarity"), F.asc("id")], k)
    return ranked.select("query_id", F.col("id").alias(id_col), "similarity",
                         (1 - F.col("similarity")).alias("distance"), "rank")


def profile_vectors(vectors: DataFrame, key: str = "person_id", embedding: str = "embedding") -> DataFrame:
    """Mean vector per key; a partial sum per task and dimension, so no key is gathered in one task."""
    parts = vectors.select(key, F.posexplode(embedding).alias("_dim", "_x"))
    means = parts.groupBy(key, "_dim").agg(F.avg(F.col("_x").cast("double")).alias("_mean"))
    ordered = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_dim", "_mean"))).alias("_m"))
    return ordered.select(key, F.col("_m._mean").alias("embedding"))


def profile_ranking(profiles: DataFrame, queries: DataFrame, limit: int | None, also: DataFrame | None = None) -> DataFrame:
    """(query_id, person_id, similarity, profile_rank from 0) by cosine similarity.

    The best `limit` profiles of each query, and with `also` (query_id, person_id) those persons too, with their rank
    among all profiles. Without a limit all profiles are ranked.
    """
    k = profiles.count() if limit is None else limit
    best = knn_exact(profiles, queries, max(k, 1), id_col="person_id").select(
        "query_id", "person_id", "similarity", (F.col("rank") - 1).alias("profile_rank"))
    if also is None or limit is None:
        return best
    rest = cut_lineage(also.select("query_id", "person_id").distinct().join(best, ["query_id", "person_id"], "left_anti"))
    return best.unionByName(exact_ranks(profiles, queries, rest))


def _before(code: np.ndarray, own: np.ndarray, person: np.ndarray, matrix: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """How many of the profiles (ids, vectors) come before each pair (query row `code` of the matrix, own similarity, person).

    Pairs are the edges of a histogram per query; a profile falls between two edges once, only equal similarities are
    looked at one by one.
    """
    out, sims = np.zeros(len(code), dtype=np.int64), np.round(vectors @ matrix.T, 12)
    order = np.lexsort((own, code))
    edges = np.searchsorted(code[order], np.arange(len(matrix) + 1))
    for q in range(len(matrix)):
        at = order[edges[q]:edges[q + 1]]
        if not len(at):
            continue
        low, high = (np.searchsorted(own[at], sims[:, q], side) for side in ("left", "right"))
        out[at] += np.cumsum(np.bincount(low, minlength=len(at) + 1)[::-1])[::-1][1:]  # edges below a profile
        for row in np.flatnonzero(high > low):
            equal = at[low[row]:high[row]]
            out[equal] += ids[row] < person[equal]
    return out


def exact_ranks(profiles: DataFrame, queries: DataFrame, pairs: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """Ranks of chosen (query_id, person_id) pairs among all profiles: (query_id, person_id, similarity, profile_rank).

    One pass: profiles fall into a histogram per query whose edges are the pairs' own similarities. Few pairs (counted) are
    shipped to the profiles, which stay where they are; beyond that blocks of pairs meet blocks of profiles in a cogroup.
    One count per block, or task, and pair is shuffled.
    """
    vector = profiles.select("person_id", F.col("embedding").alias("_v"))
    asked = cut_lineage(pairs.join(queries.select("query_id", F.col("vector").alias("_q")), "query_id").join(
        vector, "person_id").select("query_id", "person_id", "_q", F.round(cosine(F.col("_v"), F.col("_q")), 12).alias("similarity")))
    numbered = asked.withColumn("_n", F.monotonically_increasing_id())  # of checkpointed rows
    schema, total = "_n long, _before long", numbered.count()
    if total <= 8 * block and is_small(asked.select("query_id").distinct(), block):
        rows, vectors = numbered.drop("_q").toPandas(), numbered.groupBy("query_id").agg(F.first("_q").alias("_q")).toPandas()
        matrix = _matrix(vectors["_q"]) if len(vectors) else np.zeros((0, 1))
        code = vectors.reset_index().set_index("query_id")["index"].reindex(rows["query_id"]).to_numpy()
        own, person, n = rows["similarity"].to_numpy(), rows["person_id"].to_numpy(), rows["_n"].to_numpy()

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            before = np.zeros(len(own), dtype=np.int64)
            for batch in batches:
                if len(batch) and len(own):
                    before += _before(code, own, person, matrix, batch["person_id"].to_numpy(), _matrix(batch["_v"]))
            yield pd.DataFrame({"_n": n, "_before": before})

        counted = vector.mapInPandas(count, schema)
    else:
        n_p, n_v = max(1, -(-total // block)), max(1, -(-vector.count() // VECTOR_BLOCK))
        left = numbered.withColumn("pb", F.pmod(F.xxhash64("query_id", "person_id"), F.lit(n_p))).withColumn(
            "vb", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1)).cast("array<bigint>")))
        right = vector.withColumn("vb", F.pmod(F.xxhash64("person_id"), F.lit(n_v))).withColumn(
            "pb", F.explode(F.sequence(F.lit(0), F.lit(n_p - 1)).cast("array<bigint>")))

        def meet(some: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            if some.empty or known.empty:
                return pd.DataFrame({"_n": [], "_before": []})
            code, first = pd.factorize(some["query_id"])[0], ~some["query_id"].duplicated()
            return pd.DataFrame({"_n": some["_n"], "_before": _before(
                code, some["similarity"].to_numpy(), some["person_id"].to_numpy(), _matrix(some["_q"][first]),
                known["person_id"].to_numpy(), _matrix(known["_v"]))})

        counted = left.groupBy("pb", "vb").cogroup(right.groupBy("pb", "vb")).applyInPandas(meet, schema)
    sums = counted.groupBy("_n").agg(F.sum("_before").alias("_before"))
    return numbered.join(sums, "_n").select("query_id", "person_id", "similarity", F.col("_before").cast("int").alias("profile_rank"))


# --- fusion -----------------------------------------------------------------------------------

def rrf_fuse(*lists: DataFrame, id_col: str = "chunk_id", rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, id, rank0): sum of 1 / (rrf_k + rank0) per id."""
    union = lists[0].select("query_id", id_col, "rank0")
    for other in lists[1:]:
        union = union.unionByName(other.select("query_id", id_col, "rank0"))
    return union.groupBy("query_id", id_col).agg(F.sum(1.0 / (F.lit(float(rrf_k)) + F.col("rank0"))).alias("rrf"))


def union_hits(first: DataFrame, second: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Union of two hit lists keyed by (query_id, id); the second list's row wins."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    rest = [c for c in first.columns if c not in ("query_id", id_col)]
    return (both.groupBy("query_id", id_col)
            .agg(F.max_by(F.struct(*rest), "_p").alias("_r")).select("query_id", id_col, "_r.*"))


def _zero_based(ranked: DataFrame, id_col: str) -> DataFrame:
    return ranked.select("query_id", id_col, (F.col("rank") - 1).alias("rank0"))


def hybrid_chunk_search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, use_semantic: bool = True,
                        use_bm25: bool = True, k_bm25: int = BM25_TOP_K, k_semantic: int = SEMANTIC_TOP_K,
                        with_content: bool = True) -> DataFrame:
    """Semantic and BM25 lists fused: (query_id, chunk_id, person_id, section[, content], rrf).

    Text is not carried through the rankings; it is joined to the few hits at the end.
    """
    legs = []
    if use_semantic:
        legs.append(_zero_based(knn_exact(vectors, queries, k_semantic), "chunk_id"))
    if use_bm25:
        legs.append(_zero_based(bm25_topk(chunks, queries, k_bm25), "chunk_id"))
    fused = rrf_fuse(*legs)
    columns = ["chunk_id", "person_id", "section", *(["content"] if with_content else [])]
    return attach(chunks.select(*columns), fused, "chunk_id")


def attach(table: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Columns of a large table for a few hits: the hits are broadcast when counted to be few."""
    return bounded_join(table, hits, [key], [key])


# --- evidence -----------------------------------------------------------------------------------

def person_evidence(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, chosen: DataFrame,
                    budget: int = EVIDENCE_BUDGET, rrf_k: int = RRF_K,
                    tokenizer: Callable[[Column], Column] = tokenize) -> DataFrame:
    """Own chunks of the chosen persons per query, best first, while their total length fits the budget.

    `chosen` is (query_id, person_id). Both rankings (cosine; BM25 with the person's own statistics) cover all
    chunks of the person; those without a vector follow the others in the order of their ids and have similarity 0.
    The list stops at the first chunk that does not fit.

    Few queries (counted) are ranked in blocks of a person's chunks (`own_evidence`), beyond that by joins.
    """
    from scholarmesh.operators import own_evidence as O

    chosen = cut_lineage(chosen.select("query_id", "person_id").distinct().where("person_id is not null").join(
        queries.select("query_id").distinct(), "query_id"))
    wanted = queries.join(chosen.select("query_id").distinct(), "query_id", "left_semi")
    terms = cut_lineage(query_terms(wanted, tokenizer=tokenizer))
    if is_small(wanted, QUERY_BLOCK) and (asked := small_terms(terms)) is not None:
        hits = cut_lineage(O.evidence_hits(chunks, vectors, wanted, chosen, *asked, budget, rrf_k, tokenizer))
    else:
        hits = evidence_by_joins(chunks, vectors, queries, chosen, budget, rrf_k, tokenizer)
    return attach(chunks.select("chunk_id", "section", "content"), hits, "chunk_id")


def evidence_by_joins(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, chosen: DataFrame, budget: int, rrf_k: int,
                      tokenizer: Callable[[Column], Column]) -> DataFrame:
    """(query_id, person_id, chunk_id, evidence_rank, rrf, similarity) of the listed chunks, by a row per pair and own chunk.

    Ranks come from bucketed running counts, so a person with very many chunks is not one task.
    """
    small = is_small(chosen)
    q = queries.select("query_id", F.col("vector").alias("_q"))
    owned = chunks.select("chunk_id", "person_id", F.length("content").alias("_chars")).join(
        vectors.select("chunk_id", "embedding"), "chunk_id", "left")
    pairs = bounded_join(owned, chosen.join(q, "query_id"), ["person_id"], ["chunk_id"], small_enough=small).select(
        "query_id", "person_id", "chunk_id", "_chars",
        F.coalesce(F.round(cosine(F.col("embedding"), F.col("_q")), 12), F.lit(NO_VECTOR)).alias("_order"))
    own_terms = query_terms(queries, tokenizer=tokenizer).join(chosen, "query_id")
    lexical = bm25_scores(chunks, own_terms, ("person_id",), tokenizer=tokenizer)
    keys = ["query_id", "person_id"]
    scored = pairs.join(lexical, [*keys, "chunk_id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    scored = cut_lineage(scored)  # narrow rows, read once for the ranks and once for each ranking's bucket totals

    # chunks without a vector tie behind the others; their buckets are leading parts of the id, as in the lexical list
    unknown = id_bucket(F.col("chunk_id"), scored.schema["chunk_id"].dataType.typeName(), F.col("_order") == NO_VECTOR)
    semantic_bucket = F.struct((-F.floor(F.col("_order") * 256)).alias("a"), unknown.alias("b"))
    # chunks without a match tie at 0 and follow in id order; their buckets are leading parts of the id
    tie = id_bucket(F.col("chunk_id"), scored.schema["chunk_id"].dataType.typeName(), F.col("bm25") == 0)
    lexical_bucket = F.struct((-F.ceil(F.col("bm25") * 4)).alias("a"), tie.alias("b"))
    both = running_total(scored, keys, [F.desc("_order"), F.asc("chunk_id")], semantic_bucket, name="_s")
    both = running_total(both, keys, [F.desc("bm25"), F.asc("chunk_id")], lexical_bucket, name="_l", totals_from=scored)
    both = both.withColumn("similarity", F.when(F.col("_order") == NO_VECTOR, 0.0).otherwise(F.col("_order"))).drop("_order")
    fused = both.withColumn("rrf", 1.0 / (rrf_k - 1 + F.col("_s")) + 1.0 / (rrf_k - 1 + F.col("_l")))

    # chunks of no characters are listed too; of the others, only the first `budget` + 1 can fit
    blank = F.col("_chars") == 0
    filled = top_k(fused.where(~blank), keys, [F.desc("rrf"), F.asc("chunk_id")], budget + 1, "_r").drop("_r")
    candidates = running_total(filled.unionByName(fused.where(blank)), keys, [F.desc("rrf"), F.asc("chunk_id")],
                               -F.floor(F.col("rrf") * (1 << 16)), name="_r")
    candidates = cut_lineage(candidates)
    listed = running_total(candidates, keys, [F.asc("_r")], F.floor(F.col("_r") / 1024), F.col("_chars"), "_used")
    return cut_lineage(listed.where(F.col("_used") <= budget).select(
        *keys, "chunk_id", F.col("_r").alias("evidence_rank"), "rrf", "similarity"))


def id_bucket(id_: Column, type_name: str, applies: Column) -> Column:
    """Order-preserving bucket of an id: numeric ids by thousands, text ids by their first three characters."""
    if type_name in ("string", "varchar", "char"):
        return F.when(applies, F.left(id_, F.lit(3))).otherwise(F.lit(""))
    return F.when(applies, F.floor(id_ / 1024)).otherwise(F.lit(-1).cast("bigint"))


# --- corpus signature -----------------------------------------------------------------------------

def index_signature(chunks: DataFrame, id_col: str = "chunk_id", content: str = "content") -> DataFrame:
    """One row (n_chunks, signature) that changes when any chunk changes; no sort, no gathering.

    The 128-bit md5 of each (id, content) is added up in two halves, which no order can change.
    """
    return signature_of(chunks.select(id_col, F.md5(content).alias("hash")), id_col)


def signature_of(hashes: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """The signature of rows (id, hash)."""
    digest = F.md5(F.concat_ws("\x1f", F.col(id_col).cast("string"), "hash"))

    def half(start: int) -> Column:
        return F.sum(F.conv(F.substring(digest, start, 12), 16, 10).cast("decimal(20,0)"))

    return hashes.agg(F.count("*").alias("n_chunks"), F.concat_ws(
        ":", F.count("*").cast("string"), F.coalesce(half(1), F.lit(0)).cast("string"),
        F.coalesce(half(13), F.lit(0)).cast("string")).alias("signature"))
