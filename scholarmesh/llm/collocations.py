"""Phrase collocations per language: counts of all word phrases up to a depth by multikey three-way quicksort.

Suffix pointers are word positions; a suffix is the words from there to the end of its piece, at most `depth` of them. Words
are named by 64-bit hashes that include the language, so suffixes of all languages sort together.

1. A task sorts the suffix pointers of a bounded block by multikey three-way quicksort: a pivot at the current depth parts
   the pointers into smaller, equal and greater; the equal ones go one word deeper. The size of an equal partition is the
   number of times its phrase occurs in the block. Only distinct suffixes with their numbers leave the block, coded.
2. They are routed over the cluster by their two leading words (words by themselves, for the dictionary). Two leading words
   that a sample of rows shows to be very common are dealt out by the third word too; this balances tasks, nothing else.
3. A task sorts what it received in the same way. The weights of an equal partition add up to the count over all documents;
   partitions below the least count are abandoned at once, with everything that is deeper.

What is left, words and phrases with their counts, is small against the texts. Scores, containment and the ranking are joins
and aggregates in decimals, which are exact.

Defined cases: null texts are empty; a null language is `und`; ties of cuts go to the smaller first part, ties of rank to the
phrase in byte order; repeated rows count again; texts without words give nothing. Two words with one name stop the job (the
seed is a parameter).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmesh.functions.ranking import top_k
from scholarmesh.llm import shingles as S
from scholarmesh.llm.common import cut_lineage, table, whole_text

LEAST, DEPTH, BEST = 10, 3, 2000
SCALE, WITHIN = 1_000_000, 50
NAMING_BYTES = 256 << 10  # text that is named at once
BLOCK_WORDS = 1_500_000  # suffixes that a task sorts at once
BUCKET_WORDS = 2_000_000  # suffixes of all documents that one bucket gets on average
SAMPLE, SHARE = 0.01, 512  # rows looked at for very common leading pairs, and the share (1 in so many) that is common
CUTOFF = 1 << 14  # so few pointers are sorted outright
PIECE_ENDS = np.zeros(256, dtype=bool)
PIECE_ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
GAPS = PIECE_ENDS.copy()
GAPS[[32, 9]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CODEC = "zstd"


def language_names(langs: list[str | None], seed: int) -> np.ndarray:
    """A number for each row's language."""
    known: dict[str, int] = {}
    for lang in langs:
        name = "und" if lang is None else lang
        if name not in known:
            value = np.frombuffer(name.encode() or b"\0", np.uint8).astype(np.uint64) + np.uint64(1)
            value = S.mix((value * S.powers(len(value), S.STEP)).sum(keepdims=True) + np.uint64(seed))
            known[name] = int(S.mix(value + S.PRIME)[0])  # unlike the names of words, such as a language's own name
    return np.array([known["und" if lang is None else lang] for lang in langs], dtype=np.uint64)


def named(data: np.ndarray, offsets: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, ...]:
    """(name, start, size, row, piece) of every word of lower-cased bytes; names are odd, so never 0."""
    solid = ~GAPS[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begin[firsts] = solid[firsts]
    start = np.nonzero(begin)[0]
    if not len(start):
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4
    inside = np.nonzero(solid)[0]
    first = np.searchsorted(inside, start)
    size = np.diff(np.append(first, len(inside)))
    place = np.arange(len(inside)) - np.repeat(first, size)
    value = (data[inside].astype(np.uint64) + np.uint64(1)) * S.powers(int(size.max()))[place]
    row = np.searchsorted(offsets, start, side="right") - 1
    name = S.mix(S.mix(np.add.reduceat(value, first)) ^ salt[row]) | np.uint64(1)
    return name, start, size, row, np.cumsum(PIECE_ENDS[data])[start]


def followed(row: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Whether the next word belongs to the same piece."""
    out = np.zeros(len(row), dtype=bool)
    out[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
    return out


def suffixes(word: np.ndarray, goes_on: np.ndarray, depth: int = DEPTH) -> list[np.ndarray]:
    """Columns of the words at 0, 1, ... behind every position; 0 beyond the end of the piece."""
    out, inside = [word], np.ones(len(word), dtype=bool)
    for k in range(1, min(depth, len(word))):
        inside = inside[:-1] & goes_on[k - 1:-1]
        column = np.zeros_like(word)
        column[:-k] = np.where(inside, word[k:], word.dtype.type(0))
        out.append(column)
    return out + [np.zeros_like(word) for _ in range(depth - len(out))]


def multikey_sort(columns: list[np.ndarray], weight: np.ndarray, least: int = 1) -> tuple[list[list[tuple]], list[tuple]]:
    """(per depth, whole suffixes): lists of (pointers, one per phrase; counts) with at least `least` occurrences.

    A phrase of depth d is columns[:d + 1] at its pointer; suffixes that ended before (0) are no phrases of that depth.
    """
    found: list[list[tuple]] = [[] for _ in columns]
    whole: list[tuple] = []
    todo = [(np.arange(len(weight), dtype=np.int32), 0)]
    while todo:
        at, depth = todo.pop()
        if not len(at):
            continue
        if depth == len(columns):
            whole.append((at[:1], weight[at].sum(keepdims=True)))
        elif len(at) <= CUTOFF:
            _sorted_outright(columns, weight, at, depth, least, found, whole)
        else:
            key = columns[depth][at]
            pivot = np.sort(key[:: len(key) // 9][:9])[4]
            equal = at[key == pivot]
            todo += [(at[key < pivot], depth), (at[key > pivot], depth)]
            total = weight[equal].sum(keepdims=True)
            if total[0] >= least:
                (found[depth] if pivot else whole).append((equal[:1], total))
                if pivot:
                    todo.append((equal, depth + 1))
    return found, whole


def _sorted_outright(columns, weight, at, depth, least, found, whole) -> None:
    """The rest of the sort for few pointers."""
    order = np.lexsort([columns[d][at] for d in range(len(columns) - 1, depth - 1, -1)])
    at = at[order]
    new = np.zeros(len(at), dtype=bool)
    new[:1] = True
    for d in range(depth, len(columns)):
        key = columns[d][at]
        new[1:] |= key[1:] != key[:-1]
        first = np.nonzero(new)[0]
        total = np.add.reduceat(weight[at], first)
        keep, ended = total >= least, key[first] == 0
        for chosen, to in ((keep & ~ended, found[d]), (keep & (ended | (d + 1 == len(columns))), whole)):
            if chosen.any():
                to.append((at[first[chosen]], total[chosen]))
        stay = np.repeat(keep & ~ended, np.diff(np.append(first, len(at))))
        at, new = at[stay], new[stay]
        if not len(at):
            return


def joined(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def packed(arrays: list[np.ndarray]) -> bytes:
    """Compressed bytes of the arrays: number, then size and width of each, then all bytes."""
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), a.dtype.itemsize)]], dtype=np.int64).tobytes()
    raw = head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec(CODEC).compress(raw, asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = pa.Codec(CODEC).decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, 2 * count, 8), 8 + 16 * count, []
    for n, width in sizes.reshape(-1, 2).tolist():
        out.append(np.frombuffer(raw, np.dtype(f"u{width}"), n, at))
        at += n * width
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 2**32 else np.uint64)


def packed_suffixes(columns: list[np.ndarray], count: np.ndarray) -> bytes:
    """Names are written once each; suffixes are places in that list."""
    names, place = np.unique(np.concatenate(columns), return_inverse=True)
    return packed([names, *[_narrow(p) for p in np.split(place, len(columns))], _narrow(count)])


def packed_words(names: np.ndarray, count: np.ndarray, texts: list[bytes], langs: list[str]) -> bytes:
    known = {lang: n for n, lang in enumerate(dict.fromkeys(langs))}
    data, list_of = b"".join(texts), "\n".join(json.dumps(x) for x in known).encode()
    return packed([names, _narrow(count), _narrow(np.array([len(t) for t in texts])), np.frombuffer(data, np.uint8), _narrow(
        np.array([known[x] for x in langs])), np.frombuffer(list_of, np.uint8)])


def unpacked_words(data: bytes) -> Iterator[tuple[int, int, bytes, str]]:
    """(name, count, text, language) of every word."""
    names, count, sizes, text, lang, list_of = unpacked(data)
    langs, raw, ends = [json.loads(x) for x in list_of.tobytes().decode().split("\n")], text.tobytes(), np.cumsum(sizes.astype(np.int64)).tolist()
    for name, n, lo, hi, of in zip(names.tolist(), count.tolist(), [0, *ends[:-1]], ends, lang.tolist()):
        yield name, n, raw[lo:hi], langs[of]


def unpacked_suffixes(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    names, *places, count = unpacked(data)
    return [names[p] for p in places], count.astype(np.int64)


class _Words:
    """Distinct words of a block: name, text, row's language."""

    def __init__(self):
        self.names = np.zeros(0, np.uint64)
        self.texts: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.langs: list[str] = []
        self.order: list[np.ndarray] = []

    def add(self, data, name, start, size, row, langs) -> None:
        fresh, first = np.unique(name, return_index=True)
        new = ~np.isin(fresh, self.names, assume_unique=True)
        fresh, first = fresh[new], first[new]
        if not len(fresh):
            return
        n = size[first]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[first], n)
        self.texts.append(data[place])
        self.sizes.append(n)
        self.order.append(fresh)
        self.langs += ["und" if langs[r] is None else langs[r] for r in row[first].tolist()]
        self.names = np.sort(np.concatenate([self.names, fresh]))

    def columns(self) -> tuple[np.ndarray, list[bytes], list[str]]:
        data, ends = np.concatenate(self.texts).tobytes(), np.cumsum(np.concatenate(self.sizes)).tolist()
        return np.concatenate(self.order), [data[a:b] for a, b in zip([0, *ends[:-1]], ends)], self.langs


def _route(columns: list[np.ndarray], hot: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the two leading words; of very common ones by the third too."""
    pair = S.mix(columns[0] + S.mix(columns[1]))
    route = pair
    if len(hot) and len(columns) > 2:
        common = hot[np.minimum(np.searchsorted(hot, pair), len(hot) - 1)] == pair
        route = np.where(common, S.mix(pair + columns[2]), pair)
    return (route % np.uint64(buckets)).astype(np.int64)


ROUTED = "kind int, bucket long, part binary"
COUNTED = "kind int, lang string, word string, h array<bigint>, count long"


def routed(docs: DataFrame, buckets: int, hot: np.ndarray, depth: int = DEPTH, seed: int = 0,
           block_words: int = BLOCK_WORDS) -> DataFrame:
    """kind (0 dictionary, 1 suffixes), bucket, coded parts of every block of (lang, text)."""
    def dealt(route: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(route, kind="stable")
        firsts = np.nonzero(np.diff(route[order], prepend=-1))[0]
        for lo, hi in zip(firsts, np.append(firsts[1:], len(order))):
            yield int(route[order[lo]]), order[lo:hi]

    def parts(name: np.ndarray, goes_on: np.ndarray, words: _Words) -> Iterator[tuple]:
        names = np.concatenate([np.zeros(1, np.uint64), words.names])  # sorted; a word's place stands for it
        columns = suffixes(np.searchsorted(names, name).astype(np.int32), goes_on, depth)
        found, whole = multikey_sort(columns, np.ones(len(name), dtype=np.int32))
        at, count = joined(whole)
        own = [c[at] for c in columns]
        for bucket, part in dealt(_route([names[c] for c in own[:3]], hot, buckets)):
            yield 1, bucket, packed_suffixes([names[c[part]] for c in own], count[part])
        at, count = joined(found[0])
        learnt, texts, langs = words.columns()
        own, place = names[columns[0][at]], np.argsort(learnt)[columns[0][at] - 1]
        for bucket, part in dealt((S.mix(own) % np.uint64(buckets)).astype(np.int64)):
            yield 0, bucket, packed_words(own[part], count[part], [texts[p] for p in place[part]], [langs[p] for p in place[part]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, size = [], _Words(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = parts(*[np.concatenate(c) for c in zip(*held)], words)
            while some := list(islice(rows, 16)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), (pa.int32(), pa.int64(), pa.binary()))],
                                                 names=["kind", "bucket", "part"])

        for batch in batches:
            for lo, hi, data, offsets in S.blocks(batch.column(1), NAMING_BYTES):
                langs = batch.column(0).slice(lo, hi - lo).to_pylist()
                data = LOWER[data]
                name, start, length, row, piece = named(data, offsets, language_names(langs, seed))
                if not len(name):
                    continue
                held.append((name, followed(row, piece)))
                words.add(data, name, start, length, row, langs)
                size += len(name)
                if size >= block_words:
                    yield from flush()
                    held, words, size = [], _Words(), 0
        if held:
            yield from flush()

    return docs.select("lang", whole_text().alias("text")).mapInArrow(run, ROUTED)


def merged(parts: DataFrame, least: int = LEAST, hot: np.ndarray | None = None, pending: int = BUCKET_WORDS) -> DataFrame:
    """COUNTED rows: kind 0 words with at least `least` occurrences, 1 phrases (names h), 2 occurrences of a language (a part).

    Counts of two leading words that are dealt out by the third are parts too; they are added up later.
    """
    hot = np.zeros(0, np.uint64) if hot is None else hot
    kinds = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64()]
    names = [c.split()[0] for c in COUNTED.split(", ")]

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds)], names=names)

    def squeezed(held: list) -> list:
        """Distinct suffixes with their sums."""
        columns, count = [np.concatenate(c) for c in zip(*[h[0] for h in held])], np.concatenate([h[1] for h in held])
        order = np.lexsort(columns[::-1])
        columns, count = [c[order] for c in columns], count[order]
        new = np.ones(len(count), dtype=bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        first = np.nonzero(new)[0]
        return [([c[first] for c in columns], np.add.reduceat(count, first))]

    def phrases(held: list) -> Iterator[pa.RecordBatch]:
        columns, count = [np.concatenate(c) for c in zip(*[h[0] for h in held])], np.concatenate([h[1] for h in held])
        common = np.isin(S.mix(columns[0] + S.mix(columns[1])), hot)
        for chosen, bar in ((~common, least), (common, 1)):
            at = np.nonzero(chosen)[0]
            own = [c[at] for c in columns]
            for d, level in enumerate(multikey_sort(own, count[at], bar)[0][1:], 1):
                p, total = joined(level)
                if d > 1:
                    p, total = p[total >= least], total[total >= least]
                if len(p):
                    name = np.stack([c[p] for c in own[:d + 1]], axis=1).view(np.int64)
                    ends = np.arange(len(p) + 1, dtype=np.int32) * (d + 1)
                    yield rows(len(p), kind=pa.array(np.full(len(p), 1, np.int32)), count=pa.array(total), h=pa.ListArray.from_arrays(
                        pa.array(ends), pa.array(name.ravel())))

    def dictionary(known: dict[int, list]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = {}
        for count, _, lang in known.values():
            sums[lang] = sums.get(lang, 0) + count
        yield rows(len(sums), kind=pa.array(np.full(len(sums), 2, np.int32)), lang=pa.array(list(sums)), count=pa.array(list(sums.values())))
        kept = [(name, *of) for name, of in known.items() if of[0] >= least]
        if kept:
            name, count, texts, langs = zip(*kept)
            yield rows(len(kept), kind=pa.array(np.zeros(len(kept), np.int32)), lang=pa.array(langs), word=pa.array(
                [t.decode() for t in texts]), count=pa.array(count), h=pa.array([[n] for n in np.array(name, np.uint64).view(
                    np.int64).tolist()], pa.list_(pa.int64())))

    def learn(known: dict[int, list], part: bytes) -> None:
        for name, n, text, lang in unpacked_words(part):
            of = known.setdefault(name, [0, text, lang])
            if of[1] != text or of[2] != lang:
                raise ValueError(f"{of[1]!r} and {text!r} have one name; choose another seed")
            of[0] += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, known, size, bound = None, [], {}, 0, pending
        for batch in batches:
            for n in range(len(batch)):  # one part at a time
                kind, bucket, part = (c[n].as_py() for c in batch.columns)
                if at is not None and at != (kind, bucket):
                    yield from phrases(held) if at[0] else dictionary(known)
                    held, known, size, bound = [], {}, 0, pending
                at = (kind, bucket)
                if not kind:
                    learn(known, part)
                    continue
                held.append(unpacked_suffixes(part))
                size += len(held[-1][1])
                if size > bound:
                    held = squeezed(held)
                    size = len(held[0][1])
                    bound = max(pending, 2 * size)
        if at is not None:
            yield from phrases(held) if at[0] else dictionary(known)

    return parts.mapInArrow(run, COUNTED)


def common_pairs(docs: DataFrame, depth: int = DEPTH, seed: int = 0, sample: float = SAMPLE, share: int = SHARE) -> tuple[np.ndarray, int]:
    """(sorted names of two leading words that hold more than 1 in `share` of a sample's suffixes, words of all documents by it).

    Only how rows are dealt out depends on it. A task reports less than `share` pairs, each with a share of its rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, total = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            for lo, hi, data, offsets in S.blocks(batch.column(1), NAMING_BYTES):
                langs = batch.column(0).slice(lo, hi - lo).to_pylist()
                name, _, _, row, piece = named(LOWER[data], offsets, language_names(langs, seed))
                total += len(name)
                a, b = suffixes(name, followed(row, piece), 2)
                pairs.append(S.mix(a + S.mix(b))[b > 0])
        value, count = np.unique(np.concatenate(pairs), return_counts=True)
        keep = count * 2 * share > total
        yield pa.RecordBatch.from_arrays([pa.array(np.append(value[keep], np.uint64(0)).view(np.int64)), pa.array(
            np.append(count[keep], total))], names=["pair", "count"])

    looked = docs.sample(sample, seed).select("lang", whole_text().alias("text")).mapInArrow(run, "pair long, count long")
    sums = looked.groupBy("pair").agg(F.sum("count").alias("count"))
    total = sums.where("pair = 0").agg(F.sum("count")).first()[0] or 0
    top = sums.where((F.col("pair") != 0) & (F.col("count") * share > total)).select("pair").toPandas()["pair"]  # fewer than share
    return np.sort(top.to_numpy().astype(np.int64).view(np.uint64)), int(total / sample)


def phrase_counts(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, seed: int = 0, buckets: int | None = None,
                  hot: np.ndarray | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: h, lang, word, f), (phrases: h array, f), (languages: lang, n) of (lang, text); checkpointed."""
    if buckets is None or hot is None:
        hot, total = common_pairs(docs, depth, seed)
        buckets = max(2 * docs.sparkSession.sparkContext.defaultParallelism, total // BUCKET_WORDS + 1)
    parts = routed(docs, buckets, hot, depth, seed)
    found = cut_lineage(merged(parts.repartition(buckets, "kind", "bucket").sortWithinPartitions("kind", "bucket"), least, hot))
    words = found.where("kind = 0").select(F.col("h")[0].alias("h"), "lang", "word", F.col("count").alias("f"))
    phrases = found.where("kind = 1").groupBy("h").agg(F.sum("count").alias("f")).where(F.col("f") >= least)
    return words, phrases, found.where("kind = 2").groupBy("lang").agg(F.sum("count").alias("n"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)), in whole numbers of up to 38 digits."""
    a, left, right = (x.cast("decimal(18,0)") for x in (a, left, right))
    return F.call_function("div", a * a * F.lit(SCALE).cast("decimal(10,0)"), left * right)


def collocations(docs: DataFrame, least: int = LEAST, best: int | None = BEST, seed: int = 0, buckets: int | None = None,
                 hot: np.ndarray | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `best` (None: all) phrases of 2 or 3 words of every language.

    docs: lang, text.
    """
    words, phrases, languages = phrase_counts(docs, least, 3, seed, buckets, hot)
    phrases = cut_lineage(phrases.select(*[F.get("h", F.lit(k)).alias(f"h{k + 1}") for k in range(3)], "f"))
    pairs, triples = phrases.where("h3 is null").drop("h3"), phrases.where("h3 is not null")
    longer = triples.select("h1", "h2", "f").unionByName(triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "f")).groupBy(
        "h1", "h2").agg(F.max("f").alias("longer"))
    kept = pairs.join(longer, ["h1", "h2"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < WITHIN * F.col("f"))).drop("longer")
    head = pairs.select("h1", "h2", F.col("f").alias("f12"))
    tail = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("f").alias("f23"))
    wide = kept.select("h1", "h2", F.lit(None).cast("long").alias("h3"), "f", F.lit(None).cast("long").alias("f12"), F.lit(None).cast(
        "long").alias("f23")).unionByName(triples.join(head, ["h1", "h2"]).join(tail, ["h2", "h3"]).select(
            "h1", "h2", "h3", "f", "f12", "f23"))
    one = words.select(F.col("h").alias("h1"), "lang", F.col("word").alias("w1"), F.col("f").alias("f1"))
    last = F.coalesce("h3", "h2")  # the last word of the phrase
    three = words.select(F.col("h").alias("last"), F.col("word").alias("w_last"), F.col("f").alias("f_last"))
    middle = words.select(F.col("h").alias("h2"), F.col("word").alias("w2"))
    told = wide.join(one, "h1").withColumn("last", last).join(three, "last").join(middle, "h2")
    first = F.struct(_score(F.col("f"), F.col("f1"), F.coalesce("f23", "f_last")).alias("score"), F.lit(1).alias("k"),
                     F.col("f1").alias("l"), F.coalesce("f23", "f_last").alias("r"))
    second = F.when(F.col("h3").isNotNull(), F.struct(
        _score(F.col("f"), F.col("f12"), F.col("f_last")).alias("score"), F.lit(2).alias("k"), F.col("f12").alias("l"),
        F.col("f_last").alias("r")))
    scored = told.select("lang", F.concat_ws(" ", "w1", "w2", F.when(F.col("h3").isNotNull(), F.col("w_last"))).alias("phrase"),
                         F.col("f").alias("a"), F.least(first, second).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    ranked = top_k(scored, ["lang"], order, 2**31 - 1 if best is None else best)
    return ranked.join(languages, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
