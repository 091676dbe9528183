"""Collocations against counting in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from scholarmesh.llm import collocations as C


def brute(rows, least=10, best=2000):
    """(lang, rank, phrase, a, l, r, n, score) of rows (lang, text)."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang, f = lang or "und", counts.setdefault(lang or "und", Counter())
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[tuple(words[i:i + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = [p for p, a in f.items() if len(p) > 1 and a >= least]
        longest = Counter()
        for p in candidates:
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longest[part] = max(longest[part], f[p])
        rows_of = []
        for p in candidates:
            a = f[p]
            if len(p) == 2 and longest[p] and 100 * longest[p] >= 50 * a:
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows_of.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_of)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def corpus(seed, rows=300, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{n}" for n in range(vocabulary)] + ["en", "de", "Über", "über", "İ", "New", "york", "don't", "🙂"]
    weights = [1 / (n + 1) for n in range(len(words))]
    gaps = [" ", "\t", "  ", ", ", ". ", "\n", "\r\n", "!?", " ; "]
    out = []
    for _ in range(rows):
        text = ""
        for _ in range(rng.randint(0, 120)):
            text += "New York City" if rng.random() < 0.03 else rng.choices(words, weights)[0]
            text += rng.choices(gaps, [20, 1, 1, 2, 2, 1, 1, 1, 1])[0]
        out.append((rng.choice(["en", "en", "de", None]), text))
    return out + [("en", None), ("en", ""), ("fr", " .,; \n"), (None, "one\ttwo"), ("und", "one two")] * 3


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, lang, text, "x", 1) for i, (lang, text) in enumerate(rows)],
                                 "doc_id long, lang string, text string, word string, f long").repartition(3)


def test_whole_result_equals_counting(spark):
    rows = corpus(1)
    assert rows_of(C.collocations(frame(spark, rows), best=None)) == brute(rows, best=10**9)
    assert rows_of(C.collocations(frame(spark, rows), best=7)) == brute(rows, best=7)


def test_small_blocks_and_common_pairs_change_nothing(spark, request):
    rows = corpus(2, 150, 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch"))
    want = brute(rows, best=10**9)
    salt = C.language_names(["en"], 0)
    name = C.named(np.frombuffer(b"w0 w1", np.uint8), np.array([0, 5]), salt)[0]
    hot = np.sort((name[:, None] + C.S.mix(name)[None, :]).ravel())
    hot = np.sort(C.S.mix(hot))
    for buckets in (1, 5):
        parts = C.routed(frame(spark, rows), buckets, hot, block_words=700)
        assert parts.count() > 20
        assert rows_of(C.collocations(frame(spark, rows), best=None, buckets=buckets, hot=hot)) == want


def test_sort_equals_counter_of_tuples(monkeypatch):
    monkeypatch.setattr(C, "CUTOFF", 8)
    rng = np.random.default_rng(3)
    columns = [rng.integers(1, 6, 3000).astype(np.uint64), rng.integers(0, 4, 3000).astype(np.uint64), rng.integers(0, 9, 3000).astype(np.uint64)]
    columns[2][columns[1] == 0] = 0
    weight = rng.integers(1, 5, 3000)
    found, whole = C.multikey_sort(columns, weight, 30)
    for d in range(3):
        want = Counter()
        for *key, w in zip(*columns[:d + 1], weight):
            if key[-1]:
                want[tuple(map(int, key))] += int(w)
        at, total = C.joined(found[d])
        got = {tuple(int(c[p]) for c in columns[:d + 1]): int(t) for p, t in zip(at, total)}
        assert got == {k: v for k, v in want.items() if v >= 30}
    _, whole = C.multikey_sort(columns, weight)
    at, total = C.joined(whole)
    assert len(at) == len(set(zip(*[c.tolist() for c in columns]))) and total.sum() == weight.sum()


def test_squeezing_while_merging_changes_nothing(spark):
    rows = corpus(4, 200, 10)
    df = frame(spark, rows)
    parts = C.routed(df, 3, np.zeros(0, np.uint64), block_words=500).repartition(3, "kind", "bucket").sortWithinPartitions("kind", "bucket")
    a, b = ({tuple(r.h): r["count"] for r in C.merged(parts, pending=p).where("kind = 1").collect()} for p in (50, 10**9))
    assert a == b and len(a) > 50


def test_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_000_001, 3_000_000_000_007, 3_100_000_000_003
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(
        C._score(C.F.col("a"), C.F.col("l"), C.F.col("r"))).first()
    assert row[0] == 1000000 * a * a // (left * right)


def test_equal_names_stop_the_job(spark, monkeypatch):
    parts = [C.packed_words(np.array([5], np.uint64), np.array([3]), [word], ["en"]) for word in (b"one", b"two")]
    df = spark.createDataFrame([(0, 0, bytearray(part)) for part in parts], C.ROUTED)
    with pytest.raises(Exception, match="one name"):
        C.merged(df.coalesce(1)).collect()


def test_suffixes_end_with_their_piece():
    word = np.array([1, 2, 3, 4, 5])
    assert [c.tolist() for c in C.suffixes(word, np.array([True, True, False, True, False]))] == [
        [1, 2, 3, 4, 5], [2, 3, 0, 5, 0], [3, 0, 0, 0, 0]]
    assert [c.tolist() for c in C.suffixes(word[:1], np.array([False]))] == [[1], [0], [0]]


def test_nothing(spark):
    assert rows_of(C.collocations(frame(spark, []))) == []
    assert rows_of(C.collocations(frame(spark, [("en", None), ("en", ". .")]))) == []
