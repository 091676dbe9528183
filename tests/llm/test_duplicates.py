"""Duplicate operators against brute force over all pairs and all positions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scholarmesh.llm import fingerprints as M
from scholarmesh.llm import near_dedup as N
from scholarmesh.llm import shingles as S
from scholarmesh.llm import suffix_dedup as D
from scholarmesh.llm.components import components

VOCABULARY = [f"w{n}" for n in range(3000)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def shingle_counts(text):
    w = words_of(text)
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def alignment(a, b):
    """common / (words of both - common) of the longest common subsequence, by the full table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1] / max(1, len(a) + len(b) - row[-1])


def sketch_of(text):
    shingle, sizes = S.shingles(*S.words(*S.text_bytes(pa.array([text]))))
    return set(enumerate(N.order_minhash(S.numbered(shingle, sizes), sizes)[0].tolist())) if sizes[0] else set()


def near_rows(seed=1, groups=12):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [rng.choice(VOCABULARY) for _ in range(rng.randint(30, 300))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 40 + 1)):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            rows.append((len(rows) * 3 + 10, " ".join(w)))
        rows.append((len(rows) * 3 + 10, " ".join(base)))
    return rows


def brute_classes(rows, least=0.8):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    texts = list(dict.fromkeys(t or "" for _, t in rows))
    words, sketches = [words_of(t) for t in texts], [sketch_of(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if sketches[i] & sketches[j] and alignment(words[i], words[j]) >= least:
                parent[root(texts[i])] = root(texts[j])
    members = {}
    for d, t in rows:
        members.setdefault(root(t or ""), []).append(d)
    least_id = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    return sorted(((d is None, d or 0), (t or "", least_id[root(t or "")])) for d, t in rows)


def test_classes_equal_all_pairs(docs_of, odd_rows):
    rows = near_rows() + odd_rows
    got = N.classes(docs_of(rows)).collect()
    by_node = {hashlib.md5((t or "").encode()).digest(): t or "" for _, t in rows}
    assert sorted(((r.doc_id is None, r.doc_id or 0), (by_node[bytes(r.node)], r.class_id)) for r in got) == brute_classes(rows)


def test_near_group_around_the_threshold(docs_of):
    rng = random.Random(9)
    base = [rng.choice(VOCABULARY) for _ in range(150)]
    rows = []
    for n in range(150):
        w = list(base)
        for _ in range(rng.randint(4, 24)):
            w[rng.randrange(150)] = rng.choice(VOCABULARY)
        rows.append((n, " ".join(w)))
    got = {r.doc_id: r.class_id for r in N.classes(docs_of(rows)).collect()}
    assert got == {d[1]: c for d, (_, c) in brute_classes(rows)}
    assert len(set(got.values())) > 1


def test_classes_of_nothing_and_of_blank_texts(docs_of):
    assert N.classes(docs_of([])).count() == 0
    assert {r.class_id for r in N.classes(docs_of([(1, ""), (2, None), (3, " ")])).collect()} == {1, 3}


def as_words(x):
    return S.words(*S.text_bytes(pa.array([" ".join(x)])))[0]


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(2)
    for n in range(300):
        a = [rng.choice(VOCABULARY[:40 if n % 2 else 3]) for _ in range(rng.randint(1, 80))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 4 + 1)):
            b.insert(rng.randrange(len(b)), rng.choice(VOCABULARY)) if rng.random() < 0.5 else b.pop(rng.randrange(len(b)))
            b = b or ["z"]
        want, got = alignment(a, b), N.aligned(as_words(a), as_words(b))
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 0.95])
def test_alignment_over_many_windows(least):
    rng = random.Random(5)
    a = [rng.choice(VOCABULARY[:200]) for _ in range(4000)]
    for moved in (0, 60, 300):
        b = a[moved:] + a[:moved]
        for _ in range(120):
            b[rng.randrange(len(b))] = rng.choice(VOCABULARY)
        want, got = alignment(a, b), N.aligned(as_words(a), as_words(b), least)
        assert got == pytest.approx(want) if want >= least else got == 0


@pytest.mark.parametrize("edits, recall", [(0.01, 1.0), (0.03, 1.0), (0.05, 0.95)])
def test_near_copies_are_found_by_edit_rate(docs_of, edits, recall):
    rng = random.Random(11)
    rows = []
    for n in range(100):
        w = [rng.choice(VOCABULARY) for _ in range(300)]
        rows.append((2 * n, " ".join(w)))
        for i in rng.sample(range(300), int(300 * edits)):
            w[i] = rng.choice(VOCABULARY)
        rows.append((2 * n + 1, " ".join(w)))
    got = {r.doc_id: r.class_id for r in N.classes(docs_of(rows)).collect()}
    assert sum(got[2 * n + 1] == 2 * n for n in range(100)) >= 100 * recall
    assert all(got[2 * n] == 2 * n for n in range(100))


def test_first_of_each_keeps_columns_and_one_row(docs_of, odd_rows):
    df = docs_of(near_rows(4, 3) + odd_rows)
    out = N.first_of_each(df)
    assert out.columns == df.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(3) == 1 and 9 not in ids and 8 in ids and None in ids


def test_components_of_chains_and_stars(spark):
    rng = random.Random(0)
    links = [(n, n + 1) for n in range(50)] + [(100, 100 + n) for n in range(1, 60)] + [(rng.randint(300, 500), rng.randint(300, 500)) for _ in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.u: r.v for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_cut(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, texts):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((d or -1, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages(seed, n=60, unit=30):
    rng = random.Random(seed)
    letters = "abcdé "
    shared = ["".join(rng.choice(letters) for _ in range(rng.randint(unit // 2, 4 * unit))) for _ in range(8)]
    return [(k, "".join(rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 2 * unit)))
                        for _ in range(rng.randint(1, 8)))) for k in range(n)]


@pytest.mark.parametrize("length, gram, hot", [(20, 8, 2000), (20, 8, 3), (33, 16, 1), (200, 64, 2000)])
def test_cut_bytes_equal_brute_force(spark, docs_of, tmp_path, monkeypatch, length, gram, hot):
    monkeypatch.setattr(D, "HOT", hot)
    rows = passages(length + hot, unit=length) + [
        (500, "a" * 3 * length), (501, "ab" * length), (502, "same " * length), (503, "same " * length), (503, "same " * length),
        (504, None), (505, ""), (None, "x" * length), (506, "q" * (length - 1)), (507, "q" * (length - 1))]
    docs = D.keyed(docs_of(rows))
    lost = {(r.key, r.doc_id): r for r in D.without_repeats(docs, length, gram).collect()}
    got = []
    for r in docs.collect():
        raw, cut = r.text.encode(), lost.get((r.key, r.doc_id))
        kept = bytes(cut.kept) if cut else raw
        got.append((r.doc_id or -1, len(raw), cut.n_removed if cut else 0, cut.n_spans if cut else 0, hashlib.sha256(kept).hexdigest()))
    assert sorted(got) == brute_cut(rows, length)


def test_periodic_texts_that_differ_by_one_byte_keep_it(docs_of):
    rng = random.Random(12)
    rows = []
    for n in range(24):
        line = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(3, 70)))
        half = line * (rng.randint(260, 900) // len(line) + 1)
        rows += [(10 * n + 1, half + "X" + half), (10 * n + 2, half + "Y" + half)]
    docs = D.keyed(docs_of(rows))
    lost = {r.key: r for r in D.without_repeats(docs).collect()}
    kept = {r.doc_id: bytes(lost[r.key].kept) if r.key in lost else r.text.encode() for r in docs.collect()}
    got = sorted((d, hashlib.sha256(k).hexdigest()) for d, k in kept.items())
    assert got == [(r[0], r[4]) for r in brute_cut(rows, D.LENGTH)]
    assert all((b"X" if d % 10 == 1 else b"Y") in k for d, k in kept.items())


def test_cut_text_keeps_whole_characters_and_columns(docs_of):
    twice = "é中" * 100
    df = docs_of([(1, "head中" + twice + "中tail"), (2, "x" + twice + "y"), (3, twice), (4, None), (5, ""), (6, "clean")])
    out = D.cut_text(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert set(got) == {1, 2, 4, 5, 6} and got[4] is None and got[6] == "clean"
    assert got[1].startswith("head") and got[1].endswith("tail") and "�" not in got[1] and got[2] == "xy"
    assert D.cut_text(docs_of([])).count() == 0


def test_fingerprints_of_edited_and_next_texts(docs_of, odd_rows):
    rows = odd_rows + near_rows(7, 6)
    got = M.with_next(docs_of(rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).collect()
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for n, (d, t) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        want.append((d or -1, len(t), hashlib.sha256(M.edited(t, after).encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    errors = []
    for n, (d, t) in enumerate(order):
        r = next(r for r in got if r.doc_id == d and r.n_chars == len(t))
        after = order[(n + 1) % len(order)][1]
        for other, value in ((M.edited(t, after), r.near_edited), (after, r.near_next)):
            a, b = set(shingle_counts(t)), set(shingle_counts(other))
            if a and b:
                errors.append(abs(value - len(a & b) / len(a | b)))
    assert np.mean(errors) < 0.06 and max(errors) < 0.35
    assert M.with_next(docs_of([]).select("doc_id", "text")).count() == 0
    assert M.with_next(docs_of([(1, "a b c d e f g h")]).select("doc_id", "text")).first().near_next == 1.0


def test_near_pairs_link_all_that_share_a_band(docs_of):
    rng = random.Random(21)
    base = [rng.choice(VOCABULARY) for _ in range(150)]
    rows = []
    for n in range(120):  # the first 90 are leaders of the bands of the others, but too far from them
        w = list(base)
        for at in rng.sample(range(150), 8 if n < 90 else 1):
            w[at] = f"z{n}x{at}"
        rows.append((n, " ".join(w)))
    rows += [(1000 + d, t) for d, t in near_rows(5, 6)]
    bands = {}
    for (d, _), s in zip(rows, M.text_signatures([t for _, t in rows])):
        for n in range(M.BANDS):
            bands.setdefault((n, s[n * M.ROWS:(n + 1) * M.ROWS].tobytes()), []).append(d)
    sets = {d: set(shingle_counts(t)) for d, t in rows}
    near = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for ids in bands.values() for a in ids for b in ids if b < a}
    got = M.near_pairs(docs_of(rows).select("doc_id", "text")).collect()
    assert got and len({r.doc_id for r in got}) == len(got)

    def classes(links):
        parent = {d: d for d, _ in rows}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return {d: root(d) for d in parent}

    assert classes(r[:2] for r in got) == classes(k for k, v in near.items() if 100 * v >= M.PERCENT - 1e-9)


def test_fingerprints_carry_the_class_of_the_links(docs_of, odd_rows):
    rows = near_rows(3, 5) + odd_rows
    docs = docs_of(rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = M.with_class(M.with_next(docs), docs).collect()
    assert len(got) == len(rows) and {r.near_class for r in got if r.doc_id in (8, 9)} == {8}
    distinct = {t: d for d, t in reversed(near_rows(3, 5))}
    texts = docs_of([(d, t) for t, d in distinct.items()]).select("doc_id", "text")
    links = M.near_pairs(texts).collect()
    own = {r.doc_id: r.near_class for r in got}
    assert links and all(own[r.doc_id] == own[r.leader] for r in links)
    linked = {d: d for d in distinct.values()}
    for _ in linked:
        for r in links:
            linked[r.doc_id] = linked[r.leader] = min(linked[r.doc_id], linked[r.leader])
    assert {d: own[d] for d in linked} == linked
