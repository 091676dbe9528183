"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from scholarmesh.llm import jaccard_join as J
from scholarmesh.llm import shingles as S

VOCABULARY = [f"w{n}" for n in range(2000)]


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def linked(a, b, percent=85):
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def brute(rows, percent=85):
    sets = list({shingle_set(t) for _, t in rows} - {frozenset()})
    parent = {s: s for s in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for b in sets[:i]:
            if root(a) != root(b) and linked(a, b, percent):
                parent[root(a)] = root(b)
    least = {}
    for d, t in rows:
        if (s := shingle_set(t)) and d is not None:
            least[root(s)] = min(d, least.get(root(s), d))
    return sorted(((d is None, d or 0, len(s), least.get(root(s)) if s else d) for d, t in rows for s in [shingle_set(t)]), key=str)


def rows_of(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def edited(rng, words, most):
    out = list(words)
    for _ in range(rng.randint(0, most)):
        at = rng.randrange(len(out))
        match rng.randrange(3):
            case 0: out[at] = rng.choice(VOCABULARY)
            case 1: out.insert(at, rng.choice(VOCABULARY))
            case _: out = out[:at] + out[at + 1:] or ["w0"]
    return out


def family_rows(seed, groups=14, size=12):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [rng.choice(VOCABULARY) for _ in range(rng.choice([3, 5, 9, 12, 30, 80, 200, 700]))]
        for _ in range(rng.randint(1, size)):
            rows.append((len(rows) * 3 + 10, " ".join(edited(rng, base, len(base) // 60 + 1))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(docs_of, odd_rows, seed):
    rows = family_rows(seed) + odd_rows + [(8000, "SAME Text Again"), (8001, "one two"), (8002, "one TWO"), (8003, "one two three four five six seven")]
    assert rows_of(J.jaccard_components(docs_of(rows))) == brute(rows)


def test_group_around_the_threshold_needs_the_tree(docs_of):
    rng = random.Random(9)
    base = [rng.choice(VOCABULARY) for _ in range(120)]
    rows = [(n, " ".join(edited(rng, base, 6))) for n in range(160)]
    want = brute(rows)
    assert 1 < len({r[3] for r in want}) < 160
    assert rows_of(J.jaccard_components(docs_of(rows))) == want


def test_every_linked_pair_shares_a_cell():
    rng = random.Random(3)
    together = 0
    for trial in range(400):
        n = rng.choice([5, 7, 9, 13, 14, 15, 28, 29, 60, 112, 113, 300, 900])
        a = [rng.getrandbits(64) for _ in range(n)]
        b = [x for x in a if rng.random() > 0.06] + [rng.getrandbits(64) for _ in range(rng.randint(0, max(1, n // 14)))]
        if not b or set(a) == set(b) or 100 * len(set(a) & set(b)) < 85 * len(set(a) | set(b)):
            continue
        together += 1
        flat, sizes = np.array(sorted(a) + sorted(b), dtype=np.uint64), np.array([len(a), len(b)])
        cell, row = J.entries(flat, sizes)
        assert set(cell[row == 0].tolist()) & set(cell[row == 1].tolist()), n
        alone = J.entries(flat[:len(a)], sizes[:1])[0]
        assert set(alone.tolist()) == set(cell[row == 0].tolist())  # a set's cells do not depend on its block
    assert together > 150


def test_families_of_cells_are_complete(monkeypatch):
    monkeypatch.setattr(J, "FAMILIES", 0)
    flat = np.arange(1, 101, dtype=np.uint64)
    cell, _ = J.entries(flat, np.array([50, 50]))
    assert len(set(cell.tolist())) < len(cell)  # the last cell of a class takes all that is left


def brute_parts(pairs, root):
    part = {int(r): {int(r)} for r in root}
    for i, j, _ in pairs:
        whole = part[int(root[i])] | part[int(root[j])]
        for r in whole:
            part[r] = whole
    return part


@pytest.mark.parametrize("count", [2, 40, 700])
def test_tree_join_equals_all_pairs_of_points(count):
    rng = np.random.default_rng(count)
    points = rng.poisson(3, (count, 32)).astype(np.int64)
    points[count // 2:] = np.maximum(0, points[rng.integers(0, max(1, count // 2), count - count // 2)] + rng.integers(-1, 2, (count - count // 2, 32)) * (
        rng.random((count - count // 2, 32)) < 0.2))
    size, root = points.sum(axis=1), rng.integers(0, max(2, count // 50), count)
    want = {(i, j) for i in range(count) for j in range(i) if root[i] != root[j] and 185 * np.minimum(points[i], points[j]).sum() >= 85 * (
        size[i] + size[j])}
    tree = J.Tree(points, size, root)
    found = J.tree_join(tree, tree)
    assert {(max(p[:2]), min(p[:2])) for p in found} == want and all(s == np.minimum(points[i], points[j]).sum() for i, j, s in found)
    if found:
        spanning = J.forest(found, (size, size), (root, root))
        assert brute_parts(spanning, root) == brute_parts(found, root) and len(spanning) < len(set(root.tolist()))
    half = np.arange(count) % 2 == 0
    a, b = (J.Tree(points[s], size[s], root[s]) for s in (half, ~half))
    to = [np.nonzero(s)[0] for s in (half, ~half)]
    assert {(max(p), min(p)) for i, j, _ in J.tree_join(a, b) for p in [(int(to[0][i]), int(to[1][j]))]} == {
        p for p in want if p[0] % 2 != p[1] % 2}


def test_tree_opens_few_nodes():
    rng = np.random.default_rng(5)
    centres = rng.poisson(4, (40, 64))
    points = np.repeat(centres, 64, axis=0)
    tree = J.Tree(points, points.sum(axis=1), np.repeat(np.arange(40), 64))
    assert not J._open(tree.levels[0], tree.levels[0], [(i, j) for i in range(len(tree.leaves)) for j in range(i)], 85)


def test_parts_of_large_cells_change_nothing(docs_of, spark):
    rng = random.Random(4)
    base = [rng.choice(VOCABULARY) for _ in range(100)]
    texts = [" ".join(edited(rng, base, 8)) for _ in range(90)]
    named = J.named_sets(docs_of(list(enumerate(texts)))).collect()
    names = list({bytes(r.name) for r in named})
    nodes = {r.doc_id: names.index(bytes(r.name)) for r in named}
    needed = spark.createDataFrame([(r.doc_id, bytearray(r.name), nodes[r.doc_id]) for r in named], "doc_id long, name binary, node long")
    sets = J.full_sets(docs_of(list(enumerate(texts))), needed).cache()
    assert sets.count() == len(names)
    apart = spark.createDataFrame([(1, n, nodes[0] if d % 2 else n) for d, n in nodes.items()], "cell long, node long, root long").distinct()
    whole, cut = ({(r.u, r.v) for r in J.tree_pairs(apart, sets, part=p).collect()} for p in (1000, 7))
    assert whole == cut and len(whole) > 20


def test_size_names_and_points():
    shingle, sizes = J.distinct_sets(*S.text_bytes(pa.array(["A b c d e a B c d", "a b c d e a b c d", "", "x"])))
    assert sizes.tolist() == [5, 5, 0, 1]
    high, low = J.set_names(shingle, sizes)
    assert high[0] == high[1] and low[0] == low[1] and high[0] != high[3]
    for n in (1, 127, 500, 5000):
        p = J.point(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
        assert p.sum() == n and len(p) == J.groups_for(n)
    a, b = (J.point(np.arange(n, dtype=np.uint64)) for n in (100, 1000))
    assert (J.folded([a, b])[0] <= J.folded([a, b])[1]).all()  # a subset


def test_nothing(docs_of):
    assert J.jaccard_components(docs_of([])).count() == 0
    assert rows_of(J.jaccard_components(docs_of([(1, None), (2, " \n"), (3, "x")]))) == [(False, 1, 0, 1), (False, 2, 0, 2), (False, 3, 1, 3)]
