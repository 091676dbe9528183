"""Exact Jaccard join of shingle sets: count vectors in R-trees, bounds by summed minima, verified pairs, components.

A document is the set of its distinct shingles. Shingles are hashed into groups; how many of a set's shingles fall into each
group is a point. Two sets share at most the sum of the coordinate minima of their points, two R-tree nodes at most the sum
of the minima of their upper corners; pairs of nodes and points below what the least similarity needs are never opened, and
what survives is verified on the sets themselves.

The tree's first level is laid over the cluster by cells. Shingles are dealt into m buckets, a size class has one m; two sets
that are similar enough differ in at most D shingles, so in at most D buckets, and all but D are the same. A set thus enters
the cells (bucket, its content) of D + 1 + e buckets, e of which may be empty: every pair of linked sets meets in at least one.
A set with too many empty buckets enters the cells of another dealing besides. Cells with the same members are one cell.

Only components are wanted, so in a cell all members first meet one leader; what is verified is contracted. Cells that still
hold several components are joined by the R-tree, in parts of bounded size, pairs within a component left out; before that go
sets too few of whose shingles occur in any other set that is left. A first pass of the tree gives only a forest over a cell's
components, by the best bounds; when that is verified and contracted, a second pass gives all pairs that are left. No link
between different sets is lost, and groups are never collected.

Sets are named by 128 bits and numbered; cells and their entries have 64 (an entry leads to all sets with that half). Defined cases: null texts
are empty; documents without words have no shingles and are linked with nothing; repeated rows and equal sets are linked;
component ids ignore null document ids (null if all are null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmesh.llm import shingles as S
from scholarmesh.llm.common import compact, cut_lineage, documents, hot_join, whole_text
from scholarmesh.llm.components import components
from scholarmesh.llm.token_files import shared_folder

WIDTH, PERCENT = 4, 85
BLOCK_BYTES = 512 << 10
LEAF, FAN = 32, 8  # points of a leaf, children of an inner node
PART = 512  # members of a cell that one part of the tree holds on average
SEEN = 1_000_000  # sets a task remembers to enter equal ones once
FAMILIES = 6
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BROADCAST_SHINGLES = 1 << 20  # 8 MiB


def distinct_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, letters: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles, sorted in each row; set size per row); `letters` maps bytes."""
    shingle, sizes = S.shingles(*S.words(letters[data], offsets), width)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((shingle, row))
    shingle, row = shingle[order], row[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (row[1:] != row[:-1])
    return shingle[new], np.bincount(row[new], minlength=len(sizes))


def _sums(value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes), dtype=np.uint64)
    has = sizes > 0
    if has.any():
        out[has] = np.add.reduceat(value, (np.cumsum(sizes) - sizes)[has])
    return out


def set_names(shingle: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of every set's name."""
    return tuple(S.mix(_sums(S.mix(shingle * S.PRIME + np.uint64(k)), sizes) + sizes.astype(np.uint64)) for k in (1, 2))


def classes_of(percent: int, most: int) -> list[int]:
    """Upper bounds of the size classes up to one beyond `most`; sets of the first one are similar only if they are equal."""
    out = [max(1, (99 + percent) // (2 * (100 - percent)))]
    while len(out) < 2 or out[-2] < most:
        out.append(max(2 * out[-1], out[-1] * 100 // percent + 1))
    return out


def entries(shingle: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row) entries of sets: every two sets that are similar enough, but not equal, share a cell."""
    if not len(shingle):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    bounds = np.array(classes_of(percent, int(sizes.max())))
    own = np.searchsorted(bounds, sizes)
    starts = np.cumsum(sizes) - sizes
    cells, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for step in (0, 1):  # a set near the end of its class also enters the next one
        level = own + step
        at = np.nonzero((sizes > 0) & (level > 0) & (level < len(bounds)) & ((step == 0) | (100 * sizes >= percent * (bounds[own] + 1))))[0]
        for family in range(FAMILIES + 1):
            if not len(at):
                break
            n, top = sizes[at], bounds[level[at]]
            differ = (100 - percent) * (n + np.minimum(top, n * 100 // percent)) // (100 + percent)  # D of this set
            m = (100 - percent) * 2 * top // (100 + percent) + 1
            m += np.ceil(m * 0.006 + 3 * np.sqrt(m * 0.003)).astype(np.int64)  # room for empty buckets
            code = level[at].astype(np.uint64) * np.uint64(16) + np.uint64(family)
            if family == FAMILIES:  # one cell for the rest of a class
                cells.append(S.mix(S.mix(code + S.STEP)))
                rows.append(at)
                break
            base = np.cumsum(m) - m
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[at], n)
            value = S.mix(shingle[place] * S.STEP + np.repeat(code, n))
            bucket = (value % np.repeat(m, n).astype(np.uint64)).astype(np.int64) + np.repeat(base, n)
            content = np.zeros(int(m.sum()), dtype=np.uint64)
            np.add.at(content, bucket, S.mix(value + S.PRIME))
            filled = np.zeros(len(content), dtype=bool)
            filled[bucket] = True
            empty = m - np.add.reduceat(filled, base)
            skip = m - differ - 1 - empty  # so many of the first buckets are not needed
            nth = np.arange(len(content)) - np.repeat(base, m)
            use = filled & (nth >= np.repeat(np.maximum(skip, 0), m))
            cells.append(S.mix(content[use] + S.mix(np.repeat(code, m)[use] * S.PRIME + nth[use].astype(np.uint64))))
            rows.append(np.repeat(at, m)[use])
            at = at[skip < 0]
    return np.concatenate(cells), np.concatenate(rows)


def groups_for(n: int) -> int:
    """Coordinates of a set's point: about its size, 32 to 4096, a power of two."""
    return 1 << min(12, max(5, max(n, 1).bit_length()))


def _width(n: int) -> type:
    """Counts of a set of n shingles are at most n."""
    return np.uint16 if n < 65536 else np.uint32


def point(shingles: np.ndarray) -> np.ndarray:
    groups = groups_for(len(shingles))
    shift = np.uint64(65 - groups.bit_length())
    return np.bincount((S.mix(shingles + S.STEP) >> shift).astype(np.int64), minlength=groups).astype(_width(len(shingles)))


def folded(points: list[np.ndarray]) -> np.ndarray:
    """Points with the coordinates of the coarsest of them."""
    groups = min(len(p) for p in points)
    return np.stack([p.reshape(groups, -1).sum(axis=1) for p in points]).astype(np.int32)


def _needed(a: np.ndarray, b: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b that share at most so many shingles may be similar enough."""
    return (100 + percent) * shared >= percent * (a + b)


class Tree:
    """A packed R-tree over points; leaves hold points of one root where a root has many."""

    def __init__(self, points: np.ndarray, size: np.ndarray, root: np.ndarray):
        _, group, count = np.unique(root, return_inverse=True, return_counts=True)
        group = np.where(count[group] >= LEAF, group, -1)
        slab = np.argsort(np.argsort(size, kind="stable")) // max(1, LEAF * FAN)
        self.order = np.lexsort((points[:, int(points.var(axis=0).argmax())], slab, group))
        self.points, self.size, self.root = points[self.order], size[self.order], root[self.order]
        edge = np.nonzero(np.diff(group[self.order], prepend=group[self.order][0] - 1))[0]
        starts = np.concatenate([np.arange(a, b, LEAF) for a, b in zip(edge, np.append(edge[1:], len(root)))])
        self.leaves = list(zip(starts.tolist(), np.append(starts[1:], len(root)).tolist()))
        self.levels = [self._corners(self.points, self.size, self.root, starts)]
        self.children: list[np.ndarray] = []
        while len(self.levels[-1][1]) > FAN:
            starts = np.arange(0, len(self.levels[-1][1]), FAN)
            self.children.append(starts)
            self.levels.append(self._corners(*self.levels[-1], starts))

    @staticmethod
    def _corners(points, size, root, starts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(upper corners, least sizes, root where all have one, else -1) of consecutive groups."""
        low, high = np.minimum.reduceat(root, starts), np.maximum.reduceat(root, starts)
        return np.maximum.reduceat(points, starts), np.minimum.reduceat(size, starts), np.where(low == high, low, -1)

    def _kids(self, level: int, node: int) -> range:
        begin = int(self.children[level - 1][node])
        return range(begin, min(begin + FAN, len(self.levels[level - 1][1])))


def _open(a: tuple, b: tuple, pairs: list[tuple[int, int]], percent: int) -> list[tuple[int, int]]:
    """The pairs of nodes that may hold linked points of different roots."""
    out = []
    for lo in range(0, len(pairs), 2048):
        i, j = np.array(pairs[lo:lo + 2048]).T
        shared = np.minimum(a[0][i], b[0][j]).sum(axis=1)
        keep = _needed(a[1][i], b[1][j], shared, percent) & ((a[2][i] != b[2][j]) | (a[2][i] < 0))
        out += zip(i[keep].tolist(), j[keep].tolist())
    return out


def tree_join(a: Tree, b: Tree, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(point of a, point of b, bound of what they share) of different roots that may be similar enough; b may be a."""
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    pairs = [(i, j) for i in range(len(a.levels[la][1])) for j in range(len(b.levels[lb][1])) if a is not b or i <= j]
    while True:
        pairs = _open(a.levels[la], b.levels[lb], pairs, percent)
        if la == 0 and lb == 0:
            break
        both = la if la >= lb else -1, lb if lb >= la else -1  # the higher tree is opened, or both
        la, lb = la - (both[0] > 0), lb - (both[1] > 0)
        pairs = [(x, y) for i, j in pairs for x in (a._kids(la + 1, i) if both[0] > 0 else (i,))
                 for y in (b._kids(lb + 1, j) if both[1] > 0 else (j,)) if a is not b or x <= y]
    out = []
    for i, j in pairs:
        (a0, a1), (b0, b1) = a.leaves[i], b.leaves[j]
        shared = np.minimum(a.points[a0:a1, None, :], b.points[None, b0:b1, :]).sum(axis=2)
        keep = _needed(a.size[a0:a1, None], b.size[None, b0:b1], shared, percent) & (a.root[a0:a1, None] != b.root[None, b0:b1])
        x, y = np.nonzero(keep)
        if a is b and i == j:
            x, y = x[x < y], y[x < y]
        out += zip(a.order[a0 + x].tolist(), b.order[b0 + y].tolist(), shared[x, y].tolist())
    return out


def forest(found: list[tuple[int, int, int]], sizes: tuple[np.ndarray, np.ndarray], roots: tuple[np.ndarray, np.ndarray]) -> list[tuple]:
    """The best of the found pairs that connect all roots which they connect."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    a, b, shared = np.array(found).T
    best = np.argsort(-shared / (sizes[0][a] + sizes[1][b]), kind="stable")
    out = []
    for n in best.tolist():
        u, v = top(int(roots[0][a[n]])), top(int(roots[1][b[n]]))
        if u != v:
            parent[u] = v
            out.append(found[n])
    return out


def _name(high: np.ndarray, low: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.stack([high, low], axis=1).astype(">u8")], pa.binary())


def named_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, name (of the set), half (its first 64 bits), n (set size) of (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in S.blocks(batch.column(1), BLOCK_BYTES):
                shingle, sizes = distinct_sets(data, offsets, width)
                high, low = set_names(shingle, sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _name(high, low), pa.array(
                    high.view(np.int64)), pa.array(sizes.astype(np.int64))], names=["doc_id", "name", "half", "n"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, "doc_id long, name binary, half long, n long")


def cell_entries(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """cell, half of all sets of (doc_id, text); equal sets of a task enter once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in S.blocks(batch.column(0), BLOCK_BYTES):
                shingle, sizes = distinct_sets(data, offsets, width)
                high, _ = set_names(shingle, sizes)
                if len(seen) > SEEN:
                    seen.clear()
                fresh = np.array([not (h in seen or seen.add(h)) for h in high.tolist()], dtype=bool)
                shingle = shingle[np.repeat(fresh, sizes)]
                cell, row = entries(shingle, sizes[fresh], percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.view(np.int64)), pa.array(high[fresh][row].view(np.int64))], names=["cell", "half"])

    return docs.select(whole_text().alias("text")).mapInArrow(run, "cell long, half long")


SETS = "node long, n long, point binary, shingles binary"


def set_rows(shingle: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
    """Columns n, point, shingles of SETS."""
    rows = [shingle[e - n:e] for e, n in zip(np.cumsum(sizes), sizes)]
    return [pa.array(sizes.astype(np.int64)), pa.array([point(r).tobytes() for r in rows], pa.binary()), pa.array(
        [r.tobytes() for r in rows], pa.binary())]


def full_sets(docs: DataFrame, needed: DataFrame, width: int = WIDTH) -> DataFrame:
    """node, n, point (binary), shingles (binary) of the needed (doc_id, name, node); one row per node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in S.blocks(batch.column(2), BLOCK_BYTES):
                shingle, sizes = distinct_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), _name(*set_names(shingle, sizes)), batch.column(1).slice(lo, hi - lo),
                     *set_rows(shingle, sizes)], names=["wanted", "name", "node", "n", "point", "shingles"])

    text = docs.select(F.col("doc_id").alias("_id"), whole_text().alias("text"))
    found = text.join(needed, text["_id"].eqNullSafe(needed["doc_id"])).select("name", "node", "text").mapInArrow(
        run, "wanted binary, name binary, node long, n long, point binary, shingles binary")
    return found.where("wanted = name").drop("wanted", "name").dropDuplicates(["node"])


def bounded_pairs(pairs: DataFrame, points: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) whose points leave room for the least similarity. points: node, n, point."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, nu, nv, pu, pv = (c.to_pylist() for c in batch.columns)
            keep = [bool(_needed(a, b, np.minimum(*folded([np.frombuffer(p, _width(a)), np.frombuffer(q, _width(b))])).sum(), percent))
                    for a, b, p, q in zip(nu, nv, pu, pv)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    left = points.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("point").alias("pu"))
    right = points.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("point").alias("pv"))
    a, b = F.col("nu"), F.col("nv")
    return pairs.join(left, "u").join(right, "v").where(100 * F.least(a, b) >= percent * F.greatest(a, b)).select(
        "u", "v", "nu", "nv", "pu", "pv").mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """u, v of the pairs (a checkpointed table) whose sets are similar enough. sets: node, n, shingles.

    Where the second sets together have few shingles (counted), they are broadcast and no set is sent to them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n in range(len(batch)):  # one pair's sets at a time
                a, b = (np.frombuffer(batch.column(c)[n].as_buffer(), np.uint64) for c in (2, 3))
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    seconds = pairs.select("v").distinct()
    if (sets.select(F.col("node").alias("v"), "n").join(seconds, "v").agg(F.sum("n")).first()[0] or 0) <= BROADCAST_SHINGLES:
        right = F.broadcast(right.join(seconds, "v", "left_semi"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def placed(members: DataFrame, links: DataFrame) -> DataFrame:
    """cell, node, root of the cells that hold several components of the links (u, v: node and root)."""
    rooted = members.select("cell", "node").join(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "cell", "node", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("cell").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("cell")
    return rooted.join(several, "cell")


def with_company(apart: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows of `apart` whose node shares enough of its shingles with any other node there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shingle = np.frombuffer(data.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(np.full(len(shingle), node))], names=["shingle", "node"])

    nodes = apart.select("node").distinct()
    rows = sets.select("node", "shingles").join(nodes, "node").mapInArrow(run, "shingle long, node long")
    alone = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other").groupBy(
        "node").agg(F.count(F.lit(1)).alias("alone"))
    known = sets.select("node", "n").join(nodes, "node").join(alone, "node", "left").where(
        100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= percent * F.col("n")).select("node")
    return apart.join(known, "node")


def tree_pairs(apart: DataFrame, sets: DataFrame, percent: int = PERCENT, part: int = PART, spanning: bool = False) -> DataFrame:
    """u, v: pairs of different components that meet in a cell and whose points leave room for the least similarity.

    apart: cell, node, root. A cell's members are cut into parts of about `part`; parts of one root are not joined. With
    `spanning` only as many pairs as connect the components of two parts.
    """
    by_root = apart.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("c"))
    small = F.when(F.col("c") < part, F.col("c")).otherwise(0)
    by_cell = by_root.groupBy("cell").agg(F.sum(small).alias("rest"))
    sized = by_root.join(by_cell, "cell").select(
        "cell", "root", F.when(F.col("c") >= part, F.col("root")).alias("own"),
        F.ceil(F.when(F.col("c") >= part, F.col("c")).otherwise(F.col("rest")) / part).alias("parts"))
    dealt = apart.join(sized, ["cell", "root"]).select("cell", "node", "root", "own", F.when(
        F.col("own").isNull(), F.pmod(F.xxhash64("root"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("node"), F.col(
            "parts"))).alias("nth")).withColumn("part", F.xxhash64("own", "nth"))
    parts = dealt.select("cell", "part", "own").distinct()
    other = parts.select("cell", F.col("part").alias("part2"), F.col("own").alias("own2"))
    met = parts.join(other, "cell").where(
        (F.col("part") <= F.col("part2")) & (F.col("own").isNull() | F.col("own2").isNull() | (F.col("own") != F.col("own2"))))
    met = met.select("cell", "part", "part2")
    rows = dealt.select("cell", "part", "node", "root")
    left = rows.join(met, ["cell", "part"]).select("cell", "part", "part2", F.lit(0).alias("side"), "node", "root")
    right = rows.withColumnRenamed("part", "part2").join(met.where("part != part2"), ["cell", "part2"]).select(
        "cell", "part", "part2", F.lit(1).alias("side"), "node", "root")

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        nodes, roots = [r[4] for r in held], {r: n for n, r in enumerate(dict.fromkeys(r[5] for r in held))}
        points, size = folded([np.frombuffer(r[7], _width(r[6])) for r in held]), np.array([r[6] for r in held])
        root = np.array([roots[r[5]] for r in held])
        sides = [np.nonzero(np.array([r[3] for r in held]) == s)[0] for s in (0, 1)]
        trees = [Tree(points[s], size[s], root[s]) if len(s) else None for s in sides]
        same = held[0][1] == held[0][2]
        if trees[0] is None or (trees[1] is None and not same):
            return
        sides = [sides[0], sides[0] if same else sides[1]]
        found = tree_join(trees[0], trees[0] if same else trees[1], percent)
        if found and spanning:
            found = forest(found, tuple(size[s] for s in sides), tuple(root[s] for s in sides))
        if found:
            a, b, _ = zip(*found)
            u, v = ([nodes[s[n]] for n in x] for s, x in zip(sides, (a, b)))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and row[:3] != held[0][:3]:
                    yield from solve(held)
                    held = []
                held.append(row)
        if held:
            yield from solve(held)

    points = sets.select("node", "n", "point")
    near = left.unionByName(right).join(points, "node").select("cell", "part", "part2", "side", "node", "root", "n", "point")
    return near.repartition("cell", "part", "part2").sortWithinPartitions("cell", "part", "part2").mapInArrow(
        run, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def of_different_members(rows: DataFrame, member: str) -> DataFrame:
    """Of the cells with the same members (distinct per cell) the rows of one."""
    marks = [F.bit_xor(F.xxhash64(F.lit(k), member)).alias(f"mark{k}") for k in (1, 2)]
    kept = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("c"), *marks).groupBy("c", "mark1", "mark2").agg(F.min("cell").alias("cell"))
    return rows.join(kept.select("cell"), "cell")


def members_of_cells(docs: DataFrame, nodes: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """cell, node of the cells with several sets; of cells with the same sets one stays. nodes: node, half."""
    shared = cut_lineage(cell_entries(docs, width, percent).groupBy("cell").agg(
        F.min("half").alias("low"), F.max("half").alias("high")).where("low != high").select("cell"))
    inside = cut_lineage(cell_entries(docs, width, percent).join(shared, "cell").distinct())
    return compact(of_different_members(inside, "half").join(nodes, "half").select("cell", "node"))


def linked(docs: DataFrame, nodes: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """u, v: every linked set with the least set of its component (itself left out).

    nodes: node (number), name, half (of the name), doc_id (of one text).
    """
    spark = docs.sparkSession
    members = members_of_cells(docs, nodes.select("node", "half"), width, percent)
    folder = shared_folder(spark, "sets")
    needed = nodes.join(members.select("node").distinct(), "node").select("doc_id", "name", "node")
    full_sets(docs, needed, width).write.parquet(folder)
    return linked_in_cells(members, spark.read.schema(SETS).parquet(folder), percent)


def linked_in_cells(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """u, v as in `linked`: components of all links between members of a cell.

    members: cell, node (distinct); sets: node, n, point, shingles of every member.
    """
    leaders = members.groupBy("cell").agg(F.min("node").alias("v"))
    stars = members.join(leaders, "cell").where("node != v").select(F.col("node").alias("u"), "v").distinct()
    links = components(verified(compact(bounded_pairs(stars, sets, percent)), sets, percent))
    apart = of_different_members(compact(with_company(compact(placed(members, links)), sets, percent)), "node")
    for spanning in (True, False):
        apart = compact(placed(apart, links))
        if apart.isEmpty():
            break
        pairs = compact(tree_pairs(apart, sets, percent, spanning=spanning))
        links = components(links.unionByName(verified(pairs, sets, percent)))
    return links


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    known = cut_lineage(named_sets(docs, width))
    nodes = cut_lineage(known.where("n > 0").groupBy("name").agg(
        F.min("doc_id").alias("doc_id"), F.min("half").alias("half"), F.count(F.lit(1)).alias("c"))).withColumn(
        "node", F.monotonically_increasing_id())  # numbers of checkpointed rows
    roots = linked(docs, nodes, width, percent).select(F.col("u").alias("node"), F.col("v").alias("root"))
    rooted = nodes.join(roots, "node", "left").select("name", "doc_id", "c", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    found = cut_lineage(hot_join(rooted.select("name", "c", "root"), ids, "root", "size").select("name", "component_id", "c"))
    full = hot_join(known.where("n > 0"), found, "name", "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(known.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
