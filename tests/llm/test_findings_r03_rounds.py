"""Components start no round that changes nothing, and small counted tables are read in few tasks."""

from __future__ import annotations

import random

from scholarmesh.llm import common
from scholarmesh.llm import components as C


def _brute(links):
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for u, v in links:
        a, b = root(u), root(v)
        top[max(a, b)] = min(a, b)
    return {x: root(x) for x in top if root(x) != x}


def test_components_of_chains_hubs_and_cycles_equal_brute_force(spark):
    rng = random.Random(5)
    links = [(n, n + 1) for n in range(100, 140)] + [(7, n) for n in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    links += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(70)]
    rng.shuffle(links)
    got = C.components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r.u: r.v for r in got} == _brute(links) and len(got) == len({r.u for r in got})


def test_finished_components_take_no_round(spark, monkeypatch):
    done = C.components(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8)], "u long, v long"))
    monkeypatch.setattr(C, "_small_star", lambda edges: 1 / 0)
    assert {(r.u, r.v) for r in C.components(done).collect()} == {(2, 1), (3, 1), (4, 1), (9, 8)}


def test_small_tables_are_read_in_as_many_tasks_as_there_are_cores(spark):
    kept = common.compact(spark.range(0, 1000, 1, 211))
    assert kept.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and kept.count() == 1000
