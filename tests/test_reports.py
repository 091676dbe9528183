"""Merged change reports, run status, exact ranks and best rows against plain Python."""

import numpy as np
import pandas as pd
import pytest

from scholarmesh.operators import calls as C
from scholarmesh.operators import retrieval as R
from scholarmesh.operators import snapshot as N


def test_report_merges_fields_and_sections_of_a_person(spark):
    persons = spark.createDataFrame([("B2", "AYŞE KAYA", "PROFESÖR", "X"), ("C3", "CAN", "", None)], "author_id string, ad_soyad string, unvan string, bolum string")
    fields = spark.createDataFrame([("B2", "changed", "unvan", "DOÇENT", "PROFESÖR"), ("D4", "added", None, None, None)],
                                   "author_id string, change string, field string, old string, new string")
    items = spark.createDataFrame([("B2", "makaleler", "added", "Yeni"), ("B2", "makaleler", "added", "Yeni"), ("B2", "dersler", "removed", "Eski"),
                                   ("E5", "dersler", "added", "Ders")], "author_id string, section string, change string, text string")
    got = {r.author_id: r for r in N.change_report(persons, fields, items).collect()}
    assert set(got) == {"B2", "E5"}
    assert got["B2"].ad_soyad == "AYŞE KAYA" and [tuple(x) for x in got["B2"].fields] == [("unvan", "DOÇENT", "PROFESÖR")]
    assert [tuple(x) for x in got["B2"].sections] == [("dersler", [], ["Eski"]), ("makaleler", ["Yeni", "Yeni"], [])]
    assert got["E5"].fields == [] and got["E5"].ad_soyad is None
    assert N.change_report(persons, fields.limit(0), items.limit(0)).count() == 0


def test_run_status_counts_active_persons_and_finds_the_last_ended_run(spark):
    runs = spark.createDataFrame([(1, "tam", "bitti", 10), (2, "hizli", "hata", 20), (3, "tam", "calisiyor", None)], "run_id long, kind string, status string, finished_at long")
    persons = spark.createDataFrame([(True,), (False,), (None,), (True,)], "active boolean")
    r = C.run_status(runs, persons).first()
    assert (r.last_run_id, r.oldest_active_id, r.last_ended_id, r.last_ended_status, r.last_full_success, r.n_active_persons) == (3, 3, 2, "hata", 10, 2)
    assert "n_active_persons" not in C.run_status(runs).columns
    assert C.run_status(runs.limit(0), persons).first().last_ended_id is None


def _vectors(n, seed, ties=True):
    v = np.round(np.random.default_rng(seed).normal(size=(n, 4)), 1)
    if ties:
        v[n // 2:] = v[:n - n // 2]
    return v + 0.05


@pytest.mark.parametrize("block", [2048, 7])
def test_exact_ranks_equal_sorting_all_profiles(spark, block):
    people, asked = _vectors(120, 1), _vectors(9, 2, False)
    profiles = spark.createDataFrame([(f"p{n:03d}", v.tolist()) for n, v in enumerate(people)], "person_id string, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(asked)], "query_id long, vector array<double>")
    pairs = [(q, f"p{n:03d}") for q in range(8) for n in range(q, 120, 11)]
    got = {(r.query_id, r.person_id): r.profile_rank for r in R.exact_ranks(
        profiles, queries, spark.createDataFrame(pairs, "query_id long, person_id string"), block).collect()}
    want = {}
    for q, v in enumerate(asked):
        sims = [round(float(p @ v / np.sqrt((p @ p) * (v @ v))), 12) for p in people]
        order = sorted(range(120), key=lambda n: (-sims[n], f"p{n:03d}"))
        want |= {(q, f"p{n:03d}"): rank for rank, n in enumerate(order)}
    assert got == {p: want[p] for p in pairs}
    none = R.exact_ranks(profiles, queries, spark.createDataFrame([], "query_id long, person_id string"), block)
    assert none.count() == 0


def test_best_rows_equal_sorting(spark):
    rng = np.random.default_rng(4)
    sims, ids, queries = np.round(rng.random((50, 6)), 1), rng.permutation(50), np.array([f"q{n}" for n in range(6)])
    for k in (1, 5, 80):
        got = R._best(queries, ids, sims, k)
        for j, q in enumerate(queries):
            want = sorted(zip(-sims[:, j], ids))[:k]
            assert [(-s, i) for s, i in zip(got[got["query_id"] == q]["similarity"], got[got["query_id"] == q]["id"])] == want
    assert isinstance(got, pd.DataFrame)
