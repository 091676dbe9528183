"""Cases that once gave wrong or partial results."""

from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scholarmesh.operators import announcements as A
from scholarmesh.operators import evidence as D
from scholarmesh.operators import matching as M
from scholarmesh.operators import people as P
from scholarmesh.operators import retrieval as R
from scholarmesh.operators import sections as C
from scholarmesh.operators import snapshot as N
from scholarmesh.sources import html as W
from scholarmesh.sources import readers as S
from scholarmesh.streaming import ingest as I


def main_text(spark, html):
    return W.extract_main_text(spark.createDataFrame([(1, "https://o.example/", html)], "page_id int, url string, html string"), 1).first().text


@pytest.mark.parametrize("html, text", [
    ('<div><p class="menu">Home<div>Body one</div></div><p>Body two</p>', "Body one\nBody two"),
    ('<div><ul id="menu"><li>Home</div><p>Body</p>', "Body"),
    ("<nav>a<p>b</nav>Body<aside>c", "Body"),
    ("<div class=menu><div>a</div>b</div>Body</div></p>tail", "Body\ntail"),
    ("a\tb\x0bc d", "a b\nc\nd"),
])
def test_a_hidden_part_ends_with_its_parent(spark, html, text):
    assert main_text(spark, html) == text


def test_links_by_first_address(spark):
    html = "<a href='x'>[One ]</a><a href='/x'>Two</a><a href='https://o.example/x'>3</a><a href='//h/y'></a><a href='ftp://z'>f</a><a href='http://[bad'>b</a>"
    page = spark.createDataFrame([(1, "https://o.example/", html)], "page_id int, url string, html string")
    assert [tuple(r) for r in W.extract_links(page).collect()] == [(1, 0, "One", "https://o.example/x"), (1, 1, "https://h/y", "https://h/y")]


def test_blank_lines_have_no_number(spark):
    chunk = spark.createDataFrame([(1, "p", 1, "head\n\t\n a \x0b \nb c")], "query_id int, person_id string, evidence_rank int, content string")
    got = [(r.line_no, r.text.strip()) for r in D.number_lines(chunk).orderBy("line_no").collect()]
    assert got == [(1, "a"), (2, "b"), (3, "c")]


@pytest.mark.parametrize("level, want", [
    ("Doktora", "doktora"), ("PhD", "doktora"), ("Ph.D.", "doktora"), ("Doktor", "doktora"), ("Sanatta Yeterlik", "doktora"),
    ("Yüksek Lisans", "yuksek_lisans"), ("", "yuksek_lisans"), (None, "yuksek_lisans")])
def test_thesis_levels(spark, level, want):
    got = spark.createDataFrame([(level,)], "l string").select(F.when(F.col("l").rlike(C.DOCTORAL_LEVEL), "doktora").otherwise("yuksek_lisans")).first()[0]
    assert got == want


def test_state_counts_where_it_is_present(spark, tmp_path):
    for n, (text, ok) in enumerate([('{"state": null, "status": true, "data": []}', False), ('{"status": true, "data": []}', True),
                                    ('{"state": true, "status": false, "data": []}', True), ('{"data": []}', False)]):
        (tmp_path / f"{n}.json").write_text(text)
        read = S.read_announcements_json(spark, str(tmp_path / f"{n}.json"))
        if ok:
            assert read.collect() == []
        else:
            with pytest.raises(PySparkException):
                read.collect()


def test_upsert_replaces_rows_of_a_key(spark):
    schema = "author_id string, seen int, name string"
    stored = spark.createDataFrame([("1", 1, "old"), ("2", 1, "kept")], schema)
    loaded = spark.createDataFrame([("1", 2, "b"), ("1", 3, "a"), ("3", 1, "new")], schema)
    got = sorted(tuple(r) for r in N.upsert_by_key(stored, loaded, order="seen").collect())
    assert got == [("1", 3, "a"), ("2", 1, "kept"), ("3", 1, "new")]
    assert sorted(tuple(r) for r in N.upsert_by_key(N.upsert_by_key(stored, loaded, order="seen"), loaded, order="seen").collect()) == got


def test_replayed_updates_add_no_address(spark):
    dates = "array<struct<label:string,date:date,is_application:boolean>>"
    calls = spark.createDataFrame([("c", [], ["u1"])], f"call_id string, dates {dates}, update_urls array<string>")
    updates = spark.createDataFrame([("c", "u1", []), ("c", "u2", [])], f"call_id string, url string, dates {dates}")
    once = A.merge_extension_dates(calls, updates)
    assert A.merge_extension_dates(once, updates).first().update_urls == once.first().update_urls == ["u1", "u2"]


def test_updates_of_nothing_found_one_call(spark):
    items = spark.createDataFrame([
        ("a", "Ege Liman Gemi Kuru Yük destek süresi uzatıldı", "s", date(2024, 1, 1), "proje başvuru"),
        ("b", "Ege Liman Gemi Kuru Yük destek süresi uzatıldı", "s", date(2024, 1, 5), "proje başvuru"),
        ("b", "Ege Liman Gemi Kuru Yük destek süresi uzatıldı", "s", date(2024, 1, 5), "proje başvuru")], I.ITEM)
    out = I.ingest_batch(items, spark.createDataFrame([], I.LEDGER), spark.createDataFrame([], I.CALL))
    assert out.new_calls.select("url").collect() == [("a",)]
    assert sorted((r.url, r.decision) for r in out.ledger.collect()) == [("a", "cagri"), ("b", "guncelleme")]
    assert len({r.call_id for r in out.ledger.collect()}) == 1


def test_name_scores_are_means_of_best_ratios(spark):
    from difflib import SequenceMatcher

    persons = [("1", "ece ada kıyak"), ("2", "ece kıyak kıyak"), ("3", "bora çelik")]
    asked = [(1, "ece kiyac ece"), (2, "borra celik x")]
    p = spark.createDataFrame(persons, "person_id string, name string")
    q = spark.createDataFrame(asked, "query_id int, name string")
    got = {(r.query_id, r.person_id): r.score for r in P.resolve_person_name(q, p).collect()}
    fold = {"ı": "i", "ç": "c"}
    for (i, text) in asked:
        for (pid, name) in persons:
            words = "".join(fold.get(c, c) for c in name).split()
            want = sum(max(SequenceMatcher(None, a, b).ratio() for b in words) for a in text.split()) / len(text.split())
            if (i, pid) in got:
                assert got[(i, pid)] == pytest.approx(want, abs=1e-6)
    assert got


def test_a_person_with_hits_keeps_the_rank_among_all_profiles(spark):
    n = 1500
    profiles = spark.createDataFrame([(f"p{k:04d}", [float(n - k), float(k + 1)]) for k in range(n)], "person_id string, embedding array<double>")
    queries = spark.createDataFrame([(1, "bor kompozit", [1.0, 0.0])], "query_id int, keywords string, vector array<double>")
    chunks = spark.createDataFrame([*[(c, f"p{n - 1:04d}", "x", "bor kompozit") for c in (1, 3, 4)], (2, "p0000", "x", "deniz")],
                                   "chunk_id int, person_id string, section string, content string")
    vectors = spark.createDataFrame([(2, [1.0, 0.0])], "chunk_id int, embedding array<double>")
    ranked = {r.person_id: (r["rank"], r.score) for r in M.rank_persons(chunks, vectors, profiles, queries).collect()}
    last = f"p{n - 1:04d}"
    assert len(ranked) == 20 and ranked[last][1] == pytest.approx((1 / 60 + 1 / 61 + 1 / 62) / 3 + 1 / (60 + n - 1))
    assert ranked["p0000"][1] == pytest.approx(1 / 60 / 3 + 1 / 60)
    whole = {r.person_id: r.profile_rank for r in R.profile_ranking(profiles, queries, None).collect()}
    assert whole == {f"p{k:04d}": k for k in range(n)}


def test_evidence_lists_blank_chunks_and_chunks_without_a_vector(spark):
    chunks = spark.createDataFrame([(1, "p", "a", "bor kompozit"), (2, "p", "a", ""), (3, "p", "a", "deniz"), (4, "p", "a", "bor bor")],
                                   "chunk_id int, person_id string, section string, content string")
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "chunk_id int, embedding array<double>")
    queries = spark.createDataFrame([(1, "bor", [1.0, 0.0])], "query_id int, keywords string, vector array<double>")
    chosen = spark.createDataFrame([(1, "p")], "query_id int, person_id string")
    out = {r.chunk_id: r for r in R.person_evidence(chunks, vectors, queries, chosen).collect()}
    assert set(out) == {1, 2, 3, 4} and out[2].similarity == 1.0 and out[3].similarity == out[4].similarity == 0.0
    assert out[3].evidence_rank == 4


def test_updates_meet_calls_without_pairs_of_rows(spark):
    calls = spark.createDataFrame([("c1", "u1", "ege liman gemi", None, date(2024, 1, 1)), ("c2", "u2", "ege liman gemi", None, date(2024, 2, 1)),
                                   ("c3", "u3", "ege liman vinç", "x", date(2024, 1, 5))],
                                  "call_id string, url string, title string, program_code string, publish_date date")
    ann = spark.createDataFrame([("a", "ege liman gemi", None, date(2024, 1, 20)), ("u2", "ege liman gemi", None, date(2024, 3, 1)),
                                 ("b", "ege liman gemi", None, None), ("c", "ege liman gemi", None, date(2023, 1, 1)),
                                 ("d", "ege liman gemi", "X", date(2024, 3, 1))],
                                "url string, title string, program_code string, publish_date date")
    out = A.match_update_to_call(ann, calls)
    assert {r.url: r.call_id for r in out.collect()} == {"a": "c1", "u2": "c1", "b": "c2", "d": "c3"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
