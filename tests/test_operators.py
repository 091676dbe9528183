"""Operators on small hand-made tables, and properties that must hold for any input."""

from datetime import date

import numpy as np
from pyspark.sql import functions as F

from scholarmesh.functions.ranking import running_total
from scholarmesh.operators import announcements as A
from scholarmesh.operators import evidence as D
from scholarmesh.operators import people as P
from scholarmesh.operators import retrieval as R
from scholarmesh.operators import sections as T
from scholarmesh.operators import snapshot as N
from scholarmesh.sources import html as W
from scholarmesh.sources import readers as S
from scholarmesh.sources.sinks import write_json_dump, write_match_csv
from scholarmesh.streaming import ingest as I


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_running_total_is_row_number_for_a_hot_key(spark):
    data = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise("cold").alias("k"), (F.col("id") * 7919 % 5000).alias("v"))
    out = running_total(data, ["k"], [F.asc("v")], F.floor(F.col("v") / 100), name="n").collect()
    for key in ("hot", "cold"):
        mine = sorted((r.v, r.n) for r in out if r.k == key)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_knn_paths_agree_with_brute_force(spark):
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(60, 8)), rng.normal(size=(5, 8))
    vs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, embedding array<double>")
    qs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, vector array<double>")
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    expected = {(i, int(c)) for i in range(5) for c in np.argsort(-cos[i])[:7]}
    for limit in (100, 2):
        assert {(r.query_id, r.chunk_id) for r in R.knn_exact(vs, qs, 7, max_queries=limit).collect()} == expected


def test_rrf_does_not_depend_on_list_order(spark):
    a = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "query_id int, chunk_id string, rank0 int")
    b = spark.createDataFrame([(1, "y", 0), (1, "z", 1)], "query_id int, chunk_id string, rank0 int")
    assert rows(R.rrf_fuse(a, b)) == rows(R.rrf_fuse(b, a))
    assert dict((r.chunk_id, r.rrf) for r in R.rrf_fuse(a, b).collect())["y"] == 1 / 60 + 1 / 61


def test_bm25_counts_repeated_query_terms(spark):
    chunks = spark.createDataFrame([(1, "deniz gemi"), (2, "gemi gemi liman"), (3, "tarla")], "chunk_id long, content string")
    once = spark.createDataFrame([(1, "gemi")], "query_id long, keywords string")
    twice = spark.createDataFrame([(1, "gemi gemi")], "query_id long, keywords string")
    s1 = {r.chunk_id: r.bm25 for r in R.bm25_topk(chunks, once).collect()}
    s2 = {r.chunk_id: r.bm25 for r in R.bm25_topk(chunks, twice).collect()}
    assert set(s1) == {1, 2} and all(abs(s2[c] - 2 * s1[c]) < 1e-5 for c in s1)
    assert [r.chunk_id for r in R.bm25_topk(chunks, once, 3, include_zero=True).orderBy("rank").collect()][-1] == 3


def _chunks(text, size, overlap):
    """Brute force of the splitting rule, in plain words, for the test only."""
    def cut(t, separators):
        head, rest = separators[0], separators[1:]
        pieces = [p for p in __import__("re").split(f"(?={head})", t) if p]
        out, small = [], []
        for p in pieces:
            if len(p.split()) < size:
                small.append(p)
                continue
            out += pack(small) if small else []
            small = []
            out += cut(p, rest) if rest else [p]
        return out + (pack(small) if small else [])

    def pack(pieces):
        out, cur, n = [], [], 0
        for p in pieces:
            k = len(p.split())
            if n + k > size and cur:
                out.append("".join(cur).strip())
                while n > overlap or (n + k > size and n > 0):
                    n -= len(cur.pop(0).split())
            cur.append(p)
            n += k
        return [c for c in [*out, "".join(cur).strip()] if c]

    return cut(text, ["\n", "; ", " "])


def test_split_text_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(["ab ", "c", "; ", "\n", " "], size=n, p=[.5, .1, .1, .1, .2])) for n in (5, 40, 80, 200)]
    texts += ["tek", "a b c d e f g h i j\nk l", "bir; iki uc dort bes alti yedi; sekiz\ndokuz on"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.c for r in df.select("t", T.split_text(F.col("t"), 6, 2).alias("c")).collect()}
    for t in texts:
        assert got[t] == _chunks(t, 6, 2), repr(t)


def test_pack_lines_keeps_every_character(spark):
    text = "\n".join("x" * n for n in (3, 4000, 3000, 9000, 10, 20)) + "\n"
    pieces = spark.createDataFrame([(text,)], "t string").select(T.pack_lines(F.col("t")).alias("p")).first().p
    assert "".join(pieces) == text and [len(p) for p in pieces] == [4005, 3001, 9001, 32]


def test_multiset_diff_is_its_own_inverse(spark):
    a = spark.createDataFrame([("p", "s", i, t) for i, t in enumerate(["Kitap", "KİTAP.", "Gemi"])], "author_id string, section string, pos int, text string")
    b = spark.createDataFrame([("p", "s", 0, "kitap"), ("p", "s", 1, "Liman")], a.schema)
    there, back = N.multiset_diff(a, b), N.multiset_diff(b, a)
    assert rows(there.where("change = 'added'").select("text")) == [("Liman",)]
    assert sorted(t.lower() for (t,) in rows(there.where("change = 'removed'").select("text"))) == ["gemi", "kitap"]
    assert {F_ for (F_,) in rows(back.where("change = 'removed'").select("text"))} == {"Liman"}


def test_sync_is_idempotent(spark):
    source = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, hash string")
    stored = spark.createDataFrame([("a", "1"), ("c", "3")], "id string, hash string")
    assert rows(N.sync_actions(source, stored)) == [("a", "skip"), ("b", "process"), ("c", "delete")]
    assert {a for _, a in rows(N.sync_actions(source, source))} == {"skip"}


def test_names(spark):
    persons = spark.createDataFrame([("1", "Ece Kıyak"), ("2", "Ece Aydın"), ("3", "Su Dilara Yıldız")], "person_id string, name string")
    asked = spark.createDataFrame([(1, "ece kiyac"), (2, "Yıldız"), (3, "Ece"), (4, "Mehmet Öztürk")], "query_id int, name string")
    out = {}
    for r in P.resolve_person_name(asked, persons).collect():
        out.setdefault(r.query_id, []).append((r.person_id, r.status))
    assert out[1] == [("1", "found")] and out[2] == [("3", "found")]
    assert sorted(out[3]) == [("1", "ambiguous"), ("2", "ambiguous")] and 4 not in out


def test_evidence_groups_and_fallback(spark):
    chunks = spark.createDataFrame([
        (1, "p", 1, "projeler", "[Bölüm]\nBor kompozit\n\nToz modeli", 0.5), (1, "p", 2, "yayinlar", "[Bölüm]\nKaynak &amp; imalat\nBOR KOMPOZİT", 0.4),
        (1, "r", 1, "yayinlar", "[Bölüm]\nDeniz\nLiman\nGemi\nSu", 0.3)], "query_id int, person_id string, evidence_rank int, section string, content string, similarity double")
    lines = D.number_lines(chunks)
    assert rows(lines.where("person_id = 'p'").select("line_no", "text")) == [
        (1, "Bor kompozit"), (2, "Toz modeli"), (3, "Kaynak &amp; imalat"), (4, "BOR KOMPOZİT")]
    cited = spark.createDataFrame([(1, "p", 1), (1, "p", 3), (1, "p", 4), (1, "p", 99)], "query_id int, person_id string, line_no int")
    best = lines.groupBy("query_id").agg(F.max("similarity").alias("best"))
    shown = {(r.person_id, r.section): (r["items"], r.score) for r in D.group_evidence(lines, D.resolve_evidence_lines(lines, cited), best).collect()}
    assert shown[("p", "projeler")] == (["Bor kompozit"], 100.0)
    assert shown[("r", "yayinlar")] == (["Deniz", "Liman", "Gemi"], 60.0)


def test_repeat_and_update(spark):
    calls = spark.createDataFrame([
        ("c1", "u1", "1833 Yeşil Dönüşüm 2026 1. Çağrısı", "1833", date(2026, 1, 1)), ("c2", "u2", "Tamamen başka konu 2026", None, None)],
        "call_id string, url string, title string, program_code string, publish_date date")
    ann = spark.createDataFrame([
        ("n1", "1833 Yeşil Dönüşüm 2026-1 Çağrı Takvimi", "1833", date(2026, 3, 1)), ("n2", "1833 Yeşil Dönüşüm 2026-1", "1833", date(2027, 3, 1)),
        ("u1", "1833 Yeşil Dönüşüm 2026 1. Çağrısı", "1833", date(2026, 3, 1))], "url string, title string, program_code string, publish_date date")
    assert rows(A.find_repeat_call(ann, calls).select("url", "call_id")) == [("n1", "c1")]
    assert rows(A.match_update_to_call(ann, calls).select("url", "call_id")) == [("n1", "c1"), ("n2", "c1")]


def test_merge_anchors_takes_the_oldest_within_reach(spark):
    calls = spark.createDataFrame([(1, "a b c", date(2024, 1, 1)), (2, "A B C", date(2024, 5, 1)), (3, "a b c", date(2024, 9, 1)),
                                   (4, "a b c", None), (5, "a b", date(2024, 1, 1))], "call_id int, title string, publish_date date")
    out = A.merge_anchors(calls.withColumn("first_seen", F.col("publish_date")))
    assert rows(out) == [(2, 1), (4, 1)]


def test_pages(spark):
    html = ("<html><nav>menu</nav><h1>Baş <b>lık</b></h1><div class='x'>Bir <a href='/a#b'>[bağ]</a> iki<p>üç &amp; dört <script>x()</script>"
            "<div class='topmenu'><div>gizli</div></div><a href='mailto:x'>m</a><a href='/a#b'>yine</a></div></html>")
    page = spark.createDataFrame([(1, "https://o.example/s", html)], "page_id int, url string, html string")
    out = W.extract_main_text(page, min_chars=5, with_heading=True).first()
    assert out.text == "# Baş lık\n\nBaş lık\nBir [bağ] iki\nüç & dört myine"
    assert "gizli" not in out.text and "x()" not in out.text
    assert rows(W.extract_links(page)) == [(1, 0, "bağ", "https://o.example/a#b")]
    assert W.extract_main_text(page, min_chars=5000).first().rejected_reason == "no main text"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "p1.json").write_text('{"state": true, "data": [{"redirect_url": "u", "name": " A \\n b ", "date_to_show": "", "publish_start_date": "2024-02-30"}]}')
    assert rows(S.read_announcements_json(spark, str(tmp_path / "p1.json"))) == [("u", "A b", None)]
    docs = tmp_path / "docs" / "sub"
    docs.mkdir(parents=True)
    for name in ("001_Dr_Ada_Su.pdf", "~$x.pdf", ".h.pdf", "n.txt"):
        (docs / name).write_text(name)
    found = S.assert_unique_ids(S.scan_documents(spark, str(tmp_path / "docs")))
    assert rows(found.select("name", "person_id")) == [("001_Dr_Ada_Su.pdf", "C001_Ada_Su")]
    out = spark.createDataFrame([(1, 1, 'a "b"; c')], "query_id int, rank int, evidence string")
    write_match_csv(out, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("bucket=*/*.csv")).read_text()
    assert '"a ""b""; c"' in text
    write_json_dump(out, str(tmp_path / "json"), "query_id")
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_model_isolates_bad_rows(spark):
    df = spark.createDataFrame([(1, "iyi"), (2, "bozuk"), (3, "nul")], "id int, prompt string").coalesce(1)

    def strict(texts):
        if any(t == "bozuk" for t in texts):
            raise ValueError("bozuk")
        return ["\x00" if t == "nul" else t.upper() for t in texts]

    def fallback(texts):
        return [None if t == "bozuk" else "yedek" for t in texts]

    out = {r.id: (r.value, r.attempts) for r in D.apply_model(df, "prompt", strict, fallback).collect()}
    assert out == {1: ("IYI" if "iyi".upper() == "IYI" else "IYI", 1), 2: (None, 2), 3: ("yedek", 2)}


def test_stream_equals_batch_and_replay_is_harmless(spark, tmp_path):
    items = [("u1", "1501 Deniz Enerjisi 2025 Çağrısı", "S", "2025-01-01", "Proje çağrısı son gün 9 Kasım 2025"),
             ("u2", "1501 Deniz Enerjisi 2025 Çağrısı Açıldı", "S", "2025-02-01", "Proje başvuruları"),
             ("u3", "Seminer", "S", "2025-02-01", "x"), ("u4", "Haber", "S", "2025-02-01", "hiçbir şey"), ("u5", "1002 Liman Işığı 2025", "S", "2025-02-01", "")]
    df = spark.createDataFrame(items, "url string, title string, source string, publish_date string, text string").withColumn(
        "publish_date", F.to_date("publish_date"))
    batch = I.ingest_batch(df, spark.createDataFrame([], I.LEDGER), spark.createDataFrame([], I.CALL))
    expected = rows(batch.ledger.select("url", "decision"))
    assert expected == [("u1", "cagri"), ("u2", "guncelleme"), ("u3", "kara_liste"), ("u4", "cagri_degil"), ("u5", "hata")]
    df.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(I.ITEM).json(str(tmp_path / "in"))
    state = str(tmp_path / "state")
    query = I.ingest_announcements(stream, state, str(tmp_path / "cp"))
    query.awaitTermination()
    assert query.exception() is None
    ledger = I.current(spark, f"{state}/ledger", I.LEDGER, "url")
    assert rows(ledger.select("url", "decision")) == expected
    I.apply_batch(spark, df, 0, state)
    assert rows(I.current(spark, f"{state}/ledger", I.LEDGER, "url").select("url", "decision")) == expected
    calls = I.current(spark, f"{state}/calls", I.CALL, "call_id")
    assert calls.count() == 1 and calls.first().update_urls == ["u2"]
