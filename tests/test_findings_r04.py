"""Small cases of the fourth round's findings."""

import hashlib
import random
from datetime import date, timedelta

import pytest

from scholarmesh.operators import announcements as A
from scholarmesh.operators import own_evidence as O
from scholarmesh.operators import retrieval as R
from scholarmesh.operators import search_index as IX
from scholarmesh.functions.text import tokenize
from scholarmesh.sources import readers as S
from scholarmesh.streaming import ingest as I


def _collection(spark, seed=5, n=160):
    rnd = random.Random(seed)
    words = ["bor", "deniz", "gemi", "liman", "kompozit", "ege", "rüzgar", "vinç"]
    vector = lambda: [float(rnd.randint(-2, 2)) for _ in range(3)] if rnd.random() < 0.9 else [1.0, 1.0, 1.0]
    texts = [(i, "pqr"[0 if i % 3 else i % 2 + 1], "a", rnd.choice(["", None]) if rnd.random() < 0.1 else
              " ".join(rnd.choices(words, k=rnd.randint(1, 6)))) for i in range(n)]
    chunks = spark.createDataFrame([*texts, (n, None, "a", "bor")], "chunk_id long, person_id string, section string, content string")
    vectors = spark.createDataFrame([(i, vector()) for i in range(0, n, 2)], "chunk_id long, embedding array<float>").where(
        "aggregate(embedding, 0D, (a, x) -> a + x * x) > 0")
    queries = spark.createDataFrame([(7, "bor deniz bor", [1.0, 0.5, 0.0]), (8, "gemi ege", [0.0, 1.0, 1.0]), (9, "x", [1.0, 0.0, 0.0])],
                                    "query_id long, keywords string, vector array<double>")
    chosen = spark.createDataFrame([(q, p) for q in (7, 8, 9) for p in "pqr" if (q, p) != (8, "q")] + [(7, "none")],
                                   "query_id long, person_id string")
    return chunks, vectors, queries, chosen


@pytest.mark.parametrize("budget, rows, head", [(60, 8, 2), (400, 16, 4), (10_000, 30, 3), (60, 8192, 128)])
def test_evidence_of_blocks_equals_evidence_of_all_pairs(spark, budget, rows, head):
    chunks, vectors, queries, chosen = _collection(spark)
    terms = R.query_terms(queries)
    got = O.evidence_hits(chunks, vectors, queries, chosen, *R.small_terms(terms), budget, R.RRF_K, tokenize, rows, head)
    want = R.evidence_by_joins(chunks, vectors, queries, chosen, budget, R.RRF_K, tokenize)

    def found(df):
        return sorted((r.query_id, r.person_id, r.evidence_rank, r.chunk_id, round(r.rrf, 12), round(r.similarity, 9)) for r in df.collect())

    assert found(got) == found(want) and len(found(got)) > 8


def test_evidence_makes_no_row_per_query_and_chunk(spark):
    chunks, vectors, queries, chosen = _collection(spark)
    made = []
    cut = O.cut_lineage
    try:
        O.cut_lineage = lambda df: made.append((out := cut(df)).count()) or out
        R.person_evidence(chunks, vectors, queries, chosen, 30).count()
    finally:
        O.cut_lineage = cut
    assert made and max(made) < 160


def test_an_index_is_written_without_a_row_per_posting_in_between(spark, tmp_path, monkeypatch):
    frame = lambda some: spark.createDataFrame(some, "chunk_id long, content string")
    old = [(i, " ".join(f"w{j}" for j in range(i % 40))) for i in range(300)] + [(None, "w1")]
    new = [(i, t if i is None or i % 3 else f"{t} new") for i, t in old[10:]] + [(1000, "w1 w2"), (1001, None)]
    path, asked = str(tmp_path / "ix"), spark.createDataFrame([(1, "w1 w2 new"), (2, "w39 w3")], "query_id long, keywords string")
    made = []
    cut = IX.cut_lineage
    monkeypatch.setattr(IX, "cut_lineage", lambda df: made.append((out := cut(df)).count()) or out)
    monkeypatch.setattr(IX, "PLACE_ROWS", 16)  # several places a shard
    IX.build_index(frame(old), path, 8)
    assert IX.refresh_index(frame(new), path, 8) == 8 and IX.refresh_index(frame(new), path, 8) == 0
    assert max(made) <= 300
    got, want = (sorted(tuple(r) for r in df.select("query_id", "chunk_id", "bm25", "rank").collect()) for df in (
        IX.search_index(spark, path, asked, 200), R.bm25_topk(frame([r for r in new if r[0] is not None]), asked, 200)))
    assert got == want and got


@pytest.mark.parametrize("hot, few", [(10**6, True), (10**6, False), (3, False)])
def test_updates_equal_a_comparison_of_all_pairs_and_are_not_checkpointed(spark, monkeypatch, hot, few):
    rnd = random.Random(3)
    titles = ["ege liman gemi", "ege liman", "ege liman gemi vinç", "bor kompozit", "liman gemi bor ege"]
    day = lambda: None if rnd.random() < 0.1 else date(2024, 1, 1) + timedelta(days=rnd.randint(0, 9))
    calls = [(f"c{i:02d}", f"u{i}", rnd.choice(titles), rnd.choice([None, "x", "Y "]), day()) for i in range(30)]
    ann = [(f"u{i}" if i % 20 == 0 else f"n{i}", rnd.choice(titles), rnd.choice(["X", "y", None]), day()) for i in range(900)]

    def best(url, title, code, at):
        found = []
        for call, own, name, other, day in calls:
            a, b, same = set(title.split()), set(name.split()), code is not None and other is not None and code.lower() == other.strip().lower()
            overlap, day = len(a & b) / len(b), date.min if day is None else day
            if own != url and day <= (at or date.max) and overlap >= (0.5 if same else 0.7):
                found.append((-overlap - 0.5 * same, -day.toordinal(), call))
        return min(found)[2] if found else None

    made, cut = [], A.cut_lineage
    monkeypatch.setattr(A, "cut_lineage", lambda df: made.append((out := cut(df)).count()) or out)
    monkeypatch.setattr(A, "HOT_ROWS", hot)
    if not few:
        monkeypatch.setattr(A, "is_small", lambda df, *a: False)
    out = A.match_update_to_call(spark.createDataFrame(ann, "url string, title string, program_code string, publish_date date"),
                                 spark.createDataFrame(calls, "call_id string, url string, title string, program_code string, publish_date date"))
    assert sorted((r.url, r.call_id) for r in out.collect()) == sorted((u, c) for u, *rest in ann if (c := best(u, *rest)))
    assert max(made) < 300


def test_ingestion_folds_each_title_and_text_once_with_the_same_outcome(spark, monkeypatch):
    titles = ["Ege çağrısı", "Süresi uzatıldı: Ege çağrısı", "Bilim fuarı", None, "Liman destek programı 1001"]
    texts = ["Proje başvurusu 5 Mayıs 2024", "", None, "duyuru"]
    rows = [(f"n{i}", titles[i % 5], "s", date(2024, 1, 1 + i % 9) if i % 7 else None, texts[i % 4]) for i in range(200)]
    items = spark.createDataFrame(rows, I.ITEM)
    ledger, calls = spark.createDataFrame([], I.LEDGER), spark.createDataFrame([], I.CALL)
    folded, ruled = [], I._ruled
    monkeypatch.setattr(I, "_ruled", lambda df: folded.append(df.count()) or ruled(df))

    def outcome():
        out = I.ingest_batch(items, ledger, calls)
        return [sorted(map(str, df.select(*sorted(df.columns)).collect())) for df in (out.ledger, out.new_calls, out.updates)]

    once = outcome()
    assert folded and max(folded) <= 20
    monkeypatch.setattr(I, "REPEATS", 10**9)
    assert outcome() == once and len(once[0]) == 200 and once[1] and once[2]


def test_large_files_are_hashed_line_by_line(spark, tmp_path, monkeypatch):
    rnd = random.Random(1)
    some = {"a b.pdf": rnd.randbytes(300_000), "b.pdf": rnd.randbytes(50_000) + b"\n", "c.pdf": b"\xef\xbb\xbf" + rnd.randbytes(40_000),
            "d.pdf": b"\xef\xbb\xbfx\r\n" * 9000, "e.pdf": b"\n" * 20_000, "f.pdf": b"x" * 30_000, "g.pdf": b"small"}
    (tmp_path / "in").mkdir()
    for name, data in some.items():
        (tmp_path / "in" / name).write_bytes(data)
    monkeypatch.setattr(S, "WHOLE_BYTES", 10_000)
    monkeypatch.setattr(S, "BLOCK_BYTES", 3000)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r.name: (r.n_bytes, r.content_hash) for r in S.scan_documents(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in some.items()}
