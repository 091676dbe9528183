"""Small cases of the third round's findings."""

import math

import pytest

from pyspark.sql import functions as F

from scholarmesh.functions import extraction as E
from scholarmesh.functions import text as X
from scholarmesh.operators import retrieval as R
from scholarmesh.plans import texts


def test_scores_within_a_person_use_the_person_s_own_statistics(spark):
    chunks = spark.createDataFrame([(1, "p", "bor kompozit"), (2, "p", "deniz"), (3, "r", "bor bor")], "chunk_id int, person_id string, content string")
    terms = spark.createDataFrame([(1, "p", "bor", 1), (1, "r", "bor", 1)], "query_id int, person_id string, term string, qtf long")
    out = {(r.person_id, r.chunk_id): r.bm25 for r in R.bm25_scores(chunks, terms, ("person_id",)).collect()}
    own = math.log(1 + 1.5 / 1.5) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 1.5))
    other = math.log(1 + 0.5 / 1.5) * 2 * 2.5 / (2 + 1.5)
    assert out == {("p", 1): pytest.approx(own, abs=1e-6), ("r", 3): pytest.approx(other, abs=1e-6)}


def test_short_titles_lose_the_venue_behind_them(spark, tmp_path):
    rows = [(1, "Éaux", "fr", "src6", 4), (2, "De l'eau et du vent", "fr", "src2", 19), (3, "Éaux", "de", "src6", 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r.title for r in texts.title_tails(spark, str(tmp_path)).collect()}
    assert out == {1: "Éaux", 2: "De l'eau et du vent", 3: "Éaux"}


def test_dates_fold_their_text_once(spark):
    d = spark.createDataFrame([("İlan 5 EKİM 2024",), ("Proje çağrısı",), ("99999999999 3 ocak 2023",), ("3 OCAK 2023",), (None,)], "t string")
    got = d.select(E.parse_tr_date(F.col("t")).cast("string").alias("d"), X.fold(F.col("t")).alias("f"))
    assert [tuple(r) for r in got.collect()] == [("2024-10-05", "ilan 5 ekim 2024"), (None, "proje cagrisi"),
                                                 ("2023-01-03", "99999999999 3 ocak 2023"), ("2023-01-03", "3 ocak 2023"), (None, None)]
    assert str(got._jdf.queryExecution().optimizedPlan()).count("regexp_extract_all") == 1


def test_bm25_makes_no_row_per_chunk_and_query(spark, monkeypatch):
    rows = [(1, "bor kompozit"), (2, ""), (3, None), (4, "bor bor deniz"), (5, "deniz"), (5, "bor deniz"), (6, "bor"), (6, "bor"), (None, "bor")]
    chunks = spark.createDataFrame(rows, "chunk_id int, content string")
    queries = spark.createDataFrame([(1, "bor bor deniz"), (2, "deniz"), (3, "absent"), (4, None)], "query_id int, keywords string")
    best = R.bm25_topk(chunks, queries, 3)
    assert "Join" not in str(best._jdf.queryExecution().optimizedPlan())
    got = sorted(map(tuple, best.where("chunk_id is not null").collect()))
    monkeypatch.setattr(R, "WEIGHT_CELLS", 0)  # chunks and terms joined
    assert got and got == sorted(map(tuple, R.bm25_topk(chunks, queries, 3).where("chunk_id is not null").collect()))
    monkeypatch.undo()
    named = R.bm25_topk(chunks.withColumn("chunk_id", F.col("chunk_id").cast("string")), queries.withColumn("query_id", F.col("query_id").cast("string")), 2)
    assert {(r.query_id, r.chunk_id) for r in named.where("rank = 1").collect()} >= {("2", "5")}
