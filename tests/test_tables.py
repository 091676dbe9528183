"""Grounding of nested records; keyed tables in buckets; exports that are read back."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scholarmesh.operators import sections as T
from scholarmesh.operators import snapshot as N
from scholarmesh.sources import sinks as K

RECORD = """identity struct<title: string>, contact struct<email: string, orcid: string>, areas array<string>,
education array<struct<university: string, thesis: string>>, posts array<struct<role: string, year: int>>,
publications array<struct<title: string, venue: string>>, metrics struct<citations: int, h_index: int>, note string"""
TEXT = """Ayşe Yılmaz, ayse@example.edu, yapay zeka. Ege Üniversitesi doktora: Derin Öğrenme ile Görüntü İşleme.
Bölüm Başkanı 2015. Akıllı tarım sistemleri üzerine bir inceleme. Tarım Dergisi. h-indeksi 12"""


def files(path):
    return {(p.parent.name, p.name) for p in Path(path).rglob("*.parquet")}


def ground(spark, *rows):
    frame = spark.createDataFrame([(text, cv) for text, cv in rows], f"text string, cv struct<{_nested(RECORD)}>")
    return [r.cv for r in T.ground_nested(frame, "cv").collect()]


def _nested(fields):
    out, depth = [], 0
    for word in fields.replace("\n", " ").split(", "):
        name, sep, rest = word.strip().partition(" ")
        out.append(f"{name}: {rest}" if sep and depth == 0 else word)
        depth += word.count("<") - word.count(">")
    return ", ".join(out)


def test_a_nested_record_keeps_what_its_text_bears_out(spark):
    cv = ({"title": "Doktor Öğretim Üyesi"}, {"email": "AYSE@example.edu", "orcid": "0000-0001"}, ["Yapay Zeka", "Kuantum optiği"],
          [("Ege Üniversitesi", "Derin Öğrenme ile Görüntü İşleme — Prof. Dr. Ali Kaya"), ("Oxford", "Derin Öğrenme"),
           ("Ege Üniversitesi", "Nadir toprak mıknatısları")],
          [("Bölüm Başkanı", 2015), ("Rektör", 1999)],
          [("Akıllı tarım sistemleri üzerine bir inceleme. Tarım Dergisi", "Tarım Dergisi"), ("Mars yolculuğu", None)], (0, 12), "kalır")
    got = ground(spark, (TEXT, cv))[0]
    assert got.identity.title == "Dr. Öğr. Üyesi"
    assert (got.contact.email, got.contact.orcid) == ("AYSE@example.edu", None)
    assert got.areas == ["Yapay Zeka"]
    assert [tuple(e) for e in got.education] == [("Ege Üniversitesi", "Derin Öğrenme ile Görüntü İşleme"), ("Ege Üniversitesi", None)]
    assert [tuple(p) for p in got.posts] == [("Bölüm Başkanı", 2015)]
    assert [tuple(p) for p in got.publications] == [("Akıllı tarım sistemleri üzerine bir inceleme", "Tarım Dergisi")]
    assert tuple(got.metrics) == (None, 12) and got.note == "kalır"


def test_null_records_lists_and_texts_stay_defined(spark):
    empty = (None, None, None, None, [], [], None, None)
    got = ground(spark, (TEXT, empty), (TEXT, None), (None, ({"title": "Prof"}, None, ["Yapay Zeka"], None, None, None, None, None)))
    assert tuple(got[0]) == empty and got[1] is None
    assert got[2].identity.title == "Prof. Dr." and not got[2].areas


def test_a_policy_for_unknown_fields_is_refused_when_strict(spark):
    frame = spark.createDataFrame([("a", ("b",))], "text string, cv struct<name: string>")
    with pytest.raises(ValueError, match="posts"):
        T.ground_nested(frame, "cv", {"posts.role": T.verbatim}, strict=True)
    assert T.ground_nested(frame, "cv", {"name": T.verbatim}, strict=True).first().cv.name is None


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    K.write_buckets(spark.range(200).select("id", F.lit("a").alias("hash")), path, "id", 16)
    before = files(path)
    fresh = spark.createDataFrame([(5, "b"), (900, "c")], "id long, hash string")
    actions = spark.createDataFrame([(5, "process"), (900, "process"), (7, "delete"), (8, "skip")], "id long, action string")
    K.replace_buckets(spark, path, fresh, actions, "id", 16)
    got = {r.id: r.hash for r in K.read_buckets(spark, path, "id").collect()}
    assert got == {n: "a" for n in range(200) if n not in (5, 7)} | {5: "b", 900: "c"}
    touched = {f"bucket={r.b}" for r in fresh.union(spark.createDataFrame([(7, "")], "id long, hash string")).select(
        K.bucket_of("id", 16).alias("b")).collect()}
    after = files(path)
    assert {f for f in before if f[0] not in touched} == before & after
    assert {folder for folder, _ in before - after} == touched


def test_a_bucket_whose_last_row_goes_is_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    K.write_buckets(spark.range(3).withColumn("hash", F.lit("a")), path, "id", 4)
    actions = N.sync_actions(spark.range(0).withColumn("hash", F.lit("a")), K.read_buckets(spark, path, "id"))
    K.replace_buckets(spark, path, spark.range(0).withColumn("hash", F.lit("a")), actions, "id", 4)
    assert K.read_buckets(spark, path, "id").count() == 0
    K.replace_buckets(spark, path, spark.range(0).withColumn("hash", F.lit("a")), actions.limit(0), "id", 4)


def test_null_keys_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="a key is null"):
        K.write_buckets(spark.createDataFrame([(None, "a")], "id long, hash string"), str(tmp_path / "t"), "id")


def test_exported_cells_come_back(spark, tmp_path):
    odd = 'a;"b"\n"";c\\ '
    rows = spark.createDataFrame([(1, 2, odd, "", "x", odd, 50, "r\n\nq", "")], "query_id long, rank int, title string, name string, "
                                 "university string, department string, score int, rationale string, evidence string")
    K.write_match_csv(rows, str(tmp_path / "m"))
    assert [tuple(r) for r in K.read_match_csv(spark, str(tmp_path / "m")).collect()] == [tuple(r) for r in rows.collect()]
