"""The toxicity models on held-out rows, the pipeline against its parts, and the registered queries."""

import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as C
from scholarmesh.llm import toxicity as T

SF = "/root/testdata/sf0.001"
BAD = ["vile", "scum", "rotten", "nasty"]


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(2000)]
    rows = []
    for k in range(n):
        toxic = int(rng.random() < 0.15)
        text = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        if toxic:
            for _ in range(max(2, len(text) // 25)):
                text[rng.randrange(len(text))] = rng.choice(BAD)
        rows.append((k, " ".join(text), toxic))
    return rows


def test_held_out_rows_are_told_apart(spark, docs_of):
    rows = corpus()
    labels = spark.createDataFrame([(d, x if d % 5 else None) for d, _, x in rows] + [(d, 0) for d, _, _ in rows[:20]], "doc_id long, toxic int")
    docs = docs_of([(d, t) for d, t, _ in rows] + [(5000, None), (5001, ""), (None, "w1"), (5002, "w1 " * 50_000)])
    out = T.toxicity(docs, labels).collect()
    assert len(out) == len(rows) + 4 and all(0 <= r.score <= 1 for r in out)
    want = {d: x for d, _, x in rows}
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(want[r.doc_id], r.score >= 0.5) for r in out if r.held_out and r.doc_id in want]
    assert np.mean([a == b for a, b in held]) >= 0.97 and sum(b for _, b in held) > 5


def test_labels_of_the_held_out_fold_are_not_used(spark, docs_of):
    rows = corpus(300)
    docs = docs_of([(d, t) for d, t, _ in rows])
    def scores(flip):
        labels = spark.createDataFrame([(d, 1 - x if flip and zlib.crc32(str(d).encode()) % 5 == 0 else x) for d, _, x in rows], "doc_id long, toxic int")
        return sorted((r.doc_id, r.score) for r in T.toxicity(docs, labels).collect())
    assert scores(True) == scores(False)


def test_counts_are_texts_with_the_expression(spark):
    texts = spark.createDataFrame([(1, "Bad bad day"), (0, "day, day!"), (0, "")], "toxic int, text string")
    got = T.counted(texts).where("level = 0").groupBy().agg(F.sum("ordinary"), F.sum("toxic")).first()
    assert tuple(got) == (1, 2)


def test_expressions_are_told_apart_however_many_there_are(spark):
    texts = [(n % 2, " ".join(f"v{n}x{k}" for k in range(5000))) for n in range(300)]  # 1.5 million words and pairs
    got = T.counted(spark.createDataFrame(texts, "toxic int, text string").repartition(4)).groupBy("level").agg(
        F.count(F.lit(1)), F.max(F.col("ordinary") + F.col("toxic"))).collect()
    assert sorted(map(tuple, got)) == [(0, 1_500_000, 1), (1, 1_500_000, 1)]


def test_means_equal_sums_over_words(spark, docs_of, monkeypatch):
    rows = corpus(300)
    texts = [(x, t) for _, t, x in rows]
    model = T.fit(T.counted(spark.createDataFrame(texts, "toxic int, text string")), ((1.0, 0.25), (1.0, 0.25)))
    excess = {(r.level, r.hash): (r.o, r.t) for r in model.collect()}
    docs = docs_of([(d, t) for d, t, _ in rows] + [(1, rows[1][1]), (900, None)]).withColumn("digest", F.lit("x"))
    want = []
    for d, t, _ in rows + [(1, rows[1][1], 0), (900, "", 0)]:
        raw = np.frombuffer(t.encode(), np.uint8)
        word, pair, _ = T.expressions(raw, np.array([0, len(raw)]))
        one = [np.array(excess.get((0, int(w)), (0, 0))) + excess.get((1, int(p)), (0, 0)) for w, p in zip(word.view(np.int64), pair.view(np.int64))]
        want.append((d, sum(np.log((1 + b) / (1 + a)) for a, b in one) / max(1, len(word))))
    for most in (T.SIEVE_BITS, 10):
        monkeypatch.setattr(T.sieve, "__defaults__", (most,))
        got = sorted((r.doc_id, r.mean) for r in T.means(docs, model).collect())
        assert [d for d, _ in got] == sorted(d for d, _ in want)
        assert np.allclose([m for _, m in got], [m for _, m in sorted(want)], atol=1e-7)
    assert len({k[0] for k in excess}) == 2


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1), (2, None)]])
def test_too_few_labels_give_the_smoothed_share(spark, docs_of, labels):
    df = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = T.toxicity(docs_of([(1, "a b"), (2, "c"), (3, None)]), df).collect()
    assert len({r.score for r in out}) == 1 and T.toxicity(docs_of([]), df).count() == 0


def test_rejected_documents_go_and_columns_stay(spark, docs_of):
    rows = corpus(600)
    df = docs_of([(d, t) for d, t, _ in rows] + [(None, "clean words"), (700, None)])
    labels = spark.createDataFrame([(d, x) for d, _, x in rows], "doc_id long, toxic int")
    out = T.without_toxic(df, labels)
    assert out.columns == df.columns
    left = {r.doc_id for r in out.select("doc_id").collect()}
    gone = {r.doc_id for r in T.toxicity(df, labels).where("score >= 0.5").collect()}
    assert gone and left == {r.doc_id for r in df.select("doc_id").collect()} - gone and None in left


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(60), text(150)
    rows = [(n, text(120)) for n in range(40)]
    rows += [(100 + n, text(50) + " " + passage + " " + text(50)) for n in range(4)]
    rows += [(200, base), (201, base), (202, base.replace(base.split()[70], "other"))]
    rows += [(300, text(40) + ' token = "0123456789abcdef0123456789abcdef" ' + text(40)), (301, None), (302, ""), (None, text(30)), (301, None)]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), 1) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, sequence_id long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(n, 1, 0) for n in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, passage


def test_stages_take_effect_and_keep_columns(spark, small, tmp_path):
    folder, rows, passage = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in C.STAGES:
        columns = docs.columns
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
            assert all(r.n_chars == len(r.text or "") for r in docs.collect() if r.text is not None)
    assert len(seen["toxicity"]) == len({d for d, _ in rows})
    assert 200 in seen["near_duplicates"] and not {201, 202} & set(seen["near_duplicates"])
    assert all(passage not in (t or "") for t in seen["repeated_passages"].values())
    assert all(len(seen["repeated_passages"][100 + n].split()) >= 98 for n in range(4))
    assert "0123456789abcdef" not in seen["secrets"][300] and "[REDACTED]" in seen["secrets"][300]
    assert all(seen["secrets"][n] == t for n, t in rows[:40])
    packed = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in packed} == set(seen["secrets"]) and all(r.n == r.t for r in packed)
    assert C.run(spark, folder).count() == docs.count()


def test_empty_tables_pass_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
    for name in ("op1_secret_scans", "op2_suffix_dedup", "op4_quality_rules", "op5_toxicity", "op6_token_files", "op7_near_dedup",
                 "op8_byte_encoding", "op9_fingerprints", "op10_packing"):
        assert entry.queries()[name](spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 11)])
def test_registered_queries_return_every_row(spark, name):
    query = next(q for q in entry.queries() if q.startswith(f"{name}_"))
    out = entry.queries()[query](spark, SF)
    got = out.collect()
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ids = {r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall()}
    if name == "op3":
        sql = con.execute(entry.oracle_sql()[query])
        columns = [d[0] for d in sql.description]
        assert sorted(columns) == sorted(out.columns)
        assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(sql.fetchall())
    else:
        assert {r.doc_id for r in got} == ids and (name == "op10" or len(got) == len(ids))
