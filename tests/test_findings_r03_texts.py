"""Small cases of the third round's findings on texts: expressions are evaluated once a row, pages go in small blocks."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from scholarmesh.functions import text as X
from scholarmesh.operators import budget as G
from scholarmesh.sources import html as W


def test_highlighting_evaluates_the_stems_once_a_text(spark):
    texts = ["Bor  kompozit\n\nve <b> BORLAR' kompozitler\t", " kompozit — a&b kom-pozit", "", None, "　Kompozıt x kompozit ", "\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    marked = rows.select("n", "t", X.highlight_stems(F.array(F.left("t", F.lit(60)))).alias("s")).select(
        "n", "t", "s", X.highlight_terms(F.col("t"), F.col("s")).alias("m"))

    def expected(text, stems):
        def key(w):
            return re.sub("[^a-z0-9]", "", w.translate(str.maketrans("İI", "iı")).lower().translate(str.maketrans("çğıöşüâîû", "cgiosuaiu")))

        out = ""
        for p in re.findall(r"[ \t\n\r\f\v]+|[^ \t\n\r\f\v]+", text):
            e = p.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")
            out += f"<mark>{e}</mark>" if len(key(p)) > 3 and key(p)[:5] in stems else e
        return out

    for r in marked.collect():
        assert r.m == (None if r.t is None else expected(r.t, r.s))
    assert "array_contains(array_distinct" not in str(marked.select("m")._jdf.queryExecution().optimizedPlan())


def test_budgets_are_read_once_a_row(spark):
    rows = [("5.000 TL", "90.000 TL", "Toplam bütçesi 90.000 TL, proje başına azami 5.000 TL."), ("90.000 TL", None, "Toplam bütçesi 90.000,00 TL."),
            ("7 TL", "7 TL", "Destek 7 TL."), ("7 TL", "7 TL", "Toplam 7 TL."), ("3 TL", "", "bugüne kadar 3 TL desteklenmiş"), (None, None, None)]
    b = G.split_budget(F.col("a"), F.col("b"), F.col("t"))
    out = spark.createDataFrame(rows, "a string, b string, t string").select(b.alias("b")).select("b.*")
    assert [tuple(r) for r in out.collect()] == [("5.000 TL", "90.000 TL"), (None, "90.000 TL"), ("7 TL", None), (None, "7 TL"), (None, None), (None, None)]
    assert str(out._jdf.queryExecution().optimizedPlan()).count("regexp_extract_all") <= 4  # the text, the values, their wording


def test_pages_are_parsed_in_small_blocks(spark, monkeypatch):
    sizes = [10, None, 700, 0, 5000, 30, 30]
    htmls = pa.array([None if n is None else "x" * n for n in sizes])
    monkeypatch.setattr(W, "BLOCK_BYTES", 1000)
    assert [(b.start, b.stop) for b in W._blocks(htmls)] == [(0, 4), (4, 5), (5, 7)]
    pages = spark.range(300).repartition(1).select(F.col("id").alias("page_id"), F.lit("https://o.example/").alias("url"), F.concat(
        F.lit('<p>w</p><a href="/'), F.col("id").cast("string"), F.lit('">'), F.repeat(F.lit("y"), 9000), F.lit("</a>")).alias("html"))
    got = {r.page_id: (r.pos, r.url) for r in W.extract_links(pages).collect()}
    assert got == {n: (0, f"https://o.example/{n}") for n in range(300)}
    none = spark.createDataFrame([(1, None, None), (2, None, "")], "page_id int, url string, html string")
    assert sorted(r.page_id for r in W.extract_main_text(none, 0).collect()) == [1, 2] and W.extract_main_text(none.limit(0)).count() == 0
