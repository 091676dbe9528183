"""Column functions on hand-made cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from scholarmesh.functions import cleaning as L
from scholarmesh.functions import extraction as E
from scholarmesh.functions import hashing as H
from scholarmesh.functions import text as X
from scholarmesh.operators import budget as G


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} string" for k in inputs)) if inputs else spark.range(1)
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize("text, expected", [
    ("GÖRÜNTÜ İşleme", "goruntu isleme"), ("IŞIK ılık", "isik ilik"), ("ﬁkir ½ №…", "fikir 12 No..."), ("Straße 日本", "strae "), ("", "")])
def test_fold(spark, text, expected):
    assert value(spark, X.fold(F.col("t")), t=text) == expected


def test_simplify_ignores_entities_accents_and_case(spark):
    for a, b in [("Mechanics &amp; Fabrication", "mechanics & fabrication"), ("Yapay Zekâ", "yapay zeka"), ("STRASSE", "straße"),
                 ("a&#233;b", "aÉb"), ("x &lt;&#x41;&gt;", "x a")]:
        assert value(spark, X.simplify(F.col("t")), t=a) == value(spark, X.simplify(F.col("t")), t=b)


def test_titles(spark):
    assert value(spark, X.tr_title_case(F.col("t")), t="LİMAN VE IŞIK BÖLÜMÜ") == "Liman ve Işık Bölümü"
    assert value(spark, X.tr_title_case(F.col("t")), t="Zaten Düzgün") == "Zaten Düzgün"
    for text, short in [("Doçent", "Doç. Dr."), ("Yrd. Doç.", "Dr. Öğr. Üyesi"), ("Öğr.Gör.Dr.", "Öğr. Gör. Dr."), ("Rektör", "Rektör"), (None, None)]:
        assert value(spark, X.short_title(F.col("t")), t=text) == short


@pytest.mark.parametrize("text, expected", [
    ("Mayıs 3, 2024", date(2024, 5, 3)), ("7 Eylül 2025 | 09:30", date(2025, 9, 7)), ("31 Şubat 2024", None), ("dün", None)])
def test_parse_tr_date(spark, text, expected):
    assert value(spark, E.parse_tr_date(F.col("t")), t=text) == expected


def test_grounding(spark):
    source = "Bütçe 1.500.000 TL, son gün 9 Kasım 2025. Vakıf doktoralı araştırmacı arıyor."
    ok = E.grounded(F.col("v"), E.source_words(F.col("s")), E.source_numbers(F.col("s")))
    for text, expected in [("1500000 TL", True), ("2025-11-09", True), ("2025-12-09", False), ("vakfın doktora", True),
                           ("tamamen uydurma", False), ("", False), ("007", False), ("9", True)]:
        assert value(spark, ok, v=text, s=source) is expected, text


def test_decisions_and_codes(spark):
    code = E.program_code(F.col("m"), F.col("t"), F.lit(True))
    assert value(spark, code, m="GİSEP-2025-1", t="Yeni destek 2025") == "GISEP"
    assert value(spark, code, m="null", t="1001 Programı") == "1001"
    assert value(spark, code, m="null", t="12.1001 sayılı") is None
    kind = E.decide(F.lit("cagri"), F.col("s"), F.lit("-"), F.col("t"), F.lit("metin"))["kind"]
    assert value(spark, kind, s="proje", t="Proje çağrısı") == "cagri"
    assert value(spark, kind, s="proje", t="Haber") == "cagri_degil"
    assert value(spark, kind, s="yok", t="Proje çağrısı") == "cagri_degil"
    assert value(spark, E.link_label(F.lit("Tıklayınız!"), F.lit("https://www.a.org/x"))) == "a.org"
    assert value(spark, E.blacklist_stem(F.lit("Yaz SEMİNERİ ve burs sonuçları"))) == "seminer"
    assert value(spark, E.blacklist_stem(F.lit("Konsorsiyum çağrısı"))) is None


def test_application_dates(spark):
    for label, flag, expected in [("E-imza için son gün", False, True), ("Sözleşme imzası", True, False), ("Çağrının açılışı", True, False),
                                  ("Son gün", True, True), ("Son gün", False, False)]:
        assert value(spark, E.is_application_date(F.lit(label), F.lit(flag))) is expected


PROGRAM = "Toplam bütçesi 80.000.000 TL olan programda proje başına azami 4.000.000 TL destek verilir."


@pytest.mark.parametrize("project, program, text, expected", [
    ("azami 4.000.000 TL", "80.000.000 TL", PROGRAM, ("azami 4.000.000 TL", "80.000.000 TL")),
    ("80.000.000 TL", None, PROGRAM, (None, "80.000.000 TL")),
    ("9 milyon TL", None, "Bugüne kadar 12 proje 9 milyon TL ile desteklenmiştir.", (None, None)),
    ("4.000.000 TL", "4.000.000,00 TL", PROGRAM, ("4.000.000 TL", None)),
    ("Toplam bütçe 4.000.000 TL", None, PROGRAM, ("4.000.000 TL", None)),
    (None, "bütçe sonra açıklanır", PROGRAM, (None, None)),
    ("50.000 TL", None, "PTİ miktarı ise 50.000 TL olur.", (None, None)),
    ("7.000 TL", None, "Tutar 7.000 TL", ("7.000 TL", None))])
def test_split_budget(spark, project, program, text, expected):
    b = value(spark, G.split_budget(F.col("a"), F.col("b"), F.col("t")), a=project, b=program, t=text)
    assert (b.project_budget, b.program_budget) == expected


def test_markers_tails_and_spelling(spark):
    text = "Deniz projesi (S7, S9) var. Gücü S3, tezleri U1 ve U2 ile artar. B4C kalır."
    assert value(spark, X.strip_markers(F.col("t")), t=text) == "Deniz projesi var. Gücü, tezleri ile artar. B4C kalır."
    assert value(spark, X.strip_title_tail(F.col("t"), F.col("v")), t="Liman yönetimi üzerine. Deniz Dergisi, 3(2)", v="Deniz Dergisi") == "Liman yönetimi üzerine"
    assert value(spark, X.strip_advisor(F.col("t")), t="Gemi hızı — Prof. Dr. A") == "Gemi hızı"
    assert value(spark, X.restore_spelling(F.col("v"), F.col("s")), v="Dokuz Eyl\x00l", s="X DOKUZ EYLÜL Y") == "DOKUZ EYLÜL"
    assert value(spark, X.restore_spelling(F.col("v"), F.col("s")), v="yok\x00", s="abc") == "yok"


def test_cleaning_and_ids(spark):
    assert value(spark, L.clean_text(F.col("t")), t="oﬃs ka-\nlem\n• madde  bir\n\n\n\nson ") == "offis kalem\n- madde bir\n\nson"
    assert value(spark, L.clean_markdown(F.col("t")), t="# **A** b  \n**c**") == "# A b\n**c**"
    import uuid
    assert value(spark, H.stable_id(F.lit("C1"), F.lit(3))) == str(uuid.uuid5(H.ID_NAMESPACE, "C1/3"))
    assert value(spark, X.id_from_filename(F.col("t")), t="012_Prof_Dr_Ada_Su_Kenar-Bir") == "C012_Ada_Su"
    assert value(spark, X.period(F.lit("01.03.2022"), F.lit("2024"))) == "2022–2024"
    assert value(spark, X.highlight_terms(F.lit("Gemi <b> hidrodinamiği"), X.highlight_stems(F.array(F.lit("hidrodinamik"))))) == (
        "Gemi &lt;b&gt; <mark>hidrodinamiği</mark>")
