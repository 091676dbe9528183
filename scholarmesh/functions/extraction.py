"""Rules that correct and verify extracted call fields: dates, grounding, codes, audience, decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholarmesh.functions.text import fold, let

# Folded Turkish month names, January first.
MONTHS = ["ocak", "subat", "mart", "nisan", "mayis", "haziran",
          "temmuz", "agustos", "eylul", "ekim", "kasim", "aralik"]

# Stems that mark a title as other than a project call, matched at a word start.
BLACKLIST = [
    "sonuc", "finalist", "yarisma", "odul", "olimpiyat",
    "lise", "ortaokul", "ilkokul", "ogrencileri", "burs",
    "bilim fuar", "bilim senlik", "bilim soylesi", "bilim merkez", "okullar",
    "yenilikci egitim uygulama", "kapsayici toplum",
    "etkinlikleri destekle", "etkinliklere katilim", "egitim etkinlik", "gozlem etkinlik",
    "katilim destegi", "toplantisina katilim",
    "kis okulu", "calistay", "seminer", "zirve", "kongre", "bilgi gunu", "proje pazari",
    "rehber", "onaylandi", "son asamaya",
    "ziyaret", "hakem", "webinar", "tamamlandi", "hak kazan", "protokol imza", "mesaji", "sikca sorulan",
    "toplantisi", "bilgilendirme etkinli", "bilgilendirme program", "egitimi duzenlen", "mentorlu",
    "yardim masasi", "satin alma", "yururluge gir",
    "kpss", "sinav", "atama", "uzman yardimci", "personel alim", "alim ilani", "alinacaktir",
]

# Patterns on folded text.
APPLICATION_WORD = "basvur|cagri|teklif"
INDUSTRY_TITLE = r"\b(eureka|eurostars|ira-sme|cornet|bigg|kobi|girisim|startup|hizlandirici)"
INDUSTRY_CODE = r"^1[5-8]\d\d$"
UNIVERSITY = r"\buniversite"
NEGATION = r"\b(olamaz|olamayacak|haric|disinda|degil|alt yuklenici|danisman)"
PUBLICATION_LABEL = r"\b(yayim|yayin|ilan|acilis|acilma|acildig)"
APPLICATION_LABEL = r"(\be-?imza|basvur|teslim)"
AFTERWARDS_LABEL = r"(sonuc|degerlendir|sozlesme|baslang|duyur|itiraz|hak kazan)"
GENERIC_LINK_LABEL = r"^(tikla[a-z0-9_]*|buraya?|buradan|link|baglanti|detay[a-z0-9_]*|devami[a-z0-9_]*)[^a-z0-9_]*$"
PROGRAM_NUMBER = r"(?<![\d.,])(?!20\d\d)([1-4]\d{3})(?![\d.,])"
NO_CODE = ["NULL", "NONE", "YOK"]
MIN_WORD_OVERLAP = 0.5


def blacklist_stem(title: Column, stems: list[str] | None = None) -> Column:
    """Leftmost blacklist stem at a word start of the folded title, else null."""
    alternatives = "|".join(stems or BLACKLIST)
    return F.nullif(F.regexp_extract(fold(title), rf"\b({alternatives})", 1), F.lit(""))


# --- dates ------------------------------------------------------------------------------

def _date_of(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y.cast("string"), m.cast("string"), d.cast("string")), "y-M-d")


def parse_tr_date(c: Column) -> Column:
    """Date of a text with a Turkish month name, a year (first number above 1900) and a day, in any order."""
    names = F.array(*map(F.lit, MONTHS))

    def date(words: Column) -> Column:
        months = F.filter(F.transform(words, lambda w: F.array_position(names, w)), lambda i: i > 0)
        digits = F.filter(words, lambda w: F.left(w, F.lit(1)).between("0", "9"))  # a failing cast of every other word is slow
        numbers = F.filter(F.transform(digits, lambda w: w.try_cast("int")), lambda n: n.isNotNull())
        year = F.try_element_at(F.filter(numbers, lambda n: n > 1900), F.lit(1))
        day = F.try_element_at(F.filter(numbers, lambda n: n.between(1, 31)), F.lit(1))
        month = F.try_element_at(months, F.lit(1))
        return F.when(year.isNotNull() & day.isNotNull() & month.isNotNull(), _date_of(year, month, day))

    return let(F.regexp_extract_all(fold(c), F.lit("[a-z]+|[0-9]+"), F.lit(0)), date)


def url_date(url: Column) -> Column:
    """Date at the end of an address, '-YYYYMMDD' with or without a slash."""
    digits = F.regexp_extract(url, r"-(\d{8})/?$", 1)
    return F.when(digits != "", F.try_to_date(digits, "yyyyMMdd"))


# --- grounding --------------------------------------------------------------------------

def source_words(text: Column) -> Column:
    """Distinct five-letter stems of the folded words of three letters or more."""
    words = F.regexp_extract_all(fold(text), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_distinct(F.transform(words, lambda w: F.left(w, F.lit(5))))


def source_numbers(text: Column) -> Column:
    """Distinct numbers (no thousands separators or leading zeros), and the numbers of months named."""
    names = F.array(*map(F.lit, MONTHS))
    named = F.regexp_extract_all(fold(text), F.lit(rf"\b({'|'.join(MONTHS)})"), F.lit(1))
    months = F.transform(named, lambda m: F.array_position(names, m).cast("string"))
    joined = F.regexp_replace(text, r"(?<=\d)[.,\s](?=\d{3}(?![\p{L}\p{N}_]))", "")
    digits = F.transform(F.regexp_extract_all(joined, F.lit(r"\d+"), F.lit(0)),
                         lambda n: F.regexp_replace(n, r"^0+(?=\d)", ""))
    return F.array_distinct(F.concat(digits, months))


def grounded(value: Column, words: Column, numbers: Column) -> Column:
    """True iff all numbers of the value are in the source and at least half of its words.

    `words` and `numbers` are the source's arrays, computed once per row; a value without words needs a number.
    """
    def verdict(v: Column) -> Column:
        numbers_ok = F.size(F.array_except(v["n"], numbers)) == 0
        words_ok = F.size(F.array_intersect(v["w"], words)) >= MIN_WORD_OVERLAP * F.size(v["w"])
        return numbers_ok & F.when(F.size(v["w"]) == 0, F.size(v["n"]) > 0).otherwise(words_ok)

    parts = F.struct(source_words(value).alias("w"), source_numbers(value).alias("n"))
    return (F.coalesce(value, F.lit("")) != "") & let(parts, verdict)


# --- codes, audience, decisions ----------------------------------------------------------

def program_code(model_code: Column, title: Column, numeric_source: Column) -> Column:
    """Program number in the title (numeric-code sources only), else the model's code up to its first separator."""
    number = F.nullif(F.regexp_extract(F.coalesce(title, F.lit("")), PROGRAM_NUMBER, 1), F.lit(""))
    first = F.upper(fold(F.element_at(F.split(F.trim(F.coalesce(model_code, F.lit(""))), r"[\s,;/_-]+"), 1)))
    short = F.when(first.rlike(r"^[A-Z0-9+]{2,10}$") & ~first.isin(NO_CODE), first)
    return F.coalesce(F.when(numeric_source, number), short)


def universities_eligible(conditions: Column) -> Column:
    """True iff a condition names universities without a negating word."""
    return F.exists(F.transform(conditions, fold), lambda k: k.rlike(UNIVERSITY) & ~k.rlike(NEGATION))


def audience(model_audience: Column, code: Column, title: Column, conditions: Column, numeric_source: Column,
             academic: str = "academic", industry: str = "industry") -> Column:
    by_code = numeric_source & F.coalesce(code.rlike(INDUSTRY_CODE), F.lit(False))
    by_title = fold(F.coalesce(title, F.lit(""))).rlike(INDUSTRY_TITLE)
    return (F.when(by_code | by_title, F.lit(industry))
            .when(~numeric_source & universities_eligible(conditions), F.lit(academic))
            .otherwise(model_audience))


def is_application_date(label: Column, model_flag: Column) -> Column:
    """False for publication and later steps, true for application labels, else the model's flag."""
    return let(fold(label), lambda f: (
        F.when(f.rlike(PUBLICATION_LABEL) | f.rlike(AFTERWARDS_LABEL), F.lit(False))
        .when(f.rlike(APPLICATION_LABEL), F.lit(True)).otherwise(model_flag)))


def clean_dates(dates: Column, words: Column, numbers: Column) -> Column:
    """Valid ISO dates that the source supports, one per (label, date), flags corrected, sorted by date."""
    def tidy(t: Column) -> Column:
        label = F.trim(t["label"])
        return F.struct(F.try_to_date(t["date"], "yyyy-MM-dd").alias("date"), label.alias("label"),
                        is_application_date(label, t["is_application"]).alias("is_application"))

    valid = F.filter(F.transform(dates, tidy),
                     lambda t: t["date"].isNotNull() & grounded(t["date"].cast("string"), words, numbers))
    indexed = F.transform(valid, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    # the last entry of a (label, date) wins, as later entries overwrite
    last = let(indexed, lambda rows: F.filter(rows, lambda a: ~F.exists(rows, lambda b: (b["i"] > a["i"]) & (
        b["t"]["date"] == a["t"]["date"]) & (b["t"]["label"] == a["t"]["label"]))))
    return F.transform(F.array_sort(F.transform(last, lambda a: F.struct(
        a["t"]["date"].alias("date"), a["t"]["label"].alias("label"),
        a["t"]["is_application"].alias("is_application")))),
        lambda t: F.struct(t["label"].alias("label"), t["date"].alias("date"),
                           t["is_application"].alias("is_application")))


def deadline(dates: Column) -> Column:
    """Latest application date of an array of dates; a missing flag counts as application; none gives null."""
    applying = F.filter(dates, lambda t: F.coalesce(t["is_application"], F.lit(True)))
    return F.array_max(F.transform(applying, lambda t: t["date"]))


def call_status(deadline_: Column, today: Column) -> Column:
    return (F.when(deadline_.isNull(), F.lit("belirsiz")).when(deadline_ >= today, F.lit("acik"))
            .otherwise(F.lit("gecmis")))


def has_application_word(title: Column, text: Column) -> Column:
    return fold(F.concat_ws(" ", F.coalesce(title, F.lit("")), text)).rlike(APPLICATION_WORD)


def decide(kind: Column, submitted: Column, reason: Column, title: Column, text: Column, has_word: Column | None = None) -> Column:
    """Final (kind, reason): only project calls with an application word in title or text (`has_word`, if known) stay calls."""
    not_call = F.lit("cagri_degil")
    has_word = has_application_word(title, text) if has_word is None else has_word
    return F.when(kind == not_call, F.struct(kind.alias("kind"), reason.alias("reason"))).when(
        submitted != "proje",
        F.struct(not_call.alias("kind"),
                 F.concat(F.lit("başvurulan: "), submitted, F.lit(" ("), reason, F.lit(")")).alias("reason"))).when(
        ~has_word,
        F.struct(not_call.alias("kind"),
                 F.concat(F.lit("metinde başvuru/çağrı ifadesi yok ("), reason, F.lit(")")).alias("reason"))
    ).otherwise(F.struct(kind.alias("kind"), reason.alias("reason")))


def link_label(label: Column, url: Column) -> Column:
    """Label, or the host without 'www.' where the label says nothing ('tıklayınız')."""
    host = F.regexp_replace(F.parse_url(url, F.lit("HOST")), r"^www\.", "")
    return F.when(fold(F.trim(label)).rlike(GENERIC_LINK_LABEL), host).otherwise(label)


# --- title tokens of announcements --------------------------------------------------------

# Five-letter stems without meaning for matching announcement titles.
TITLE_STOP_STEMS = [
    "cagri", "basvu", "sures", "uzati", "gunce", "takvi", "acild", "acili", "basla", "progr", "yili",
    "donem", "tubit", "kapsa", "ilisk", "bilgi", "belli", "oldu", "yayin", "deste",
    "tuseb", "kalki", "ajans", "ilan", "edild", "edilm",
]


def title_tokens(title: Column) -> Column:
    """Sorted distinct five-letter stems of the folded title without the stop stems."""
    stems = F.transform(F.regexp_extract_all(fold(title), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.left(w, F.lit(5)))
    return F.array_sort(F.array_except(stems, F.array(*map(F.lit, TITLE_STOP_STEMS))))
