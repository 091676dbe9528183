"""Shaping of documents and records: line packing, section chunks, section lists, common CV form, index texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarmesh.functions import extraction as E
from scholarmesh.functions import text as X

PACK_CHARS = 5000
CHUNK_SIZE = 485
CHUNK_OVERLAP = 50
SEPARATORS = ["\n", "; ", " "]  # item ends first
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"

# Section keys and their labels.
SECTION_LABELS = {
    "arastirma": "Araştırma ve Uzmanlık Alanları",
    "egitim": "Eğitim",
    "yayinlar": "Yayınlar",
    "projeler": "Projeler",
    "yonetilen_tezler": "Yönetilen Tezler",
    "patentler": "Patentler",
    "dersler": "Verdiği Dersler",
}
# Thesis levels.
THESIS_LEVELS = {"yuksek_lisans": "Yüksek Lisans", "doktora": "Doktora"}
# Fixed value: what a level of a doctorate or its equal in the arts contains.
DOCTORAL_LEVEL = r"(?i)dokt|ph\.?d|sanatta yeterlik"


def split_lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    lines = F.split(text, LINE_END)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def pack_lines(text: Column, size: int = PACK_CHARS) -> Column:
    """Array of pieces of whole lines: a line starts a new piece when the piece would grow beyond `size`.

    An over-long line stays whole. The fold is over one text's own lines.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, line: Column) -> Column:
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(line) > size)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.concat(F.when(full, F.lit("")).otherwise(acc["cur"]), line, F.lit("\n")).alias("cur"))

    return F.aggregate(split_lines(text), start, step, lambda acc: F.when(
        acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


def word_count(c: Column) -> Column:
    """Length in words; the default measure of chunk sizes (any column function can take its place)."""
    return F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)))


def split_text(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
               length_of: Callable[[Column], Column] = word_count) -> Column:
    """Array of chunks of at most `size`, cut at item ends, else at '; ', else at spaces, with up to `overlap` carried.

    A part that is itself too long is cut at the next separator and packed on its own; parts before and after it are
    not packed together with it.
    """
    def parts(c: Column, separator: str) -> Column:
        return F.filter(F.split(c, f"(?={separator})"), lambda p: p != "")

    def atom(t: Column, path: Column) -> Column:
        return F.struct(t.alias("t"), length_of(t).cast("int").alias("n"), path.alias("path"))

    def level3(t: Column, path: Column) -> Column:
        return F.transform(parts(t, SEPARATORS[2]), lambda p, i: atom(p, F.when(
            length_of(p) < size, path).otherwise(F.concat(path, F.lit("."), i.cast("string")))))

    def level2(t: Column, path: Column) -> Column:
        return F.flatten(F.transform(parts(t, SEPARATORS[1]), lambda p, i: F.when(
            length_of(p) < size, F.array(atom(p, path))).otherwise(
            level3(p, F.concat(path, F.lit("."), i.cast("string"))))))

    atoms = F.flatten(F.transform(parts(text, SEPARATORS[0]), lambda p, i: F.when(
        length_of(p) < size, F.array(atom(p, F.lit("")))).otherwise(level2(p, i.cast("string")))))

    item = "struct<t:string,n:int>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast(f"array<{item}>").alias("win"),
                     F.lit(0).alias("total"), F.lit("").alias("path"))

    def joined(win: Column) -> Column:
        return F.regexp_replace(F.array_join(F.transform(win, lambda w: w["t"]), ""), r"^\s+|\s+$", "")

    def emit(acc: Column) -> Column:
        return F.when((F.size(acc["win"]) > 0) & (joined(acc["win"]) != ""),
                      F.concat(acc["done"], F.array(joined(acc["win"])))).otherwise(acc["done"])

    def step(acc: Column, a: Column) -> Column:
        new_run = a["path"] != acc["path"]
        overflow = (acc["total"] + a["n"] > size) & (F.size(acc["win"]) > 0)
        # first position from which the rest is short enough to be carried over
        tails = F.transform(acc["win"], lambda w, i: F.aggregate(
            F.slice(acc["win"], i + 1, F.size(acc["win"])), F.lit(0), lambda s, x: s + x["n"]))
        fits = F.filter(F.transform(tails, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: (
            x["s"] <= overlap) & ((x["s"] + a["n"] <= size) | (x["s"] == 0)))
        first = F.try_element_at(fits, F.lit(1))
        carried = F.when(first.isNull(), F.array().cast(f"array<{item}>")).otherwise(
            F.slice(acc["win"], first["i"] + 1, F.size(acc["win"])))
        kept = F.when(new_run, F.array().cast(f"array<{item}>")).when(overflow, carried).otherwise(acc["win"])
        total = F.when(new_run, F.lit(0)).when(overflow, F.coalesce(first["s"], F.lit(0))).otherwise(acc["total"])
        return F.struct(
            F.when(new_run | overflow, emit(acc)).otherwise(acc["done"]).alias("done"),
            F.concat(kept, F.array(F.struct(a["t"].alias("t"), a["n"].alias("n")))).alias("win"),
            (total + a["n"]).cast("int").alias("total"), a["path"].alias("path"))

    return F.aggregate(atoms, start, step, emit)


def chunk_sections(records: DataFrame, sections: list[str], key: str = "person_id", size: int = CHUNK_SIZE,
                   overlap: int = CHUNK_OVERLAP, length_of: Callable[[Column], Column] = word_count,
                   labels: dict[str, str] = SECTION_LABELS) -> DataFrame:
    """(key, section, seq, content): chunks of each section's items, headed by the section label.

    `sections` are array<string> columns in order; empty sections give nothing; seq runs over the record's chunks.
    Everything happens inside the record's row.
    """
    def headed(section: str) -> Callable[[Column], Column]:
        return lambda t: F.struct(F.lit(section).alias("section"), F.concat(
            F.lit(f"[Bölüm: {labels.get(section, section)}]\n"), t).alias("content"))

    per_section = [F.transform(split_text(F.array_join(F.coalesce(s, F.array().cast("array<string>")), "\n"),
                                          size, overlap, length_of), headed(s)) for s in sections]
    return records.select(key, F.posexplode(F.concat(*per_section)).alias("seq", "_c")).select(
        key, "_c.section", "seq", "_c.content")


def format_sections(sections: dict[str, Column], labels: dict[str, str] = SECTION_LABELS) -> Column:
    """Markdown block of non-empty sections, for the profile model."""
    blocks = [F.when(F.size(items) > 0, F.concat(F.lit(f"## {labels.get(name, name)}\n"), F.array_join(
        F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n"))) for name, items in sections.items()]
    return F.concat_ws("\n\n", *blocks)


# --- section lists -------------------------------------------------------------------------------------

def concat_sections(lists: list[Column], distinct: list[Column] = ()) -> Column:
    """Lists of a record joined in order, those in `distinct` behind the others and without repeats; null lists are empty."""
    empty = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(c, empty) for c in lists], *[F.array_distinct(F.coalesce(c, empty)) for c in distinct])


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _suffix(c: Column, before: str = " (", after: str = ")") -> Column:
    return F.when(_filled(c), F.concat(F.lit(before), c, F.lit(after))).otherwise(F.lit(""))


def cv_sections(areas: Column, summary: Column, education: Column, publications: Column, projects: Column,
                theses: Column) -> dict[str, Column]:
    """Section lists of an extracted CV; authors and journals are left out on purpose."""
    level = F.create_map(*[F.lit(x) for pair in THESIS_LEVELS.items() for x in pair])
    return {
        "arastirma": F.concat(areas, F.when(_filled(summary), F.array(summary)).otherwise(
            F.array().cast("array<string>"))),
        "egitim": F.transform(F.filter(education, lambda e: _filled(e["thesis_title"])), lambda e: F.concat(
            e["degree"], F.lit(" tezi: "), e["thesis_title"])),
        "yayinlar": F.transform(publications, lambda y: F.concat(y["title"], _suffix(y["year"].cast("string")))),
        "projeler": F.transform(projects, lambda p: F.concat(p["name"], _suffix(p["period"]))),
        "yonetilen_tezler": F.transform(theses, lambda t: F.concat(
            F.coalesce(F.try_element_at(level, t["level"]), t["level"]), F.lit(": "), t["title"])),
    }


def has_content(sections: dict[str, Column]) -> Column:
    """True iff any section has an item; records without one are rejected."""
    out = F.lit(False)
    for items in sections.values():
        out = out | (F.coalesce(F.size(items), F.lit(0)) > 0)
    return out


def publication_line(title: Column, year: Column, venue: Column) -> Column:
    return F.concat(title, _suffix(year), F.when(_filled(venue), F.concat(F.lit(" — "), venue)).otherwise(F.lit("")))


def registry_sections() -> dict[str, Column]:
    """Section lists of a registry record, from the record's columns."""
    c = F.col
    units = F.array_join(F.transform(F.filter(
        F.array(c("fakulte"), c("bolum"), c("anabilim_dali_program")), _filled), X.tr_title_case), " / ")
    extra = F.filter(F.array(
        F.when(_filled(c("bilim_alani")), F.concat(F.lit("Bilim alanı: "), c("bilim_alani"))),
        F.when(_filled(c("temel_alan")), F.concat(F.lit("Temel alan: "), c("temel_alan"))),
        F.when(units != "", F.concat(F.lit("Birim: "), units))), lambda x: x.isNotNull())
    papers = F.transform(F.concat("makaleler", "bildiriler"),
                         lambda y: publication_line(y["baslik"], y["yil"], y["yayin_yeri"]))
    books = F.transform("kitaplar", lambda b: publication_line(F.when(_filled(b["bolum_adi"]), F.concat(
        b["bolum_adi"], F.lit(" (Kitap: "), b["baslik"], F.lit(")"))).otherwise(b["baslik"]), b["yil"], F.lit("")))

    def project(p: Column) -> Column:
        topic = F.when(_filled(p["proje_konusu"]), F.concat(F.lit(": "), X.shorten(p["proje_konusu"]))).otherwise(F.lit(""))
        return F.concat(p["baslik"], _suffix(X.period(p["baslangic"], p["bitis"])), topic)

    return {
        "arastirma": F.concat("anahtar_kelimeler", extra),
        "egitim": F.transform(F.filter("ogrenim", lambda o: _filled(o["tez_adi"])),
                              lambda o: F.concat(o["derece"], F.lit(" tezi: "), o["tez_adi"])),
        "yayinlar": F.concat(papers, books),
        "projeler": F.transform("projeler", project),
        "yonetilen_tezler": F.transform("yonetilen_tezler", lambda t: F.concat(t["duzey"], F.lit(": "), t["tez_adi"])),
        "patentler": F.transform("patentler", lambda p: F.concat(p["baslik"], F.when(
            _filled(p["ozet"]), F.concat(F.lit(": "), X.shorten(p["ozet"]))).otherwise(F.lit("")))),
        "dersler": F.array_distinct(F.transform("dersler", lambda d: d["ders_adi"])),
    }


def finished(education: Column) -> Column:
    """The registry gives finished studies as a range of years; a single year is the start of running ones."""
    return F.coalesce(education["yil"], F.lit("")).rlike(r"\d{4}\s*-\s*\d{4}")


def has_doctorate(education: Column) -> Column:
    return F.exists(education, lambda o: F.lower(F.coalesce(o["derece"], F.lit(""))).contains("doktora") & finished(o))


def to_common_cv() -> dict[str, Column]:
    """Registry record in the form of extracted CVs, from the record's columns."""
    c = F.col

    def none(x: Column) -> Column:
        return F.nullif(x, F.lit(""))

    def publication(title: Column, year: Column, kind: Column, venue: Column) -> Column:
        return F.struct(title.alias("title"), X.last_year(year).alias("year"), kind.alias("type"), venue.alias("venue"))

    is_chapter = lambda b: _filled(b["bolum_adi"])
    publications = F.concat(
        F.transform("makaleler", lambda y: publication(y["baslik"], y["yil"], F.lit("makale"), none(y["yayin_yeri"]))),
        F.transform("bildiriler", lambda y: publication(y["baslik"], y["yil"], F.lit("bildiri"), none(y["yayin_yeri"]))),
        F.transform("kitaplar", lambda b: publication(
            F.when(is_chapter(b), b["bolum_adi"]).otherwise(b["baslik"]), b["yil"],
            F.when(is_chapter(b), F.lit("kitap_bolumu")).otherwise(F.lit("kitap")),
            none(F.when(is_chapter(b), b["baslik"]).otherwise(b["yayin_yeri"])))),
        F.transform("patentler", lambda p: publication(
            p["baslik"], p["basvuru_no"], F.lit("diger"), F.trim(F.concat(F.lit("Patent "), p["basvuru_no"])))))
    education = F.transform("ogrenim", lambda o: F.struct(
        F.when(finished(o), o["derece"]).otherwise(F.concat(o["derece"], F.lit(" (devam ediyor)"))).alias("degree"),
        F.coalesce(none(o["kurum"]), F.lit("—")).alias("university"), none(o["birim"]).alias("unit"),
        F.when(finished(o), X.last_year(o["yil"])).alias("year"), none(o["tez_adi"]).alias("thesis_title")))
    projects = F.transform("projeler", lambda p: F.struct(
        p["baslik"].alias("name"), none(X.tr_title_case(F.coalesce(p["tur"], F.lit("")))).alias("program"),
        none(p["rol"]).alias("role"),
        none(F.concat_ws(" – ", none(p["baslangic"]), none(p["bitis"]))).alias("period")))
    theses = F.transform("yonetilen_tezler", lambda t: F.struct(
        t["tez_adi"].alias("title"), F.when(t["duzey"].rlike(DOCTORAL_LEVEL), F.lit("doktora"))
        .otherwise(F.lit("yuksek_lisans")).alias("level"),
        none(X.tr_title_case(F.coalesce(t["hazirlayan"], F.lit("")))).alias("student"), none(t["yil"]).alias("year")))
    posts = F.transform("akademik_gorevler", lambda g: F.struct(
        X.tr_title_case(g["unvan"]).alias("post"),
        F.concat_ws(" · ", none(g["kurum"]), none(X.tr_title_case(F.coalesce(g["birim"], F.lit(""))))).alias("institution"),
        none(g["yil"]).alias("period")))
    return {
        "title": X.registry_title(c("unvan"), has_doctorate(c("ogrenim"))),
        "name": X.tr_title_case(c("ad_soyad")),
        "university": X.tr_title_case(F.coalesce(c("universite"), F.lit(""))),
        "faculty": none(X.tr_title_case(F.coalesce(c("fakulte"), F.lit("")))),
        "department": none(X.tr_title_case(F.coalesce(c("bolum"), F.lit("")))),
        "email": none(c("eposta")), "orcid": none(c("orcid")), "web": c("profil_url"), "registry_id": none(c("arastirmaci_id")),
        "areas": c("anahtar_kelimeler"), "education": education, "publications": publications,
        "posts": posts, "projects": projects, "theses": theses,
        "courses": F.array_distinct(F.transform("dersler", lambda d: d["ders_adi"])),
    }


def profile_text(summary: Column, areas: Column, methods: Column, keywords: Column) -> Column:
    """Text that represents a profile in the index."""
    return F.concat_ws("\n", summary,
                       F.concat(F.lit("Araştırma alanları: "), F.array_join(areas, ", ")),
                       F.concat(F.lit("Yöntemler: "), F.array_join(methods, ", ")),
                       F.concat(F.lit("Anahtar kelimeler: "), F.array_join(keywords, ", ")))


# --- grounding of records -----------------------------------------------------------------------------------

def with_source_profile(records: DataFrame, source: str) -> DataFrame:
    """Adds the source text's word and number arrays, computed once per row for all fields."""
    return records.withColumns({"source_words": E.source_words(F.col(source)),
                                "source_numbers": E.source_numbers(F.col(source))})


def ground_record(records: DataFrame, scalars: list[str] = (), lists: list[str] = (), identifiers: list[str] = (),
                  counts: list[str] = (), restore_if_empty: list[str] = (), source: str = "text") -> DataFrame:
    """Record with unverifiable scalars nulled, lists filtered, identifiers kept only verbatim, zero counts nulled.

    Lists in `restore_if_empty` return to their original value when nothing of them can be verified.
    """
    rows = with_source_profile(records, source)
    words, numbers = F.col("source_words"), F.col("source_numbers")
    out = {}
    for f in scalars:
        out[f] = F.when(E.grounded(F.col(f), words, numbers), F.col(f))
    for f in lists:
        kept = F.filter(f, lambda v: E.grounded(v, words, numbers))
        out[f] = F.when(F.size(kept) == 0, F.col(f)).otherwise(kept) if f in restore_if_empty else kept
    for f in identifiers:
        out[f] = X.verbatim_in(F.col(f), F.col(source))
    for f in counts:
        out[f] = F.when((F.col(f) != 0) & E.grounded(F.col(f).cast("string"), words, numbers), F.col(f))
    return rows.withColumns(out).drop("source_words", "source_numbers")


# A rule turns (value, the record around it, the source) into the verified value; the source has `words`, `numbers`, `text`.
Rule = Callable[[Column, Column, "Source"], Column]


@dataclass(frozen=True)
class Source:
    words: Column
    numbers: Column
    text: Column

    def has(self, value: Column) -> Column:
        return E.grounded(value, self.words, self.numbers)


@dataclass(frozen=True)
class Elements:
    """Of a list, the elements that the source has: the elements themselves, or their field `by`."""
    by: str | None = None


def when_grounded(then: Callable[[Column, Column], Column] = lambda value, record: value) -> Rule:
    """The value as `then` rewrites it where the source has the value as given, else null."""
    return lambda value, record, source: F.when(source.has(value), then(value, record))


def verbatim(value: Column, record: Column, source: Source) -> Column:
    return X.verbatim_in(value, source.text)


def counted(value: Column, record: Column, source: Source) -> Column:
    """Zero says nothing."""
    return F.when((value != 0) & source.has(value.cast("string")), value)


# Which fields of an extracted CV must be in its text, and how; paths run through lists. `.*` is every field of a record.
CV_POLICY: dict[str, Rule | Elements] = {
    "identity.title": lambda value, record, source: X.short_title(value),
    "contact.*": verbatim,
    "areas": Elements(), "courses": Elements(), "awards": Elements(), "memberships": Elements(),
    "reviewing": Elements(), "languages": Elements(),
    "education": Elements("university"),
    "education.thesis": when_grounded(lambda value, record: X.strip_advisor(value)),
    "posts": Elements("role"), "management": Elements("role"), "projects": Elements("name"), "theses": Elements("title"),
    "publications": Elements("title"),
    "publications.title": lambda value, record, source: X.strip_title_tail(value, record["venue"]),
    "metrics.*": counted,
}


def compile_policy(schema: T.DataType, value: Column, policy: dict[str, Rule | Elements], source: Source, path: str = "",
                   record: Column | None = None) -> Column:
    """One expression that applies a policy to a nested value: records field by field, lists element by element.

    Elements are chosen by their values as given, before their fields are rewritten. Null records and lists stay null.
    """
    rule = policy.get(path, policy.get(f"{path.rpartition('.')[0]}.*"))
    if isinstance(schema, T.StructType):
        fields = [compile_policy(f.dataType, value[f.name], policy, source, f"{path}.{f.name}".lstrip("."), value).alias(f.name)
                  for f in schema]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(schema, T.ArrayType):
        if isinstance(rule, Elements):
            value = F.filter(value, lambda v: source.has(v if rule.by is None else v[rule.by]))
        if isinstance(schema.elementType, T.StructType):
            return F.transform(value, lambda v: compile_policy(schema.elementType, v, policy, source, path))
        return value
    return value if rule is None else rule(value, record, source)


def paths_of(schema: T.DataType, path: str = "") -> set[str]:
    """All field paths of a nested type, `.*` for every record."""
    if isinstance(schema, T.ArrayType):
        return paths_of(schema.elementType, path) | {path}
    if not isinstance(schema, T.StructType):
        return {path}
    inner = [paths_of(f.dataType, f"{path}.{f.name}".lstrip(".")) for f in schema]
    return {path, f"{path}.*".lstrip(".")}.union(*inner)


def ground_nested(records: DataFrame, column: str, policy: dict[str, Rule | Elements] = CV_POLICY, source: str = "text",
                  strict: bool = False) -> DataFrame:
    """Records whose nested `column` keeps only what the source text bears out, as the policy says per field path.

    Paths without a policy stay as they are; `strict` refuses policy paths that the column does not have.
    """
    schema = records.schema[column].dataType
    unknown = set(policy) - paths_of(schema)
    if strict and unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    rows = with_source_profile(records, source)
    facts = Source(F.col("source_words"), F.col("source_numbers"), F.col(source))
    return rows.withColumn(column, compile_policy(schema, F.col(column), policy, facts)).drop("source_words", "source_numbers")
