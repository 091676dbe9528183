"""Cleanup of text, Markdown and tables decoded from documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ligature characters and their letters; bullet characters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
BULLETS = "\u2022\u25cf\u25aa\u25e6\uf0b7"
MIN_PAGE_CHARS = 20


def _letters(c: Column) -> Column:
    for char, letters in LIGATURES.items():
        c = F.replace(c, F.lit(char), F.lit(letters))
    return F.regexp_replace(c, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")


def _trim_all(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Ligatures spelled out, hyphenated line ends joined, bullets as '- ', spaces and blank lines collapsed."""
    c = F.regexp_replace(_letters(F.coalesce(c, F.lit(""))), rf"(?m)^[{BULLETS}]\s*", "- ")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    return _trim_all(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def clean_markdown(c: Column) -> Column:
    """Ligatures, hyphenation, trailing spaces and blank lines cleaned; headings without bold marks; tables kept."""
    lines = F.transform(F.split(_letters(c), "\n"), lambda line: F.when(
        line.rlike("^#{1,6} "), F.replace(line, F.lit("**"), F.lit(""))).otherwise(line))
    c = F.regexp_replace(F.array_join(lines, "\n"), r"(?m)[ \t]+$", "")
    return _trim_all(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def clean_table(rows: Column) -> Column:
    """Cells with spaces collapsed, null cells as '', rows without content dropped."""
    cleaned = F.transform(rows, lambda row: F.transform(
        row, lambda cell: F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))))
    return F.filter(cleaned, lambda row: F.exists(row, lambda cell: cell != ""))


def page_is_empty(text: Column, markdown: Column, n_tables: Column) -> Column:
    return (F.length(text) < MIN_PAGE_CHARS) & (F.length(markdown) < MIN_PAGE_CHARS) & (n_tables == 0)


def join_pages(pages: Column) -> Column:
    """Non-empty page texts of an array, joined by a blank line."""
    return F.array_join(F.filter(pages, lambda p: p != ""), "\n\n")
