"""Text cleaning and article structure as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cleaning patterns, in order; `d` makes only \n end a line.
PAGE_MARKER = r"(?i)--+\s*(?:\d+\s*(?:PAGE|EGAP)|(?:PAGE|EGAP)\s*\d+)\s*--+"
RULE = r"(?md)^---+$"
PAGE_NUMBER = r"(?md)^\s*-\d+-\s*$"
FOOTNOTE_DIGITS = r"(?md)(\S)\d{1,2}\s*$"
PRIVATE_GLYPHS = r"[\x{F000}-\x{F8FF}]"
BLANK_LINES = r"\n{3,}"
TRIMMED = " \t\n\r\0\x0b"


def clean_text(text: Column) -> Column:
    """Page marks, rules, page numbers, footnote digits, glyphs and blank lines removed."""
    text = F.regexp_replace(text, PAGE_MARKER, "")
    text = F.regexp_replace(text, RULE, "")
    text = F.regexp_replace(text, PAGE_NUMBER, "")
    text = F.regexp_replace(text, FOOTNOTE_DIGITS, "$1")
    text = F.regexp_replace(text, PRIVATE_GLYPHS, "")
    text = F.regexp_replace(text, BLANK_LINES, "\n\n")
    return F.btrim(text, F.lit(TRIMMED))


def display_text(text: Column) -> Column:
    """Single newlines as spaces; blank lines stay."""
    return F.regexp_replace(text, r"(?<!\n)\n(?! *\n)", " ")


def like_any(columns: list[str], term: str, fold: str = "unicode") -> Column:
    """Whether any column contains the term, ignoring case; % and _ in it are wildcards.

    fold='ascii' ignores the case of A-Z only. A null column doesn't match.
    """
    pattern = F.lit(f"%{term}%")
    found = F.lit(False)
    for name in columns:
        column = F.col(name)
        if fold == "ascii":
            upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
            match = F.like(F.translate(column, upper, lower), F.translate(pattern, upper, lower), F.lit("\x01"))
        else:
            match = F.ilike(column, pattern, F.lit("\x01"))
        found = found | F.coalesce(match, F.lit(False))
    return found
