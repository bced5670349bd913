"""The algebra of section numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: words and signs before a number in a reference.
PREFIX = r"(?i)^(?:section|sec\.?|table|chapter|§)\s*"


def normalize_number(number: Column) -> Column:
    """Every run of digits padded to four by zeros, so that text order is number order."""
    wide = F.regexp_replace(number, r"(\d+)", "0000$1")
    return F.regexp_replace(wide, r"(?<!\d)0{1,4}(\d{4,})(?!\d)", "$1")


def strip_ref_prefix(text: Column) -> Column:
    """``Section 1004.5.`` -> ``1004.5``."""
    return F.trim(F.rtrim(F.regexp_replace(F.trim(text), PREFIX, ""), F.lit(".")))


def dotted_depth(number: Column) -> Column:
    return F.size(F.split(number, r"\."))


def chapter_of(number: Column) -> Column:
    return F.split_part(number, F.lit("."), F.lit(1))


def in_chapter(number: Column, prefix: str) -> Column:
    """Whether the number's chapter begins with ``prefix`` (so 1 finds 1, 10 and 1004); no character is a wildcard."""
    return F.startswith(chapter_of(number), F.lit(prefix))


def label(number: Column, title: Column) -> Column:
    return F.trim(F.concat_ws(" ", number, title))


def title_case(text: Column) -> Column:
    """Letters after a non-letter in upper case, all others in lower; text that isn't all capitals stays."""
    chars = F.split(text, "")
    cased = F.transform(chars, lambda c, i: F.when((i > 0) & F.coalesce(F.get(chars, i - 1).rlike(r"\p{L}"), F.lit(False)), F.lower(c)).otherwise(F.upper(c)))
    return F.when(text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}"), F.array_join(cased, "")).otherwise(text)


def citation(document: Column, corpus_title: Column, corpus: Column, number: Column, page: Column) -> Column:
    """``Title §1004.5 (p. 12)``, from the first title there is."""
    name = F.coalesce(F.nullif(document, F.lit("")), F.nullif(corpus_title, F.lit("")), corpus)
    return F.concat(name, F.lit(" §"), number, F.when(page > 0, F.concat(F.lit(" (p. "), page.cast("string"), F.lit(")"))).otherwise(""))
