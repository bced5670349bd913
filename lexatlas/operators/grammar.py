"""Heading grammars as column expressions: which blocks are headings, of what number, depth and kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexatlas.functions.numbers import dotted_depth, title_case

#: The line forms of numbered codes.
CHAPTER = r"(?i)^CHAPTER\s+(\d{1,2})\b\s*(.*?)\s*$"
SECTION = r"(?i)^SECTION\s+(?:[A-Z]{1,3}\s+)?(\d{3,4})\b\s*(.*?)\s*$"
CAPTION = r"(?i)^TABLE\s+(\d{3,4}(?:\.\d+)*)\s*(.*?)\s*$"
NUMBERED = r"^(\d{3,4}(?:\.\d+)*)\s+([A-Z][^.]{2,120}?)\.?\s*$"
INLINE = r"^(\d{3,4}(?:\.\d+)*)\s+([A-Z][^.]{2,120}?)\.\s*([A-Z(\"“].*)$"
FORMS = (SECTION, CAPTION, NUMBERED, INLINE)
RULE = r"^(4101:\d{1,2}-\d{1,2}-\d{2})\s+(.+?)\s*$"
INSTRUCTION = r"(?is)^\(([A-Z]{1,2})\)\s*(.*?(?:Sections?|Tables?|Chapters?)\s*(\d{1,4}(?:\.\d+)*).*)$"
PLAIN = r"^(\d+(?:\.\d+)*)\.?\s+(\S.*?)\s*$"
DEFINITIONS = {"code": r"(?i)\bDEFINITIONS?\b", "long": r"(?i)\bDEFINITIONS?\b", "rules": r"(?i)\bDEFINITIONS?\b", "plain": r"(?i)\b(definitions?|glossary|terms)\b"}

HEADING = "struct<number:string,title:string,depth:int,kind:string,remainder:string,supersedes:string,alias:string>"


def _heading(number: Column, title: Column, depth: Column, kind: str = "section", remainder: Column | None = None, supersedes: Column | None = None, alias: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(number.alias("number"), title.alias("title"), depth.cast("int").alias("depth"), F.lit(kind).alias("kind"), (remainder if remainder is not None else F.lit("")).alias("remainder"), (supersedes if supersedes is not None else none).alias("supersedes"), (alias if alias is not None else none).alias("alias"))


def _first(*cases: tuple[Column, Column]) -> Column:
    """The value of the first condition that holds, else null."""
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out


def numbered_code(kind: Column, text: Column, level: Column, ord_: Column, digits: str = "3,4") -> Column:
    """Chapters and sections on headings, table captions on headings and paragraphs, numbered titles, and numbers with a
    title that lead into prose on any block but tables. Numbers begin with so many ``digits``."""
    t = F.trim(text)
    section, caption, numbered, inline = (p.replace("{3,4}", f"{{{digits}}}") for p in FORMS)
    part = lambda p, i: F.regexp_extract(t, p, i)
    head = kind == "heading"
    number = lambda p: dotted_depth(part(p, 1))
    return _first(
        (kind == "table", F.lit(None).cast(HEADING)),
        (head & t.rlike(CHAPTER), _heading(part(CHAPTER, 1), title_case(part(CHAPTER, 2)), F.lit(0))),
        (head & t.rlike(section), _heading(part(section, 1), title_case(part(section, 2)), F.lit(1))),
        (kind.isin("heading", "paragraph") & t.rlike(caption), _heading(part(caption, 1), title_case(part(caption, 2)), number(caption), "table-caption")),
        (head & t.rlike(numbered), _heading(part(numbered, 1), F.trim(part(numbered, 2)), number(numbered))),
        (t.rlike(inline), _heading(part(inline, 1), F.trim(part(inline, 2)), number(inline), remainder=part(inline, 3))),
    )


def long_code(kind: Column, text: Column, level: Column, ord_: Column) -> Column:
    """The numbered code's forms with numbers of three digits or more, for documents of very many sections."""
    return numbered_code(kind, text, level, ord_, "3,")


def rule_code(kind: Column, text: Column, level: Column, ord_: Column) -> Column:
    """Rules, amending instructions under them, and the numbered code's forms, whose sections amend their namesakes."""
    t = F.trim(text)
    part = lambda p, i: F.regexp_extract(t, p, i)
    inner = numbered_code(kind, text, level, ord_)
    amends = F.when((inner["kind"] == "section") & (inner["depth"] > 0), inner.withField("supersedes", inner["number"])).otherwise(inner)
    title = F.concat(F.lit("("), part(INSTRUCTION, 1), F.lit(") "), F.trim(part(INSTRUCTION, 2)))
    return _first(
        (kind.isin("heading", "paragraph") & t.rlike(RULE), _heading(part(RULE, 1), part(RULE, 2), F.lit(0))),
        ((kind == "heading") & t.rlike(INSTRUCTION), _heading(part(INSTRUCTION, 3), title, F.lit(1), supersedes=part(INSTRUCTION, 3), alias=part(INSTRUCTION, 1))),
        (F.lit(True), amends),
    )


def plain(kind: Column, text: Column, level: Column, ord_: Column) -> Column:
    """Numbered headings, and made-up numbers for the others from their level and place."""
    t = F.trim(text)
    number = F.regexp_extract(t, PLAIN, 1)
    deep = F.coalesce(level, F.lit(1))
    made = F.format_string("H%d-%04d", deep, ord_)
    return _first(((kind == "heading") & t.rlike(PLAIN), _heading(number, F.regexp_extract(t, PLAIN, 2), dotted_depth(number))), (kind == "heading", _heading(made, t, deep - 1)))


GRAMMARS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {"code": numbered_code, "rules": rule_code, "plain": plain, "long": long_code}


def grammar(name: str) -> Callable[[Column, Column, Column, Column], Column]:
    if name not in GRAMMARS:
        raise ValueError(f"no grammar is called {name!r} (available: {', '.join(GRAMMARS)})")
    return GRAMMARS[name]
