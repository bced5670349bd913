"""Extraction from section texts: exceptions, definitions and cross-references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The forms that open and continue an exception, lead a definition and name another section.
EXCEPTION = r"(?i)^\s*Exceptions?\s*:"
ITEM = r"^\s*(?:\d+[.)]|[-*•])\s+"
TERM = r"(?m)(?:(?<=\n)|^)\s*\**([A-Z0-9][A-Z0-9 ,\-/()']{2,60}?)\**\.\s*(?=[A-Z(\"“])"
REFERENCE = r"\b(Sections?|Tables?|Chapters?)\s+(\d{3,4}(?:\.\d+)*|\d{1,2})(?!\d)(?!\.\d)"
BARE = r"(?<![\d.])(\d{3,4}(?:\.\d+)+|4101:\d{1,2}-\d{1,2}-\d{2})(?!\d)(?!\.\d)"
_MARK = "\u0001"


def split_exceptions(paragraphs: Column) -> Column:
    """struct(body, exceptions) of an array of paragraphs.

    Paragraphs fall into runs: one belongs to the run before it if it is a list item, or if the paragraph before it doesn't end in a
    full stop, semicolon or colon; one that begins with ``Exception:`` starts a run in any case. Runs that begin so are exceptions, a line
    for each paragraph; all others are body. Null gives empty arrays.
    """
    p = F.coalesce(paragraphs, F.array().cast("array<string>"))
    return held(F.transform(p, lambda x: F.struct(x.alias("p"), x.rlike(EXCEPTION).alias("opens"), F.rtrim(x).rlike(r"[.;:]$").alias("ends"), x.rlike(ITEM).alias("item"))), _runs)


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once for each row; named twice in an expression it is made twice, inside a lambda for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _runs(marks: Column) -> Column:
    starts = F.transform(marks, lambda x, i: F.when(x["opens"] | (i == 0) | ~(x["item"] | ~F.get(marks, i - 1)["ends"]), i))
    return held(F.filter(starts, lambda i: i.isNotNull()), lambda place: _split(marks, place))


def _split(marks: Column, place: Column) -> Column:
    """The runs of ``marks`` that start at each ``place``, cut once and told apart by what opens them."""
    stop = lambda i: F.coalesce(F.get(place, i + 1), F.size(marks))
    run = lambda at, i: F.struct(F.get(marks, at)["opens"].alias("out"), F.transform(F.slice(marks, at + 1, stop(i) - at), lambda x: x["p"]).alias("ps"))
    text = lambda r: F.array_join(F.transform(r["ps"], lambda x: F.trim(x)), "\n")
    return held(F.transform(place, run), lambda runs: F.struct(F.flatten(F.transform(F.filter(runs, lambda r: ~r["out"]), lambda r: r["ps"])).alias("body"), F.transform(F.filter(runs, lambda r: r["out"]), text).alias("exceptions")))


def split_definitions(body: Column) -> Column:
    """Array of struct(term, definition); at least two terms are needed, empty definitions are left out."""

    def pairs(terms: Column) -> Column:
        texts = F.slice(F.split(F.regexp_replace(body, TERM, _MARK), _MARK), 2, F.greatest(F.size(terms), F.lit(1)))
        each = F.transform(F.arrays_zip(terms.alias("t"), texts.alias("d")), lambda x: F.struct(F.trim(x["t"]).alias("term"), F.regexp_replace(x["d"], r"^\s+|\s+$", "").alias("definition")))
        return F.when(F.size(terms) >= 2, F.filter(each, lambda x: x["definition"] != "")).otherwise(F.array().cast("array<struct<term:string,definition:string>>"))

    return held(F.regexp_extract_all(body, F.lit(TERM), F.lit(1)), pairs)


def cross_refs(text: Column) -> Column:
    """Array of struct(ref_text, number, kind) in order, each kind and number once; chapters have one or two digits, others
    more."""
    found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(i)).alias(n) for i, n in enumerate(("whole", "word", "num"))])
    named = F.transform(found, lambda x: F.struct(x["whole"].alias("ref_text"), x["num"].alias("number"), F.rtrim(F.lower(x["word"]), F.lit("s")).alias("kind")))
    fits = F.filter(named, lambda x: F.when(x["kind"] == "chapter", F.length(x["number"]) <= 2).otherwise(F.length(x["number"]) >= 3))
    return _once(fits)


def _once(refs: Column) -> Column:
    keys = F.transform(refs, lambda x: F.concat_ws(":", x["kind"], x["number"]))
    return F.filter(refs, lambda x, i: F.array_position(keys, F.concat_ws(":", x["kind"], x["number"])) == i + 1)


def references_in(text: Column) -> Column:
    """Cross-references and bare dotted numbers that none of them names, as sections."""
    named = cross_refs(text)
    numbers = F.transform(named, lambda x: x["number"])
    bare = F.array_distinct(F.regexp_extract_all(text, F.lit(BARE), F.lit(1)))
    more = F.transform(F.filter(bare, lambda n: ~F.array_contains(numbers, n)), lambda n: F.struct(n.alias("ref_text"), n.alias("number"), F.lit("section").alias("kind")))
    return F.concat(named, more)


def resolved(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """``refs`` (with corpus_id, ref_number) with to_section_id: of sections of that number in the corpus an amendment's
    comes first, then the lowest id. ``sections`` has id, corpus_id, number and layer."""
    best = sections.groupBy("corpus_id", F.col("number").alias("ref_number")).agg(F.min_by("id", F.struct((F.col("layer") != "amendment").alias("late"), "id")).alias("to_section_id"))
    return refs.drop("to_section_id").join(best, ["corpus_id", "ref_number"], "left")


def backfilled(refs: DataFrame, new_sections: DataFrame) -> DataFrame:
    """Dangling ``refs`` pointed at sections of a new document; resolved ones stay as they are."""
    new = new_sections.groupBy("corpus_id", F.col("number").alias("ref_number")).agg(F.min("id").alias("new_id"))
    return refs.join(new, ["corpus_id", "ref_number"], "left").withColumn("to_section_id", F.coalesce("to_section_id", "new_id")).drop("new_id")
