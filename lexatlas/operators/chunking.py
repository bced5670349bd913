"""Section-aware chunks, and fixed windows as a baseline."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexatlas.functions.numbers import label
from lexatlas.operators import extract
from lexatlas.operators.grammar import DEFINITIONS

#: Fixed value: where a sentence may be cut.
SENTENCE = r"(?<=[.;:])\s+(?=[A-Z0-9(])"
#: A token of the default counter: a word or a sign.
#: A token with the white space before it, and white space at a text's start.
SPACED, LEAD = r"[\x20\x09-\x0D]*(?:[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}])", r"^[\x20\x09-\x0D]+"
WORD = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def count_tokens(text: Column) -> Column:
    """Tokens by the default counter; a tokenizer's own count can take its place."""
    return F.regexp_count(text, F.lit(WORD))


def pack(paragraphs: Column, crumb: Column, target: int = 600, cap: int = 900, count: Callable[[Column], Column] = count_tokens) -> Column:
    """Pieces of whole paragraphs, and of whole sentences of paragraphs that are too long, each within the cap with its
    breadcrumb. Greedy from the front: a fold over units with their counts."""
    entry = lambda t: F.struct(t.alias("t"), count(t).alias("n"))

    def fold(units: Column, limit: Column, joiner: str) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))

        def step(acc: Column, u: Column) -> Column:
            full = (F.size(acc["cur"]) > 0) & (acc["n"] + u["n"] > limit)
            return F.struct(
                F.when(full, F.concat(acc["out"], F.array(F.array_join(acc["cur"], joiner)))).otherwise(acc["out"]).alias("out"),
                F.when(full, F.array(u["t"])).otherwise(F.concat(acc["cur"], F.array(u["t"]))).alias("cur"),
                F.when(full, u["n"]).otherwise(acc["n"] + u["n"]).alias("n"),
            )

        return F.aggregate(units, start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(F.array_join(a["cur"], joiner)))).otherwise(a["out"]))

    def packed(budget: Column) -> Column:
        units = F.flatten(F.transform(paragraphs, lambda p: F.when(count(p) <= budget, F.array(p)).otherwise(fold(F.transform(F.split(p, SENTENCE), entry), budget, " "))))
        return fold(F.transform(units, entry), F.least(F.lit(target), budget), "\n\n")

    return extract.held(F.lit(cap) - count(crumb) - 4, packed)


def chunk_sections(sections: DataFrame, grammar: str, target: int = 600, cap: int = 900, count: Callable[[Column], Column] = count_tokens) -> DataFrame:
    """``sections`` (as tree.build makes them) with chunks, clean_body and refs.

    ``chunks`` is an array of struct(kind, ordinal, content, text, token_count): definitions, body, exceptions, tables, in
    this order. A definitions section (by its title, or twenty paragraphs with ten terms) has definitions in the body's
    place.
    """
    s = sections.withColumn("split", extract.split_exceptions(F.col("paragraphs")))
    joined = F.array_join("split.body", "\n\n")
    s = s.withColumn("defs", extract.split_definitions(joined))
    named = F.coalesce(F.col("title"), F.lit("")).rlike(DEFINITIONS[grammar])
    s = s.withColumn("is_defs", named | ((F.size("split.body") >= 20) & (F.size("defs") >= 10)))
    s = s.withColumn("use_defs", F.col("is_defs") & (F.size("split.body") > 0) & (F.size("defs") > 0))
    none = F.array().cast("array<string>")
    definitions = F.when(F.col("use_defs"), F.transform("defs", lambda d: F.concat(F.lit("Definition of "), d["term"], F.lit(": "), d["definition"]))).otherwise(none)
    body = F.when(F.col("use_defs"), none).otherwise(pack(F.col("split.body"), F.col("path"), target, cap, count))
    tables = F.transform("tables", lambda t: F.concat(t["caption"], F.lit("\n\n"), t["markdown"]))

    def as_chunks(kind: str, contents: Column) -> Column:
        def one(content: Column, i: Column) -> Column:
            text = F.concat(F.col("path"), F.lit("\n\n"), content)
            return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("ordinal"), content.alias("content"), text.alias("text"), count(text).cast("int").alias("token_count"))

        return F.transform(contents, one)

    s = s.withColumn("chunks", F.concat(as_chunks("definition", definitions), as_chunks("body", body), as_chunks("exception", F.col("split.exceptions")), as_chunks("table", tables)))
    clean = F.when(F.col("is_defs"), F.array_join("paragraphs", "\n\n")).otherwise(F.array_join(F.concat("split.body", "split.exceptions"), "\n\n"))
    s = s.withColumn("clean_body", clean)
    searched = F.concat_ws("\n", F.col("clean_body"), F.array_join(F.transform("tables", lambda t: t["markdown"]), "\n"))
    return s.withColumn("refs", extract.cross_refs(searched)).drop("split", "defs", "is_defs", "use_defs")


def windows(tokens: DataFrame, size: int = 512) -> DataFrame:
    """(document, window, owner, n_tokens, text): fixed windows of ``size`` tokens.

    ``tokens`` has (document, pos, owner, token), positions from 0. A window's owner is the one with most of its tokens, of
    equals the first. Windows of blank text are left out.
    """
    w = tokens.withColumn("window", F.floor(F.col("pos") / size).cast("long"))
    owners = w.groupBy("document", "window", "owner").agg(F.count("*").alias("n"), F.min("pos").alias("at"))
    best = owners.groupBy("document", "window").agg(F.max_by("owner", F.struct("n", -F.col("at"))).alias("owner"))
    texts = w.groupBy("document", "window").agg(F.count("*").alias("n_tokens"), F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "")).alias("text"))
    return texts.where("text != ''").join(best, ["document", "window"])


def windows_within(tokens: Column, size: int = 512) -> Column:
    """Array of struct(window, owner, n_tokens, text) of a document that stands in one row: as :func:`windows` makes them, without dealing tokens.

    ``tokens`` is an array of struct(owner, token) in order."""

    def one(piece: Column, w: Column) -> Column:
        owners = F.transform(piece, lambda x: x["owner"])
        most = lambda all_: F.array_max(F.transform(F.array_distinct(all_), lambda o: F.struct(F.size(F.filter(all_, lambda x: x.eqNullSafe(o))).alias("n"), (-F.array_position(all_, o)).alias("at"), o.alias("owner"))))["owner"]
        text = F.trim(F.array_join(F.transform(piece, lambda x: x["token"]), ""))
        return F.struct(w.cast("long").alias("window"), extract.held(owners, most).alias("owner"), F.size(piece).cast("long").alias("n_tokens"), text.alias("text"))

    def cut(t: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.floor((F.size(t) - 1) / size).cast("int")), lambda w: one(F.slice(t, w * size + 1, F.lit(size)), w))
        return F.when(F.size(t) > 0, F.filter(made, lambda x: x["text"] != ""))

    return extract.held(tokens, cut)


def fixed_windows(text: Column, size: int = 512) -> Column:
    """Array of struct(window, n_tokens, text): a text's windows of ``size`` tokens, made within its row.

    White space stays with the token after it, but for a window's ends; blank and null texts have no windows.
    """
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPACED), F.lit(0))
    piece = lambda w: F.slice(found, w * size + 1, F.lit(size))
    one = lambda w: F.struct(w.cast("int").alias("window"), F.size(piece(w)).alias("n_tokens"), F.regexp_replace(F.array_join(piece(w), ""), LEAD, "").alias("text"))
    return F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / size).cast("int")), one)).otherwise(F.array().cast("array<struct<window:int,n_tokens:int,text:string>>"))


def section_tokens(sections: DataFrame) -> DataFrame:
    """(document, pos, owner, token) of concatenated sections: label, body, tables; white space stays with its token."""
    tables = F.array_join(F.transform("tables", lambda t: F.concat(t["caption"], F.lit("\n"), t["markdown"])), "\n")
    text = F.concat(F.array_join(F.filter(F.array(label(F.col("number"), F.col("title")), F.array_join("paragraphs", "\n\n"), tables), lambda x: x != ""), "\n"), F.lit("\n\n"))
    each = sections.select("document", "ordinal", F.posexplode(F.regexp_extract_all(text, F.lit(r"\s*(?:[\p{L}\p{N}]+|[^\s\p{L}\p{N}])|\s+$"), F.lit(0))).alias("i", "token"))
    w = W.partitionBy("document").orderBy("ordinal", "i")
    return each.select("document", (F.row_number().over(w) - 1).alias("pos"), F.col("ordinal").alias("owner"), "token")


def tokenizer_counter(load: Callable[[], Callable[[str], int]]) -> Callable[[Column], Column]:
    """A counter from any tokenizer: ``load`` runs once per worker and gives a function text -> count."""

    @F.pandas_udf("int")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for p in parts:
            yield p.map(lambda t: encode(t or "")).astype("int32")

    return counted
