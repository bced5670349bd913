"""Section trees: from a classified block stream to sections with parents, bodies, tables and breadcrumbs.

Parents, page spans, breadcrumbs and attachments are window and join expressions. Only one rule looks back at what has been
accepted so far: a paragraph that looks like a heading must carry a number above the last one accepted beside it. That
pass runs per document over the few candidate blocks, not over the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexatlas.functions.numbers import label, normalize_number, title_case
from lexatlas.operators.grammar import HEADING, grammar
from lexatlas.work import settled

#: Places of a document whose parents are found in one task.
BLOCK = 1 << 16


def classify(blocks: DataFrame, grammar_name: str) -> DataFrame:
    """``blocks`` with ``h``, the heading that each block is or begins with, or null."""
    rule = grammar(grammar_name)
    return blocks.withColumn("h", rule(F.col("kind"), F.col("text"), F.col("level"), F.col("ord")).cast(HEADING))


def accepted(candidates: DataFrame) -> DataFrame:
    """(document, ord) of headings that open a section.

    ``candidates`` has (document, ord, inline, number_norm, depth) of all section headings; ``inline`` ones (paragraphs)
    that don't go up from the last accepted number under the same parent and depth are body text.

    A task walks its documents' candidates in order, batch by batch. All that it keeps is the open path of the document at hand and the
    last numbers beside that, so neither a document nor a batch of short ones is held as a whole.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        path: list[tuple[int, dict[int, str]]] = []  # depth of each open section, and the last number of each depth right under it
        for batch in batches:
            keep = []
            for document, inline, number, depth in zip(*(batch.column(c).to_pylist() for c in ("document", "inline", "number_norm", "depth")), strict=True):
                if document != at or not path:
                    at, path = document, [(-1, {})]
                # the open path ends at the last level that is less deep; what is dropped from it can't come back
                cut = len(path)
                while cut > 1 and path[cut - 1][0] >= depth:
                    cut -= 1
                last = path[cut - 1][1]
                stays = not (inline and depth in last and number <= last[depth])
                if stays:
                    del path[cut:]
                    last[depth] = number
                    path.append((depth, {}))
                keep.append(stays)
            yield batch.select(["document", "ord"]).filter(pa.array(keep, pa.bool_()))

    rows = candidates.select("document", F.col("ord").cast("int").alias("ord"), "inline", "number_norm", "depth")
    return rows.repartition("document").sortWithinPartitions("document", "ord").mapInArrow(walk, "document string, ord int")


def lineage(sections: DataFrame, carry: list[str]) -> DataFrame:
    """``sections`` (document, ord, depth, ...) with ``above``: all sections that each stands in, from the top down, as an array of
    structs of ``ord`` and the columns ``carry``.

    A section stands in the last one of each lesser depth, unless a still lesser depth came after that. So a running last for each depth
    that occurs is all there is to keep, without recursion. A document is dealt in blocks of places: lasts run within a block, and one row
    a block brings those from the blocks before, so a document of any length is many tasks.
    """
    depths = sorted(r[0] for r in sections.select("depth").distinct().collect())  # as many as numbers have levels
    node = F.struct("ord", *carry)
    lasts, near = [f"__last{i}" for i in range(len(depths))], [f"__near{i}" for i in range(len(depths))]
    s = sections.withColumn("__block", F.floor(F.col("ord") / BLOCK))
    ends = s.groupBy("document", "__block").agg(F.count("*").alias("__n"), *[F.max(F.when(F.col("depth") == d, node)).alias(c) for d, c in zip(depths, lasts, strict=True)])
    blocks = W.partitionBy("document").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    before = ends.select("document", "__block", *[F.last(c, ignorenulls=True).over(blocks).alias(c) for c in lasts])
    w = W.partitionBy("document", "__block").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({c: F.last(F.when(F.col("depth") == d, node), ignorenulls=True).over(w) for d, c in zip(depths, near, strict=True)}).join(before.hint("merge"), ["document", "__block"])
    s = s.withColumns({c: F.coalesce(c, o) for c, o in zip(near, lasts, strict=True)})
    open_, newest = [], F.lit(None).cast(sections.schema["ord"].dataType)
    for d, c in zip(depths, near, strict=True):
        place = F.col(c)["ord"]
        open_.append(F.when((F.col("depth") > d) & (newest.isNull() | (place > newest)), F.col(c)))
        newest = F.greatest(newest, place)
    above = F.filter(F.array(*open_), lambda x: x.isNotNull()) if open_ else F.array().cast(f"array<{s.select(node).schema[0].dataType.simpleString()}>")
    return s.withColumn("above", above).drop("__block", *lasts, *near)


def unique_numbers(sections: DataFrame) -> DataFrame:
    """Numbers made unique within a document: a repeated one gets its alias or its count in parentheses."""
    w = W.partitionBy("document", "number").orderBy("ord")
    rn = F.row_number().over(w)
    first = sections.withColumn("rn", rn).withColumn("new", F.when(F.col("rn") > 1, F.concat("number", F.lit("("), F.coalesce("alias", F.col("rn").cast("string")), F.lit(")"))).otherwise(F.col("number")))
    # two with one alias differ by a further count
    again = F.row_number().over(W.partitionBy("document", "new").orderBy("ord"))
    return first.withColumn("again", again).withColumn("number", F.when(F.col("again") > 1, F.concat("new", F.lit("("), F.col("again").cast("string"), F.lit(")"))).otherwise(F.col("new"))).drop("rn", "new", "again")


def breadcrumbs(sections: DataFrame, root: str | None = None) -> DataFrame:
    """(document, ord, parent, path) of sections: the nearest section before that is less deep, and the labels from the root
    down, joined by " > ", after ``root`` if given."""
    named = lineage(sections.select("document", "ord", "depth", label(F.col("number"), F.col("title")).alias("name")), ["name"])
    names = F.concat(F.array(F.lit(root)) if root else F.array().cast("array<string>"), F.transform("above", lambda x: x["name"]), F.array("name"))
    return named.select("document", "ord", F.try_element_at("above", F.lit(-1))["ord"].alias("parent"), F.array_join(names, " > ").alias("path"))


def _title_like(text: Column) -> Column:
    t = F.rtrim(F.trim(text), F.lit("."))
    return (F.length(t) > 0) & (F.length(t) <= 80) & ~F.contains(t, F.lit(".")) & ~F.endswith(t, F.lit(":"))


def build(blocks: DataFrame, grammar_name: str, corpus_title: str | None = None) -> DataFrame:
    """Sections of all documents of ``blocks`` (document, ord, kind, text, page, level, font_size, bold).

    Columns: document, ord (place of the heading; -1 for front matter), ordinal, parent (an ord), number, number_norm, title,
    depth, supersedes, paragraphs (array), tables (array of caption, number, markdown, page), page_start, page_end, path.
    Blocks before the first heading form a section FRONT of depth 0. A caption attaches the next table to the first section
    so far with its number, else to the one that it stands in; a caption without a table is body text. A heading that
    is no section right after an untitled, empty one is its title.
    """
    marked = classify(blocks, grammar_name).select("document", "ord", "kind", "text", "page", "h")
    marked = settled(marked).withColumns({"is_section": F.coalesce(F.col("h.kind") == "section", F.lit(False)), "is_caption": F.coalesce(F.col("h.kind") == "table-caption", F.lit(False))})
    candidates = marked.where("is_section").select("document", "ord", (F.col("kind") != "heading").alias("inline"), normalize_number(F.col("h.number")).alias("number_norm"), F.col("h.depth").alias("depth"))
    opens = F.col("is_section")
    doubtful = candidates.where("inline").select("document").distinct()
    if not doubtful.isEmpty():
        # only inline headings can be refused, so only their documents are walked
        opened = accepted(candidates.join(doubtful.hint("merge"), "document", "left_semi")).withColumn("accepted", F.lit(True))
        marked = marked.join(opened.hint("merge"), ["document", "ord"], "left")
        opens = opens & ((F.col("kind") == "heading") | F.col("accepted").isNotNull())
    marked = marked.withColumn("opens", F.coalesce(opens, F.lit(False)))
    w = W.partitionBy("document").orderBy("ord")
    # the section that a block stands in; -1 before the first
    marked = marked.withColumn("sec", F.coalesce(F.last(F.when(F.col("opens"), F.col("ord")), ignorenulls=True).over(w), F.lit(-1)))
    after, before = lambda c: F.lead(c).over(w), lambda c: F.lag(c).over(w)
    # a caption holds until the next block that isn't a caption; only a table there makes use of it
    marked = marked.withColumn("used", F.col("is_caption") & F.coalesce(after("kind") == "table", F.lit(False)) & ~F.coalesce(after("is_caption"), F.lit(False)))
    marked = marked.withColumn("cap", F.when(before("used") & (F.col("kind") == "table"), before("h")))
    heading_text = (F.col("kind") == "heading") & ~F.col("opens") & ~F.col("is_caption")
    absorbed = heading_text & F.coalesce(before("opens") & (F.col("h").isNull()) & (before("h.title") == "") & (before("h.remainder") == ""), F.lit(False)) & _title_like(F.col("text"))
    marked = marked.withColumn("absorbed", absorbed)

    # what each block gives to its section: the heading, a later title, a paragraph or a table
    caption = F.trim(F.concat_ws(" ", F.lit("Table"), F.col("h.number"), F.col("h.title")))
    prose = ((F.col("kind") != "table") & ~F.col("is_caption") & ~F.col("absorbed")) | (F.col("is_caption") & ~F.col("used"))
    said = F.when(F.col("opens"), F.when(F.col("h.remainder") != "", F.trim("h.remainder"))).otherwise(F.when(F.col("is_caption"), caption).otherwise(F.trim("text")))
    tells = F.when(F.col("opens"), F.col("h.remainder") != "").otherwise(prose)
    named_by = F.when(F.col("cap.number").isNotNull(), F.trim(F.concat_ws(" ", F.lit("Table"), F.col("cap.number"), F.col("cap.title"))))
    given = marked.select(
        "document", "sec", "ord", "page",
        F.when(F.col("opens"), F.struct("h.number", "h.title", "h.depth", "h.supersedes", "h.alias")).alias("head"),
        F.when(F.col("absorbed"), F.trim("text")).alias("late"),
        F.when(tells, F.struct(F.col("ord").alias("at"), said.alias("p"))).alias("said"),
        F.when(F.col("kind") == "table", F.struct(F.col("ord").alias("at"), named_by.alias("caption"), F.col("cap.number").alias("number"), F.col("text").alias("markdown"), "page")).alias("table"),
        (F.col("is_caption") & F.col("used")).alias("held"),
    )
    given = settled(given)
    made = given.groupBy("document", F.col("sec").alias("ord")).agg(
        F.max("head").alias("head"), F.max("late").alias("late"), F.array_sort(F.collect_list("said")).alias("said"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.min("held").alias("held")
    )
    made = settled(made.where((F.col("ord") >= 0) | ~F.col("held")))
    none, is_front = F.lit(None).cast("string"), F.col("head").isNull()
    title = F.when(is_front, "Front matter").when(F.col("late").isNotNull(), title_case(F.col("late"))).otherwise(F.col("head.title"))
    plain = made.select(
        "document", "ord", F.when(is_front, "FRONT").otherwise(F.col("head.number")).alias("number"), title.alias("title"),
        F.when(is_front, 0).otherwise(F.col("head.depth")).alias("depth"), F.when(is_front, none).otherwise(F.col("head.supersedes")).alias("supersedes"), F.when(is_front, none).otherwise(F.col("head.alias")).alias("alias"),
    )
    sections = settled(unique_numbers(plain)).withColumn("ordinal", (F.row_number().over(W.partitionBy("document").orderBy("ord")) - 1).cast("int"))

    # joins are merges: these tables pack so well that their files' sizes would have millions of rows broadcast
    tables = given.where("table is not null").select("document", "sec", "table")
    named = sections.select("document", F.col("number").alias("cn"), F.col("ord").alias("first"))
    placed = tables.withColumn("cn", F.col("table.number")).join(named.hint("merge"), ["document", "cn"], "left")
    placed = placed.withColumn("ord", F.when(F.col("first") < F.col("table.at"), F.col("first")).otherwise(F.col("sec")))
    held = placed.groupBy("document", "ord").agg(F.array_sort(F.collect_list("table")).alias("tables"))

    bodies = made.select("document", "ord", F.transform("said", lambda x: x["p"]).alias("paragraphs"), "page_start", "page_end")
    paths = breadcrumbs(sections, corpus_title)
    out = sections.join(bodies.hint("merge"), ["document", "ord"]).join(held.hint("merge"), ["document", "ord"], "left").join(paths.hint("merge"), ["document", "ord"])
    in_ = F.concat(F.lit("Table in "), label(F.col("number"), F.col("title")))
    listed = F.transform("tables", lambda t: F.struct(F.coalesce(t["caption"], in_).alias("caption"), t["number"].alias("number"), t["markdown"].alias("markdown"), t["page"].alias("page")))
    empty = F.array().cast("array<struct<caption:string,number:string,markdown:string,page:int>>")
    return settled(out.withColumns({"tables": F.coalesce(listed, empty), "number_norm": normalize_number(F.col("number"))}).drop("alias"))


def tag_amendments(sections: DataFrame, layer: str) -> DataFrame:
    """On the amendment layer, sections below the top amend the section of their own number (without an added count)."""
    if layer != "amendment":
        return sections
    bare = F.regexp_replace("number", r"\([^)]*\)$", "")
    return sections.withColumn("supersedes", F.when((F.col("depth") > 0) & F.col("supersedes").isNull() & ~F.startswith("number", F.lit("4101:")), bare).otherwise(F.col("supersedes")))


def children_of(sections: DataFrame) -> DataFrame:
    """(document, parent, children): ords of child sections in order."""
    return sections.where("parent is not null").groupBy("document", "parent").agg(F.sort_array(F.collect_list("ord")).alias("children"))


def outline(sections: DataFrame) -> DataFrame:
    """(document, ordinal, line): an indented outline with word and table counts and what is amended."""
    words = F.size(F.filter(F.split(F.array_join("paragraphs", "\n\n"), r"\s+"), lambda x: x != ""))
    notes = F.array_compact(F.array(F.when(F.size("paragraphs") > 0, F.concat(words.cast("string"), F.lit("w"))), F.when(F.size("tables") > 0, F.concat(F.size("tables").cast("string"), F.lit("t"))), F.when(F.col("supersedes").isNotNull(), F.concat(F.lit("amends "), "supersedes"))))
    tail = F.when(F.size(notes) > 0, F.concat(F.lit("  ["), F.array_join(notes, " "), F.lit("]"))).otherwise("")
    return sections.select("document", "ordinal", F.concat(F.repeat(F.lit("  "), F.col("depth")), label(F.col("number"), F.col("title")), tail).alias("line"))
