"""Relational reads: corpora, chapters, exact numbers, neighbours, ancestors and references. Batch forms throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexatlas.functions.numbers import citation, dotted_depth, normalize_number
from lexatlas.operators import tree
from lexatlas.work import settled


def list_corpora(corpora: DataFrame, documents: DataFrame, sections: DataFrame, chunks: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Each corpus with its counts of sections and chunks and its documents in order; the embedding's settings beside."""
    n = lambda t, name: t.groupBy(F.col("corpus_id").alias("id")).agg(F.count("*").alias(name))
    doc = F.struct(F.col("id").alias("id"), "title", "layer", "version")
    docs = documents.groupBy("corpus_id").agg(F.sort_array(F.collect_list(doc)).alias("documents")).withColumnRenamed("corpus_id", "id")
    out = corpora.join(n(sections, "sections"), "id", "left").join(n(chunks, "chunks"), "id", "left").join(docs, "id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("sections", "chunks")}).withColumn("documents", F.coalesce("documents", F.array().cast(docs.schema["documents"].dataType)))
    if config is not None:
        out = out.crossJoin(F.broadcast(config.limit(1)))  # one row by definition
    return out.orderBy("id")


def children_count(sections: DataFrame) -> DataFrame:
    return sections.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))


def list_chapters(sections: DataFrame) -> DataFrame:
    """Top sections with the number of their children, by layer and number."""
    tops = sections.where("depth = 0").join(children_count(sections), "id", "left").withColumn("children", F.coalesce("children", F.lit(0)))
    return tops.orderBy("layer", "number_norm")


def find_sections(numbers: DataFrame, sections: DataFrame, layer: str | None = None) -> DataFrame:
    """For each number the section it names: amendments first, then the lowest id; no row if there is none.

    ``numbers`` has number and, where it matters, corpus_id.
    """
    keys = [c for c in ("corpus_id", "number") if c in numbers.columns]
    s = sections.where(F.col("layer") == layer) if layer else sections
    best = s.groupBy(*keys).agg(F.min_by(F.struct(*s.columns), F.struct((F.col("layer") != "amendment").alias("late"), "id")).alias("s"))
    return numbers.join(best, keys).select("s.*")


def nearest_numbers(asked: str, sections: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` numbers closest to one that isn't there: by difference of length, then those before it, nearest first."""
    want = normalize_number(F.lit(asked))
    norm = F.col("number_norm")
    before = norm <= want
    order = [F.abs(F.length("number") - F.length(F.lit(asked))), before.desc(), F.when(before, norm).desc_nulls_last(), norm.asc()]
    # distinct first, so that the limit ends in a top-n without a full sort
    return sections.where("depth > 0").select("number", "number_norm").distinct().orderBy(*order, "number").limit(n)


def nearest_for(asked: DataFrame, sections: DataFrame, n: int = 3) -> DataFrame:
    """(asked, number, rank): for each distinct ``number`` of ``asked`` the ``n`` closest, in the order of :func:`nearest_numbers`.

    A two-sided as-of join: numbers and questions are dealt together by ranges of (length, number), counted within each range and
    offset by the ranges before, so a question knows the places of its neighbours among the numbers of a length and fetches them
    by an equi-join. It meets only those lengths, nearest first, that hold ``n`` numbers. Null questions are left out.
    """
    some = sections.where("depth > 0 and number is not null").groupBy(F.length("number").alias("len"), "number_norm").agg(F.sort_array(F.collect_set("number")).alias("numbers"))  # one number, or its spellings with zeros
    some = settled(some)
    want = asked.select(F.col("number").alias("asked")).where("asked is not null").distinct().select("asked", F.length("asked").alias("asked_len"), normalize_number(F.col("asked")).alias("number_norm"))
    # a row for each pair of lengths
    apart = F.abs(F.col("len") - F.col("asked_len"))
    pairs = want.select("asked_len").distinct().crossJoin(some.groupBy("len").agg(F.count("*").alias("m"))).withColumn("apart", apart)
    nearer = F.coalesce(F.sum("m").over(W.partitionBy("asked_len").orderBy("apart").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    reach = pairs.withColumn("nearer", nearer).where(F.col("nearer") < n).select("asked_len", "len", "apart")
    want = want.join(F.broadcast(reach), "asked_len")
    rows = some.select("len", "number_norm", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("asked"), F.lit(None).cast("int").alias("apart"))
    rows = rows.unionByName(want.select("len", "number_norm", F.lit(1).alias("kind"), "asked", "apart"))
    dealt = settled(rows.repartitionByRange("len", "number_norm").withColumn("part", F.spark_partition_id()))
    own = F.count(F.when(F.col("kind") == 0, 1))
    sizes = dealt.groupBy("len", "part").agg(own.alias("own"))
    before = sizes.select("len", "part", F.coalesce(F.sum("own").over(W.partitionBy("len").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = own.over(W.partitionBy("len", "part").orderBy("number_norm", "kind").rowsBetween(W.unboundedPreceding, 0)) + F.col("before")
    # as many rows as ranges and lengths together
    placed = dealt.join(F.broadcast(before), ["len", "part"]).withColumn("place", place)
    spots = placed.where("kind = 0").select("len", "place", "number_norm").join(some, ["len", "number_norm"]).select("len", "place", F.col("number_norm").alias("norm"), "numbers")
    near = placed.where("kind = 1").select("asked", "apart", "len", F.col("place").alias("at"), F.explode(F.sequence(F.col("place") - n + 1, F.col("place") + n)).alias("place"))
    found = near.join(spots, ["len", "place"]).select("asked", "apart", (F.col("place") <= F.col("at")).alias("before"), "norm", F.explode("numbers").alias("number"))
    order = [F.col("apart"), F.col("before").desc(), F.when(F.col("before"), F.col("norm")).desc_nulls_last(), F.col("norm"), F.col("number")]
    return found.withColumn("rank", F.row_number().over(W.partitionBy("asked").orderBy(*order))).where(F.col("rank") <= n).select("asked", "number", "rank")


def children(sections: DataFrame, parents: DataFrame) -> DataFrame:
    """Children of ``parents`` (id), in order."""
    return sections.join(parents.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").orderBy("parent_id", "ordinal")


def siblings(sections: DataFrame) -> DataFrame:
    """Every section with its neighbours under the same parent (top sections are each other's), in one pass per document."""
    w = W.partitionBy("document_id", "parent_id").orderBy("ordinal", "id")
    near = {f"{name}_{c}": f(c).over(w) for name, f in (("prev", F.lag), ("next", F.lead)) for c in ("id", "number", "title")}
    return sections.withColumns(near)


def ancestors(sections: DataFrame) -> DataFrame:
    """(id, anc, dist, number, title, depth): every section (id, document_id, ordinal, depth, number, title) with all above it. A
    document's sections stand in their order with their depths, so windows tell what is open at each."""
    s = sections.select("id", F.col("document_id").alias("document"), F.col("ordinal").alias("ord"), "depth", "number", "title")
    up = tree.lineage(s.withColumn("level", F.col("depth")), ["id", "number", "title", "level"]).select("id", F.size("above").alias("n"), F.posexplode("above").alias("at", "a"))
    return up.select("id", F.col("a.id").alias("anc"), (F.col("n") - F.col("at")).alias("dist"), "a.number", "a.title", F.col("a.level").alias("depth"))


def referenced_by(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """(to_section_id, number, title): the distinct sections that refer to each section."""
    source = sections.select(F.col("id").alias("from_section_id"), "number", "title")
    return refs.where("to_section_id is not null").join(source, "from_section_id").select("to_section_id", "number", "title").distinct()


def references_out(refs: DataFrame) -> DataFrame:
    return refs.withColumn("resolved", F.col("to_section_id").isNotNull())


def amendments_for(sections: DataFrame) -> DataFrame:
    """(corpus_id, number, amendment_id): for each number the first section of the amendment layer that supersedes it or has
    it; two equi-joins' worth of keys instead of one with OR."""
    a = sections.where("layer = 'amendment'")
    keys = a.select("corpus_id", "number", "id").unionByName(a.where("supersedes_number is not null").select("corpus_id", F.col("supersedes_number").alias("number"), "id"))
    return keys.groupBy("corpus_id", "number").agg(F.min("id").alias("amendment_id"))


def details(sections: DataFrame, chunks: DataFrame, refs: DataFrame, include_children: bool = False, include_tables: bool = True, only: DataFrame | None = None) -> DataFrame:
    """Sections with everything that is shown of them: body, exceptions, tables, definitions, what amends them, references,
    citation and, if wanted, children with their bodies. Each part is aggregated once and joined, whatever the number of sections;
    with ``only`` (id) just for these.

    ``sections`` has layer, document_title, corpus_title and version beside its own columns. ``amended_by`` is a struct of
    document, version and section_number.
    """
    whole = sections
    if only is not None:
        sections = sections.join(only, "id", "left_semi")
        chunks = chunks.join(only.withColumnRenamed("id", "section_id"), "section_id", "left_semi")
        refs = refs.join(only.withColumnRenamed("id", "from_section_id"), "from_section_id", "left_semi")
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ordinal", "content")))), lambda x: x["content"])
    parts = chunks.groupBy(F.col("section_id").alias("id")).agg(listed("exception").alias("exceptions"), listed("table").alias("tables"), listed("definition").alias("definitions"))
    out_refs = refs.groupBy(F.col("from_section_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("ref_text"), F.col("ref_number").alias("number"), F.col("ref_kind").alias("kind"), F.col("to_section_id").isNotNull().alias("resolved")))).alias("cross_refs"))
    amended = amendments_for(whole).join(sections.select("corpus_id", "number").distinct(), ["corpus_id", "number"], "left_semi")
    version = F.col("version") if "version" in whole.columns else F.lit(None).cast("string")
    names = whole.select(F.col("id").alias("amendment_id"), F.col("document_title").alias("by_title"), version.alias("by_version"), F.col("number").alias("by_number"))
    s = sections.join(parts, "id", "left").join(out_refs, "id", "left").join(amended, ["corpus_id", "number"], "left")
    s = s.withColumn("amendment_id", F.when((F.col("layer") == "base"), F.col("amendment_id"))).join(names, "amendment_id", "left")
    cite = citation(F.col("document_title"), F.col("corpus_title"), F.col("corpus_id"), F.col("number"), F.col("page_start"))
    by = F.concat("by_title", F.lit(" §"), "by_number")
    amends = F.struct(F.col("by_title").alias("document"), F.col("by_version").alias("version"), F.col("by_number").alias("section_number"))
    s = s.withColumn("amended_by", F.when(F.col("amendment_id").isNotNull(), amends)).withColumn("citation", F.when(F.col("amended_by").isNotNull(), F.concat(cite, F.lit(", as amended by "), by)).otherwise(cite))
    if not include_tables:
        s = s.drop("tables")
    if include_children:
        below = whole.where("parent_id is not null")
        below = below if only is None else below.join(only.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi")
        body = F.col("body") if "body" in whole.columns else F.lit(None).cast("string")
        child = F.struct("ordinal", "number", "title", body.alias("content"))
        kids = below.groupBy(F.col("parent_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(child)), lambda x: F.struct(x["number"].alias("number"), x["title"].alias("title"), x["content"].alias("content"))).alias("children"))
        s = s.join(kids, "id", "left")
    return s.drop("by_title", "by_version", "by_number")


def section_chunks(chunks: DataFrame, sections: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Chunks of ``sections`` (id), of the given kinds where any are, in the order of kind and ordinal within a section."""
    some = chunks.where(F.col("kind").isin(kinds)) if kinds else chunks
    return some.join(sections.select(F.col("id").alias("section_id")), "section_id", "left_semi").sortWithinPartitions("section_id", "kind", "ordinal")


def contents(sections: DataFrame, deepest: int = 2) -> DataFrame:
    """(layer, document_id, ordinal, line): an indented table of contents."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.trim(F.concat_ws(" ", "number", "title")), F.when(F.col("layer") == "amendment", F.lit(" (amendment)")).otherwise(""))
    return sections.where(F.col("depth") <= deepest).select("layer", "document_id", "ordinal", line.alias("line")).orderBy("layer", "document_id", "ordinal")


def section_markdown(detail: DataFrame) -> DataFrame:
    """(id, markdown) of details: head, citation, body, exceptions and tables."""
    head = F.concat(F.lit("# "), F.trim(F.concat_ws(" ", "number", "title")))
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    parts = F.concat(F.array(head, F.concat(F.lit("*"), "citation", F.lit("*")), F.coalesce("body", F.lit(""))), some("exceptions"), some("tables"))
    return detail.select("id", F.array_join(F.filter(parts, lambda p: p != ""), "\n\n").alias("markdown"))


def document_json(documents: DataFrame) -> DataFrame:
    return documents.select("id", F.to_json(F.struct(*documents.columns)).alias("json"))


def page_count(page_end: Column) -> Column:
    """Pages of a document from its sections; null when no page is known."""
    return F.nullif(F.max(F.coalesce(page_end, F.lit(0))), F.lit(0))


def related(a: Column, b: Column) -> Column:
    """Whether one dotted number is the other's ancestor."""
    return F.startswith(a, F.concat(b, F.lit("."))) | F.startswith(b, F.concat(a, F.lit(".")))
