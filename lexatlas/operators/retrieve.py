"""Hybrid retrieval: vector and lexical candidates, reciprocal rank fusion, sections, amendment overlay, abstention."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexatlas.errors import NotFound
from lexatlas.functions import lexical
from lexatlas.functions.numbers import in_chapter, strip_ref_prefix
from lexatlas.operators import batch, extract, lookup
from lexatlas.settings import Settings

MODES = ("vector", "lexical", "hybrid")


@dataclass
class Store:
    """The tables of a store. ``index`` is the postings table of the chunks' texts; made on the fly if missing."""

    corpora: DataFrame
    documents: DataFrame
    sections: DataFrame
    chunks: DataFrame
    cross_refs: DataFrame
    index: DataFrame | None = None

    def postings(self) -> DataFrame:
        return self.index if self.index is not None else lexical.postings(self.chunks)

    def placed(self) -> DataFrame:
        """Sections with their document's and corpus' titles and layer."""
        d = self.documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), "layer", "version")
        c = self.corpora.select(F.col("id").alias("corpus_id"), F.col("title").alias("corpus_title"))
        return self.sections.join(d, "document_id").join(c, "corpus_id")

    def require(self, corpora: list[str] | None) -> None:
        if corpora:
            known = [r[0] for r in self.corpora.select("id").orderBy("id").collect()]
            for c in corpora:
                if c not in known:
                    raise NotFound(f"this store has no corpus {c!r} (available: {', '.join(known) or 'none yet'})")


def ranked(scored: DataFrame, order: list[Column], limit: int, start: int = 0) -> DataFrame:
    """The first ``limit`` rows with their rank. The limit comes first, so only so many rows are numbered."""
    top = scored.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)) + start)


def vector_candidates(base: DataFrame, query: list[float], limit: int = 40) -> DataFrame:
    """(id, similarity, rank): exact nearest chunks by dot product of unit vectors, ids breaking ties. Each task multiplies its
    rows as a matrix and keeps ``limit`` of them."""
    found = base.where("embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(batch.topmost(np.array([query], np.float64), limit), "q long, id long, similarity double")
    return ranked(found.select("id", "similarity"), [F.col("similarity").desc(), F.col("id")], limit)


def fuse(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """(id, score): sum over ranked lists (id, rank) of 1 / (k + rank)."""
    out = lists[0].select("id", "rank")
    for x in lists[1:]:
        out = out.unionByName(x.select("id", "rank"))
    return out.groupBy("id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"))


def numbers_in(query: str) -> list[str]:
    """Dotted section numbers and rule numbers that a query names, each once."""
    return list(dict.fromkeys(re.findall(extract.BARE, query)))


def filtered(store: Store, corpora: list[str] | None, kinds: list[str] | None, layer: str | None, chapter: str | None) -> DataFrame:
    """Chunks with their section's number and layer that satisfy all filters; filters run before any ranking."""
    c, s = store.chunks, store.placed().select(F.col("id").alias("section_id"), "number", "layer")
    if corpora:
        c = c.where(F.col("corpus_id").isin(corpora))
    if kinds:
        c = c.where(F.col("kind").isin(kinds))
    if layer:
        s = s.where(F.col("layer") == layer)
    if chapter:
        s = s.where(in_chapter(F.col("number"), chapter))
    return c.join(s, "section_id")


def lexical_candidates(base: DataFrame, index: DataFrame, query: str, limit: int = 40) -> tuple[DataFrame, int]:
    """((id, rank), strict hits): chunks of sections that the query names by number, then all-terms matches, then, while
    there are fewer than ``limit``, any-term matches; each pass by score, ids breaking ties. A chunk keeps its first rank."""
    spark = base.sparkSession
    named = numbers_in(query)
    key = index.withColumnRenamed("key", "id")
    passes = []
    if named:
        place = F.array_position(F.array(*[F.lit(n) for n in named]), F.col("number"))
        passes.append(base.where(F.col("number").isin(named)).select("id", F.lit(0).alias("pass"), F.struct(place.cast("double").alias("a"), (F.col("kind") != "body").cast("double").alias("b"), F.col("ordinal").cast("double").alias("c")).alias("o")))
    ids = base.select("id")

    def scored(found: DataFrame, n: int) -> DataFrame:
        top = found.withColumnRenamed("key", "id").join(ids, "id", "left_semi").orderBy(F.col("score").desc(), "id").limit(limit)
        return top.select("id", F.lit(n).alias("pass"), F.struct((-F.col("score")).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c")).alias("o"))

    plain = key.withColumnRenamed("id", "key")
    passes.append(scored(lexical.matching(plain, lexical.parse(query)), 1))

    def numbered(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        first = out.groupBy("id").agg(F.min(F.struct("pass", "o")).alias("at"))
        return first.withColumn("rank", F.row_number().over(W.orderBy("at.pass", "at.o", "id"))).select("id", "rank")

    # a few dozen rows: the passes' limits bound them, so ranks are settled on the driver's side of the plan
    strict = [(r["id"], r["rank"]) for r in numbered(passes).collect()]
    if len(strict) < limit:
        words = lexical.or_query(query)
        if words:
            all_ranked = numbered([*passes, scored(lexical.any_matching(plain, words), 2)])
            return all_ranked, len(strict)
    return spark.createDataFrame(strict, "id long, rank int"), len(strict)


def grouped(fused: DataFrame, vector: DataFrame | None, words: DataFrame | None, chunks: DataFrame, keep: int) -> DataFrame:
    """Sections of fused chunks: best score, best ranks and matched chunks with excerpts; the best ``keep``."""
    f = fused
    for name, ranks in (("vector_rank", vector), ("lexical_rank", words)):
        f = f.join(ranks.select("id", F.col("rank").alias(name)), "id", "left") if ranks is not None else f.withColumn(name, F.lit(None).cast("int"))
    meta = chunks.select("id", "section_id", "kind", "ordinal", F.substring("content", 1, 300).alias("excerpt"))
    hit = F.struct((-F.col("score")).alias("order"), "kind", "ordinal", "excerpt")
    sections = f.join(meta, "id").groupBy("section_id").agg(F.max("score").alias("score"), F.min("vector_rank").alias("vector_rank"), F.min("lexical_rank").alias("lexical_rank"), F.array_sort(F.collect_list(hit)).alias("hits"))
    sections = sections.withColumn("matched_chunks", F.transform("hits", lambda h: F.struct(h["kind"].alias("kind"), h["ordinal"].alias("ordinal"), h["excerpt"].alias("excerpt")))).drop("hits")
    return sections.orderBy(F.col("score").desc(), F.col("vector_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), "section_id").limit(keep)


def overlaid(hits: DataFrame, amended: DataFrame, k: int) -> DataFrame:
    """Hits with the amendment of each base section right above it, once; k rows, one more if any was put in.

    ``hits`` has section_id, position (1, 2, ...), corpus_id, number, layer, score; ``amended`` has corpus_id, number,
    amendment_id.
    """
    a = hits.where("layer = 'base'").join(amended, ["corpus_id", "number"]).select(F.col("amendment_id").alias("section_id"), "position", F.lit(0).alias("part"), "score", F.lit(True).alias("overlay"))
    own = hits.select("section_id", "position", F.lit(1).alias("part"), "score", F.lit(False).alias("overlay"))
    both = own.unionByName(a)
    once = both.withColumn("rn", F.row_number().over(W.partitionBy("section_id").orderBy("position", "part"))).where("rn = 1").drop("rn")
    w = W.orderBy("position", "part")
    numbered = once.withColumn("place", F.row_number().over(w)).withColumn("before", F.coalesce(F.max(F.col("overlay").cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(0)))
    # k rows, and one more if any overlay came before the end of them or right after it
    kept = numbered.withColumn("most", F.lit(k) + F.when(F.max(F.when(F.col("place") <= k + 1, F.col("before"))).over(W.partitionBy()) > 0, 1).otherwise(0))
    return kept.where("place <= most").drop("before", "part", "position", "most")


def abstains(mode: str, ranks: int, strict: int, similarity: float, floor: float) -> bool:
    """Whether the result is too weak to answer from."""
    if mode == "lexical":
        return ranks == 0
    if mode == "vector":
        return similarity < floor
    return strict == 0 and similarity < floor


def search(store: Store, embedder: object, query: str, corpora: list[str] | None = None, k: int = 8, chapter: str | None = None, kinds: list[str] | None = None, layer: str | None = None, mode: str = "hybrid", settings: Settings | None = None) -> dict:
    """{query, hits (DataFrame by place), abstain, confidence, provenance}.

    k is held between 1 and 20; overlays come beside it. Ties are broken by id everywhere.
    """
    settings = settings or Settings()
    spark: SparkSession = store.chunks.sparkSession
    query, k = query.strip(), max(1, min(int(k), 20))
    if mode not in MODES:
        raise ValueError(f"no search mode {mode!r}; there are {', '.join(MODES)}")
    store.require(corpora)
    base = filtered(store, corpora, kinds, layer, chapter)
    vector = words = None
    similarity, strict, n_words = 0.0, 0, 0
    if mode != "lexical":
        rows = vector_candidates(base, embedder.query(spark, query), settings.candidate_limit).collect()  # at most the limit
        vector = spark.createDataFrame([(r["id"], r["rank"]) for r in rows], "id long, rank int")
        similarity = max([0.0, *(float(r["similarity"]) for r in rows)])
    if mode != "vector":
        words, strict = lexical_candidates(base, store.postings(), query, settings.candidate_limit)
        got = [(r["id"], r["rank"]) for r in words.collect()]  # at most twice the limit and what was named
        n_words = len(got)
        words = spark.createDataFrame(got, "id long, rank int")
    fused = fuse([x for x in (vector, words) if x is not None], settings.rrf_k)
    tops = grouped(fused, vector, words, store.chunks, 2 * k)
    placed = store.placed()
    names = placed.select(F.col("id").alias("section_id"), "corpus_id", "number", "layer")
    order = W.orderBy(F.col("score").desc(), F.col("vector_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), "section_id")
    listed = tops.join(names, "section_id").withColumn("position", F.row_number().over(order))
    placed_hits = overlaid(listed, lookup.amendments_for(placed), k)
    shown = placed_hits.join(tops.select("section_id", "vector_rank", "lexical_rank", "matched_chunks"), "section_id", "left")
    detail = lookup.details(placed, store.chunks, store.cross_refs, include_children=True, only=shown.select(F.col("section_id").alias("id"))).withColumnRenamed("id", "section_id")
    none = F.lit(None)
    hits = shown.join(detail, "section_id").select(
        "place", "section_id", "corpus_id", F.struct(F.col("document_title").alias("title"), "layer", "version").alias("document"), F.struct("number", "title", "path", "page_start", "page_end").alias("section"),
        F.col("body").alias("content"), "exceptions", "tables", "definitions", "amended_by", "cross_refs", "citation", "children",
        F.when(F.col("overlay"), none).otherwise(F.col("matched_chunks")).alias("matched_chunks"),
        F.struct(F.round("score", 5).alias("rrf"), F.when(~F.col("overlay"), F.col("vector_rank")).alias("vector_rank"), F.when(~F.col("overlay"), F.col("lexical_rank")).alias("lexical_rank"), none.cast("double").alias("rerank"), "overlay").alias("scores"),
    ).orderBy("place")
    floor = getattr(embedder, "floor", settings.abstain_similarity)
    return {
        "query": query,
        "hits": hits,
        "abstain": abstains(mode, n_words, strict, similarity, floor),
        "confidence": {"strict_lexical_hits": strict, "top_vector_similarity": round(similarity, 4)},
        "provenance": {"embedding_model": getattr(embedder, "name", "unknown"), "retrieval": "hybrid-rrf" if mode == "hybrid" else mode, "reranked": False},
    }


def _number(store: Store, number: str) -> str:
    return store.chunks.sparkSession.range(1).select(strip_ref_prefix(F.lit(number))).first()[0]


def _found(store: Store, number: str, corpus: str | None, prefer: str | None = None) -> tuple[DataFrame, object]:
    store.require([corpus] if corpus else None)
    number = _number(store, number)
    s = store.placed()
    s = s.where(F.col("corpus_id") == corpus) if corpus else s
    asked = store.chunks.sparkSession.createDataFrame([(number,)], "number string")
    row = (lookup.find_sections(asked, s, prefer).first() if prefer else None) or lookup.find_sections(asked, s).first()
    if row is None:
        near = ", ".join(r["number"] for r in lookup.nearest_numbers(number, s).collect()) or "none"
        where = f" in {corpus}" if corpus else ""
        raise NotFound(f"no section numbered {number}{where}; close to it: {near}")
    return s, row


def get_section(store: Store, number: str, corpus: str | None = None, include_children: bool = False, include_tables: bool = True) -> DataFrame:
    """The section's details in one row; NotFound names the nearest numbers."""
    s, row = _found(store, number, corpus)
    return lookup.details(store.placed(), store.chunks, store.cross_refs, include_children, include_tables, store.chunks.sparkSession.createDataFrame([(row["id"],)], "id long"))


def get_context(store: Store, number: str, corpus: str | None = None) -> dict:
    """What stands around a section, the base text preferred: ancestors, neighbours, children, referring sections."""
    s, row = _found(store, number, corpus, "base")
    own = s.where(F.col("document_id") == row["document_id"])
    here = lookup.siblings(own.where(F.col("parent_id").eqNullSafe(F.lit(row["parent_id"])))).where(F.col("id") == row["id"]).first()
    pair = lambda x, n: {"number": x[f"{n}_number"], "title": x[f"{n}_title"]} if x[f"{n}_id"] is not None else None
    up = lookup.ancestors(own.where(F.col("ordinal") <= row["ordinal"])).where(F.col("id") == row["id"]).orderBy("depth").collect()
    kids = own.where(F.col("parent_id") == row["id"]).orderBy("ordinal").select("number", "title").collect()
    by = lookup.referenced_by(store.cross_refs, store.sections).where(F.col("to_section_id") == row["id"]).orderBy("number").collect()
    only = store.chunks.sparkSession.createDataFrame([(row["id"],)], "id long")
    cite = lookup.details(store.placed(), store.chunks, store.cross_refs, only=only).select("citation").first()[0]
    named = lambda rows: [{"number": r["number"], "title": r["title"]} for r in rows]
    return {"corpus": row["corpus_id"], "section": {"number": row["number"], "title": row["title"], "path": row["path"]}, "ancestors": named(up), "previous": pair(here, "prev"), "next": pair(here, "next"), "children": named(kids), "referenced_by": named(by), "citation": cite}


def resolve_references(store: Store, texts: DataFrame, text: str = "text", key: str = "id", corpus: str | None = None) -> DataFrame:
    """(key, ref_text, number, kind, corpus, found, title) of every reference in ``texts``."""
    store.require([corpus] if corpus else None)
    s = store.placed()
    s = s.where(F.col("corpus_id") == corpus) if corpus else s
    refs = texts.select(key, F.posexplode(extract.references_in(F.col(text))).alias("at", "r")).select(key, "at", "r.*")
    best = lookup.find_sections(refs.select("number").distinct(), s).select("number", F.col("corpus_id").alias("corpus"), "title")
    return refs.join(best, "number", "left").select(key, "at", "ref_text", "number", "kind", "corpus", F.col("corpus").isNotNull().alias("found"), "title").orderBy(key, "at")
