"""A postings table that is searched without a full scan: clustered by term, with the best count of each range of keys beside it.

Rows are dealt and sorted by (term, range, key), so Parquet's statistics leave out all but the asked terms' row groups. For a search by any
term the maxima bound what a range of keys can hold: the ranges that look best are scored first, and then only those whose
bound reaches the k-th score found. Both rounds are exact, so ranks are those of a full scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.functions import lexical
from lexatlas.work import settled

#: Keys of a range, ranges scored in the first round, bytes of a row group.
SPAN, FIRST, GROUP = 1 << 14, 16, 4 << 20

#: What is cut from the ends of words of four letters at least, in this order; a form's doubled last letter; what takes the place of
#: the last ends.
PLURALS = (r"(ss|[^aeiou]i)es$", r"([^su])s$")
FORMS = r"^(.*[aeiouy].+)(?:ing|ed)$"
DOUBLED = r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
ENDS = ((r"^(.*[aeiouy].+)ly$", ""), (r"([^aeiou])y$", "i"), (r"^(.*[aeiouy].+)e$", ""))


def stem(term: Column) -> Column:
    """A word without plural, tense, -ly and a last e; other terms, such as numbers, stay as they are."""
    # what is read several times is made once: a step takes the one before as its variable
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    out = term
    for pattern in PLURALS:
        out = F.regexp_replace(out, pattern, "$1")
    single = lambda c, o: F.when((c != o) & c.rlike(DOUBLED), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    out = once(out, lambda o: once(F.regexp_replace(o, FORMS, "$1"), lambda c: single(c, o)))
    for pattern, more in ENDS:
        out = F.regexp_replace(out, pattern, f"$1{more}")
    # a word that ends otherwise keeps its end
    may = F.substring(term, -1, 1).isin("s", "g", "d", "y", "e")
    return F.when(may & term.rlike("^[a-z]{4,}$"), out).otherwise(term)


def stemmed(postings: DataFrame) -> DataFrame:
    """Postings (term, key, places) by stem; terms of one stem share their places. Stems are made where the postings stand, so these are dealt
    once, by stem and key."""
    met = postings.where("term is not null").groupBy(stem(F.col("term")).alias("term"), "key")
    return met.agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))


@dataclass
class TermIndex:
    """``rows``: (term, range, key, n, places), clustered; ``maxima``: (term, range, best, rows)."""

    spark: SparkSession
    path: str
    stems: bool

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    @property
    def maxima(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/maxima")

    def _asked(self, words: list[str]) -> list[str]:
        """The words as the index holds them, each once."""
        if not self.stems:
            return sorted(set(words))
        found = self.spark.createDataFrame([(w,) for w in words], "w string").select(stem(F.col("w")))
        return sorted({r[0] for r in found.collect()})

    def of(self, words: list[str]) -> DataFrame:
        """Postings (term, key, places) of the words; only their row groups are read."""
        return self.rows.where(F.col("term").isin(self._asked(words))).select("term", "key", "places")

    def any_of(self, words: list[str], k: int = 40) -> DataFrame:
        """(key, score): the ``k`` rows with the most places of any of the words, a tenth for each; smaller keys break ties."""
        asked = self._asked(words)
        mine = self.rows.where(F.col("term").isin(asked)).select("range", "key", "n")
        bounds = self.maxima.where(F.col("term").isin(asked)).groupBy("range").agg(F.sum("best").alias("bound"))
        order = [F.col("n").desc(), F.col("key")]
        scored = lambda rows: rows.groupBy("key").agg(F.sum("n").alias("n"))
        first = [r["range"] for r in bounds.orderBy(F.col("bound").desc(), "range").limit(FIRST).collect()]
        best = settled(scored(mine.where(F.col("range").isin(first))).orderBy(*order).limit(k))
        n, least = best.agg(F.count("*"), F.min("n")).first()
        rest = bounds.where(~F.col("range").isin(first))
        if n == k:
            rest = rest.where(F.col("bound") >= least)
        more = scored(mine.join(rest.select("range"), "range", "left_semi"))
        return best.unionByName(more).orderBy(*order).limit(k).select("key", (F.col("n") * 0.1).alias("score"))

    def all_of(self, query: lexical.Query) -> DataFrame:
        """(key, score) of rows that satisfy a parsed query, by cover density, from the query's postings alone."""
        if self.stems:
            as_held = {w: self._asked([w])[0] for w in sorted(set(query.terms) | {t for p in query.without for t in p})}
            query = lexical.Query([[[as_held[t] for t in p] for p in g] for g in query.groups], [[as_held[t] for t in p] for p in query.without])
        words = sorted(set(query.terms) | {t for p in query.without for t in p})
        return lexical.matching(self.rows.where(F.col("term").isin(words)).select("term", "key", "places"), query)


def build(postings: DataFrame, path: str, stems: bool = False, span: int = SPAN, files: int | None = None) -> TermIndex:
    """The index of ``postings`` (term, key, places) under ``path``, a new folder. ``key`` is a number; with ``stems`` words of one stem are one term.
    ``files`` holds the number of files, which else follows the size.

    A term that most rows have is split into ranges of keys, so it is no single task's, here or in a search."""
    spark = postings.sparkSession
    rows = settled((stemmed(postings) if stems else postings).select("term", "key", "places"))
    # ranges go up with keys, so this is the order of (term, range, key), and what follows from key and places isn't dealt
    order = ["term", "key"]
    dealt = (rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    dealt = dealt.select("term", F.floor(F.col("key") / span).cast("long").alias("range"), "key", F.size("places").cast("long").alias("n"), "places")
    dealt.write.option("parquet.block.size", GROUP).parquet(f"{path}/rows")
    # dealt once: ranges of (term, range) hold all rows of each
    near = spark.read.parquet(f"{path}/rows").select("term", "range", "n").repartitionByRange("term", "range")
    best = near.groupBy("term", "range").agg(F.max("n").alias("best"), F.count("*").alias("rows"))
    best.sortWithinPartitions("term", "range").write.option("parquet.block.size", GROUP).parquet(f"{path}/maxima")
    return TermIndex(spark, path, stems)
