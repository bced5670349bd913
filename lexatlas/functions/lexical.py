"""Text search without a search engine: analyzer, query parser, postings and cover density."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dotted numbers stay whole; other tokens are runs of letters and digits.
TOKEN = r"[0-9]+(?:\.[0-9]+)+|[\p{L}\p{N}]+"
#: English words that carry no meaning in a search.
STOP = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don "
    "down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me "
    "more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that "
    "the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while "
    "who whom why will with you your yours yourself yourselves"
).split()


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def terms(text: Column, stop: list[str] | None = None) -> Column:
    """Tokens in order with stop words as null, so places are kept."""
    return F.transform(tokens(text), lambda t: F.when(~t.isin(STOP if stop is None else stop) if (stop is None or stop) else F.lit(True), t))


def gathered(found: Column) -> Column:
    """Array of struct(term, places) of a row's terms (an array in order, null ones left out), made within the row: its (term, place) pairs in
    order, cut where the term changes."""
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    pairs = F.sort_array(F.filter(F.transform(found, lambda t, i: F.struct(t.alias("term"), i.alias("place"))), lambda x: x["term"].isNotNull()))

    def cut(e: Column) -> Column:
        new = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i == 0) | (F.get(e, i)["term"] != F.get(e, i - 1)["term"]))
        places = lambda f, to: F.transform(F.slice(e, f + 1, to - f), lambda x: x["place"])
        return once(new, lambda n: F.transform(n, lambda f, j: F.struct(F.get(e, f)["term"].alias("term"), places(f, F.coalesce(F.get(n, j + 1), F.size(e))).alias("places"))))

    return once(pairs, lambda e: F.when(F.size(e) > 0, cut(e)))


def postings(chunks: DataFrame, key: str = "id", text: str = "text", stop: list[str] | None = None) -> DataFrame:
    """(term, key, places): the inverted index, one row per term and row of ``chunks``."""
    listed = chunks.select(F.col(key).alias("key"), F.posexplode(terms(F.col(text), stop)).alias("place", "term")).where("term is not null")
    return listed.groupBy("term", "key").agg(F.sort_array(F.collect_list("place")).alias("places"))


@dataclass
class Query:
    """Any of ``groups`` (all of a group's terms and phrases), and none of ``without``."""

    groups: list[list[list[str]]] = field(default_factory=list)
    without: list[list[str]] = field(default_factory=list)

    @property
    def terms(self) -> list[str]:
        return sorted({t for g in self.groups for p in g for t in p})


def _words(text: str) -> list[str]:
    found = re.findall(r"[0-9]+(?:\.[0-9]+)+|[^\W_]+", text.lower())
    return [w for w in found if w not in STOP]


def parse(query: str) -> Query:
    """Web search syntax: words are required, "quotes" keep words together, OR joins alternatives, - excludes."""
    out = Query([[]])
    pending_or = False
    for m in re.finditer(r'(-?)"([^"]*)"|(\S+)', query):
        minus, phrase, word = m.group(1) == "-", m.group(2), m.group(3)
        if word is not None:
            if word == "OR":
                pending_or = bool(out.groups[-1])
                continue
            minus = word.startswith("-") and len(word) > 1
            parts = _words(word.lstrip("-"))
        else:
            parts = _words(phrase)
        if not parts:
            continue
        if minus:
            out.without.append(parts)
            continue
        if pending_or:
            out.groups.append([])
            pending_or = False
        # a hyphenated word is a phrase, as quotes are
        out.groups[-1].append(parts)
    out.groups = [g for g in out.groups if g]
    return out


def or_query(query: str) -> list[str]:
    """All terms of a query, each of which is enough."""
    return sorted(set(_words(query)))


def phrase_at(places: list[Column]) -> Column:
    """Whether places follow each other by one."""
    first = places[0]
    return F.exists(first, lambda p: _all([F.array_contains(x, p + i + 1) for i, x in enumerate(places[1:])]))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def cover_density(places: Column, wanted: Column) -> Column:
    """Sum over minimal extents that hold all ``wanted`` terms of 0.1 / (1 + other words inside).

    ``places`` is an array of (place, term), by place. One fold keeps each term's last place; an extent ends wherever all
    have been seen and starts at the least of those; it is minimal when that start is later than the last extent's.
    """
    n = F.size(wanted)
    zero = F.struct(F.transform(wanted, lambda _: F.lit(-1)).alias("last"), F.lit(-1).alias("from"), F.lit(0.0).alias("score"))

    def step(acc: Column, x: Column) -> Column:
        last = F.transform(F.arrays_zip(wanted.alias("w"), acc["last"].alias("p")), lambda z: F.when(z["w"] == x["term"], x["place"]).otherwise(z["p"]))
        start = F.array_min(last)
        new = (start >= 0) & (start > acc["from"])
        gain = F.lit(0.1) / (F.lit(1) + F.greatest(F.lit(0), x["place"] - start + 1 - n))
        return F.struct(last.alias("last"), F.when(new, start).otherwise(acc["from"]).alias("from"), (acc["score"] + F.when(new, gain).otherwise(0.0)).alias("score"))

    return F.aggregate(places, zero, step, lambda acc: acc["score"])


def matching(index: DataFrame, query: Query) -> DataFrame:
    """(key, score) of rows that satisfy a parsed query, scored by cover density of the best group."""
    wanted = sorted(set(query.terms) | {t for p in query.without for t in p})
    if not query.groups:
        return index.select("key", F.lit(0.0).alias("score")).limit(0)
    # at most as many rows per key as the query has terms
    held = index.where(F.col("term").isin(wanted)).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))
    at = lambda t: F.try_element_at(F.col("at"), F.lit(t))
    has = lambda parts: _all([at(t).isNotNull() for t in parts]) & (F.coalesce(phrase_at([at(t) for t in parts]), F.lit(False)) if len(parts) > 1 else F.lit(True))
    ok, score = F.lit(False), F.lit(0.0)
    for group in query.groups:
        fits = _all([has(p) for p in group])
        words = sorted({t for p in group for t in p})
        entries = F.array_sort(F.flatten(F.array(*[_tagged(at(t), t) for t in words])))
        score = F.when(fits, F.greatest(score, cover_density(entries, F.array(*[F.lit(t) for t in words])))).otherwise(score)
        ok = ok | fits
    for parts in query.without:
        ok = ok & ~has(parts)
    return held.where(ok).select("key", score.alias("score"))


def _tagged(places: Column, term: str) -> Column:
    return F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda p: F.struct(p.alias("place"), F.lit(term).alias("term")))


def any_matching(index: DataFrame, words: list[str]) -> DataFrame:
    """(key, score) of rows with any of the terms: each place is an extent of its own."""
    return index.where(F.col("term").isin(words)).groupBy("key").agg((F.sum(F.size("places")) * 0.1).alias("score"))
