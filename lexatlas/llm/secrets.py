"""Secret scans over an incremental blob ledger, in DataFrame operations alone.

Every version of every file is addressed by the SHA-256 of its content. The ledger says which (blob, rule version)
pairs have been scanned and what was found; a run scans only pairs the ledger lacks, each distinct blob once however
many paths or versions hold it, and joins the findings back to all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import saved


@dataclass(frozen=True)
class Rule:
    """A kind of secret: all leftmost non-overlapping matches of ``pattern`` whose checked part is long enough.

    ``value`` extracts the checked part from a whole match (None: the match itself).
    """

    kind: str
    pattern: str
    least: int
    value: str | None = None
    version: int = 1


_KEY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: The production rules, in their listed order. Short runs can't be part of a longer match of the second and third
#: pattern, so these ask for the least length at once; the first must consume matches that fail.
RULES = (
    Rule("assign", _KEY + r"[A-Za-z0-9+/_.=-]+", 8, f"^{_KEY}([A-Za-z0-9+/_.=-]+)$"),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)

#: Matches of a text whose places are summed up in one fold.
RUN = 512
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Spans (code points, end exclusive) of a rule's matches in a text.

    The pieces between matches and the matches themselves alternate, so running lengths give positions: match k
    starts after pieces 0..k and matches 0..k-1.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    lengths = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(found, F.length).alias("len"), F.transform(found, lambda m: F.length(F.regexp_extract(m, rule.value, 1)) if rule.value else F.length(m)).alias("checked"))
    # runs of matches: a fold copies what it has gathered at every step, so it gathers the starts of runs, then within each run
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int")), lambda k: F.slice(lengths, k * RUN + 1, F.lit(RUN)))
    wide = lambda x: x["gap"] + F.coalesce(x["len"], F.lit(0))
    begun = F.aggregate(
        runs,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda acc, run: F.struct((acc["at"] + F.aggregate(run, F.lit(0), lambda n, x: n + wide(x))).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )

    def within(run: Column, at: Column) -> Column:
        return F.aggregate(
            run,
            F.struct(at.alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + wide(x)).alias("at"),
                F.when(x["checked"] >= rule.least, F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + x["gap"] + x["len"]).alias("end"), F.lit(rule.kind).alias("kind"))))).otherwise(acc["out"]).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    start = F.flatten(F.zip_with(runs, begun, within))
    return F.when(text.rlike(rule.pattern), start).otherwise(F.expr(f"cast(array() as {SPAN})"))


def address(files: DataFrame, text: str = "text") -> DataFrame:
    """``files`` with ``blob``, the SHA-256 (32 bytes) of its content; a null text has the blob of the empty text."""
    return files.withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))


def scan_unseen(files: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """New ledger rows (blob, kind, version, spans) for every (blob, rule version) that ``ledger`` lacks.

    ``files`` holds historical versions: any columns besides ``text``. Each distinct blob is scanned once: copies
    are dropped before the shuffle within a task and after it across tasks, so a blob with a third of all rows
    brings at most one row per task. A blob scanned without findings is recorded with no spans.
    """
    blobs = address(files.select(F.coalesce(F.col(text), F.lit("")).alias("content")), "content")
    wanted = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for i, r in enumerate(rules)])
    if ledger is None:
        todo = blobs.groupBy("blob").agg(F.first("content").alias("content")).withColumn("todo", wanted)
    else:
        seen = ledger.select("blob", "kind", "version").distinct().groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
        # a set of at most one entry for each rule version there ever was
        todo = blobs.groupBy("blob").agg(F.first("content").alias("content")).join(seen, "blob", "left")
        todo = todo.withColumn("todo", F.filter(wanted, lambda w: ~F.exists(F.coalesce(F.col("seen"), F.expr("cast(array() as array<struct<kind:string,version:int>>)")), lambda s: (s["kind"] == w["kind"]) & (s["version"] == w["version"])))).where(F.size("todo") > 0)
    has = lambda i: F.exists("todo", lambda w: w["rank"] == i)
    scans = F.array(*[F.when(has(i), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans_of(F.col("content"), r, i).alias("spans"))) for i, r in enumerate(rules)])
    return todo.select("blob", F.explode(F.filter(scans, lambda s: s.isNotNull())).alias("s")).select("blob", "s.kind", "s.version", "s.spans")


def scan(files: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(files with ``blob`` and ``findings``, ledger after the run).

    ``findings`` are all spans of all rules in their current versions, by start, then by the rules' order. The
    ledger's new rows are written in the shared folder first, so nothing is scanned twice by later reads. Columns of
    ``files`` are kept; any named blob or findings is replaced. Null and empty texts have no findings; an empty
    table gives empty results.
    """
    new = saved(scan_unseen(files, ledger, rules, text), "ledger")
    after = new if ledger is None else ledger.select("blob", "kind", "version", "spans").unionByName(new)
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    # written before it is joined, so that the join of a blob that very many files share can be split
    known = saved(after.where(current & (F.size("spans") > 0)).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans")), "findings")
    base = address(files.drop("findings"), text)
    # the row travels as one struct, so that its columns may have any names
    out = base.select(F.struct(*base.columns).alias("d"), "blob").join(known, "blob", "left")
    return out.select(*[F.col("d").getField(c).alias(c) for c in base.columns], F.coalesce("spans", F.expr(f"cast(array() as {SPAN})")).alias("findings")), after
