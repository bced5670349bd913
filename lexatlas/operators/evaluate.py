"""Retrieval evaluation: credits, hit@k, reciprocal rank, kinds and abstention, overall and by tag."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexatlas.operators.lookup import related

#: Ranks at which hits are counted, and the rank up to which kinds are.
CUTS, KIND_AT = (1, 3, 5, 10), 5


def credit(number: Column, expected: Column) -> Column:
    """1 for an expected number, a half for an ancestor or descendant of one, else 0."""
    return F.when(F.array_contains(expected, number), 1.0).when(F.exists(expected, lambda e: related(number, e)), 0.5).otherwise(0.0)


def score(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per mode and question.

    ``hits`` has mode, id (of the question), rank, number, kinds (array), and abstain; ``questions`` id, expected_sections,
    expected_kinds, tags. Questions without expected sections are judged by abstention alone.
    """
    modes = hits.select("mode").distinct()
    asked = questions.crossJoin(F.broadcast(modes))  # a handful of modes
    h = hits.join(questions.select("id", "expected_sections", "expected_kinds"), "id")
    h = h.withColumn("credit", credit(F.col("number"), F.col("expected_sections")))
    cut = {f"hit@{k}": F.max(F.when(F.col("rank") <= k, F.col("credit")).otherwise(0.0)) for k in CUTS}
    per = h.groupBy("mode", "id").agg(*[v.alias(n) for n, v in cut.items()], F.min_by(F.col("credit") / F.col("rank"), F.when(F.col("credit") > 0, F.col("rank"))).alias("rr"), F.max((F.col("rank") <= KIND_AT) & F.arrays_overlap("kinds", "expected_kinds")).alias("kind"), F.max("abstain").alias("abstain"))
    out = asked.join(per, ["mode", "id"], "left")
    known = F.size("expected_sections") > 0
    value = lambda c: F.when(known, F.coalesce(F.col(f"`{c}`"), F.lit(0.0)))
    gave_up = F.coalesce("abstain", F.lit(True)).cast("double")
    kinds = F.when(known & (F.size(F.coalesce("expected_kinds", F.array().cast("array<string>"))) > 0), F.coalesce("kind", F.lit(False)).cast("double"))
    return out.select("mode", "id", "tags", *[value(f"hit@{k}").alias(f"hit@{k}") for k in CUTS], value("rr").alias("mrr"), kinds.alias(f"kind@{KIND_AT}"), F.when(~known, gave_up).alias("abstain"), F.when(known, gave_up).alias("false_abstain"))


METRICS = (*[f"hit@{k}" for k in CUTS], "mrr", f"kind@{KIND_AT}", "abstain", "false_abstain")


def summarize(scores: DataFrame) -> DataFrame:
    """(mode, tag, n, metrics): means over all questions (tag null) and by tag; missing values don't count."""
    tags = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit("untagged")))
    both = scores.select("mode", *[F.col(f"`{m}`") for m in METRICS], F.explode(F.concat(F.array(F.lit(None).cast("string")), tags)).alias("tag"))
    return both.groupBy("mode", "tag").agg(F.count("*").alias("n"), *[F.round(F.avg(f"`{m}`"), 3).alias(m) for m in METRICS])


def misses(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("`hit@5`") < 1).select("mode", "id", "`hit@5`")


def run(ask: Callable[[str, str, str | None], tuple[list[dict], bool]], questions: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """``hits`` for :func:`score`: ``ask(mode, question, corpus)`` gives (hits as dicts of number and kinds, abstain)."""
    rows = []
    for q in questions.select("id", "question", "corpus").collect():  # a hand-written list
        for mode in modes:
            found, abstain = ask(mode, q["question"], q["corpus"])
            rows += [(mode, q["id"], i, h["number"], h["kinds"], abstain) for i, h in enumerate(found, 1)] or [(mode, q["id"], 1_000_000, None, [], abstain)]
    return questions.sparkSession.createDataFrame(rows, "mode string, id string, rank int, number string, kinds array<string>, abstain boolean")


def report(summary: DataFrame) -> str:
    """The summary as a Markdown table."""
    rows = summary.orderBy(F.col("tag").asc_nulls_first(), "mode").collect()
    head = ["mode", "tag", "n", *METRICS]
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for r in rows:
        lines.append("| " + " | ".join("-" if r[c] is None else f"{r[c]:.3f}" if isinstance(r[c], float) else str(r[c]) for c in head).replace("| None |", "| all |") + " |")
    return "\n".join(lines)


def gate(summary: DataFrame, mode: str, rules: list[str]) -> list[str]:
    """The rules ``metric=least`` that the overall figures of a mode break; a prefix ``section-`` is ignored."""
    row = summary.where((F.col("mode") == mode) & F.col("tag").isNull()).first()
    broken = []
    for rule in rules:
        metric, least = rule.split("=", 1)
        got = row[metric.removeprefix("section-")] if row is not None else None
        if got is None or got < float(least):
            broken.append(f"{metric}: {got} is below {least}")
    return broken
