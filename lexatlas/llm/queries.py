"""The registered queries of the corpus operators: thin wrappers that derive each contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, jaccard_join, line_dedup, lm_scoring, media, mixing, quality, ranked_search, secrets, sharding, substring_dedup, token_counts
from ._work import table

TOKENIZER = "word_bpe_49k.json"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), 4, 85)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontamination.leaks(docs, items)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.prefix_token_counts(docs, public_tokenizers.path(TOKENIZER))
    n = token_counts.total(F.col("prefix_tokens"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > 2048)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "p_quality", "p_toxic", "keep")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = media.load(media.store(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media"))
    size = lambda c: F.octet_length(c).cast("long")
    return read.select(
        "doc_id",
        "n_bytes",
        size("payload").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        size("media").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("x", F.col("height").cast("string"), F.col("width").cast("string"), F.lit("3"), F.md5("tensor")).alias("feature"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a history of two runs: the ledger of the first two rules comes first, then the last rule arrives and only its pairs are scanned
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, ledger = secrets.scan(docs, rules=secrets.RULES[:-1])
    found, _ = secrets.scan(docs, ledger)
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = F.concat_ws(",", F.transform("findings", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), shortest=line_dedup.LEAST, exact=line_dedup.EXACT)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return ranked_search.search(docs, items)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_decontamination, op3_lm_scoring, op4_token_counts, op5_mixing, op6_quality_classifier, op7_substring_dedup, op8_media, op9_secret_scan, op10_line_dedup, op11_sharding, op12_ranked_search)}

#: Words of the texts with A-Z in lower case, and as they are, in DuckDB.
_LOW = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

#: Set similarity by shingles, windows by hash, and mixing by the same running sums over sources and the same MD5 draw, in DuckDB.
SQL = {
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOW} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.doc_id)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, c.c AS component_id FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) c ON c.doc_id = s.doc_id
""",
    "op7_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) AS h, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50),
g AS (SELECT w.doc_id, i FROM w JOIN (SELECT h, min(doc_id) AS first FROM w GROUP BY h) f ON f.h = w.h AND f.first < w.doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
m AS (SELECT x.*, coalesce(max(g.i) OVER (PARTITION BY x.doc_id ORDER BY x.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) > 0 AS gone FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.p),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
""",
    "op5_mixing": """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::HUGEINT AS weight, source_size * 3 AS cap FROM s),
r AS (SELECT *, sum(weight) OVER () AS all_w, sum(source_size) OVER () AS all_s,
  coalesce(sum(weight) OVER up, 0) AS v, coalesce(sum(cap) OVER up, 0) AS c
  FROM w WINDOW up AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, cap * (all_w - v) <= weight * (all_s - c) AS capped FROM r),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (weight * (all_s - coalesce(sum(cap) FILTER (capped) OVER (), 0)))::DOUBLE
  / (all_w - coalesce(sum(weight) FILTER (capped) OVER (), 0))::DOUBLE END AS target FROM k),
j AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size::DOUBLE, 3.0) ELSE 0.0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  ((floor(rate) + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM j
""",
    "op12_ranked_search": f"""
WITH d AS (SELECT doc_id, len({_TERMS}) AS n, {_TERMS} AS ts FROM documents),
c AS (SELECT count(*) FILTER (n > 0)::BIGINT AS docs, sum(n)::BIGINT AS tokens FROM d),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
w AS (SELECT item_id, term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM q JOIN f USING (term), c),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // tokens))))::BIGINT AS score FROM w JOIN p USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
""",
}
