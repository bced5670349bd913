"""The jobs as registered queries, with the SQL that their output must equal: each runs twice into one new folder."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from jobs import chunk_feed, retrieval_report
from lexatlas.functions import lexical
from lexatlas.operators import chunking
from lexatlas.work import folder


def _new(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def _settings(name: str) -> dict:
    """The config that lies beside the job, on the machine that registers it."""
    return json.loads((Path(__file__).parent / f"{name}.json").read_text())


def job1_chunk_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run finds no new file."""
    at, settings = _new(spark, "chunk-feed"), _settings("chunk_feed")
    for _ in range(2):
        # a glob takes a table that is one file as well as a folder
        chunk_feed.run(spark, f"{sf_dir}/documents.parquet*", f"{at}/chunks", f"{at}/checkpoint", settings)
    return chunk_feed.current(spark, f"{at}/chunks")


def job2_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run replaces the first one's partitions."""
    at, settings = _new(spark, "retrieval-report"), _settings("retrieval_report")
    for _ in range(2):
        out = retrieval_report.run(spark, f"{sf_dir}/documents.parquet", f"{at}/ranks", settings)
    return out


QUERIES = {f.__name__: f for f in (job1_chunk_feed, job2_retrieval_report)}

_STOP = ", ".join(f"'{w}'" for w in lexical.STOP)
_TERMS = f"regexp_extract_all(lower(coalesce(text, '')), '{lexical.TOKEN}')"

SQL = {
    "job1_chunk_feed": f"""
WITH t AS (SELECT doc_id, source AS corpus, regexp_extract_all(coalesce(text, ''), '{chunking.SPACED}') AS ts FROM documents),
w AS (SELECT doc_id, corpus, ts, unnest(range(0, (len(ts) + 511) // 512)) AS win FROM t),
c AS (SELECT doc_id, corpus, win, len(list_slice(ts, win * 512 + 1, win * 512 + 512)) AS n, regexp_replace(array_to_string(list_slice(ts, win * 512 + 1, win * 512 + 512), ''), '{chunking.LEAD}', '') AS text FROM w)
SELECT doc_id, win::INT AS "window", n::INT AS n_tokens, len(list_filter({_TERMS}, lambda x: x NOT IN ({_STOP})))::INT AS n_terms, sha256(text) AS sha256, text, corpus FROM c
""",
    "job2_retrieval_report": f"""
WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term, generate_subscripts({_TERMS}, 1) AS pos FROM documents),
f AS (SELECT * FROM t WHERE term NOT IN ({_STOP})),
tf AS (SELECT doc_id, term, count(*) AS n FROM f GROUP BY doc_id, term),
a AS (SELECT doc_id AS question, term FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS r FROM f WHERE doc_id % 100 = 0 GROUP BY doc_id, term) WHERE r <= 12),
m AS (SELECT question, count(*) AS need FROM a GROUP BY question),
g AS (SELECT question, doc_id, count(*) = need AS full_match, sum(n)::BIGINT AS places FROM a JOIN tf USING (term) JOIN m USING (question) GROUP BY question, doc_id, need),
r AS (SELECT 'strict' AS mode, question, doc_id, places, row_number() OVER (PARTITION BY question ORDER BY places DESC, doc_id) AS rank FROM g WHERE full_match
  UNION ALL SELECT 'any', question, doc_id, places, row_number() OVER (PARTITION BY question ORDER BY places DESC, doc_id) FROM g
  UNION ALL SELECT 'both', question, doc_id, places, row_number() OVER (PARTITION BY question ORDER BY full_match DESC, places DESC, doc_id) FROM g),
q AS (SELECT d.doc_id AS question, coalesce(d.lang, '') AS tag, x.mode FROM documents d, (VALUES ('strict'), ('any'), ('both')) x(mode) WHERE d.doc_id % 100 = 0)
SELECT q.question, q.tag, r.rank::INT AS rank, r.doc_id AS id, r.places, coalesce(r.doc_id = q.question, false) AS expected, q.mode FROM q LEFT JOIN r ON r.question = q.question AND r.mode = q.mode AND r.rank <= 10
""",
}
