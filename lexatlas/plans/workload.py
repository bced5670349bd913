"""The registered queries: each applies engine operators to whole tables; ORACLE has the SQL that each must equal.

The tables have no regulatory text, so views stand in: the region-nation-customer-orders hierarchy is a section tree,
documents are sections of one paragraph each with their source as corpus and every fifth as an amendment, and embeddings
are chunk vectors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexatlas.functions import lexical, numbers, vectors
from lexatlas.operators import batch, chunking, evaluate, extract, lookup, retrieve, term_index, tree, vector_index
from lexatlas.sources import files, store
from lexatlas.work import folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query (spark, sf_dir) -> DataFrame with its SQL, if SQL can express it."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- views


def sections(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    s = lambda c: F.col(c).cast("string")
    region = t("region").select(F.col("r_regionkey").alias("r"), "r_name")
    nation = t("nation").join(region, F.col("n_regionkey") == F.col("r"))
    customer = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t("orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    top = (F.col("r") + 100).cast("string")
    second, third = F.concat_ws(".", top, s("n_nationkey")), F.concat_ws(".", top, s("n_nationkey"), s("c_custkey"))
    row = lambda df, id_, parent, number, title, depth, ordinal: df.select(id_.cast("long").alias("id"), parent.cast("long").alias("parent_id"), number.alias("number"), title.alias("title"), F.lit(depth).alias("depth"), ordinal.cast("long").alias("ordinal"), F.col("r").cast("long").alias("document_id"))
    k = F.col
    out = row(region, k("r") + 1, F.lit(None), top, k("r_name"), 0, k("r"))
    out = out.unionByName(row(nation, k("n_nationkey") + 100, k("r") + 1, second, k("n_name"), 1, k("n_nationkey")))
    out = out.unionByName(row(customer, k("c_custkey") + 1000, k("n_nationkey") + 100, third, k("c_name"), 2, k("c_custkey")))
    out = out.unionByName(row(orders, k("o_orderkey") + 10_000_000, k("c_custkey") + 1000, F.concat_ws(".", third, s("o_orderkey")), k("o_orderpriority"), 3, k("o_orderkey")))
    layer = F.when(k("document_id") % 5 == 4, "amendment").otherwise("base")
    return out.withColumns({"number_norm": numbers.normalize_number(k("number")), "corpus_id": F.lit("code"), "layer": layer})


TREE = """
WITH cust AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
raw AS (
  SELECT (r_regionkey + 1)::BIGINT AS id, NULL::BIGINT AS parent_id, (100 + r_regionkey)::VARCHAR AS number, r_name AS title, 0 AS depth, r_regionkey::BIGINT AS ordinal, r_regionkey::BIGINT AS document_id FROM region
  UNION ALL SELECT (n_nationkey + 100)::BIGINT, (r_regionkey + 1)::BIGINT, (100 + r_regionkey) || '.' || n_nationkey, n_name, 1, n_nationkey::BIGINT, r_regionkey::BIGINT FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_custkey + 1000, (n_nationkey + 100)::BIGINT, (100 + r_regionkey) || '.' || n_nationkey || '.' || c_custkey, c_name, 2, c_custkey, r_regionkey::BIGINT FROM cust
  UNION ALL SELECT o_orderkey + 10000000, c_custkey + 1000, (100 + r_regionkey) || '.' || n_nationkey || '.' || c_custkey || '.' || o_orderkey, o_orderpriority, 3, o_orderkey, r_regionkey::BIGINT FROM orders JOIN cust ON o_custkey = c_custkey),
s AS (SELECT *, list_aggregate(list_transform(string_split(number, '.'), lambda x: CASE WHEN length(x) < 4 THEN lpad(x, 4, '0') ELSE x END), 'string_agg', '.') AS number_norm,
  'code' AS corpus_id, CASE WHEN document_id % 5 = 4 THEN 'amendment' ELSE 'base' END AS layer FROM raw)
"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    layer = F.when(F.col("doc_id") % 5 == 0, "amendment").otherwise("base")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("corpus_id"), layer.alias("layer"), "lang")


def index_of(spark: SparkSession, sf: str) -> DataFrame:
    """Postings of the documents' unfiltered [a-z0-9]+ tokens, made within each row; only where ids repeat are they dealt and merged."""
    d = table(spark, sf, "documents")
    listed = d.select(F.col("doc_id").alias("key"), F.inline(lexical.gathered(vectors.bow_tokens(F.col("text"))))).select("term", "key", "places")
    if d.groupBy("doc_id").count().where("count > 1").isEmpty():
        return listed
    return listed.groupBy("term", "key").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))


TERMS = ["and", "the", "was"]
TOK = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents"
VEC = "SELECT e.vec_id AS id, e.label, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, list[float]]:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", "label"), e.where("vec_id = 0").first()["embedding"]


def _top(found: DataFrame) -> DataFrame:
    return retrieve.ranked(found.withColumnRenamed("key", "id"), [F.col("score").desc(), F.col("id")], 40)


# ---------------------------------------------------------------- vectors


@query(f"SELECT id, round(similarity, 6) AS similarity, row_number() OVER (ORDER BY similarity DESC, id)::BIGINT AS rank FROM ({VEC}) ORDER BY similarity DESC, id LIMIT 40")
def vector_topk(spark, sf):  # noqa: ANN001, ANN201
    v, q = _vectors(spark, sf)
    return retrieve.vector_candidates(v, q).select("id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long"))


@query(f"SELECT id, round(similarity, 6) AS similarity FROM ({VEC}) WHERE label IN (1, 3, 5) ORDER BY similarity DESC, id LIMIT 40")
def vector_topk_filtered(spark, sf):  # noqa: ANN001, ANN201
    v, q = _vectors(spark, sf)
    return retrieve.vector_candidates(v.where(F.col("label").isin(1, 3, 5)), q).select("id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT label, round(max(similarity), 6) AS best, round(greatest(0, max(similarity)), 6) AS top_similarity FROM ({VEC}) GROUP BY label")
def vector_sim_max(spark, sf):  # noqa: ANN001, ANN201
    v, q = _vectors(spark, sf)
    best = F.max("similarity")
    scored = v.withColumn("similarity", vectors.query_dot(F.col("embedding"), q))
    return scored.groupBy("label").agg(F.round(best, 6).alias("best"), F.round(F.greatest(F.lit(0.0), best), 6).alias("top_similarity"))


@query("SELECT vec_id, generate_subscripts(embedding, 1)::BIGINT AS i, round(unnest(embedding)::DOUBLE * 3 / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * 9), 6) AS x FROM embeddings")
def l2_normalize(spark, sf):  # noqa: ANN001, ANN201
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    unit = vectors.l2_normalize(tripled)
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(unit).alias("i", "x")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


_PAIRS = "SELECT q.vec_id AS question, e.vec_id AS id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS similarity FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q"
_NEAREST = f"SELECT question, id, similarity, row_number() OVER (PARTITION BY question ORDER BY similarity DESC, id) AS rank FROM ({_PAIRS})"
_NEAR40 = f"SELECT question, id, round(similarity, 6) AS similarity, rank::INT AS rank FROM ({_NEAREST}) WHERE rank <= 40"


def _asking(v: DataFrame) -> DataFrame:
    """The rows that ask: those whose id is a multiple of 100."""
    return v.where(F.col("id") % 100 == 0).select(F.col("id").alias("question"), "embedding")


def _indexed(spark: SparkSession, sf: str) -> tuple[DataFrame, vector_index.VectorIndex]:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return v, vector_index.build(v, f"{folder(spark)}/vectors-{uuid.uuid4().hex}")


@query(_NEAR40)
def batch_vector_topk(spark, sf):  # noqa: ANN001, ANN201
    v, _ = _vectors(spark, sf)
    return batch.nearest(v, _asking(v)).select("question", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(_NEAR40)
def vector_index_topk(spark, sf):  # noqa: ANN001, ANN201
    """Exact search through the inverted-file index: lists that can't win aren't read."""
    v, index = _indexed(spark, sf)
    return index.search(_asking(v)).select("question", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"SELECT question, id, round(similarity, 6) AS similarity, rank::INT AS rank FROM (SELECT question, p.id, similarity, row_number() OVER (PARTITION BY question ORDER BY similarity DESC, p.id) AS rank FROM ({_PAIRS}) p JOIN embeddings e ON e.vec_id = p.id WHERE e.label IN (1, 3, 5)) WHERE rank <= 40")
def vector_index_filtered(spark, sf):  # noqa: ANN001, ANN201
    v, index = _indexed(spark, sf)
    found = index.search(_asking(v), only=v.where(F.col("label").isin(1, 3, 5)))
    return found.select("question", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query()
def vector_index_recall(spark, sf):  # noqa: ANN001, ANN201
    """The share of the 40 nearest that the calibrated probes find, by question; a test holds its mean at 0.9 or more."""
    v, index = _indexed(spark, sf)
    return vector_index.recall(index.search(_asking(v), exact=False), batch.nearest(v, _asking(v)))


@query(f"""WITH b AS (SELECT doc_id, (('0x' || substr(md5(term), 1, 8))::BIGINT % 64)::INT AS bucket, count(*) AS n FROM ({TOK}) GROUP BY 1, 2)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS x FROM b""")
def hashed_bow_embed(spark, sf):  # noqa: ANN001, ANN201
    t = table(spark, sf, "documents").select("doc_id", F.explode(vectors.bow_tokens(F.col("text"))).alias("term"))
    b = t.groupBy("doc_id", vectors.md5_bucket(F.col("term"), 64).alias("bucket")).agg(F.count("*").alias("n"))
    return b.select("doc_id", "bucket", F.round(F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy("doc_id"))), 6).alias("x"))


# ---------------------------------------------------------------- lexical


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM ({TOK}) GROUP BY term")
def postings_build(spark, sf):  # noqa: ANN001, ANN201
    return index_of(spark, sf).groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("places")).cast("long").alias("n"))


_OR = f"SELECT doc_id AS id, count(*) * 0.1 AS score FROM ({TOK}) WHERE term IN ('and', 'the', 'was') GROUP BY doc_id"


@query(f"SELECT id, round(score, 4) AS score FROM ({_OR}) ORDER BY score DESC, id LIMIT 40")
def lexical_or_topk(spark, sf):  # noqa: ANN001, ANN201
    return _top(lexical.any_matching(index_of(spark, sf), TERMS)).select("id", F.round("score", 4).alias("score"))


@query(f"SELECT id FROM (SELECT doc_id AS id FROM ({TOK}) WHERE term IN ('and', 'the', 'was') GROUP BY doc_id HAVING count(DISTINCT term) = 3)")
def lexical_and_match(spark, sf):  # noqa: ANN001, ANN201
    q = lexical.Query([[[t] for t in TERMS]])
    return lexical.matching(index_of(spark, sf), q).select(F.col("key").alias("id"))


def _cover(terms: list[str], toks: str = "unnest(ts) AS term") -> str:
    """Cover density by windows: at each place the last place of each term; their least is an extent's start, which is new when it moves."""
    last = ", ".join(f"max(CASE WHEN term = '{t}' THEN p END) OVER w AS t{i}" for i, t in enumerate(terms))
    names = [f"t{i}" for i in range(len(terms))]
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""
WITH t AS (SELECT doc_id, {toks}, generate_subscripts(ts, 1) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents)),
o AS (SELECT doc_id, p, {last} FROM t WHERE term IN ({listed}) WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT doc_id, p, least({", ".join(names)}) AS start FROM o WHERE {" AND ".join(f"{n} IS NOT NULL" for n in names)}),
g AS (SELECT doc_id, p, start, lag(start) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM s),
r AS (SELECT doc_id AS id, round(sum(0.1::DOUBLE / (1 + greatest(0, p - start + 1 - {len(terms)}))), 6) AS score FROM g WHERE before IS NULL OR start > before GROUP BY doc_id)
SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM r ORDER BY score DESC, id LIMIT 40"""


@query(_cover(TERMS))
def cover_density_rank(spark, sf):  # noqa: ANN001, ANN201
    q = lexical.Query([[[t] for t in TERMS]])
    return _top(lexical.matching(index_of(spark, sf), q).withColumn("score", F.round("score", 6))).select("id", "score", "rank")


def _term_index(spark: SparkSession, sf: str, stems: bool = False) -> term_index.TermIndex:
    # ranges of 64 keys, so that these tables have several
    return term_index.build(index_of(spark, sf), f"{folder(spark)}/terms-{uuid.uuid4().hex}", stems, 64)


@query(f"SELECT id, round(score, 4) AS score FROM ({_OR}) ORDER BY score DESC, id LIMIT 40")
def term_index_topk(spark, sf):  # noqa: ANN001, ANN201
    """The clustered index, range by range while its bound reaches the k-th score."""
    found = _term_index(spark, sf).any_of(TERMS)
    return found.select(F.col("key").alias("id"), F.round("score", 4).alias("score"))


@query(_cover(TERMS))
def term_index_cover_density(spark, sf):  # noqa: ANN001, ANN201
    found = _term_index(spark, sf).all_of(lexical.Query([[[t] for t in TERMS]]))
    return _top(found.withColumn("score", F.round("score", 6))).select("id", "score", "rank")


_ASKED = f"""t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{lexical.TOKEN}')) AS term, generate_subscripts(regexp_extract_all(lower(coalesce(text, '')), '{lexical.TOKEN}'), 1) AS pos FROM documents),
tf AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY doc_id, term),
a AS (SELECT doc_id AS question, term FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS r FROM t WHERE doc_id % 100 = 0 GROUP BY doc_id, term) WHERE r <= 12),
m AS (SELECT question, count(*) AS need FROM a GROUP BY question),
g AS (SELECT question, doc_id AS id, count(*) = need AS full_match, sum(n)::BIGINT AS places FROM a JOIN tf USING (term) JOIN m USING (question) GROUP BY question, doc_id, need),
l AS (SELECT question, id, places, row_number() OVER (PARTITION BY question ORDER BY full_match DESC, places DESC, id)::INT AS rank FROM g)"""


def _batch_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """All documents whose id is a multiple of 100 ask with their first twelve terms."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = batch.question_terms(d.where(F.col("id") % 100 == 0).select(F.col("id").alias("question"), "text"), most=12, stop=[])
    return batch.lexical_top(d, asked, stop=[]).drop("mode")


@query(f"WITH {_ASKED} SELECT * FROM l WHERE rank <= 40")
def batch_lexical_topk(spark, sf):  # noqa: ANN001, ANN201
    return _batch_lexical(spark, sf)


@query(f"""WITH {_ASKED}, v AS ({_NEAREST}),
b AS (SELECT question, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT question, id, rank FROM l WHERE rank <= 40 UNION ALL SELECT question, id, rank FROM v WHERE rank <= 40) GROUP BY question, id)
SELECT * FROM (SELECT question, id, round(score, 6) AS score, row_number() OVER (PARTITION BY question ORDER BY score DESC, id)::INT AS rank FROM b) WHERE rank <= 10""")
def batch_rrf(spark, sf):  # noqa: ANN001, ANN201
    v, _ = _vectors(spark, sf)
    found = batch.fused([batch.nearest(v, _asking(v)), _batch_lexical(spark, sf)], 10)
    return found.select("question", "id", F.round("score", 6).alias("score"), "rank")


def _stem_sql(c: str) -> str:
    """The stemmer's steps in SQL."""
    a = c
    for pattern in term_index.PLURALS:
        a = f"regexp_replace({a}, '{pattern}', '\\1')"
    b = f"regexp_replace({a}, '{term_index.FORMS}', '\\1')"
    out = f"(CASE WHEN {b} <> {a} AND regexp_matches({b}, '{term_index.DOUBLED}') THEN left({b}, -1) ELSE {b} END)"
    for pattern, more in term_index.ENDS:
        out = f"regexp_replace({out}, '{pattern}', '\\1{more}')"
    return f"(CASE WHEN regexp_full_match({c}, '[a-z]{{4,}}') THEN {out} ELSE {c} END)"


@query(f"SELECT stem AS term, count(DISTINCT doc_id) AS df, count(*) AS n FROM ({TOK}) t JOIN (SELECT term, {_stem_sql('term')} AS stem FROM (SELECT DISTINCT term FROM ({TOK}))) USING (term) GROUP BY stem")
def stemmed_postings(spark, sf):  # noqa: ANN001, ANN201
    rows = term_index.stemmed(index_of(spark, sf))
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("places")).cast("long").alias("n"))


@query("""WITH t AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id) AS p FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)),
n AS (SELECT doc_id, term, p, lead(term) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM t) SELECT doc_id AS id FROM n WHERE term = 'and' AND nxt = 'the' GROUP BY doc_id""")
def lexical_phrase(spark, sf):  # noqa: ANN001, ANN201
    return lexical.matching(index_of(spark, sf), lexical.Query([[["and", "the"]]])).select(F.col("key").alias("id"))


@query(f"""WITH strict AS (SELECT doc_id AS id, count(*) AS n FROM ({TOK}) WHERE term IN ('erinannd', 'reou') GROUP BY doc_id HAVING count(DISTINCT term) = 2),
loose AS (SELECT doc_id AS id, count(*) * 0.1 AS score FROM ({TOK}) WHERE term IN ('erinannd', 'reou') GROUP BY doc_id ORDER BY score DESC, id LIMIT 40)
SELECT id, min(pass) AS pass FROM (SELECT id, 1 AS pass FROM strict UNION ALL SELECT id, 2 FROM loose) GROUP BY id""")
def lexical_two_pass(spark, sf):  # noqa: ANN001, ANN201
    i = index_of(spark, sf)
    words = ["erinannd", "reou"]
    strict = lexical.matching(i, lexical.Query([[[w] for w in words]])).select(F.col("key").alias("id"), F.lit(1).alias("pass"))
    loose = _top(lexical.any_matching(i, words)).select("id", F.lit(2).alias("pass"))
    return strict.unionByName(loose).groupBy("id").agg(F.min("pass").alias("pass"))


# ---------------------------------------------------------------- fusion

_V40 = f"(SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM ({VEC}) ORDER BY similarity DESC, id LIMIT 40)"
_L40 = f"(SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({_OR}) ORDER BY score DESC, id LIMIT 40)"
_RRF = f"SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM {_V40} UNION ALL SELECT * FROM {_L40}) GROUP BY id"


def _lists(spark, sf):  # noqa: ANN001, ANN202
    v, q = _vectors(spark, sf)
    return retrieve.vector_candidates(v, q), _top(lexical.any_matching(index_of(spark, sf), TERMS))


@query(f"SELECT id, round(score, 6) AS score FROM ({_RRF}) ORDER BY score DESC, id LIMIT 10")
def rrf_hybrid(spark, sf):  # noqa: ANN001, ANN201
    fused = retrieve.fuse(list(_lists(spark, sf)))
    return fused.orderBy(F.col("score").desc(), "id").limit(10).select("id", F.round("score", 6).alias("score"))


@query(f"""SELECT d.source AS section, round(max(score), 6) AS score, min(v.rank)::BIGINT AS vector_rank, min(l.rank)::BIGINT AS lexical_rank, count(*) AS chunks
FROM ({_RRF}) f JOIN documents d ON d.doc_id = f.id LEFT JOIN {_V40} v ON v.id = f.id LEFT JOIN {_L40} l ON l.id = f.id GROUP BY d.source""")
def rrf_group_sections(spark, sf):  # noqa: ANN001, ANN201
    v, words = _lists(spark, sf)
    d = documents(spark, sf).select("id", F.col("corpus_id").alias("section_id"), F.lit("body").alias("kind"), F.lit(0).alias("ordinal"), F.col("text").alias("content"))
    g = retrieve.grouped(retrieve.fuse([v, words]), v, words, d, 1_000_000)
    return g.select(F.col("section_id").alias("section"), F.round("score", 6).alias("score"), F.col("vector_rank").cast("long"), F.col("lexical_rank").cast("long"), F.size("matched_chunks").cast("long").alias("chunks"))


@query(f"""WITH a AS (SELECT (SELECT max(similarity) FROM ({VEC}) WHERE id <> 0) AS sim, (SELECT count(*) FROM ({TOK}) WHERE term = 'zebra') AS strict)
SELECT round(sim, 4) AS top_similarity, strict AS strict_hits, strict = 0 AND sim < 0.66 AS abstain FROM a""")
def abstain_flag(spark, sf):  # noqa: ANN001, ANN201
    v, q = _vectors(spark, sf)
    sim = v.where("id != 0").agg(F.max(vectors.query_dot(F.col("embedding"), q)).alias("sim"))
    strict = lexical.matching(index_of(spark, sf), lexical.parse("zebra")).count()
    top = sim.first()["sim"]
    return spark.createDataFrame([(round(top, 4), strict, retrieve.abstains("hybrid", strict, strict, top, 0.66))], "top_similarity double, strict_hits long, abstain boolean")


_AMEND = "SELECT lang AS corpus_id, source AS number, min(doc_id) AS amendment_id FROM documents WHERE doc_id % 5 = 0 GROUP BY 1, 2"


def _layered(spark, sf):  # noqa: ANN001, ANN202
    d = documents(spark, sf)
    return d.select("id", F.col("lang").alias("corpus_id"), F.col("corpus_id").alias("number"), F.lit(None).cast("string").alias("supersedes_number"), "layer")


@query(_AMEND)
def amendment_for(spark, sf):  # noqa: ANN001, ANN201
    return lookup.amendments_for(_layered(spark, sf))


@query(f"""WITH top AS (SELECT d.doc_id AS id, score, row_number() OVER (ORDER BY score DESC, d.doc_id) AS position, lang AS corpus_id, source AS number, doc_id % 5 <> 0 AS base FROM ({_OR}) o JOIN documents d ON d.doc_id = o.id ORDER BY score DESC, d.doc_id LIMIT 8),
b AS (SELECT id, position, 1 AS part, false AS overlay FROM top UNION ALL SELECT amendment_id, position, 0, true FROM top JOIN ({_AMEND}) USING (corpus_id, number) WHERE base),
o AS (SELECT id, overlay, row_number() OVER (ORDER BY position, part) AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position, part) AS rn FROM b) WHERE rn = 1)
SELECT id, overlay, place FROM o WHERE place <= 8 + (SELECT count(*) > 0 FROM o WHERE overlay AND place <= 9)::INT""")
def amendment_overlay(spark, sf):  # noqa: ANN001, ANN201
    top = retrieve.ranked(lexical.any_matching(index_of(spark, sf), TERMS).withColumnRenamed("key", "id"), [F.col("score").desc(), F.col("id")], 8)
    hits = top.join(_layered(spark, sf), "id").select(F.col("id").alias("section_id"), F.col("rank").alias("position"), "corpus_id", "number", "layer", "score")
    out = retrieve.overlaid(hits, lookup.amendments_for(_layered(spark, sf)), 8)
    return out.select(F.col("section_id").alias("id"), "overlay", F.col("place").cast("long").alias("place"))


# ---------------------------------------------------------------- numbers and tree reads


@query(TREE + "SELECT number, number_norm, depth + 1 AS dots FROM s")
def normalize_number(spark, sf):  # noqa: ANN001, ANN201
    s = sections(spark, sf)
    return s.select("number", "number_norm", numbers.dotted_depth(F.col("number")).alias("dots"))


@query(TREE + "SELECT id, number AS stripped FROM s")
def strip_ref_prefix(spark, sf):  # noqa: ANN001, ANN201
    s = sections(spark, sf)
    lead = F.element_at(F.array(*[F.lit(x) for x in ("Section ", "§", "Table ", "sec. ")]), (F.col("id") % 4 + 1).cast("int"))
    return s.select("id", numbers.strip_ref_prefix(F.concat(lead, "number", F.lit("."))).alias("stripped"))


@query(TREE + "SELECT id, title || ' §' || number || CASE WHEN ordinal > 0 THEN ' (p. ' || ordinal || ')' ELSE '' END AS cite FROM s")
def citation(spark, sf):  # noqa: ANN001, ANN201
    return sections(spark, sf).select("id", numbers.citation(F.col("title"), F.lit(None).cast("string"), F.lit("code"), F.col("number"), F.col("ordinal")).alias("cite"))


@query(TREE + "SELECT layer, depth, count(*) AS n FROM s WHERE starts_with(split_part(number, '.', 1), '10') AND depth > 0 GROUP BY layer, depth")
def chapter_prefix_filter(spark, sf):  # noqa: ANN001, ANN201
    return sections(spark, sf).where(numbers.in_chapter(F.col("number"), "10") & (F.col("depth") > 0)).groupBy("layer", "depth").agg(F.count("*").alias("n"))


@query(TREE + "SELECT q.i::BIGINT AS i, s.id, s.title FROM s JOIN (VALUES (0, '101.1'), (1, '102.9')) q(i, n) ON s.number = q.n")
def exact_number_injection(spark, sf):  # noqa: ANN001, ANN201
    named = retrieve.numbers_in("is 101.1 like 102.9, or 101.1 again, but not 1004")
    asked = spark.createDataFrame(list(enumerate(named)), "i long, number string")
    return lookup.find_sections(asked.select("number"), sections(spark, sf)).join(asked, "number").select("i", "id", "title")


@query(TREE + "SELECT number, layer, (SELECT count(*) FROM s c WHERE c.parent_id = s.id) AS children FROM s WHERE depth = 0")
def list_chapters(spark, sf):  # noqa: ANN001, ANN201
    return lookup.list_chapters(sections(spark, sf)).select("number", "layer", "children")


@query(TREE + "SELECT document_id, repeat('  ', depth) || number || ' ' || title || CASE WHEN layer = 'amendment' THEN ' (amendment)' ELSE '' END AS line FROM s WHERE depth <= 2")
def toc_outline(spark, sf):  # noqa: ANN001, ANN201
    return lookup.contents(sections(spark, sf)).select("document_id", "line")


@query(TREE + "SELECT number, min(id) AS id FROM s GROUP BY number")
def find_section(spark, sf):  # noqa: ANN001, ANN201
    s = sections(spark, sf)
    return lookup.find_sections(s.select("number").distinct(), s).select("number", "id")


@query(TREE + ", q AS (SELECT '0101.0007.9999' AS w) SELECT number FROM (SELECT DISTINCT number, number_norm FROM s WHERE depth > 0), q ORDER BY abs(length(number) - length('101.7.9999')), (number_norm <= w) DESC, CASE WHEN number_norm <= w THEN number_norm END DESC NULLS LAST, number_norm, number LIMIT 3")
def nearest_numbers(spark, sf):  # noqa: ANN001, ANN201
    return lookup.nearest_numbers("101.7.9999", sections(spark, sf)).select("number")


@query(TREE + """, q AS (SELECT DISTINCT (100 + p_partkey % 5) || '.' || (p_partkey % 25) || '.' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.' || (p_partkey * 7) END AS asked FROM part),
m AS (SELECT asked, list_aggregate(list_transform(string_split(asked, '.'), lambda x: CASE WHEN length(x) < 4 THEN lpad(x, 4, '0') ELSE x END), 'string_agg', '.') AS w FROM q WHERE asked NOT IN (SELECT number FROM s)),
d AS (SELECT DISTINCT number, number_norm FROM s WHERE depth > 0),
r AS (SELECT asked, number, row_number() OVER (PARTITION BY asked ORDER BY abs(length(number) - length(asked)), (number_norm <= w) DESC, CASE WHEN number_norm <= w THEN number_norm END DESC NULLS LAST, number_norm, number)::INT AS rank FROM m, d)
SELECT * FROM r WHERE rank <= 3""")
def nearest_numbers_batch(spark, sf):  # noqa: ANN001, ANN201
    """Numbers made of all part keys that no section has, each with the three closest there are."""
    s, p = sections(spark, sf), F.col("p_partkey")
    text = lambda c: c.cast("string")
    asked = F.concat(F.concat_ws(".", text(100 + p % 5), text(p % 25), text(p)), F.when(p % 3 == 0, "").otherwise(F.concat(F.lit("."), text(p * 7))))
    missing = table(spark, sf, "part").select(asked.alias("number")).join(s.select("number"), "number", "left_anti")
    return lookup.nearest_for(missing, s)


@query(TREE + "SELECT id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id, lead(number) OVER w AS next_number FROM s WINDOW w AS (PARTITION BY document_id, parent_id ORDER BY ordinal, id)")
def siblings(spark, sf):  # noqa: ANN001, ANN201
    return lookup.siblings(sections(spark, sf)).select("id", "prev_id", "next_id", "next_number")


@query(TREE + "SELECT parent_id AS id, count(*) AS children FROM s WHERE parent_id IS NOT NULL GROUP BY parent_id")
def children(spark, sf):  # noqa: ANN001, ANN201
    s = sections(spark, sf)
    return lookup.children(s, s).groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))


@query(TREE + ", m AS (SELECT id, parent_id, number FROM s), l AS (SELECT a.id, b.id AS anc, 1 AS dist FROM m a JOIN m b ON a.parent_id = b.id), l2 AS (SELECT l.id, m.parent_id AS anc, 2 AS dist FROM l JOIN m ON l.anc = m.id WHERE m.parent_id IS NOT NULL), l3 AS (SELECT l2.id, m.parent_id AS anc, 3 AS dist FROM l2 JOIN m ON l2.anc = m.id WHERE m.parent_id IS NOT NULL) SELECT x.id, x.anc, x.dist, m.number FROM (SELECT * FROM l UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) x JOIN m ON m.id = x.anc")
def ancestors_recursive(spark, sf):  # noqa: ANN001, ANN201
    s = _ordered(spark, sf).withColumnsRenamed({"document": "document_id", "ord": "ordinal"})
    return lookup.ancestors(s).select("id", "anc", "dist", "number")


def _ordered(spark, sf):  # noqa: ANN001, ANN202
    """Sections with their places, which go on from document to document: numbered by ranges, since the five documents hold all rows."""
    s = sections(spark, sf).select("id", "number", "title", "depth", F.col("document_id").cast("string").alias("document"), "number_norm")
    return store.numbered(s, ["document", "number_norm"], 0, "ord").drop("number_norm")


@query(TREE + ", p AS (SELECT s.id, CASE s.depth WHEN 0 THEN s.number || ' ' || s.title WHEN 1 THEN p1.number || ' ' || p1.title || ' > ' || s.number || ' ' || s.title WHEN 2 THEN p2.number || ' ' || p2.title || ' > ' || p1.number || ' ' || p1.title || ' > ' || s.number || ' ' || s.title ELSE p3.number || ' ' || p3.title || ' > ' || p2.number || ' ' || p2.title || ' > ' || p1.number || ' ' || p1.title || ' > ' || s.number || ' ' || s.title END AS path FROM s LEFT JOIN s p1 ON p1.id = s.parent_id LEFT JOIN s p2 ON p2.id = p1.parent_id LEFT JOIN s p3 ON p3.id = p2.parent_id) SELECT id, path FROM p")
def breadcrumb(spark, sf):  # noqa: ANN001, ANN201
    s = _ordered(spark, sf)
    return tree.breadcrumbs(s).join(s, ["document", "ord"]).select("id", "path")


@query(TREE + "SELECT id, parent_id FROM s")
def tree_parent_window(spark, sf):  # noqa: ANN001, ANN201
    s = _ordered(spark, sf)
    return tree.lineage(s, ["id"]).select("id", F.try_element_at("above", F.lit(-1))["id"].alias("parent_id"))


@query("SELECT doc_id AS ord, source || CASE WHEN row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) > 1 THEN '(' || row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) || ')' ELSE '' END AS number FROM documents")
def dup_alias(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "documents").select(F.col("lang").alias("document"), F.col("source").alias("number"), F.col("doc_id").alias("ord"), F.lit(None).cast("string").alias("alias"))
    return tree.unique_numbers(d).select("ord", "number")


# ---------------------------------------------------------------- corpora, references, store


@query("SELECT source AS id, count(*) AS sections, sum(len(string_split(text, chr(10))))::BIGINT AS chunks, count(DISTINCT lang) AS documents, string_agg(DISTINCT lang, ',' ORDER BY lang) AS titles FROM documents GROUP BY source")
def list_corpora(spark, sf):  # noqa: ANN001, ANN201
    d = documents(spark, sf)
    corpora = d.select(F.col("corpus_id").alias("id")).distinct()
    docs = d.select("corpus_id", F.col("lang").alias("title")).distinct().select("corpus_id", F.col("title").alias("id"), "title", F.lit("base").alias("layer"), F.lit(None).cast("string").alias("version"))
    lines = d.select("corpus_id", F.explode(F.split("text", "\n")).alias("content"))
    out = lookup.list_corpora(corpora, docs, d, lines)
    return out.select("id", "sections", "chunks", F.size("documents").cast("long").alias("documents"), F.array_join(F.transform("documents", lambda x: x["title"]), ",").alias("titles"))


@query("SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def page_links(spark, sf):  # noqa: ANN001, ANN201
    return files.page_links(table(spark, sf, "pages"))


@query("""WITH r AS (SELECT doc_id, 1000 + doc_id % 9 AS a, doc_id % 4 AS b, 1000 + doc_id % 3 AS c, doc_id % 99 AS d FROM documents)
SELECT doc_id, a || '.' || b AS number, 'section' AS kind FROM r UNION ALL SELECT doc_id, c::VARCHAR, 'table' FROM r UNION ALL SELECT doc_id, d::VARCHAR, 'chapter' FROM r""")
def cross_refs_extract(spark, sf):  # noqa: ANN001, ANN201
    k = F.col("doc_id")
    s = lambda x: x.cast("string")
    a = F.concat(s(1000 + k % 9), F.lit("."), s(k % 4))
    text = F.concat(F.lit("See Section "), a, F.lit(" and Table "), s(1000 + k % 3), F.lit("; Sections "), a, F.lit(", Chapter "), s(k % 99))
    return table(spark, sf, "documents").select("doc_id", F.explode(extract.cross_refs(text)).alias("r")).select("doc_id", "r.number", "r.kind")


def _refs(spark, sf):  # noqa: ANN001, ANN202
    line = table(spark, sf, "lineitem")
    return line.select(F.col("l_orderkey").alias("from_section_id"), F.lit("code").alias("corpus_id"), F.col("l_partkey").cast("string").alias("ref_number"), F.col("l_linenumber").alias("n"))


def _parts(spark, sf):  # noqa: ANN001, ANN202
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.lit("code").alias("corpus_id"), (F.col("p_partkey") - F.col("p_partkey") % 3).cast("string").alias("number"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 5 == 0, "amendment").otherwise("base").alias("layer"))


_PARTS = "p AS (SELECT p_partkey AS id, (p_partkey - p_partkey % 3)::VARCHAR AS number, p_name AS title, p_size % 5 = 0 AS late FROM part), best AS (SELECT number, coalesce(min(id) FILTER (late), min(id)) AS to_id FROM p GROUP BY number)"


@query(f"WITH {_PARTS} SELECT l_orderkey AS from_section_id, l_linenumber AS n, l_partkey::VARCHAR AS ref_number, to_id AS to_section_id FROM lineitem LEFT JOIN best ON number = l_partkey::VARCHAR")
def resolve_refs(spark, sf):  # noqa: ANN001, ANN201
    return extract.resolved(_refs(spark, sf), _parts(spark, sf)).select("from_section_id", "n", "ref_number", "to_section_id")


@query(f"WITH {_PARTS} SELECT l_partkey::VARCHAR AS ref_number, count(*) AS n FROM lineitem WHERE l_partkey::VARCHAR NOT IN (SELECT number FROM best) GROUP BY 1")
def broken_refs(spark, sf):  # noqa: ANN001, ANN201
    r = lookup.references_out(extract.resolved(_refs(spark, sf), _parts(spark, sf)))
    return r.where(~F.col("resolved")).groupBy("ref_number").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS from_section_id, l_linenumber AS n, CASE WHEN l_partkey % 2 = 0 THEN l_partkey WHEN l_partkey % 7 = 0 THEN l_partkey + 1000000 END AS to_section_id FROM lineitem")
def dangling_backfill(spark, sf):  # noqa: ANN001, ANN201
    r = _refs(spark, sf).withColumn("to_section_id", F.when(F.col("ref_number").cast("long") % 2 == 0, F.col("ref_number").cast("long")))
    new = table(spark, sf, "part").where("p_partkey % 7 = 0").select((F.col("p_partkey") + 1_000_000).alias("id"), F.lit("code").alias("corpus_id"), F.col("p_partkey").cast("string").alias("number"))
    return extract.backfilled(r, new).select("from_section_id", "n", "to_section_id")


@query("SELECT l_partkey AS to_section_id, o_orderkey AS number, o_orderpriority AS title FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey")
def referenced_by(spark, sf):  # noqa: ANN001, ANN201
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("from_section_id"), F.col("l_partkey").alias("to_section_id"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("title"))
    return lookup.referenced_by(r, o)


@query("SELECT lower(sha256(text)) AS sha, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1")
def dedupe_sha256(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return store.firsts(d).select(F.col("sha256").alias("sha"), F.col("path").alias("first"), "copies")


@query("SELECT o_orderkey AS id, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey END AS to_section_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 7 <> 0")
def delete_cascade(spark, sf):  # noqa: ANN001, ANN201
    """Orders (odd ids) and customers (even ones) are sections that refer to each other; two documents go."""
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    own = orders.select((F.col("o_orderkey") * 2 + 1).alias("id"), (F.col("o_orderkey") % 7).alias("document_id"))
    of = customers.select((F.col("c_custkey") * 2).alias("id"), (F.col("c_custkey") % 10 + 100).alias("document_id"))
    all_ = own.unionByName(of)
    chunks = all_.select("id", F.col("id").alias("section_id"))
    refs = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 2 + 1).alias("from_section_id"), (F.col("o_custkey") * 2).alias("to_section_id"))
    documents = all_.select(F.col("document_id").alias("id")).distinct()
    left = store.cascade({"documents": documents, "sections": all_, "chunks": chunks, "postings": chunks.select(F.col("id").alias("key")), "cross_refs": refs}, documents.where("id in (0, 100)"))
    return left["cross_refs"].select("id", (F.col("to_section_id") / 2).cast("long").alias("to_section_id"))


# ---------------------------------------------------------------- parsing and chunking


@query("SELECT doc_id, l AS line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(l) < 80 GROUP BY doc_id, l HAVING count(*) >= 3")
def running_lines(spark, sf):  # noqa: ANN001, ANN201
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    pdf = lines.select(F.col("doc_id").cast("string").alias("document"), (F.col("n") + 1).alias("page"), "n", "text", F.lit(10.0).alias("size"), F.lit(False).alias("bold"), F.lit(False).alias("is_table"))
    kept = files.without_running_lines(pdf, pages=1)
    gone = pdf.join(kept.select("document", "n"), ["document", "n"], "left_anti")
    return gone.groupBy(F.col("document").cast("long").alias("doc_id"), F.col("text").alias("line")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT l_orderkey, round(l_quantity / 3, 1) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey AS document, arg_max(s, (n, -s)) AS body FROM c GROUP BY 1""")
def body_mode(spark, sf):  # noqa: ANN001, ANN201
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document"), (F.col("l_quantity") / 3).alias("size"))
    return files.body_sizes(lines)


@query("""WITH l AS (SELECT doc_id, rtrim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
f AS (SELECT *, CASE WHEN regexp_matches(line, '^\\s*\\|.*\\|\\s*$') THEN 'table' WHEN regexp_matches(line, '^(#{1,6})\\s+(.+?)\\s*#*\\s*$') THEN 'heading' WHEN regexp_matches(line, '^\\s*(?:[-*+]|\\d+[.)])\\s+') THEN 'list-item' WHEN trim(line) = '' THEN 'blank' ELSE 'paragraph' END AS form FROM l),
e AS (SELECT *, (form <> coalesce(lag(form) OVER w, '') OR form IN ('heading', 'list-item'))::INT AS new FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM e)
SELECT doc_id, form AS kind, count(DISTINCT run) AS blocks FROM g WHERE form <> 'blank' GROUP BY doc_id, form""")
def blocks_markdown(spark, sf):  # noqa: ANN001, ANN201
    b = files.markdown_blocks(table(spark, sf, "documents"), "doc_id")
    return b.groupBy(F.col("document").alias("doc_id"), "kind").agg(F.count("*").alias("blocks"))


@query()
def html_blocks(spark, sf):  # noqa: ANN001, ANN201
    pages = table(spark, sf, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return files.file_blocks(pages).groupBy("document", "kind").agg(F.count("*").alias("blocks"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) - 1 AS pos FROM documents)
SELECT doc_id, (pos // 512)::BIGINT AS win, count(*) AS n_tokens FROM t GROUP BY 1, 2""")
def naive_windows(spark, sf):  # noqa: ANN001, ANN201
    tokens = F.transform(vectors.bow_tokens(F.col("text")), lambda t, i: F.struct(F.floor(i / 100).alias("owner"), t.alias("token")))
    made = table(spark, sf, "documents").select("doc_id", F.inline(chunking.windows_within(tokens)))
    # rows of one id are one document
    return made.groupBy("doc_id", F.col("window").alias("win")).agg(F.sum("n_tokens").alias("n_tokens"))


@query()
def split_to_fit(spark, sf):  # noqa: ANN001, ANN201
    pieces = chunking.pack(F.split("text", "\n"), F.lit("Crumb"))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(pieces).alias("i", "piece")).select("doc_id", "i", chunking.count_tokens(F.col("piece")).alias("n"))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS paragraphs, 0::BIGINT AS exceptions FROM documents")
def exceptions_split(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "documents").select("doc_id", extract.split_exceptions(F.split("text", "\n")).alias("x"))
    return d.select("doc_id", F.size("x.body").cast("long").alias("paragraphs"), F.size("x.exceptions").cast("long").alias("exceptions"))


@query("SELECT source, lang, count(*) AS sections, count(*) FILTER (doc_id % 3 = 0) AS exceptions, nullif(max(coalesce(n_chars // 3000, 0)), 0) AS page_count, min(n_chars) AS first, max(n_chars) AS last FROM documents GROUP BY source, lang")
def ingest_stats(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "documents")
    return d.groupBy("source", "lang").agg(F.count("*").alias("sections"), F.count(F.when(F.col("doc_id") % 3 == 0, 1)).alias("exceptions"), lookup.page_count(F.floor(F.col("n_chars") / 3000)).alias("page_count"), F.min("n_chars").alias("first"), F.max("n_chars").alias("last"))


@query(TREE + "SELECT s.id, s.number, s.title, count(c.id) AS kids, min(c.number) AS first_kid, s.title AS exceptions, coalesce(s.parent_id % 2 = 0, false) AS resolved, CASE WHEN s.layer = 'base' THEN a.number END AS amended_by FROM s LEFT JOIN s c ON c.parent_id = s.id LEFT JOIN (SELECT number, replace(number, '104', '103') AS target FROM s WHERE layer = 'amendment' AND depth = 0) a ON a.target = s.number GROUP BY s.id, s.number, s.title, s.parent_id, s.layer, a.number")
def section_detail(spark, sf):  # noqa: ANN001, ANN201
    """The last region supersedes the number of the one before; each section has an exception, and refers to its parent."""
    over = F.when((F.col("layer") == "amendment") & (F.col("depth") == 0), F.regexp_replace("number", "104", "103"))
    s = sections(spark, sf).withColumns({"document_title": F.lit("Code"), "corpus_title": F.lit("Code"), "supersedes_number": over, "page_start": F.lit(None).cast("int"), "body": F.lit("")})
    chunks = s.select(F.col("id").alias("section_id"), F.lit("exception").alias("kind"), F.lit(0).alias("ordinal"), F.col("title").alias("content"))
    refs = s.where("parent_id is not null").select(F.col("id").alias("from_section_id"), F.lit("r").alias("ref_text"), "number", F.lit("section").alias("ref_kind"), F.when(F.col("parent_id") % 2 == 0, F.col("parent_id")).alias("to_section_id")).withColumnRenamed("number", "ref_number")
    d = lookup.details(s, chunks, refs, include_children=True)
    return d.select("id", "number", "title", F.coalesce(F.size("children"), F.lit(0)).cast("long").alias("kids"), F.array_min(F.transform("children", lambda c: c["number"])).alias("first_kid"), F.array_join("exceptions", ",").alias("exceptions"), F.coalesce(F.get("cross_refs", F.lit(0))["resolved"], F.lit(False)).alias("resolved"), F.col("amended_by.section_number").alias("amended_by"))


# ---------------------------------------------------------------- evaluation

def _scores(spark, sf):  # noqa: ANN001, ANN202
    """Line items of an order as its hits, by price; parts of some brands are relevant."""
    line = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    w = W.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc(), "l_linenumber")
    hits = line.select(F.lit("all").alias("mode"), F.col("l_orderkey").cast("string").alias("id"), F.row_number().over(w).alias("rank"), F.concat(F.lit("10."), F.col("p_size").cast("string")).alias("number"), F.array("l_returnflag").alias("kinds"), F.lit(False).alias("abstain"))
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.array(F.concat(F.lit("10."), (F.col("o_orderkey") % 50).cast("string"))).alias("expected_sections"), F.array(F.lit("R")).alias("expected_kinds"), F.array("o_orderpriority").alias("tags"))
    return evaluate.score(hits, asked)


_SCORES = """WITH h AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank, p_size, l_returnflag FROM lineitem JOIN part ON p_partkey = l_partkey),
c AS (SELECT *, (p_size = k % 50)::INT::DOUBLE AS credit FROM h),
p AS (SELECT k, max(CASE WHEN rank <= 1 THEN credit ELSE 0 END) AS h1, max(CASE WHEN rank <= 5 THEN credit ELSE 0 END) AS h5, coalesce(max(credit / rank) FILTER (credit > 0), 0) AS mrr, max((rank <= 5 AND l_returnflag = 'R')::INT)::DOUBLE AS kind FROM c GROUP BY k),
f AS (SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS tag, coalesce(h1, 0) AS h1, coalesce(h5, 0) AS h5, coalesce(mrr, 0) AS mrr, coalesce(kind, 0) AS kind, (k IS NULL)::INT::DOUBLE AS fa FROM orders LEFT JOIN p ON k = o_orderkey)
"""


@query(_SCORES + "SELECT id, h1::DOUBLE AS hit1, h5::DOUBLE AS hit5, round(mrr, 6) AS mrr, kind AS kind5 FROM f")
def eval_hits(spark, sf):  # noqa: ANN001, ANN201
    s = _scores(spark, sf)
    return s.select("id", F.col("`hit@1`").alias("hit1"), F.col("`hit@5`").alias("hit5"), F.round("mrr", 6).alias("mrr"), F.col("`kind@5`").alias("kind5"))


@query(_SCORES + "SELECT tag, count(*) AS n, round(avg(h5), 3) AS hit5, round(avg(mrr), 3) AS mrr, round(avg(fa), 3) AS false_abstain FROM (SELECT * FROM f UNION ALL SELECT id, NULL, h1, h5, mrr, kind, fa FROM f) GROUP BY tag")
def eval_by_tag(spark, sf):  # noqa: ANN001, ANN201
    s = evaluate.summarize(_scores(spark, sf))
    return s.select("tag", "n", F.col("`hit@5`").alias("hit5"), "mrr", "false_abstain")


@query(_SCORES + "SELECT id FROM f WHERE h5 < 1")
def eval_misses(spark, sf):  # noqa: ANN001, ANN201
    return evaluate.misses(_scores(spark, sf)).select("id")
