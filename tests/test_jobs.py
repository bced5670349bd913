import json
import logging
import re

import pytest

from jobs import chunk_feed, common, retrieval_report
from lexatlas.functions import lexical
from lexatlas.operators import batch

SCHEMA = "doc_id long, text string, lang string, source string"
PIECE = re.compile(r"[ \t-\r]*(?:[^\W_]+|[^ \t-\r])")


def chunks(docs, window):
    """{(doc_id, corpus, window, n_tokens, n_terms, text)} in plain Python."""
    out = []
    for doc_id, text, _, source in docs:
        found = PIECE.findall(text or "")
        for w in range(0, len(found), window):
            piece = "".join(found[w : w + window]).lstrip(" \t\n\x0b\x0c\r")
            terms = [t for t in re.findall(r"[0-9]+(?:\.[0-9]+)+|[^\W_]+", piece.lower()) if t not in lexical.STOP]
            out.append((doc_id, source, w // window, len(found[w : w + window]), len(terms), piece))
    return sorted(out, key=str)


def held(df):
    return sorted(map(tuple, df.select("doc_id", "corpus", "window", "n_tokens", "n_terms", "text").collect()), key=str)


FIRST = [(1, "Of one thing.\nSee 12.5, and more - words!", "en", "a"), (2, None, "en", "a"), (3, "", "fr", None), (4, " \n ", "fr", "b"), (None, "no id here", "en", "b"), (5, "same same", "en", "c=1/x"), (5, "same same", "en", "c=1/x"), (6, "word " * 1300, "en", "a"), (7, "was here once", "en", "a")]
SECOND = [(1, "A new version of one.", "en", "b"), (7, "  ", "en", "a"), (8, "newcomer", "en", "a"), (None, "no id here", "en", "b")]


@pytest.fixture
def growing(spark, tmp_path):
    def add(rows, name):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return add, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")


def test_feed_takes_only_what_is_new(spark, growing):
    add, source, out, checkpoint = growing
    add(FIRST, "a")
    assert chunk_feed.run(spark, source, out, checkpoint, {"window": 100})["documents"] == len(FIRST)
    assert held(chunk_feed.current(spark, out)) == chunks(FIRST, 100)
    assert chunk_feed.run(spark, source, out, checkpoint, {"window": 100}) == {"batches": 0, "documents": 0, "chunks": 0}
    add(SECOND, "b")
    before = {r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(out).select("path").collect()}
    done = chunk_feed.run(spark, source, out, checkpoint, {"window": 100})
    assert (done["batches"], done["documents"]) == (1, len(SECOND))
    after = {r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(out).select("path").collect()}
    # what stood there wasn't written again
    assert before < after
    # newer versions take the place of older ones, and a blank one of all
    want = [d for d in FIRST if d[0] not in (1, 7)] + [d for d in SECOND if d[0] != 7]
    assert held(chunk_feed.current(spark, out)) == chunks(want, 100)


def test_feed_in_small_batches_and_after_a_failure(spark, growing, monkeypatch):
    add, source, out, checkpoint = growing
    add(FIRST[:4], "a")
    add(FIRST[4:], "b")
    real, calls = chunk_feed.write_batch, []

    def breaks(docs, number, *rest):
        real(docs, number, *rest)
        calls.append(number)
        if len(calls) == 1:
            raise RuntimeError("lost after its rows were written")

    monkeypatch.setattr(chunk_feed, "write_batch", breaks)
    settings = {"window": 100, "files_per_batch": 1}
    with pytest.raises(Exception, match="lost after"):
        chunk_feed.run(spark, source, out, checkpoint, settings)
    assert chunk_feed.run(spark, source, out, checkpoint, settings)["batches"] == 2
    # the batch that failed was written twice and stands once
    assert calls == [0, 0, 1] and held(chunk_feed.current(spark, out)) == chunks(FIRST, 100)


def report(docs, modes, k, terms, every):
    words = {i: [t for t in re.findall(r"[0-9]+(?:\.[0-9]+)+|[^\W_]+", (t or "").lower()) if t not in lexical.STOP] for i, (_, t, _, _) in enumerate(docs)}
    out = set()
    for q, (doc_id, _, lang, _) in enumerate(docs):
        if doc_id is None or doc_id % every:
            continue
        asked = list(dict.fromkeys(words[q]))[:terms]
        found = [(all(a in words[i] for a in asked), sum(w in asked for w in words[i]), d[0]) for i, d in enumerate(docs) if asked and any(w in asked for w in words[i])]
        for mode in modes:
            rows = [f for f in found if mode != "strict" or f[0]]
            rows = sorted(rows, key=lambda f: (-f[0] if mode == "both" else 0, -f[1], f[2]))[:k]
            out |= {(doc_id, lang, r, f[2], f[1], f[2] == doc_id, mode) for r, f in enumerate(rows, 1)} or {(doc_id, lang, None, None, None, False, mode)}
    return out


def test_report(spark, tmp_path, caplog):
    docs = [(i, " ".join(f"w{(i * j) % 17} and x{j % (i + 2)}" for j in range(1, 12 + i)), "en" if i % 2 else "fr", "s") for i in range(40)] + [(50, None, "en", "s"), (60, "the of", "en", "s"), (70, "alone", "de", "s")]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "in"))
    settings = {"k": 5, "terms": 4, "every": 10}
    with caplog.at_level(logging.INFO, "lexatlas.jobs"):
        rows = retrieval_report.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), settings)
    want = report(docs, retrieval_report.DEFAULTS["modes"], 5, 4, 10)
    assert {tuple(r) for r in rows.collect()} == want and rows.count() == len(want)
    again = retrieval_report.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), settings | {"modes": ["both"]})
    assert {tuple(r) for r in again.collect()} == want and again.count() == len(want)
    assert "hit@5" in caplog.text and "for 7 questions" in caplog.text
    s = {(r["mode"], r["tag"]): r for r in retrieval_report.summary(again).collect()}
    assert s["strict", "de"]["hit@1"] == 1.0 and s["both", None]["n"] == 7


def test_commands(spark, growing, tmp_path, monkeypatch):
    add, source, out, checkpoint = growing
    add(FIRST, "a")
    (tmp_path / "c.json").write_text(json.dumps({"window": 50}))
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    work = lambda s, settings, at: chunk_feed.run(s, at["source"], at["out"], at["checkpoint"], settings)
    common.command("chunk_feed", work, {"source": "", "out": "", "checkpoint": ""}, [str(tmp_path / "c.json"), "--source", source, "--out", out, "--checkpoint", checkpoint])
    assert held(chunk_feed.current(spark, out)) == chunks(FIRST, 50)


def test_nearest_and_fused(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 8)).round(1)
    vectors[5:60] = vectors[4]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(1000, None)]
    base = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    asked = base.where("id % 7 = 0").withColumnRenamed("id", "question")
    exact = np.round(np.array(vectors, np.float32).astype(np.float64) @ np.array(vectors, np.float32).astype(np.float64).T, 9)
    monkeypatch.setattr(batch, "slices", lambda q, real=batch.slices: real(q, 16))
    got = {}
    for r in batch.nearest(base, asked, 9).collect():
        got.setdefault(r["question"], []).append((r["rank"], r["id"], r["similarity"]))
    for q in range(0, 300, 7):
        want = sorted(range(300), key=lambda i: (-exact[q, i], i))[:9]
        assert sorted(got[q]) == [(n, i, exact[q, i]) for n, i in enumerate(want, 1)]
    assert len(got) == len(range(0, 300, 7))
    assert batch.nearest(base, asked.limit(0), 9).count() == 0 and batch.nearest(base.limit(0), asked, 9).count() == 0
    one = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "question long, id long, rank int")
    two = spark.createDataFrame([(1, 11, 1)], "question long, id long, rank int")
    assert [tuple(r) for r in batch.fused([one, two]).orderBy("question", "rank").collect()] == [(1, 11, round(1 / 61 + 1 / 62, 9), 1), (1, 10, round(1 / 61, 9), 2), (2, 10, round(1 / 61, 9), 1)]
