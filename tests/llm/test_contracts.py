"""The registered queries on the smallest tables, every column of their contracts against plain Python."""

import hashlib
import os
import re
import zlib

import pytest

from lexatlas.llm import queries
from tests.llm.conftest import words
from tests.llm.test_line_dedup import distance
from tests.llm.test_lm_scoring import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()


def rows(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_op1(spark, docs):
    sets = {}
    for d in docs:
        w = words(d["text"], True)
        sets[d["doc_id"]] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and 100 * len(x & y) >= 85 * len(x | y):
                i, j = sorted((find(a), find(b)))
                root[j] = i
    want = {d: (len(s), min(e for e in sets if find(e) == find(d))) for d, s in sets.items()}
    assert rows(queries.op1_ngram_jaccard_join(spark, SF), "n_shingles", "component_id") == want


def test_op3(spark, docs):
    out = queries.op3_lm_scoring(spark, SF)
    got = sorted((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in out.collect())
    for g, w in zip(got, brute(docs), strict=True):
        assert g[:4] == w[:4] and all(abs(x - y) < 1e-3 for x, y in zip(g[4:], w[4:], strict=True))


def test_op4(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(public_tokenizers.path(queries.TOKENIZER)))
    t.no_padding()
    t.no_truncation()
    n = {d["doc_id"]: len(t.encode(d["text"] or "", add_special_tokens=False).ids) for d in docs}
    want = {d["doc_id"]: (len((d["text"] or "").encode()), n[d["doc_id"]], n[d["doc_id"]] > 2048) for d in docs}
    assert rows(queries.op4_token_counts(spark, SF), "n_bytes", "n_tokens", "over_limit") == want


def test_op7(spark, docs):
    own = {d["doc_id"]: words(d["text"]) for d in docs}
    first = {}
    for d in sorted(own):
        for i in range(len(own[d]) - 49):
            first.setdefault(tuple(own[d][i : i + 50]), d)
    want = {}
    for d, w in own.items():
        gone = {k for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for k in range(i, i + 50)}
        want[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    assert rows(queries.op7_substring_dedup(spark, SF), "n_words", "n_removed", "kept_sha256") == want


def test_op8(spark, docs):
    out = {r["doc_id"]: r for r in queries.op8_media(spark, SF).collect()}
    texts = {}
    for d in docs:
        raw, r = (d["text"] or "").encode(), out[d["doc_id"]]
        payload = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] > 0 and len(r["media_sha256"]) == 64 and r["feature"]
        assert texts.setdefault(d["text"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert len(out) == len(docs)


def secrets_of(text):
    key = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(key, text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_op9(spark):
    larger = SF.replace("0.001", "0.01")  # the smallest table has no secret
    want = {}
    for d in spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "text").collect():
        s = secrets_of(d["text"] or "")
        spans = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        want[d["doc_id"]] = (*[sum(x[3] == k for x in s) for k in ("assign", "access", "hex")], hashlib.sha256(spans.encode()).hexdigest(), spans)
    assert rows(queries.op9_secret_scan(spark, larger), "n_assign", "n_access", "n_hex", "base_sha256", "spans") == want
    assert any(w[0] + w[1] + w[2] for w in want.values())


def test_op10(spark, docs):
    seen = {}
    for d in sorted(docs, key=lambda r: r["doc_id"]):
        for k, x in enumerate((d["text"] or "").split("\n")):
            seen.setdefault(x.strip(" \t\r\xa0"), (d["doc_id"], k))
    seen.pop("", None)
    by = {}
    for x in seen:
        by.setdefault(len(x), []).append(x)
    bag = {x: {c: x.count(c) for c in set(x)} for x in seen}

    def near(x, y):
        if sum(abs(bag[x].get(c, 0) - bag[y].get(c, 0)) for c in bag[x].keys() | bag[y].keys()) > 4:
            return False
        return distance(x, y) <= 2

    bound = {x: min([at, *[seen[y] for n in range(len(x) - 2, len(x) + 3) for y in by.get(n, []) if min(len(x), n) >= 3 and seen[y] < at and near(x, y)]]) for x, at in seen.items()}
    want = {}
    for d in docs:
        lines = (d["text"] or "").split("\n")
        kept = [x for k, x in enumerate(lines) if not x.strip(" \t\r\xa0") or (d["doc_id"], k) <= bound[x.strip(" \t\r\xa0")]]
        want[d["doc_id"]] = (len(lines) if d["text"] is not None else 0, len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    assert rows(queries.op10_line_dedup(spark, SF), "n_lines", "n_removed", "kept_sha256") == want


def test_results_of_the_others(spark, docs):
    """One row per document, with the model's columns; leaks name items that are there."""
    ids = sorted(d["doc_id"] for d in docs)
    scored = queries.op6_quality_classifier(spark, SF).collect()
    assert sorted(r["doc_id"] for r in scored) == ids and all(0 <= r["p_quality"] <= 1 and 0 <= r["p_toxic"] <= 1 and r["keep"] == (r["p_quality"] >= 0.5 and r["p_toxic"] < 0.5) for r in scored)
    items = {r["item_id"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    leaks = queries.op2_decontamination(spark, SF).collect()
    assert {r["item_id"] for r in leaks} <= items and {r["doc_id"] for r in leaks} <= set(ids)
