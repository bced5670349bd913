import random
import time

import pytest
from pyspark.sql import functions as F

from lexatlas.llm import token_counts as t

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
CASES = ["Hello don't   worry's 'll x'", "<|endoftext|>a<|start b <|endoftext|> ", "Èéá İstanbul ΣΑΣ  x y  12345!!?'s", "", "  ", "'sx'tt!!'s", "a\x1cb\x85c​d", "한국어 é̂x日本", "x" * 300 + " y", "unbelievably " * 40]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    return lambda s: len(lib.encode(s, add_special_tokens=False).ids)


def test_every_prefix(spark, library):
    got = t.prefix_token_counts(spark.createDataFrame([(c,) for c in CASES], "text string"), PATH).collect()
    for r in got:
        assert list(r["prefix_tokens"]) == [library(r["text"][: i + 1]) for i in range(len(r["text"]))]


def test_combining_prefixes(library):
    rng = random.Random(3)
    counter = t.PrefixCounter(str(PATH))
    alphabet = ["e", "E", "a", "n", "s", "r", "l", "'", "!", "1", "\u0301", "\u0323", "\u0302", "\u0130", "\u1100", "\u1161", "\u11a8", "\u00e9", "\u212b", "\u0958", "\u093c", "\u0915", "\u09c7", "\u09be"]
    for _ in range(400):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14)))
        assert counter.combining(s) == [library(s[: i + 1]) for i in range(len(s))], ascii(s)


def test_long_runs_cost_in_proportion(library):
    counter = t.PrefixCounter(str(PATH))
    for s in ("e\u0301" * 50_000, "e" + "\u0301" * 20_000, "'re\u0301!1" * 5_000):
        began = time.monotonic()
        got = counter.chunk(s)
        assert time.monotonic() - began < 30
        assert got[-1] == library(s) and got[999] == library(s[:1000]) and len(got) == len(s)


def test_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(t, "KEEP", 4000)
    counter = t.PrefixCounter(str(PATH))
    for i in range(200):
        counter.chunk(f"word{i}")
        assert sum(map(t._cost, counter.words)) <= 4000 and sum(map(t._cost, counter.pieces)) <= 4000


def test_odd_rows(odd, none, library):
    got = t.prefix_token_counts(odd, PATH).select("text", t.total(F.col("prefix_tokens")).alias("n"), "key").collect()
    assert len(got) == odd.count() and all(r["n"] == library(r["text"] or "") for r in got)
    assert t.prefix_token_counts(none, PATH).count() == 0


def test_budgets(spark):
    df = t.prefix_token_counts(spark.createDataFrame([("hello brave new world",)], "text string"), PATH)
    r = df.select(t.count_at(F.col("prefix_tokens"), F.lit(11)).alias("a"), t.fits(F.col("prefix_tokens"), F.lit(2)).alias("f"), t.count_at(F.col("prefix_tokens"), F.lit(0)).alias("z")).first()
    assert (r["a"], r["z"]) == (2, 0) and "hello brave new world"[: r["f"]].strip() == "hello brave"
