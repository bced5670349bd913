import random

import pytest

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW) if lower else (text or ""))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, and extra columns with names used inside."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = prose(300)
    rows = [(1, base, "a"), (2, base, "a"), (2, base, "a"), (3, None, "b"), (4, "", None), (5, " \t\n ", "b"), (None, prose(80), "a"), (None, base, None), (6, "one two", "c"), (7, "One  TWO", "c"), (8, prose(6000), "a"), (9, base.replace("w7 ", "zz ", 1), "a"), (10, prose(120) + "\n" + base, "b"), (11, "Ünï cödé wörds — ok", "b")]
    extra = "t string, key string, h long, block long, item string, copy string, size string, keep string, media string, blob string, n_lines string, rate string, __gone string"
    filler = tuple("x" if "string" in c else 1 for c in extra.split(", "))
    return spark.createDataFrame([(*r, "en", len(r[1] or ""), *filler) for r in rows], f"doc_id long, text string, source string, lang string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
