"""Vector columns: normalisation, cosine similarity and hashed bag-of-words embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: below this similarity the hashed embedding is taken for a miss.
HASHED_FLOOR = 0.30


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Unit vector; the zero vector stays."""
    n = F.coalesce(F.nullif(norm(a), F.lit(0.0)), F.lit(1.0))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def query_dot(vector: Column, query: list[float]) -> Column:
    """Dot product with a literal vector."""
    return dot(vector, F.array(*[F.lit(float(x)) for x in query]))


def bow_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def md5_bucket(token: Column, size: int) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % size).cast("int")


def hashed_embedding(dimensions: int):  # noqa: ANN201
    """A pandas UDF text -> unit vector: each token adds 1 at its BLAKE2b hash and a half at the hash shifted by 16 bits;
    a text without tokens points along the first axis."""
    import hashlib
    import re

    import numpy as np

    word = re.compile("[a-z0-9]+")

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for texts in parts:
            out = []
            for t in texts:
                v = np.zeros(dimensions)
                for w in word.findall((t or "").lower()):
                    h = known.get(w)
                    if h is None:
                        if len(known) > 200_000:
                            known.clear()
                        h = known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                    v[h % dimensions] += 1.0
                    v[(h >> 16) % dimensions] += 0.5
                if not v.any():
                    v[0] = 1.0
                out.append((v / np.linalg.norm(v)).astype("float32"))
            yield pd.Series(out)

    return embed


class HashedEmbedder:
    """Deterministic embedder without a model."""

    name, floor = "hashed-bow", HASHED_FLOOR

    def __init__(self, dimensions: int = 768) -> None:
        self.dimensions = dimensions

    def documents(self, text: Column) -> Column:
        return hashed_embedding(self.dimensions)(text)

    def query(self, spark, text: str) -> list[float]:  # noqa: ANN001
        return [float(x) for x in spark.createDataFrame([(text,)], "t string").select(self.documents(F.col("t"))).first()[0]]


class LocalEmbedder:
    """A sentence-transformers model, loaded once per Python worker; prefixes mark documents and queries."""

    floor = 0.66

    def __init__(self, model: str, dimensions: int, query_prefix: str = "", doc_prefix: str = "") -> None:
        self.name, self.dimensions, self.query_prefix, self.doc_prefix = model, dimensions, query_prefix, doc_prefix

    def _embed(self, prefix: str):  # noqa: ANN202
        model = self.name

        @F.pandas_udf("array<float>")
        def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from sentence_transformers import SentenceTransformer

            encoder = SentenceTransformer(model)
            for texts in parts:
                found = encoder.encode([prefix + (t or "") for t in texts], batch_size=32, normalize_embeddings=True)
                yield pd.Series([x.astype("float32") for x in found])

        return embed

    def documents(self, text: Column) -> Column:
        return self._embed(self.doc_prefix)(text)

    def query(self, spark, text: str) -> list[float]:  # noqa: ANN001
        one = spark.createDataFrame([(text,)], "t string").select(self._embed(self.query_prefix)(F.col("t")))
        return [float(x) for x in one.first()[0]]


def embedder(provider: str, dimensions: int, allow_remote: bool = False):  # noqa: ANN201
    """The embedder of a provider; remote ones need to be allowed, since text leaves the cluster."""
    if provider == "hashed":
        return HashedEmbedder(dimensions)
    if provider in ("openai", "voyage", "remote"):
        if not allow_remote:
            raise ValueError(f"provider '{provider}' sends text to a remote service; allow_remote must be set")
        raise ValueError(f"provider '{provider}' has no client here: pass an object with documents() and query()")
    if provider == "local":
        try:
            import sentence_transformers  # noqa: F401
        except ImportError:
            raise ValueError("provider 'local' needs sentence_transformers") from None
        return LocalEmbedder("nomic-ai/nomic-embed-text-v1.5", dimensions, "search_query: ", "search_document: ")
    raise ValueError(f"no embeddings come from {provider!r}; choose hashed or local, or pass an embedder")
