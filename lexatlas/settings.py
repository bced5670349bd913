"""Engine settings, each of which an environment variable LEXATLAS_<NAME> overrides."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Fixed defaults of the retrieval model."""

    rrf_k: int = 60
    candidate_limit: int = 40
    abstain_similarity: float = 0.66
    dimensions: int = 768
    provider: str = "hashed"
    model: str = "hashed-bow"
    query_prefix: str = ""
    doc_prefix: str = ""
    allow_remote: bool = False
    chunk_target: int = 600
    chunk_cap: int = 900
    window: int = 512

    @staticmethod
    def load(env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        given = {}
        for f in fields(Settings):
            raw = env.get(f"LEXATLAS_{f.name.upper()}")
            if raw is not None:
                kind = type(f.default)
                given[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        return Settings(**given)
