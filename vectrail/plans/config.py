"""Parameters of indexes and searches with their defaults; the environment overrides them, values are checked."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

PREFIX = "VECTRAIL_"


@dataclass(frozen=True)
class Config:
    metric: str = "cosine"
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    nsg_degree: int = 16
    graph_pool: int = 100
    disk_degree: int = 64
    beam_width: int = 4
    alpha: float = 1.2
    pq_parts: int = 16
    pq_bits: int = 8
    partitions: int = 100
    reorder_top_k: int = 200
    kmeans_rounds: int = 25
    seed: int = 42
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    rrf_constant: float = 60.0
    fusion_alpha: float = 0.5
    fusion_beta: float = 0.5
    cache_enabled: bool = True
    cache_capacity: int = 1000
    cache_ttl: float = 300.0

    def checked(self) -> Config:
        wrong = [
            why
            for bad, why in (
                (not 2 <= self.m <= 100, "m must be 2 to 100"),
                (self.ef_construction < 10, "ef_construction must be 10 or more"),
                (self.ef_search < 1, "ef_search must be positive"),
                (self.cache_capacity < 1, "cache_capacity must be positive"),
                (not 1 <= self.pq_bits <= 8, "pq_bits must be 1 to 8"),
                (not 0 <= self.bm25_b <= 1, "bm25_b must be 0 to 1"),
            )
            if bad
        ]
        if wrong:
            raise ValueError("; ".join(wrong))
        return self


def from_environment(env: Mapping[str, str] = os.environ, base: Config = Config()) -> Config:  # noqa: B008
    """base with VECTRAIL_<NAME> variables; values that don't parse are passed over."""
    found = {}
    for f in fields(Config):
        raw = env.get(PREFIX + f.name.upper())
        if raw is None:
            continue
        try:
            kind = type(getattr(base, f.name))
            found[f.name] = raw.strip().lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        except ValueError:
            continue
    return replace(base, **found).checked()
