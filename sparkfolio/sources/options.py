"""Settings of chunking and retrieval, read from the environment and kept inside their limits."""

from __future__ import annotations

import os
from dataclasses import dataclass

from sparkfolio import lexicon as lx

# --- fixed values: variable, default, lowest and highest value ---
LIMITS = {
    "chunk_size": ("RAG_CHUNK_SIZE", lx.CHUNK_SIZE, 128, 6000),
    "chunk_overlap": ("RAG_CHUNK_OVERLAP", lx.CHUNK_OVERLAP, 0, 1200),
    "candidate_pool": ("RAG_SPARSE_CANDIDATE_POOL_SIZE", lx.CANDIDATE_POOL, 8, 400),
    "context_radius": ("RAG_CONTEXT_WINDOW_RADIUS", lx.CONTEXT_RADIUS, 0, 3),
    "min_score": ("RAG_MIN_COMBINED_THRESHOLD", lx.MIN_SCORE, 0.0, 1.0),
}


@dataclass(frozen=True)
class Options:
    chunk_size: int = lx.CHUNK_SIZE
    chunk_overlap: int = lx.CHUNK_OVERLAP
    candidate_pool: int = lx.CANDIDATE_POOL
    context_radius: int = lx.CONTEXT_RADIUS
    min_score: float = lx.MIN_SCORE


def clamp(raw: str | None, default, low, high):
    """The default when the text does not parse, else the number inside its limits."""
    try:
        return min(high, max(low, type(default)(raw)))
    except (TypeError, ValueError):
        return default


def load(env: dict[str, str] | None = None) -> Options:
    source = os.environ if env is None else env
    return Options(**{k: clamp(source.get(name), d, lo, hi) for k, (name, d, lo, hi) in LIMITS.items()})
