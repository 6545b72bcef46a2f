"""All registered queries, in one place."""

from __future__ import annotations

import importlib

from sparkfolio.plans import registry

MODULES = ("text_queries", "question_queries", "chunk_queries", "retrieval_queries", "answer_queries", "window_queries", "evaluation_queries", "convert_queries",
           "store_queries", "prompt_queries")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"sparkfolio.plans.{name}")


def queries() -> dict[str, registry.Run]:
    load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(registry.ORACLES)
