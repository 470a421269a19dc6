"""The registered queries: every operator run over the given tables, next to an independent SQL check."""
from __future__ import annotations

import importlib

MODULES = [
    "scalars", "corpus", "intake", "classification", "extraction", "merging", "catalog", "access", "household", "streams", "library", "stored", "finance",
]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"paperloom.suite.{name}")


def all_queries():
    from paperloom.suite.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles():
    from paperloom.suite.registry import ORACLES

    _load()
    return dict(ORACLES)
