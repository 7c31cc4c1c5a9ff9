"""Queries of the training-data operators, and their SQL where DuckDB can express it."""

from __future__ import annotations

import importlib

MODULES = ["sharding", "warc", "merkle", "simhash", "bpe", "packing", "langid", "toxicity", "ann", "pii", "kneser", "phrases", "audit"]


def _gather(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{module}"), name, {})
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
