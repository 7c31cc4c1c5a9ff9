"""Queries that apply the operators to the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

import importlib

MODULES = ["spatial", "relational", "reconstruction", "frames", "epochs", "views", "selection", "latent"]


def _gather(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{module}"), name)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
