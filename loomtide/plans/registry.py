"""All queries outside loomtide.llm, by name."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("spectra", "onsets", "states", "evals")


def queries() -> dict:
    return {n: f for m in _MODULES for n, f in import_module(f"loomtide.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for m in _MODULES for n, s in import_module(f"loomtide.plans.{m}").SQL.items()}
