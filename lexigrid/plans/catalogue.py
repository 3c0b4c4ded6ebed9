"""All registered queries of the core: one module per project of the inventory."""

from __future__ import annotations

from importlib import import_module

MODULES = ("profile", "corpus", "ngram", "annotation", "pages", "io", "timestamps", "reports")


def _modules():
    return [import_module(f"lexigrid.plans.{m}") for m in MODULES]


def queries() -> dict:
    out: dict = {}
    for m in _modules():
        out |= m.queries()
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in _modules():
        out |= m.oracle_sql()
    return out
