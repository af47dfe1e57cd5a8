"""Registered queries over the given tables, each with an equivalent DuckDB statement where SQL can say it."""

import importlib

from .base import QUERIES, STATEMENTS

_MODULES = ("detection", "jobs", "records", "reports", "live")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")


def queries():
    _load()
    return dict(QUERIES)


def statements():
    _load()
    return dict(STATEMENTS)
