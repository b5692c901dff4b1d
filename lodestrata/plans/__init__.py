"""Named queries over the test tables, each module with QUERIES and ORACLE_SQL."""

from __future__ import annotations

import importlib

NAMES = ("core_problems", "filters", "joins", "groups", "graphs", "texts", "more")


def modules() -> list:
    return [importlib.import_module(f"{__name__}.{n}") for n in NAMES]
