"""Named queries over the driver's tables and the SQL that checks each of them."""

from __future__ import annotations

import importlib

GROUPS = ["windows", "evaluate", "scoring", "packets", "alerts", "normalize", "store", "privacy", "models", "streaming"]


def load():
    for group in GROUPS:
        importlib.import_module(f"netloom.catalog.{group}")
    from netloom.catalog.base import ORACLES, QUERIES

    return QUERIES, ORACLES
