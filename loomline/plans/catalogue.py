"""The registered queries over the test tables and, where SQL can say it, their oracles."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "date_interpolate"

for _name in ("ordered", "estimates", "vectors", "matching", "places", "lifecycle", "composites", "extras", "listings", "curation", "records", "pictures", "streams"):
    _part = importlib.import_module(f"loomline.plans.{_name}")
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
