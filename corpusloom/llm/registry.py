"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import licenses, linededup, mixing, packing, quality, secret_scan, sharding, simhash, topk, warc

_MODULES = (topk, quality, sharding, warc, licenses, packing, linededup, secret_scan, mixing, simhash)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
