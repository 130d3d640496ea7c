"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import collocations, decontaminate, jaccard, language, licences, mixing, neighbours, packing, periodic, shards, substrings, toxicity, warc

_MODULES = (substrings, mixing, shards, toxicity, warc, licences, language, neighbours, jaccard, decontaminate, packing, collocations, periodic)
QUERIES: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES


def oracles() -> dict[str, str]:
    """SQL by query. A module may make its own when asked: some of it holds a trained model."""
    found: dict[str, str] = {}
    for m in _MODULES:
        found |= m.oracle() if hasattr(m, "oracle") else m.ORACLE
    return found
