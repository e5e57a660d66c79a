"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from codelattice.operators import checks, clones, entry as general, gates, graph, history, inline, lookup, packs, parsing, reports, resolve, search, text, upkeep, vectors
from codelattice.streaming import flow

_MODULES = [general, clones, lookup, graph, text, search, checks, gates, vectors, reports, resolve, parsing, packs, history, flow, upkeep, inline]


def queries() -> dict[str, Callable]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
