"""All registered queries."""

from tarn.plans import compose, diagnostics, inventory, lookups, memory, retrieval, sources, storage, streams, symbols, tools, xref
from tarn.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "compose", "diagnostics", "inventory", "lookups", "memory", "retrieval", "sources", "storage", "streams", "symbols", "tools", "xref"]
