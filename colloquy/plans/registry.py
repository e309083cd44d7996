"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from colloquy.plans import advantages, builders, datasets, graph, metrics, rewards, sampling, streams, text, tokens  # noqa: F401  (they register)
from colloquy.plans.base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "e10"
