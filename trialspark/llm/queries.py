"""Every registered corpus query; importing this module fills the registry."""

from __future__ import annotations

from trialspark.llm import decontaminate, exact, infill, lines, pieces, quality, reputation, search, sharding, simhash, substrings, tokens, toxicity  # noqa: F401
from trialspark.llm.common import REGISTRY

__all__ = ["REGISTRY"]
