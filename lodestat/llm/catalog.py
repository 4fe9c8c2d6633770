"""The registered queries of the subpackage."""

from __future__ import annotations

from lodestat.llm import catalog_chat, catalog_coded, catalog_models, catalog_native, catalog_repeats  # noqa: F401
from lodestat.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
