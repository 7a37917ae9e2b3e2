"""All registered queries; importing the modules registers them."""

from mnemolake.plans import catalog_memory, catalog_retrieval, catalog_store, catalog_streams  # noqa: F401
from mnemolake.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
