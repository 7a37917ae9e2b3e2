"""All queries of this subpackage; importing the modules registers them."""

from mnemolake.llm import bpe, chat, mixing, packing, phrases, quality, quantised, repair, secrets, simhash, topk, toxicity, windows  # noqa: F401
from mnemolake.llm.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
