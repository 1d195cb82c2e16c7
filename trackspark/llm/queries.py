"""Imports every operator module; importing registers its query."""

from . import bpe, chat, decontamination, infilling, licenses, neardup, packing, sharding, spelling, substrings, token_counts, topk, toxicity  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
