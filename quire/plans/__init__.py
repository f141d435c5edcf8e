"""Named queries over the input tables (importing this module registers them)."""

from quire.plans import chunking, cleaning, folds, io, metrics, prompts, rouge, splits, vectors  # noqa: F401
from quire.plans import streams  # noqa: F401  (reuses the batch oracles)
from quire.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
