"""All checked queries, by operator id."""

from . import classifier, cleaning, measures, prompting, splits, storage  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
