"""All registered queries but those of the training-data subpackage."""

from __future__ import annotations

from . import cases, native, reading, relational  # noqa: F401
from .registry import CASES, ORACLES, QUERIES

__all__ = ["CASES", "ORACLES", "QUERIES"]
