"""All queries over the driver tables; importing the modules registers them."""

from __future__ import annotations

from . import catalogue, conversations, evaluation, files, prompts, scheduling, sessions, sources, streams  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
