"""Every query of the core by name, and SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from .oracles import ORACLES
from .queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
