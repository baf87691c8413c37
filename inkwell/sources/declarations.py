"""Declared sources from YAML."""

from __future__ import annotations

from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..operators.collection import SETS

SCHEMA = (
    "decl_order bigint, id string, title string, gutenberg_ids array<int>, set_name string, author string, paper_title string, expected_words int, apocryphal boolean, expected_label string"
)


def parse_entry(raw: Any, set_name: str, order: int) -> tuple:
    """One declared text. ``id`` and ``title`` are required; a number may be missing, one or several."""
    if not isinstance(raw, dict) or not raw.get("id") or not raw.get("title"):
        raise ValueError(f"{set_name}: an entry needs an id and a title: {raw!r}")
    n = raw.get("gutenberg_id")
    numbers = [] if n is None else [int(x) for x in n] if isinstance(n, list) else [int(n)]
    return (order, str(raw["id"]), str(raw["title"]), numbers, set_name, raw.get("author"), raw.get("paper_title"), raw.get("expected_words"), bool(raw.get("apocryphal", False)), raw.get("expected_label") or "")


def read_declarations(spark: SparkSession, path: str | Path) -> DataFrame:
    """The rows of a YAML file of four lists, in order. What isn't a list, or lacks what it needs,
    is an error."""
    p = Path(path)
    if not p.is_file():
        raise FileNotFoundError(p)
    found = yaml.safe_load(p.read_text(encoding="utf-8"))
    if not isinstance(found, dict):
        raise ValueError(f"{p.name} holds no mapping")
    rows: list[tuple] = []
    for s in SETS:
        entries = found.get(s) or []
        if not isinstance(entries, list):
            raise ValueError(f"{s} must be a list")
        for e in entries:
            rows.append(parse_entry(e, s, len(rows) + 1))
    return spark.createDataFrame(rows, SCHEMA)
