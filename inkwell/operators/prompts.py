"""Prompt templates: their texts, their placeholders, and the version that is part of every request's key.

A template is a text with named places. ``render`` fills all of them and nothing else: a place that is
not given, or a value that has no place, is an error before anything is called. Values are put in
as they stand, so braces inside a passage are ordinary text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Raised whenever the wording of a template changes, so that answers to the old wording are not served.
SCHEMA_VERSION = 2

TEMPLATES: dict[str, str] = {
    "rewrite": (
        "Style profile of the target:\n{profile}\n\nRestate the passage below in exactly this style. Keep its meaning and its content words; change only its style."
        "\n\nPassage to rewrite:\n{passage}"
    ),
    "reminder": "\nImportant: return only the rewritten passage, whole.",
    "profile_json": "Describe the style of these creations as one JSON object with the keys vocabulary, pronouns, verb_forms, sentence_structure, punctuation, other.\n\n{texts}",
    "profile_text": "Describe the style of these creations in plain sentences.\n\n{texts}",
    "merge_json": "Merge these analyses into one JSON object with the same keys.\n\n{analyses}",
    "merge_text": "Merge these analyses into one.\n\n{analyses}",
}
#: The version of each template's wording.
VERSIONS: dict[str, int] = {"rewrite": 1, "reminder": 1, "profile_json": 2, "profile_text": 2, "merge_json": 2, "merge_text": 1}
_PLACE = re.compile(r"\{(\w+)\}")


class TemplateError(ValueError):
    """A template that is missing, or whose places and values don't agree."""


def places(name: str) -> list[str]:
    """The places of a template, in order."""
    if name not in TEMPLATES:
        raise TemplateError(f"no template {name!r}; there are {', '.join(sorted(TEMPLATES))}")
    return _PLACE.findall(TEMPLATES[name])


def render(name: str, **values: Column) -> Column:
    """A template with its places filled by columns."""
    own = places(name)
    missing, unknown = sorted(set(own) - set(values)), sorted(set(values) - set(own))
    if missing or unknown:
        raise TemplateError(f"template {name!r}: " + "; ".join([*(f"no value for {x}" for x in missing), *(f"no place for {x}" for x in unknown)]))
    parts = _PLACE.split(TEMPLATES[name])
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def fixed_text(name: str) -> str:
    """A template's wording without its places, for checks that it says nothing of any creation."""
    return _PLACE.sub("", TEMPLATES[name])
