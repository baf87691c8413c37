"""The same definitions as ``text`` as ANSI SQL for an independent engine (RE2 regular expressions)."""

from __future__ import annotations

from . import text
from .lexicon import EDGE_PUNCTUATION, FUNCTION_WORDS, REFUSAL_MARKERS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), {lit('[' + text.SPACE + ']+')}), lambda w: w <> '')"


def n_words(c: str) -> str:
    return f"len({words(c)})"


def strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), {lit('^[' + text.SPACE + ']+|[' + text.SPACE + ']+$')}, '', 'g')"


def folded(c: str) -> str:
    wide, plain = text.compatible_letters()
    out = f"translate(replace(coalesce({c}, ''), '’', ''''), {lit(wide)}, {lit(plain)})"
    for k, v in text.LIGATURES.items():
        out = f"replace({out}, {lit(k)}, {lit(v)})"
    return f"replace(replace(lower({out}), 'ß', 'ss'), 'ς', 'σ')"


def tokens(c: str) -> str:
    return f"list_filter(list_transform({words(folded(c))}, lambda w: trim(w, {lit(EDGE_PUNCTUATION)})), lambda w: w <> '')"


_FW = "[" + ", ".join(map(lit, FUNCTION_WORDS)) + "]"


def function_words(c: str) -> str:
    return f"list_filter({tokens(c)}, lambda w: list_contains({_FW}, w))"


def content_words(c: str) -> str:
    return f"list_distinct(list_filter({tokens(c)}, lambda w: NOT list_contains({_FW}, w)))"


def encoded(c: str) -> str:
    return f"coalesce(array_to_string(list_transform({function_words(c)}, lambda w: chr(list_position({_FW}, w)::INT)), ''), '')"


def without_fences(c: str) -> str:
    a = f"regexp_replace({strip(c)}, {lit('^(?:[' + text.SPACE + ']*```[a-zA-Z]*[' + text.SPACE + ']*)+')}, '')"
    return strip(f"regexp_replace({a}, {lit('(?:[' + text.SPACE + ']*```[' + text.SPACE + ']*)+$')}, '')")


def without_lead_in(c: str) -> str:
    return f"regexp_replace({c}, {lit(text.LEAD_IN)}, '')"


def cleaned(c: str) -> str:
    return strip(without_lead_in(without_fences(c)))


def refuses(c: str) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), {lit(m)})" for m in REFUSAL_MARKERS) + ")"
