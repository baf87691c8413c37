"""Column builders over text. All stay in the JVM but for the exact Unicode ones at the end."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexicon import EDGE_PUNCTUATION, FUNCTION_WORDS, LEAD_INS, REFUSAL_MARKERS

#: White space as Python's str.split has it, written so that Java and RE2 read it alike.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words(c: Column) -> Column:
    """Maximal runs of characters that are not white space; an empty array for null."""
    return F.filter(F.split(text_or_empty(c), f"[{SPACE}]+"), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.size(words(c)).cast("bigint")


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text_or_empty(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


@lru_cache(maxsize=1)
def compatible_letters() -> tuple[str, str]:
    """Characters that NFKC makes a single printable ASCII character, and those characters:
    full-width, letter-like and styled forms. A rule, not a list: all code points are asked."""
    found = [(chr(i), n) for i in [*range(0x80, 0xD800), *range(0xF900, 0x10000)] if len(n := unicodedata.normalize("NFKC", chr(i))) == 1 and "!" <= n <= "~"]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


# Ligatures of Latin letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def folded(c: Column) -> Column:
    """Lower case with full-width and styled letters, ligatures and typographic apostrophes made
    plain, sharp s and final sigma as case folding has them. Equal to NFKC and case folding on
    every token that may be a function word; ASCII rows skip the look-ups."""
    c = text_or_empty(c)
    wide, plain = compatible_letters()
    out = F.translate(F.replace(c, F.lit("’"), F.lit("'")), wide, plain)
    for k, v in LIGATURES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    out = F.replace(F.replace(F.lower(out), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    return F.when(c.rlike(r"[^\x00-\x7F]"), out).otherwise(F.lower(c))


_PUNCTUATION = "".join(f"\\{ch}" if ord(ch) < 128 else ch for ch in EDGE_PUNCTUATION)
#: What parts two tokens: white space, with punctuation on both sides of it.
_BETWEEN_TOKENS = f"[{_PUNCTUATION}]*(?:[{SPACE}]+[{_PUNCTUATION}]*)+"


def tokens(c: Column) -> Column:
    """Folded words without punctuation at their edges, empties dropped. One pass of one regular
    expression, rather than a trim of every word."""
    return F.filter(F.split(F.concat(F.lit(" "), folded(c), F.lit(" ")), _BETWEEN_TOKENS), lambda w: w != "")


def function_words(c: Column) -> Column:
    """The ordered sequence, with repeats, of a text's function words."""
    return F.filter(tokens(c), lambda w: w.isin(*FUNCTION_WORDS))


def content_words(c: Column) -> Column:
    """The set of a text's other tokens."""
    return F.array_distinct(F.filter(tokens(c), lambda w: ~w.isin(*FUNCTION_WORDS)))


def encoded_words(sequence: Column) -> Column:
    """A sequence of function words as a string of one character each (codes 1 to 127). Codes are
    looked up by first letter, then word, as a map's entries are searched one by one."""
    by_letter: dict[str, list[Column]] = {}
    for i, w in enumerate(FUNCTION_WORDS, 1):
        by_letter.setdefault(w[0], []).extend((F.lit(w), F.lit(chr(i))))
    codes = F.create_map(*[x for k, v in sorted(by_letter.items()) for x in (F.lit(k), F.create_map(*v))])
    return F.array_join(F.transform(sequence, lambda w: F.element_at(F.element_at(codes, F.substring(w, 1, 1)), w)), "")


@lru_cache(maxsize=1)
def _plain_letters() -> dict[int, str]:
    wide, plain = compatible_letters()
    return dict(zip(map(ord, wide), plain))


class _Folded(dict):
    """A white-space token -> its word as ``tokens`` has it ('' for none). It only saves time, and is emptied when
    it grows past its limit."""

    limit = 500_000

    def __missing__(self, token: str) -> str:
        if len(self) > self.limit:
            self.clear()
        out = token
        if not out.isascii():
            out = out.replace("’", "'").translate(_plain_letters())
            for k, v in LIGATURES.items():
                out = out.replace(k, v)
            out = out.lower().replace("ß", "ss").replace("ς", "σ")
        out = out.lower().strip(EDGE_PUNCTUATION)
        self[token] = out
        return out


_FOLDED = _Folded()


class _Codes(dict):
    """A white-space token -> the character that stands for it in an encoded sequence ('' for other words)."""

    def __missing__(self, token: str) -> str:
        if len(self) > _Folded.limit:
            self.clear()
        out = self[token] = _CODE_OF.get(_FOLDED[token], "")
        return out


_CODE_OF = {w: chr(i) for i, w in enumerate(FUNCTION_WORDS, 1)}
_CODES = _Codes()


def encoded(c: Column) -> Column:
    """The sequence of a text's function words as a string of one character each: what ``encoded_words`` makes of
    ``function_words``, by a look-up a token in one Arrow pass. The same as an expression costs some
    twenty times as much, as each token goes through a regular expression and a list of 127 words."""

    @F.arrow_udf(T.StringType())
    def run(batch: pa.Array) -> pa.Array:
        look = _CODES.__getitem__
        return pa.array(["".join(map(look, x.split())) if x else "" for x in batch.to_pylist()], pa.string())

    return run(c)


def retention_of(a: str | None, b: str | None) -> float:
    """Shared content words of two texts over the smaller set of them: 1 where both have none, 0 where one has."""
    x, y = ({w for w in map(_FOLDED.__getitem__, (t or "").split()) if w and w not in _CODE_OF} for t in (a, b))
    least = min(len(x), len(y))
    return len(x & y) / least if least else float(not x and not y)


def retention(a: Column, b: Column) -> Column:
    """``retention_of`` two columns, in one Arrow pass."""

    @F.arrow_udf(T.DoubleType())
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([retention_of(x, y) for x, y in zip(left.to_pylist(), right.to_pylist())], pa.float64())

    return run(a, b)


def without_fences(c: Column) -> Column:
    """Without code fences at either end, however many are nested; one in the middle stays. Texts
    without a fence are only stripped."""
    out = F.regexp_replace(strip(c), f"^(?:[{SPACE}]*```[a-zA-Z]*[{SPACE}]*)+", "")
    out = strip(F.regexp_replace(out, f"(?:[{SPACE}]*```[{SPACE}]*)+$", ""))
    return F.when(text_or_empty(c).contains("```"), out).otherwise(strip(c))


def any_phrase(phrases: tuple[str, ...], blank: str, apostrophe: str = "['\\x{2019}]") -> str:
    """A regular expression for any of some phrases: ``blank`` between their words, either apostrophe."""
    return "(?:" + "|".join(blank.join(w.replace("'", apostrophe) for w in p.split(" ")) for p in phrases) + ")"


#: A leading line of talk that ends in a colon.
LEAD_IN = f"(?i)^[{SPACE}]*{any_phrase(LEAD_INS, f'[{SPACE}]+')}[^\\n]*:[{SPACE}]*\\n"


def without_lead_in(c: Column) -> Column:
    return F.regexp_replace(text_or_empty(c), LEAD_IN, "")


def cleaned(c: Column, fences: bool = True, lead_in: bool = True) -> Column:
    """A response without what was put round it: code fences, then a line of talk; either step may be left out."""
    out = without_fences(c) if fences else strip(c)
    return strip(without_lead_in(out)) if lead_in else out


def refuses(c: Column) -> Column:
    low = F.lower(text_or_empty(c))
    out = F.lit(False)
    for m in REFUSAL_MARKERS:
        out = out | low.contains(m)
    return out


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


# --- exact Unicode, through Arrow, for rows that need it --------------------------------


def nfkc(c: Column) -> Column:
    """NFKC of a column of texts. Batches go through Arrow; ASCII texts, which are the same in every form, are
    handed on as they are."""

    @F.arrow_udf(T.StringType())
    def run(batch: pa.Array) -> pa.Array:
        plain = pc.string_is_ascii(batch)
        if pc.all(plain, skip_nulls=True).as_py() is not False:
            return batch
        return pa.array([x if x is None or ok else unicodedata.normalize("NFKC", x) for x, ok in zip(batch.to_pylist(), plain.to_pylist())], pa.string())

    return run(c)


def exact_tokens(c: Column) -> Column:
    """``tokens`` with full NFKC and case folding for texts of any script."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            folded_ = unicodedata.normalize("NFKC", x or "").replace("’", "'").casefold()
            return [t for t in (w.strip(EDGE_PUNCTUATION) for w in folded_.split()) if t]

        return s.map(one)

    return run(c)
