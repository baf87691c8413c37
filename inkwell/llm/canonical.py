"""Visually identical text with different characters.

``canonical`` brings a text to one form under which texts that look alike are
equal and texts that look different stay different:

* full-width, half-width, ligature and styled letter forms become plain letters
  (fractions, superscripts, circled and squared signs keep their own look);
* accents are composed, in canonical order;
* invisible characters go (a joiner inside an emoji sequence stays: it shows);
* every kind of space is a space, of line end a line feed, of hyphen ``-``;
* look-alike letters of a word get the one script that its other letters have,
  Latin where it has none.

Quick checks isolate what is unstable (``is_stable``: the quick-check property of normal form
KC, which form C follows from, no invisible character or other hyphen, and every word in one
script that shows): a stable text is returned as it stands; else the white-space-delimited
segments that fail the check are rewritten (a segment is the boundary context: neither composition
nor the choice of a script crosses white space) and spliced into the unchanged rest.

Defined results: null stays null; empty and blank texts keep their (mapped)
blanks; equal texts stay equal; other columns pass through; long texts are
handled whole, in linear time.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, spread

# Letters that look like a Latin letter, by script (lower and upper case). Of the public table of
# confusables (Unicode TS 39), the letters that are drawn alike, not only alike at a glance; two more by case.
LOOKALIKES = {
    "CYRILLIC": ("асеорхуѕіјһӏԁԛԝАВЕКМНОРСТХУЅІЈԚԜ", "aceopxysijhldqwABEKMHOPCTXYSIJQW"),
    "GREEK": ("ονρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovpABEZHIKMNOPTYX"),
    "ARMENIAN": ("օ", "o"),
}
_TO_LATIN = {ord(a): b for own, latin in LOOKALIKES.values() for a, b in zip(own, latin, strict=True)}
_FROM_LATIN = {script: {ord(b): a for a, b in zip(own, latin)} for script, (own, latin) in LOOKALIKES.items() if script != "ARMENIAN"}
_SCRIPTS = (("LATIN", re.compile("[A-Za-z\u00aa\u00ba\u00c0-\u024f\u1e00-\u1eff]")), ("CYRILLIC", re.compile("[\u0400-\u052f]")), ("GREEK", re.compile("[\u0370-\u03ff\u1f00-\u1fff]")))

_HYPHENS = dict.fromkeys([0x2010, 0x2011, 0x2043, 0xFE63, 0xFF0D], "-")
_LINE_ENDS = re.compile("\r\n|[\r\x0b\x0c\x85\u2028\u2029]")
_BLANKS = re.compile("[\t\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_INVISIBLE = re.compile("[\x00-\x08\x0e-\x1f\x7f\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\U000e0000-\U000e0fff]")
_PICTURE = "[\u2190-\u2bff\U0001f000-\U0001faff]"
_JOIN = "\ue200"  # stands for a joiner that shows, while the others go
_JOINED = re.compile(f"(?<={_PICTURE})\ufe0f?\u200d(?={_PICTURE})")
_SUSPICIOUS = re.compile(r"[^\n -~]")
_SEGMENT = re.compile(r"[^\n ]*[^\n -~][^\n ]*")
_WORD = re.compile("[^\\W\\d_](?:[^\\W\\d_]|[\u0300-\u036f])*")
#: Latin letters that a letter of another script looks like.
_AMBIGUOUS = dict.fromkeys([*_FROM_LATIN["CYRILLIC"], *_FROM_LATIN["GREEK"]])
_KEPT_TAGS = ("<fraction>", "<super>", "<sub>", "<circle>", "<square>", "<vertical>")
_CACHE_LIMIT = 300_000

_HIDDEN = re.compile(f"{_INVISIBLE.pattern}|[{''.join(map(chr, _HYPHENS))}]")


def _letters(first: int, last: int, of: str) -> tuple[str, str]:
    """A script's letters between two code points: all of them, and those that show it, as their base
    letter looks like no Latin one."""
    own = [c for c in map(chr, range(first, last + 1)) if c.isalpha()]
    return "".join(own), "".join(c for c in own if unicodedata.normalize("NFD", c)[0] not in LOOKALIKES[of][0])


_CYRILLIC, _SHOWN_CYRILLIC = _letters(0x400, 0x52F, "CYRILLIC")
_GREEK, _SHOWN_GREEK = (a + b for a, b in zip(_letters(0x370, 0x3FF, "GREEK"), _letters(0x1F00, 0x1FFF, "GREEK")))
#: A character whose word must be looked at: a letter of a script with look-alikes.
_OTHER_SCRIPT = re.compile(f"[{_CYRILLIC}{_GREEK}{LOOKALIKES['ARMENIAN'][0]}]")
_MARKS = "\u0300-\u036f"
#: Words of one such script that a letter shows.
_PLAIN_WORD = re.compile(f"[{_CYRILLIC}{_MARKS}]*[{_SHOWN_CYRILLIC}][{_CYRILLIC}{_MARKS}]*|[{_GREEK}{_MARKS}]*[{_SHOWN_GREEK}][{_GREEK}{_MARKS}]*")


def is_stable(text: str) -> bool:
    """Whether quick checks tell that ``canonical`` has nothing to change in a text, blanks aside."""
    if not unicodedata.is_normalized("NFKC", text) or _HIDDEN.search(text):
        return False
    return _OTHER_SCRIPT.search(text) is None or all(_PLAIN_WORD.fullmatch(w) or _OTHER_SCRIPT.search(w) is None for w in _WORD.findall(text))



def _plain_forms(text: str) -> str:
    """Compatibility forms of letters, digits and marks resolved, but for those that look different."""
    out = []
    for ch in text:
        if ch > "\x7f" and (tag := unicodedata.decomposition(ch)).startswith("<") and not tag.startswith(_KEPT_TAGS):
            plain = unicodedata.normalize("NFKC", ch)
            if not (plain.startswith(" ") or tag.startswith("<compat>") and not plain.isalpha()):
                ch = plain
        out.append(ch)
    return "".join(out)


def _one_script(match: re.Match[str]) -> str:
    """A word's look-alikes in the script of its other letters. Works on decomposed text."""
    word = match.group()
    latin = word.translate(_TO_LATIN)
    have = []
    for script, letters in _SCRIPTS:
        # what is left of another script has no Latin look-alike
        rest = latin.translate(_AMBIGUOUS) if script == "LATIN" else latin
        if letters.search(rest):
            have.append(script)
    if len(have) == 1 and have[0] != "LATIN":
        return latin.translate(_FROM_LATIN[have[0]])
    return latin


class _Segments(dict):
    """Segment -> its canonical form; only saves time, emptied when it grows past its limit."""

    def __missing__(self, segment: str) -> str:
        if len(self) > _CACHE_LIMIT:
            self.clear()
        out = segment if is_stable(segment) else _rewritten(segment)
        if len(segment) < 200:
            self[segment] = out
        return out


def _rewritten(segment: str) -> str:
    """The canonical form of an unstable segment."""
    out = _JOINED.sub(_JOIN, segment)
    out = _INVISIBLE.sub("", out).replace(_JOIN, "\u200d").translate(_HYPHENS)
    out = _plain_forms(unicodedata.normalize("NFC", out))
    if not out.isascii():
        out = unicodedata.normalize("NFC", _WORD.sub(_one_script, unicodedata.normalize("NFD", out)))
    return out


_SEGMENTS = _Segments()


def canonical(text: str | None) -> str | None:
    """The one form of a text; see the module's docstring."""
    if text is None or _SUSPICIOUS.search(text) is None:
        return text
    text = _BLANKS.sub(" ", _LINE_ENDS.sub("\n", text))
    if _SUSPICIOUS.search(text) is None or is_stable(text):
        return text
    return _SEGMENT.sub(lambda m: _SEGMENTS[m.group()], text)


def is_visible(text: str | None) -> bool:
    """Whether a canonical text shows anything."""
    return bool(text) and not text.isspace()


def canonical_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, canonical_text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([canonical(t) for t in b.column(1).to_pylist()], pa.string())], ["id", "canonical_text"])

    src = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return spread(src).mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, canonical_text string").withColumnRenamed("id", id_col)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def text_digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, stored, look of every row that shows anything: 128-bit digests of the text as it
    stands and of its canonical form. Nothing but these leaves the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, stored, look = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = canonical(t)
                if is_visible(c):
                    ids.append(i)
                    stored.append(s := _digest(t))
                    look.append(s if c == t else _digest(c))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(stored, pa.binary()), pa.array(look, pa.binary())], ["id", "stored", "look"])

    src = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return spread(src).mapInArrow(run, "id bigint, stored binary, look binary")


def lookalike_pairs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_a < doc_b of rows whose stored texts differ but look the same.

    Pairs are made between distinct stored texts of a look, never between rows: equal
    copies are folded first, and a text's rows join its pairs afterwards, so the work
    follows the pairs that come out, whatever the size of a group of copies. Digests are
    kept once (40 bytes a row), as they are read three times.
    """
    rows = checkpointed(text_digests(documents, id_col, text_col))
    texts = rows.groupBy("look", "stored").agg(F.count(F.lit(1)).alias("n"))
    looks = texts.groupBy("look").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("look")
    texts = texts.join(looks, "look", "left_semi").select("look", "stored")
    other = texts.select("look", F.col("stored").alias("stored_b"))
    pairs = texts.withColumnRenamed("stored", "stored_a").join(other, "look").where("stored_a < stored_b")
    a = rows.select(F.col("stored").alias("stored_a"), F.col("id").alias("id_a"))
    b = rows.select(F.col("stored").alias("stored_b"), F.col("id").alias("id_b"))
    out = pairs.join(a, "stored_a").join(b, "stored_b")
    return out.select(F.least("id_a", "id_b").alias("doc_a"), F.greatest("id_a", "id_b").alias("doc_b"))


def lookalike_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id, n_links of every row that shows anything: rows that look the same are one class (``class_id``:
    its least id), and n_links counts the rows of it whose stored text is another. Counts only: no
    pair is made, whatever the size of a class."""
    rows = checkpointed(text_digests(documents, id_col, text_col))
    texts = rows.groupBy("look", "stored").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_id"))
    looks = texts.groupBy("look").agg(F.sum("_n").alias("_all"), F.min("_id").alias("class_id"))
    counted = texts.join(looks, "look").select("look", "stored", "class_id", (F.col("_all") - F.col("_n")).alias("n_links"))
    return rows.join(counted, ["look", "stored"]).select(F.col("id").alias(id_col), "class_id", "n_links")
