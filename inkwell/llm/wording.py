"""Words, wrapping and language votes shared by the operators on generated text.

Everything here is plain Python over one text at a time; the operators call it
on Arrow batches. A word is a run of letters, digits and combining marks after
NFKC and case folding, apostrophes dropped, so that ``can’t`` and ``CAN'T`` are
the same word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

_RUN = re.compile("[^\\W_]+(?:[\u0300-\u036f\u0483-\u0487]+[^\\W_]*)*")
_APOSTROPHES = re.compile("['\u2019\u2018\u02bc\uff07]")
_CACHE_LIMIT = 500_000


class _TokenWords(dict):
    """White-space token -> its word, or a tuple when it holds none or several.

    The cache only saves time: it is emptied when it grows past its limit.
    """

    def __missing__(self, token: str):
        if len(self) > _CACHE_LIMIT:
            self.clear()
        folded = unicodedata.normalize("NFKC", _APOSTROPHES.sub("", token)).casefold()
        found = _RUN.findall(folded)
        value = found[0] if len(found) == 1 else tuple(found)
        self[token] = value
        return value


_TOKENS = _TokenWords()


def words(text: str | None) -> list[str]:
    """The words of a text; an empty list for null or blank text."""
    if not text:
        return []
    found = list(map(_TOKENS.__getitem__, text.split()))
    if tuple in set(map(type, found)):
        flat: list[str] = []
        for w in found:
            if type(w) is tuple:
                flat.extend(w)
            else:
                flat.append(w)
        return flat
    return found


# --- wrapping: what a generator puts round an answer --------------------------------

_FENCES = ("```", "~~~")
_FENCE_OPEN = re.compile(r"\A\s*(?:```|~~~)[ \t]*\w*[ \t]*(?:\n|\Z)")
_FENCE_CLOSE = re.compile(r"(?:\A|\n)[ \t]*(?:```|~~~)[ \t]*\s*\Z")
_LEAD_WORDS = re.compile(
    r"\b(?:here|below|sure|certainly|of course|absolutely|rewritten|rewrite|reworked|restyled|rephrased|version|rendering|passage|text|"
    r"voici|bien sûr|hier ist|gerne|aquí|claro)\b",
    re.I,
)
_INSTRUCTION = re.compile(r"\b(?:profile|passage|restyle[ds]?|recast|manner|rewrite|style)\b", re.I)
_MARKER = re.compile(r"(?:\A|\n)[ \t]*(?:passage[ \t]*:?|text[ \t]*:|-{3,}|={3,})[ \t]*\n", re.I)
_REMINDER = re.compile(r"\n\s*\n[ \t]*(return|give|answer|reply|respond|output|provide)\b[^\n]*\Z", re.I)


def unwrap(text: str | None) -> str:
    """Text without blank ends, code fences and one lead-in line. Null becomes ''."""
    if not text:
        return ""
    out, before, led = text.strip(), None, False
    while out != before:
        before = out
        if out.startswith(_FENCES):
            out = _FENCE_OPEN.sub("", out)
        if out.endswith(_FENCES):
            out = _FENCE_CLOSE.sub("", out)
        out = out.strip()
        if not led:
            head, _, rest = out.partition("\n")
            head = head.rstrip(" \t")
            if len(head) > 1 and head.endswith((":", "\uff1a")) and _LEAD_WORDS.search(head):
                led, out = True, rest.strip()
    return out


def passage_of(prompt: str | None) -> str:
    """The passage that a rewriting prompt hands over: what follows the marker line
    (or else the first blank line), without a closing reminder. Null gives ''."""
    if not prompt:
        return ""
    m = _MARKER.search(prompt)
    if m:
        body = prompt[m.end() :]
    else:
        head, sep, rest = prompt.partition("\n\n")
        body = rest if sep else prompt
    return _REMINDER.sub("", body).strip()


def strip_instruction(answer: str) -> str:
    """An answer without an instruction that it repeats before its passage and a
    reminder that it repeats after it."""
    m = _MARKER.search(answer)
    if m and _INSTRUCTION.search(answer[: m.start()]):
        answer = answer[m.end() :]
    return _REMINDER.sub("", answer).strip()


# --- language votes -------------------------------------------------------------------

# Common words by language, each in one list only.
STOPWORDS = {
    "en": "the and of to with was were that this his her their your my our she they you not for upon from by",
    "fr": "le les du des et dans avec était ne pas cette notre leur ma sa mon ce ces vous nous qui sur pour",
    "de": "der die das und ein eine einen nicht mit von war dem den sein ihr ihre mein unser jener dieser kein wir auf",
    "es": "el los las y con era su sus mi nuestro nuestra aquel esta este del ella por pero cuando una se está",
    "ru": "и в не на он она они с как его был была что это мой наш из под к но",
    "el": "και το η ο του της τον την με δεν ήταν για από στο στη μου που σε τα οι",
}
_VOTES = {w: lang for lang, text in STOPWORDS.items() for w in text.split()}


def language_votes(found: Iterable[str]) -> dict[str, int]:
    """Votes by language of the stopwords among the words."""
    votes: dict[str, int] = {}
    for w in found:
        lang = _VOTES.get(w)
        if lang:
            votes[lang] = votes.get(lang, 0) + 1
    return votes


def language_of(found: list[str], least: int = 2) -> str | None:
    """The language with most votes (ties: the first in alphabet); None under ``least`` votes."""
    votes = language_votes(found)
    if not votes or max(votes.values()) < least:
        return None
    return min(votes, key=lambda lang: (-votes[lang], lang))
