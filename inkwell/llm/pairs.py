"""Broken prompt and response pairs.

``pair_defects`` gives each pair at most one defect. It walks a suffix automaton
of the passage with the words of the answer to measure how much of the answer is
copied, searches an Aho-Corasick automaton of refusals, keeps a delimiter stack
over the answer's wrapping, and lets stopwords vote on its language. Where the
answer stops in the passage comes from a longest common subsequence kept as one
big integer (a bit for each passage word): a step for each word of the answer, each of them an operation
on an integer of the passage's length, so the product of both lengths over the machine's word size.

Defined results: a null answer is ``empty``; a null or blank passage can only
give ``empty`` or ``refusal``; equal rows give equal results; other columns pass
through under their own names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .wording import language_of, passage_of, strip_instruction, unwrap, words

#: An answer whose words agree in order with the passage to this share is taken from it.
ALIGNED = 0.42
#: An answer of fewer words than this is taken from its passage from a smaller share on.
FEW, FEW_ALIGNED = 16, 0.25
#: An answer may quote its passage up to this share and still refuse.
QUOTED = 0.65
#: Words of the passage that a copy may change.
COPY_CHANGES = 2
#: Words in a run that counts as copied.
COPY_RUN = 3
#: Words at the passage's end in which a whole answer must show agreement.
END_WINDOW = 14
#: Letters from which on an answer's last word can be part of a word of twice as many.
PART = 3

# Answers that stand for nothing.
PLACEHOLDERS = {"na", "n a", "null", "none", "nil", "empty", "no output", "no answer", "no response", "blank", "nothing", "undefined", "nan", "tbd"}

# Cues of a refusal, as words without marks (see wording.words): what denies or declines, and
# what the request was about. A refusal brings one of each close together, in whatever phrase.
DENIALS = (
    "cannot", "cant", "can not", "could not", "couldnt", "unable", "not able", "wont", "will not", "would not", "wouldnt", "not permitted", "not allowed", "not authorised", "not authorized", "isnt permitted", "isnt allowed",
    "not possible", "isnt possible", "impossible", "not something", "isnt something", "rather not", "prefer not", "not going to", "not comfortable", "not appropriate", "decline", "declining", "refuse", "refusing",
    "pass on", "no rewritten", "no rewrite", "no version", "unanswered", "refrain", "falls outside", "lies outside", "is outside", "beyond what", "against my", "against our", "prohibited", "forbidden", "violates", "not in a position", "must stop", "not willing",
    "ne peux pas", "ne peut pas", "ne puis", "ne saurais", "ne suis pas", "refuser", "refuse de", "décliner", "décline", "pas autorisé", "pas en mesure", "impossible de", "dépasse", "ne permettent pas", "ne me permet pas",
    "nicht helfen", "nicht umschreiben", "nicht bearbeiten", "nicht erfüllen", "nicht überarbeiten", "kann nicht", "darf nicht", "kann ich nicht", "darf ich nicht", "ablehnen", "ablehne", "lehne", "nicht in der lage", "nicht möglich", "nicht erlaubt", "nicht gestattet", "verweigern",
    "no puedo", "no podemos", "no me está permitido", "no está permitido", "no estoy autorizado", "no estoy autorizada", "no soy capaz", "rechazar", "declinar", "no es posible", "no me es posible", "imposible", "no se me permite",
)
TASKS = (
    "rewrite", "rewriting", "rewritten", "restyle", "restyling", "restyled", "rephrase", "rephrasing", "paraphrase", "request", "passage", "this text", "that text", "the text", "your text", "excerpt", "this material", "this content", "this piece", "this one", "this version",
    "transformation", "this task", "that task", "instruction", "instructions", "assist", "help with", "helping with", "help you", "comply", "fulfil", "fulfill", "carry out", "guidelines", "policy", "policies", "permitted to do", "allowed to do", "language system", "language model", "an ai", "do that", "do this", "process this", "reproduce", "generate",
    "réécrire", "reformuler", "passage", "ce texte", "le texte", "cette demande", "votre demande", "requête", "traiter", "vous aider", "autorisé à", "consignes", "cette tâche",
    "anfrage", "umschreiben", "abschnitt", "textstelle", "diesen text", "diesem text", "dabei helfen", "nicht helfen", "bearbeiten", "überarbeiten", "aufgabe", "richtlinien", "anliegen",
    "reescribir", "reformular", "este texto", "el texto", "pasaje", "solicitud", "petición", "ayudarle", "ayudarte", "ayudar con", "atender", "este fragmento", "esta tarea", "normas",
)
# Cues that need no other.
REFUSALS = ("must decline", "have to decline", "i decline", "i refuse to", "je dois refuser", "je dois décliner", "muss ich ablehnen", "ich muss ablehnen", "muss ich leider ablehnen", "debo rechazar", "debo declinar", "tengo que rechazar")
#: Words between which the two cues of a refusal stand at most.
REFUSAL_REACH = 9


def _automaton(cues: dict[str, Iterable[str]]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, phrases in cues.items():
        for p in dict.fromkeys(phrases):
            if not found.exists(f" {p} "):  # the first kind holds
                found.add_word(f" {p} ", (kind, p))
    found.make_automaton()
    return found


_REFUSAL_AUTOMATON: ahocorasick.Automaton | None = None


def refusals_in(found: list[str]) -> set[tuple[str, str]]:
    """The refusing cues among an answer's words: (what denies, what it denies) that stand close together."""
    global _REFUSAL_AUTOMATON
    if _REFUSAL_AUTOMATON is None:
        _REFUSAL_AUTOMATON = _automaton({"denial": DENIALS, "task": TASKS, "both": REFUSALS})
    text = f" {' '.join(found)} "
    hits: dict[str, list[tuple[int, str]]] = {"denial": [], "task": [], "both": []}
    for end, (kind, cue) in _REFUSAL_AUTOMATON.iter(text):
        hits[kind].append((end, cue))
    whole = {(cue, cue) for _, cue in hits["both"]}
    if not hits["denial"] or not hits["task"]:
        return whole
    word = list(accumulate(c == " " for c in text))  # how many words begin up to a character
    return whole | {(d, t) for i, d in hits["denial"] for j, t in hits["task"] if abs(word[i] - word[j]) <= REFUSAL_REACH}


class SuffixAutomaton:
    """All runs of words of a passage, in states of which there are under twice its words."""

    __slots__ = ("nxt", "link", "length")

    def __init__(self, passage: list[str]) -> None:
        nxt: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for w in passage:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(w) == q:
                        nxt[p][w] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.nxt, self.link, self.length = nxt, link, length

    def copied(self, answer: list[str], run: int) -> int:
        """How many words of the answer lie in runs of ``run`` or more words of the passage."""
        nxt, link, length = self.nxt, self.link, self.length
        state = matched = covered = 0
        until = -1
        for j, w in enumerate(answer):
            go = nxt[state].get(w)
            while go is None and state:
                state = link[state]
                matched = length[state]
                go = nxt[state].get(w)
            if go is None:
                matched = 0
                continue
            state = go
            matched += 1
            if matched >= run:
                start = j - matched + 1
                covered += j - (start - 1 if start > until else until)
                until = j
        return covered


def copied_words(passage: list[str], answer: list[str]) -> int:
    """How many words of an answer are copied from its passage in runs of COPY_RUN words or more."""
    return SuffixAutomaton(passage).copied(answer, min(COPY_RUN, len(passage), len(answer))) if passage and answer else 0


def agreement(passage: list[str], answer: list[str]) -> int:
    """The bits of the passage words at which the longest common subsequence with the
    answer grows. Its highest bit is the end of the least part of the passage that the
    answer covers."""
    at: dict[str, int] = {}
    bit = 1
    for w in passage:
        at[w] = at.get(w, 0) | bit
        bit <<= 1
    full = bit - 1
    v = full
    for w in answer:
        m = at.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return v ^ full


_DELIMITERS = re.compile(r"```|~~~|[\"()\[\]{}\u201c\u201d\u00ab\u00bb\\]")
_CLOSES = {")": "(", "]": "[", "}": "{", "\u201d": "\u201c", "\u00bb": "\u00ab"}


def unclosed(text: str, strings: bool = True) -> list[str]:
    """A delimiter stack over code fences, brackets and quotes: what is still open at the end. ``strings``:
    straight quotes count too, within them only their end does, and what a backslash stands before is skipped (JSON)."""
    stack: list[str] = []
    skip = -1
    for m in _DELIMITERS.finditer(text):
        d = m.group()
        top = stack[-1] if stack else ""
        if m.start() == skip or (d in '\\"' and not strings):
            continue
        if d == "\\":
            if top == '"':
                skip = m.end()
        elif top == '"':
            if d == '"':
                stack.pop()
        elif d in _CLOSES:
            if top == _CLOSES[d]:
                stack.pop()
        elif d == top and d in ("```", "~~~"):
            stack.pop()
        else:
            stack.append(d)
    return stack


def left_open(passage: str | None, answer: str) -> bool:
    """Whether an answer ends inside a fence, bracket or paired quote and its passage doesn't. Straight quotes
    tell nothing, as a passage may begin within speech."""
    mine = unclosed(answer, strings=False)
    return bool(mine) and len(mine) > len(unclosed(passage or "", strings=False))


def breaks_off(passage: list[str], answer: list[str], bits: int) -> bool:
    """Whether an answer taken from the passage stops before it has covered its end.

    A style rewrite keeps or widens word counts, so an answer of clearly fewer words
    stops early. Else the agreement must reach the passage's last words (all but a few
    words of style, which may change) and must be as dense there as a third of the rest.
    Last words of style that changed stand behind the last agreed word in other words, one
    for each but one: an answer with fewer there hasn't got to them, however it was widened,
    nor has one whose last word begins one of them.
    """
    n, m = len(passage), len(answer)
    if m < 0.85 * n - 1:
        return True
    tail = n - bits.bit_length()
    if tail >= 5:
        return True
    # of two last words one may agree across the other (that wolf this wolf, yonder wolf that wolf)
    if tail >= 3 or (tail == 1 and n > 1 and answer[-1] == passage[-2]):
        behind = m - agreement(answer, passage).bit_length()
        if behind <= max(0, tail - 2):
            return True
    if tail and len(answer[-1]) >= PART and any(len(w) >= 2 * PART and w != answer[-1] and w.startswith(answer[-1]) for w in passage[n - tail :]):
        return True
    if n >= 2 * END_WINDOW:
        at_end = (bits >> (n - END_WINDOW)).bit_count()
        rest = (bits & ((1 << (n - END_WINDOW)) - 1)).bit_count() / (n - END_WINDOW)
        if at_end < rest * END_WINDOW / 3:
            return True
    return tail >= 3 and m < n  # up to four last words of style may all have changed


def is_blank(text: str | None) -> bool:
    """Null, or nothing but blanks, marks, wrapping, a lead-in line or a placeholder."""
    body = words(unwrap(text))
    return not body or (len(body) <= 3 and " ".join(body) in PLACEHOLDERS)


def judged(passage: str | None, answer: str | None) -> tuple[str | None, list[str]]:
    """The one defect of a pair, or None; and of a pair that is whole or a copy the passage's last
    words, those after all words on which the answer agrees with it."""
    if answer is None:
        return "empty", []
    body = strip_instruction(unwrap(answer))
    body = unwrap(body)
    b = words(body)
    if not b or (len(b) <= 3 and " ".join(b) in PLACEHOLDERS):
        return "empty", []
    a = words(passage)
    if not a:
        return ("refusal" if refusals_in(b) else None), []
    n, m = len(a), len(b)
    bits = agreement(a, b)
    agreed = bits.bit_count()
    # how much is copied is asked where so many words agree that it may be a copy; each changed word and the
    # short runs between two of them may be uncovered
    if n - agreed <= COPY_CHANGES and -COPY_CHANGES <= m - n <= 0 and copied_words(a, b) >= m - 3 * COPY_CHANGES:
        return "copy", a[bits.bit_length() :]
    early = m < 0.5 * n
    near = bits & ((1 << min(n, int(1.3 * m) + 4)) - 1) if early else bits
    share = max(near.bit_count() / m, agreed / n if not early else 0)
    # a refusal may quote much of a short passage, but refuses in words that aren't the passage's
    if share < QUOTED and (said := refusals_in(b)) and (share < ALIGNED or said - refusals_in(a)):
        return "refusal", []
    if share < ALIGNED or (m > 2 * n + 8 and agreed < 0.2 * m):
        mine, theirs = language_of(b), language_of(a, 1 if n < 20 else 2)
        if mine and theirs and mine != theirs:
            return "other_language", []
    if share < ALIGNED:
        # a few words that agree little may still begin a rewrite
        return ("truncated" if m < FEW and m < 0.85 * n - 1 and share >= FEW_ALIGNED else None), []
    end = a[bits.bit_length() :]
    # last words of style may all have changed; but not where what was put round the answer, or a bracket in it, is still open
    return ("truncated", []) if breaks_off(a, b, bits) or (end and left_open(passage, answer)) else (None, end)


def defect_of(passage: str | None, answer: str | None) -> str | None:
    """The one defect of a pair, or None."""
    return judged(passage, answer)[0]


def _defects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tbl, ids, kind, left, right = (batch.column(i).to_pylist() for i in range(5))
        out = []
        for t, i, k, a, b in zip(tbl, ids, kind, left, right):
            d = defect_of(passage_of(a) if k else a, b)
            if d:
                out.append((t, i, d))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], ["tbl", "row_id", "defect"])


def measures(passage: str | None, answer: str | None) -> tuple[float, float, int, int, str | None]:
    """What the steps measure of a pair: the share of the answer's words that are copied, the share of the passage's
    that agree in order, refusing cues, delimiters left open, and the language that most stopwords vote for."""
    b = words(strip_instruction(unwrap(answer)))
    a = words(passage)
    agreed = agreement(a, b).bit_count() if a and b else 0
    return copied_words(a, b) / len(b) if b else 0.0, agreed / len(a) if a else 0.0, len(refusals_in(b)), len(unclosed(answer or "", strings=False)), language_of(b)


def pair_measures(pairs: DataFrame) -> DataFrame:
    """tbl, row_id, copied_share, agreed_share, n_refusing, n_open, language of every pair. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string())
        for batch in batches:
            kind, left, right = (batch.column(i).to_pylist() for i in (2, 3, 4))
            got = [measures(passage_of(a) if k else a, b) for k, a, b in zip(kind, left, right)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[i] for x in got], t) for i, t in enumerate(kinds))], ["tbl", "row_id", "copied_share", "agreed_share", "n_refusing", "n_open", "language"])

    cols = pairs.select("tbl", F.col("row_id").cast("bigint").alias("row_id"), "is_prompt", "source", "answer")
    return spread(cols).mapInArrow(run, "tbl string, row_id bigint, copied_share double, agreed_share double, n_refusing int, n_open int, language string")


def pair_defects(pairs: DataFrame) -> DataFrame:
    """pairs: tbl STRING, row_id BIGINT, is_prompt BOOLEAN (``source`` is a prompt that
    holds the passage), source STRING, answer STRING. Gives tbl, row_id, defect of each
    defective row. No shuffle: a row is judged where it is read."""
    cols = pairs.select("tbl", F.col("row_id").cast("bigint").alias("row_id"), "is_prompt", "source", "answer")
    return spread(cols).mapInArrow(_defects, "tbl string, row_id bigint, defect string")


def rewrite_pairs(rewrites: DataFrame, calls: DataFrame) -> DataFrame:
    """The pairs of the rewrites table and of the sound rewriting lines of the call ledger."""
    r = rewrites.select(F.lit("rewrites").alias("tbl"), F.col("rewrite_id").alias("row_id"), F.lit(False).alias("is_prompt"), F.col("original").alias("source"), F.col("rewrite").alias("answer"))
    c = calls.where((F.col("status") == "ok") & F.col("tag").isin("rewrite", "rewrite_retry"))
    c = c.select(F.lit("calls").alias("tbl"), F.col("call_id").alias("row_id"), F.lit(True).alias("is_prompt"), F.col("prompt").alias("source"), F.col("response").alias("answer"))
    return r.unionByName(c)
