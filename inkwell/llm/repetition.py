"""Repetition inside a single document.

A text's words are cut into lines: at line and sentence ends, and where words that stood earlier in
the text begin or stop. A linear-chain conditional random field labels each line content or
boilerplate from what can be seen of it (``FEATURES``): how often it stood before, its length, its
ends, its place, and how much is repeated near it. Viterbi decoding finds the best labelling
of the whole text; the share of words in content lines decides retention. The field was trained
(``train``) on texts into which loops, inserted phrases, repeated paragraphs and refrains were put, so
that which words are copies is known; phrases that merely recur are content.

Texts with too large a share of repeated words are those in which the field labels any line
boilerplate and in which, counted word by word, MOST_REPEATED or more of the words are repeated.

A word is a run of letters and digits, without case. A word is *repeated* when it
lies in a run of three or more words that already stood earlier in the text.

Defined results: null and texts of under four words have repeated share 0.0, content
share 1.0 and are kept; equal rows give equal results; no text is cut short (time is
linear in its words); an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

RUN = 3
#: Lines before and after a line that count as near it.
NEAR = 3
CONTENT, BOILERPLATE = 0, 1

#: What the field sees of a line. Fresh lines and lines that stood once or more often before, by length
#: (under 4 words, under 10, more); how much is repeated near it (under a quarter, under four tenths, more).
FEATURES = (
    "fresh short", "fresh middling", "fresh long", "second short", "second middling", "second long", "again short", "again middling", "again long",
    "fresh, little near", "fresh, some near", "fresh, much near", "repeated, little near", "repeated, some near", "repeated, much near", "begins at an end", "ends at an end", "first", "last",
)

#: Weights of the features towards boilerplate, and scores of (label before, label), as ``train`` found them
#: on 600 texts of the rewrites table at scale 0.1 (seed 0; 15,737 lines, 6,176 of them copies; 96 % of the
#: lines of 900 other texts get their label back).
WEIGHTS = (-1.83, -2.19, -2.05, -0.19, 1.14, 0.71, 0.82, 1.51, 1.54, -1.89, -1.73, -2.46, 0.27, 2.42, 2.84, -0.01, -0.11, -0.31, -0.18)
TRANSITION = np.array([[0.6, -0.23], [-0.36, 0.0]])

#: Repeated words a text may have, and the least share of content that is retained.
MOST_REPEATED, LEAST_CONTENT = 0.40, 0.60

_ALIKE = re.compile(b"\0+|[^\0]+")
_WORDS = re.compile(r"[^\W_]+|[.!?\n]")


def times_before(found: Sequence[str]) -> bytearray | None:
    """For each word, how often the runs of RUN words in which it lies stood earlier: 0, 1, or 2 for
    more. None: no run stands twice."""
    grams = list(zip(found, found[1:], found[2:]))
    if len(set(grams)) == len(grams):
        return None
    times = bytearray(len(found))
    seen: dict[tuple, int] = {}
    for i, g in enumerate(grams):
        n = seen.get(g, 0)
        seen[g] = n + 1
        if n:
            n = min(n, 2)
            for k in (i, i + 1, i + 2):
                if times[k] < n:
                    times[k] = n
    return times


def split_words(text: str) -> tuple[list[str], list[int]]:
    """The words, and how many words precede each line or sentence end."""
    return split_tokens(_WORDS.findall(text.casefold()))


def split_tokens(tokens: Iterable[str]) -> tuple[list[str], list[int]]:
    found: list[str] = []
    ends: list[int] = []
    for t in tokens:
        if t in ".!?\n":
            ends.append(len(found))
        else:
            found.append(t)
    return found, ends


def lines_of(times: bytearray, ends: Sequence[int]) -> list[tuple[int, int]]:
    """Lines of words: cut at ends, and where repeated words begin or stop."""
    n = len(times)
    cuts = {e for e in ends if 0 < e < n}
    cuts.update(m.start() for m in _ALIKE.finditer(times) if m.start())
    at = [0, *sorted(cuts), n]
    return list(zip(at, at[1:]))


def observed(found: Sequence[str], times: bytearray, lines: Sequence[tuple[int, int]], ends: Sequence[int]) -> list[tuple[int, ...]]:
    """The features (places in FEATURES) of each line."""
    natural = {0, len(found), *ends}
    words = [0]
    repeated = [0]
    for a, b in lines:
        words.append(b)
        repeated.append(repeated[-1] + (b - a if times[a] else 0))
    out = []
    last = len(lines) - 1
    for i, (a, b) in enumerate(lines):
        again = max(times[a:b])
        size = 0 if b - a < 4 else 1 if b - a < 10 else 2
        low, high = max(0, i - NEAR), min(last, i + NEAR) + 1
        share = (repeated[high] - repeated[low]) / (words[high] - words[low])
        near = 0 if share < 0.25 else 1 if share < MOST_REPEATED else 2
        f = [3 * again + size, 9 + near + (3 if again else 0)]
        if a in natural:
            f.append(15)
        if b in natural:
            f.append(16)
        if i == 0:
            f.append(17)
        if i == last:
            f.append(18)
        out.append(tuple(f))
    return out


class _Margins(dict):
    """Features of a line -> how much they speak for boilerplate. There are a few hundred combinations."""

    def __missing__(self, features: tuple[int, ...]) -> float:
        self[features] = v = float(sum(WEIGHTS[i] for i in features))
        return v


_MARGINS = _Margins()


def viterbi(margins: Sequence[float], transition=None) -> list[int]:
    """The best labelling of lines whose features speak so much for boilerplate. Ties go to content."""
    if not len(margins):
        return []
    (cc, cb), (bc, bb) = (map(float, row) for row in (TRANSITION if transition is None else transition))
    s0, s1 = 0.0, margins[0]
    back0, back1 = [], []
    for m in margins[1:]:
        f0, f1 = s1 + bc > s0 + cc, s1 + bb > s0 + cb
        back0.append(f0)
        back1.append(f1)
        s0, s1 = (s1 + bc if f0 else s0 + cc), (s1 + bb if f1 else s0 + cb) + m
    label = int(s1 > s0)
    out = [label]
    for f0, f1 in zip(reversed(back0), reversed(back1)):
        label = int(f1 if label else f0)
        out.append(label)
    return out[::-1]


def fit_field(sequences: Sequence[Sequence[tuple[int, ...]]], labels: Sequence[Sequence[int]], steps: int = 150, rate: float = 4.0, decay: float = 0.0005) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that maximise the conditional likelihood of labelled lines (gradient
    ascent with forward-backward expectations, weights decayed). The caller bounds the sample."""
    w, tr = np.zeros(len(FEATURES)), np.zeros((2, 2))
    rows = []
    for obs in sequences:
        x = np.zeros((len(obs), len(FEATURES)))
        for i, f in enumerate(obs):
            x[i, list(f)] = 1
        rows.append(x)
    total = sum(map(len, sequences)) or 1
    for _ in range(steps):
        g_w, g_tr = -decay * w, -decay * tr
        for x, lab in zip(rows, labels):
            n = len(x)
            if not n:
                continue
            unary = np.zeros((n, 2))
            unary[:, 1] = x @ w
            alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
            alpha[0] = unary[0]
            for t in range(1, n):
                alpha[t] = unary[t] + np.logaddexp(alpha[t - 1, 0] + tr[0], alpha[t - 1, 1] + tr[1])
            for t in range(n - 2, -1, -1):
                ahead = unary[t + 1] + beta[t + 1]
                beta[t] = np.logaddexp(tr[:, 0] + ahead[0], tr[:, 1] + ahead[1])
            z = np.logaddexp(*alpha[-1])
            y = np.asarray(lab)
            g_w = g_w + x.T @ (y - np.exp(alpha[:, 1] + beta[:, 1] - z)) / total
            if n > 1:
                np.add.at(g_tr, (y[:-1], y[1:]), 1 / total)
                pairs = alpha[:-1, :, None] + tr + (unary[1:] + beta[1:])[:, None, :] - z
                g_tr = g_tr - np.exp(pairs).sum(0) / total
        w, tr = w + rate * g_w, tr + rate * g_tr
    return w, tr


def injected(text: str, rng: random.Random) -> tuple[list[str], list[int]]:
    """A text's tokens with copies put in, and for each token whether it is such a copy: a phrase
    between the words, the end over and over, a paragraph again, many refrains that each come again; or none,
    or one refrain of a song, which is content."""
    base = _WORDS.findall(text.casefold())
    kind = rng.choice(("none", "song", "phrase", "end", "paragraph", "refrains"))
    n = len(base)
    if n < 12 or kind == "none":
        return base, [0] * n
    out, label = list(base), [0] * n

    def put(at: int, what: list[str], copy: int) -> None:
        out[at:at] = what
        label[at:at] = [copy] * len(what)

    def phrase(low: int, high: int) -> list[str]:
        k = rng.randint(low, high)
        a = rng.randrange(max(1, n - k))
        own = base[a : a + k]
        rng.shuffle(own)
        return own

    if kind == "song":
        own = ["\n", *(t for t in phrase(5, 8) if t.isalnum()), "\n"]
        for at in sorted(rng.sample(range(n), rng.randint(2, 3)), reverse=True):
            put(at, own, 0)
    elif kind == "phrase":
        own, step = phrase(3, 12), rng.randint(2, 14)
        places = list(range(rng.randrange(n), n, step)) or [0]
        for at in reversed(places):
            put(at, own, int(at != places[0]))
    elif kind == "end":
        own = base[-rng.randint(3, min(30, n)) :]
        put(len(out), own * max(1, round(rng.uniform(0.7, 3) * n / len(own))), 1)
    elif kind == "paragraph":
        k = rng.randint(min(20, n), n)
        a = rng.randrange(n - k + 1)
        put(len(out), ["\n", *(base[a : a + k])] * rng.randint(1, 4), 1)
    else:
        k, fresh, times = rng.randint(3, 8), rng.randint(2, 6), rng.randint(1, 3)
        out, label = [], []
        own = phrase(k, k)
        left = 0
        for i in range(0, n, fresh):
            put(len(out), base[i : i + fresh], 0)
            put(len(out), own, int(left > 0))
            left = left + 1 if left else 1
            if left > times:
                own, left = phrase(k, k), 0
    return out, label


def labelled(text: str, rng: random.Random) -> tuple[list[tuple[int, ...]], list[int]]:
    """Features of the lines of a text with copies put in, and labels to train from: a line is
    boilerplate where more than half of its words are copies."""
    tokens, copies = injected(text, rng)
    found, ends = split_tokens(tokens)
    if not found:
        return [], []
    flags = [c for t, c in zip(tokens, copies) if t not in ".!?\n"]
    times = times_before(found) or bytearray(len(found))
    cut = lines_of(times, ends)
    return observed(found, times, cut, ends), [int(2 * sum(flags[a:b]) > b - a) for a, b in cut]


def train(texts: DataFrame, sample: int = 600, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions from at most ``sample`` texts (column text), taken in the order of a hash.
    Texts that hold loops already are left out, as their copies bear no label."""
    rows = texts.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("h")).orderBy("h", "text").limit(sample).collect()
    rng = random.Random(seed)
    pairs = [labelled(r["text"], rng) for r in rows if repeated_share(r["text"]) < 0.2]
    return fit_field([o for o, _ in pairs], [y for _, y in pairs])


def repeated_share(text: str) -> float:
    found, _ = split_words(text)
    times = times_before(found)
    return 0.0 if times is None else (len(times) - times.count(0)) / len(times)


def shares(text: str | None) -> tuple[int, float, float]:
    """Words, the share of them repeated, and the share that the field labels content."""
    if not text:
        return 0, 0.0, 1.0
    found, ends = split_words(text)
    n = len(found)
    times = times_before(found)
    if times is None:
        return n, 0.0, 1.0  # fresh lines with nothing repeated near: the best labelling is all content
    cut = lines_of(times, ends)
    margins = [_MARGINS[f] for f in observed(found, times, cut, ends)]
    kept = sum(b - a for (a, b), label in zip(cut, viterbi(margins)) if label == CONTENT)
    return n, (n - times.count(0)) / n, kept / n


def repetition(texts: DataFrame) -> DataFrame:
    """texts: tbl, row_id, text. Gives tbl, row_id, n_words, repeated_share, content_share of every row;
    retained: whether the field leaves LEAST_CONTENT of it; and keep: false where the field sees
    boilerplate and MOST_REPEATED or more of the words are repeated. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shares(t) for t in b.column(2).to_pylist()]
            n, rep, con = (list(x) for x in zip(*got)) if got else ([], [], [])
            keep = [c == 1.0 or r < MOST_REPEATED for r, c in zip(rep, con)]
            retained = [c >= LEAST_CONTENT for c in con]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(rep, pa.float64()), pa.array(con, pa.float64()), pa.array(retained, pa.bool_()), pa.array(keep, pa.bool_())],
                ["tbl", "row_id", "n_words", "repeated_share", "content_share", "retained", "keep"],
            )

    src = texts.select("tbl", F.col("row_id").cast("bigint").alias("row_id"), "text")
    return spread(src).mapInArrow(run, "tbl string, row_id bigint, n_words bigint, repeated_share double, content_share double, retained boolean, keep boolean")


def generated_texts(rewrites: DataFrame, calls: DataFrame) -> DataFrame:
    """tbl, row_id, text of the rewrites and of the ledger's responses."""
    r = rewrites.select(F.lit("rewrites").alias("tbl"), F.col("rewrite_id").alias("row_id"), F.col("rewrite").alias("text"))
    return r.unionByName(calls.select(F.lit("calls").alias("tbl"), F.col("call_id").alias("row_id"), F.col("response").alias("text")))
