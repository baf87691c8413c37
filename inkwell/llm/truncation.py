"""Text cut off by field limits.

A value that is a strict prefix of a longer copy elsewhere was cut. Values are cut into blocks at
fixed places (``block_starts``); each block goes under the hash of all that stands before it. Where
a value ends in a block, every value with the same hash before it and more in the block is asked for
the hash of its prefix of that length, and a self-join on whole hashes tells which values have a
longer copy. A block has at most 256 characters, so a hash is asked for at most 256 lengths however
many values share a beginning; whole texts are neither sorted, nor sampled, nor gathered anywhere.

Most cut answers have no longer copy, so a second measure follows for every line: an answer to a
rewriting prompt must cover the end of its passage (``pairs.judged``), and a JSON value must be closed.

Of a value's longer copies the one that comes first counts for how it goes on, in an order in which
word characters stand before all others: it goes on inside the value's last word if any copy does.

Defined results: null, blank and placeholder responses are not cut; a response that agrees with
the last word of its passage or closes its JSON value is whole even if a longer copy goes on; one
whose last words differ from the passage's is cut where a longer copy goes on inside its last
word, or with one of the words that it lacks; one that neither tells (a refusal, another
language) is cut where a longer copy goes on, or the length limit was met, and it doesn't end
in a closing mark. Equal rows give equal results.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .pairs import is_blank, judged, unclosed
from .wording import passage_of, unwrap, words

#: Where the first blocks start; from the last on a block starts every BLOCK characters.
FIRST_STARTS = (0, 8, 32, 128, 256)
BLOCK = 256
_CLOSED = re.compile("[.!?;:\u2026\u3002\uff01\uff1f)\\]}][\"'\u2019\u201d\u00bb)*_`]*\\Z")
#: Stands before every character that is not of a word, and sorts behind all others.
_LAST = "\U0010ffff"
_NO_WORD = re.compile(r"[\W_]")
#: Keys over which the beginnings of all values are dealt.
SALTS = 64
#: Blocks that a task hands on at a time, so that a batch of long texts fits in memory.
ROWS_AT_A_TIME = 20_000
#: Characters of a longer copy that are kept of what follows a value: two words of it are looked at.
AHEAD = 40
_LIMIT_REASONS = ("length", "max_tokens", "max_output_tokens", "token_limit")


def json_state(body: str) -> str:
    """'whole', 'cut' or 'unknown' (no JSON value)."""
    if not body or body[0] not in "{[":
        return "unknown"
    try:
        json.loads(body)
        return "whole"
    except ValueError:
        return "cut" if unclosed(body) else "whole"


def judged_line(tag: str | None, prompt: str | None, response: str | None) -> tuple[str, list[str]]:
    """What a line tells by itself: 'whole', 'cut', 'blank' or 'unknown'; and the last words of
    its passage that a whole answer doesn't agree with."""
    if tag not in ("rewrite", "rewrite_retry") or not (passage := passage_of(prompt)):
        if response is None or is_blank(response):
            return "blank", []
        return (json_state(unwrap(response)) if tag not in ("rewrite", "rewrite_retry") else "unknown"), []
    d, end = judged(passage, response)
    return {"truncated": "cut", "empty": "blank", "refusal": "unknown", "other_language": "unknown"}.get(d, "whole"), end


def state_of(tag: str | None, prompt: str | None, response: str | None) -> str:
    """The state of ``judged_line``."""
    return judged_line(tag, prompt, response)[0]


def block_starts(n: int) -> list[int]:
    """Where the blocks of n characters start."""
    return [x for x in FIRST_STARTS if x < n] + list(range(FIRST_STARTS[-1] + BLOCK, n, BLOCK))


def blocks(value: str) -> tuple[list[tuple[bytes, str, int]], bytes]:
    """(hash of all before it, the block and AHEAD characters more, characters of a full block) of each
    block, and the hash of the whole value. The hash of a beginning is the same in every value that
    begins so: each is made from the hash before its block and what of it lies in the block."""
    starts = block_starts(len(value))
    out, before = [], b""
    for i, a in enumerate(starts):
        end = starts[i + 1] if i + 1 < len(starts) else (FIRST_STARTS[i + 1] if i + 1 < len(FIRST_STARTS) else a + BLOCK)
        out.append((before, value[a : end + AHEAD], end - a))
        before = hashlib.md5(before + value[a:end].encode("utf-8", "surrogatepass")).digest()
    return out, before


def value_hash(value: str) -> bytes:
    """The hash of a whole value, as ``longer_copies`` has it."""
    return blocks(value)[1]


def longer_copies(texts: DataFrame, form=None) -> DataFrame:
    """texts: one STRING column. key, goes_inside, next_words of every value, and of every other beginning
    of the same length, of which a strictly longer copy stands in the column: whether a copy goes on with a
    word character, and the first two words of what follows in the first copy. ``form``: what a text's
    value is (the text itself, where it isn't given); null and empty values are none.

    What is shuffled is each block once, with AHEAD characters more. Equal texts of a batch are
    folded before. The empty beginning, which all values share, is dealt over SALTS keys, and its at most
    eight lengths go to each; other hashes that many values share are skewed keys of a plain join
    with one row of lengths each, which adaptive execution splits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {form(t) if form else t for t in set(b.column(0).to_pylist()) if t}
            rows, short = [], set()
            for v in found:
                if len(rows) >= ROWS_AT_A_TIME:
                    yield _rows(rows)
                    rows = []
                for before, text, full in blocks(v)[0] if v else ():
                    n = len(text) if len(text) <= full else None  # else the value goes on
                    if before:
                        rows.append((before, text, n))
                    else:
                        rows.append((bytes([zlib.crc32(text.encode("utf-8", "surrogatepass")) % SALTS]), text, None))
                        short.add(n)
            yield _rows(rows + [(bytes([k]), None, n) for n in short - {None} for k in range(SALTS)])

    def _rows(rows: list[tuple[bytes, str | None, int | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.binary(), pa.string(), pa.int32()))], ["at", "text", "n"])

    def following(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ahead = b.column(1).to_pylist()
            inside = [not x.startswith(_LAST) for x in ahead]
            after = [words(x.replace(_LAST, ""))[:2] for x in ahead]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(inside, pa.bool_()), pa.array(after, pa.list_(pa.string()))], ["key", "goes_inside", "next_words"])

    rows = texts.transform(spread).mapInArrow(run, "at binary, text string, n int")
    ends = rows.where("n IS NOT NULL").groupBy("at").agg(F.collect_set("n").alias("lengths"))
    asked = rows.where("text IS NOT NULL").select("at", "text").join(ends, "at").select("at", "text", F.explode(F.filter("lengths", lambda n: n < F.length("text"))).alias("n"))
    before = F.when(F.length("at") > 1, F.col("at")).otherwise(F.lit(b""))
    key = F.unhex(F.md5(F.concat(before, F.encode(F.substring("text", F.lit(1), F.col("n")), "UTF-8"))))
    ahead = F.regexp_replace(F.substring("text", F.col("n") + 1, F.lit(AHEAD)), r"(?U)[\W_]", _LAST + "$0")
    return asked.select(key.alias("key"), ahead.alias("ahead")).groupBy("key").agg(F.min("ahead").alias("ahead")).mapInArrow(following, "key binary, goes_inside boolean, next_words array<string>")


def prefix_lines(calls: DataFrame) -> DataFrame:
    """call_id, provider, model_id of the sound lines whose stored response, as it stands, is a strict
    prefix of another sound line's."""
    sound = calls.where("status = 'ok' AND response <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([value_hash(x) for x in b.column(3).to_pylist()], pa.binary())], ["call_id", "provider", "model_id", "key"])

    lines = spread(sound.select(F.col("call_id").cast("bigint"), "provider", "model_id", "response")).mapInArrow(run, "call_id bigint, provider string, model_id string, key binary")
    return lines.join(longer_copies(sound.select("response")).select("key"), "key", "left_semi").drop("key")


def ledger_states(calls: DataFrame) -> DataFrame:
    """call_id, provider, model_id, state, unmatched, key, open_end, in_word, at_limit of each sound line. The
    key of a blank line is its own number: it matches nothing, and blank lines don't meet in one group."""
    fields = "call_id bigint, provider string, model_id string, state string, unmatched array<string>, key binary, open_end boolean, in_word boolean, at_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tag, prompt, response = (b.column(i).to_pylist() for i in (3, 4, 5))
            state, end = zip(*(judged_line(*x) for x in zip(tag, prompt, response))) if tag else ((), ())
            body = [unwrap(r) for r in response]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), b.column(2), pa.array(state, pa.string()), pa.array([x or None for x in end], pa.list_(pa.string())), pa.array([value_hash(x) if x else str(i).encode() for i, x in zip(b.column(0).to_pylist(), body)], pa.binary()),
                    pa.array([_CLOSED.search(x[-12:]) is None for x in body], pa.bool_()), pa.array([bool(x) and _NO_WORD.match(x[-1]) is None for x in body], pa.bool_()), b.column(6),
                ],
                ["call_id", "provider", "model_id", "state", "unmatched", "key", "open_end", "in_word", "at_limit"],
            )

    at_limit = F.lower("finish_reason").isin(*_LIMIT_REASONS) | (F.col("output_tokens") >= F.col("max_output_tokens"))
    src = calls.where("status = 'ok'").select(F.col("call_id").cast("bigint"), "provider", "model_id", "tag", "prompt", "response", F.coalesce(at_limit, F.lit(False)).alias("at_limit"))
    return spread(src).mapInArrow(run, fields)


def cut_lines(calls: DataFrame) -> DataFrame:
    """call_id, provider, model_id, is_cut, has_longer_copy of every line with status ok."""
    prefixes = longer_copies(calls.where("status = 'ok' AND response IS NOT NULL").select("response"), unwrap).withColumn("has_longer_copy", F.lit(True))
    out = ledger_states(calls).join(prefixes, "key", "left").withColumn("has_longer_copy", F.coalesce("has_longer_copy", F.lit(False)))
    unsure = (F.col("state") == "unknown") & F.col("open_end") & (F.col("has_longer_copy") | F.col("at_limit"))
    goes_on = (F.col("in_word") & F.col("goes_inside")) | F.arrays_overlap("unmatched", "next_words")
    short = F.coalesce((F.col("state") == "whole") & F.col("unmatched").isNotNull() & goes_on, F.lit(False))
    return out.select("call_id", "provider", "model_id", ((F.col("state") == "cut") | unsure | short).alias("is_cut"), "has_longer_copy")


def cut_shares(calls: DataFrame) -> DataFrame:
    """Lines and cut lines of each source (provider, model_id)."""
    out = cut_lines(calls).groupBy("provider", "model_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("is_cut").alias("n_cut"), F.count_if("has_longer_copy").alias("n_longer_copy"))
    return out.withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_lines"), 6))
