"""Same or near-same records across splits.

A record's passage is its name, normalised. Evaluation passages are sharded; the pieces of a shard's
passages go into an Aho-Corasick automaton, which scans the training records of the shard with
their words run together, so that lost and added spaces don't count. The intervals of an evaluation
passage whose pieces were matched are merged into its coverage. A slip of the pen touches one piece,
or two where neighbours are swapped across their border, so what is uncovered by more than
MOST_PIECES pieces is no overlap; what remains is compared exactly (``same_work``).

Records meet in a shard by *signatures*: pairs of their words (single words and forms
with a letter left out, also run together, for short records) together with their numerals. Two records
that differ by at most two slips share a signature, so no training record is scanned
against shards it can't belong to, and the work follows the records. Records of equal keys are
folded before, and their rows join the pairs afterwards. A signature whose two sides would make more
than HOT_PAIRS pairs is refined by each other word of the record (that word, or it with a letter left
out, is shared too), and what is still hot then is scanned in blocks.

Defined results: rows with a null set_name belong to no split; null ids name no work,
but may share numbers; null, empty and non-positive numbers are shared with nobody; a
row that repeats another makes pairs of its own; pairs within a split are no cases.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import ahocorasick
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

TRAINING = ("texts", "noise_pool")
EVALUATION = ("heldout", "mixture_sources")
SLIPS = 2
#: Pieces of an evaluation passage that two slips, or a lost space and a slip, can leave uncovered.
MOST_PIECES = 4
#: Signed records in a shard, on average.
SHARD_SIGNATURES = 20_000
#: Pairs of records that one signature, or one block of it, may give a task to look at.
HOT_PAIRS = 100_000

# Articles and joining words that a name may have or lack.
JOINING = frozenset("a an the of in on and or to for with from by le la les l un une des du de et der die das ein eine und von el los las y o".split())
# Words that mark another copy or edition of the same work.
EDITION = frozenset("copy dup duplicate edition ed edn rev revised new reprint reprinted reissue printing another alt bis".split())
# Words before a part's number.
PARTS = {"vol": "vol", "volume": "vol", "part": "part", "pt": "part", "book": "book", "bk": "book", "no": "no", "number": "no", "act": "act", "canto": "canto", "chapter": "chapter"}
_PART_NAMES = frozenset(PARTS.values())
_ROMAN = re.compile(r"(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_EDITION_MARK = re.compile(r"(?:v|ver|ed|edn|rev|copy)\d+|\d+(?:st|nd|rd|th)")
_WORD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z])")


def _roman(word: str) -> int:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    total = 0
    for a, b in zip(word, word[1:] + " "):
        total += -values[a] if values.get(b, 0) > values[a] else values[a]
    return total


def name_key(name: str | None) -> tuple[tuple[str, ...], tuple[str, ...], str]:
    """(sorted words, numerals, everything run together) of a work's id."""
    if not name:
        return (), (), ""
    text = "".join(c for c in unicodedata.normalize("NFKD", _CAMEL.sub(" ", name)) if not unicodedata.combining(c)).casefold()
    tokens = _WORD.findall(text)
    words, numerals = [], []
    for i, t in enumerate(tokens):
        if t in JOINING or (t in EDITION and len(tokens) > 2) or _EDITION_MARK.fullmatch(t):
            continue
        if t.isdigit():
            numerals.append(t.lstrip("0") or "0")
        elif i and _ROMAN.fullmatch(t):
            numerals.append(str(_roman(t)))
        elif t in PARTS and i + 1 < len(tokens):
            words.append(PARTS[t])
        else:
            words.append(t)
    return tuple(sorted(words)), tuple(numerals), "".join(tokens)


def left_out(word: str, letters: int) -> set[str]:
    """The word, and it with up to so many letters left out."""
    out = {word}
    for _ in range(letters):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return out


#: Words up to which single words are signatures.
FEW_WORDS = 4


def _counts(k: int, side: str) -> list[str]:
    """With which counts of words a record of k words meets those of the other side on a single word, as (words
    of the evaluation record, words of the training record): counts that a lost space or slipped joining words
    make of one another. Records of FEW_WORDS words each need none: two of their words are intact."""
    near = [j for j in range(max(1, k - SLIPS), min(FEW_WORDS, k + SLIPS) + 1) if not j == k == FEW_WORDS]
    return [f"{k}-{j}" if side == "evaluation" else f"{j}-{k}" for j in near]


def signatures(words: tuple[str, ...], numerals: tuple[str, ...], together: str, side: str = "evaluation") -> list[str]:
    """Strings of which records of the two sides that are within two slips of each other share at least one."""
    n = ",".join(numerals)
    k = len(words)
    if k > 10:  # neighbours in sorted order: two slips break at most six of the seven or more pairs of common words
        parts = {f"{a} {b}" for a, b in zip(words, words[1:])}
    else:
        parts = {f"{a} {b}" for a, b in combinations(words, 2)}
    if k <= 3:  # lost spaces and a slip in what is run together
        parts |= {f"+{x}" for t in ("".join(words), "".join(reversed(words))) for x in left_out(t, 1)}
    out = [f"{p}|{n}" for p in parts] + [f"={together}"]
    if k <= FEW_WORDS:  # four words and three, of which a space was lost and another word slipped, have one in common
        single = {x for w in words for x in (left_out(w, 3 - k) if k < 3 else (w,))}
        out += [f"{x}|{n}|{c}" for c in _counts(k, side) for x in single]
    return out


def refined(words: tuple[str, ...], signature: str) -> list[str]:
    """A signature of words with each other word of its record, with each form of that word that lacks
    a letter (two, where it is the only one), and with the others run together where they are two at
    most. Records within two slips that share the signature share one of these: of several other words
    one is equal or slipped once. Records that agree run together are left as they are."""
    if signature[0] in "=+":
        return [signature]
    others = list(words)
    for w in signature.split("|")[0].split(" "):
        if w in others:
            others.remove(w)
    forms = {x for w in others for x in left_out(w, 2 if len(others) == 1 else 1)}
    if len(others) <= 2:
        forms |= left_out("".join(others), 1) | left_out("".join(reversed(others)), 1)
    if all(_joining_slips(w, SLIPS) <= SLIPS for w in others):  # as good as none
        forms.add("")
    return [f"{signature}&{x}" for x in forms]


def slips(a: str, b: str, most: int) -> int:
    """Letters added, dropped, changed or swapped with the next; most + 1 where there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return row[-1]


def _joining_slips(word: str, most: int) -> int:
    return min((slips(word, j, most) for j in JOINING if abs(len(j) - len(word)) <= 1), default=most + 1)


def same_work(a: tuple, b: tuple, most: int = SLIPS) -> bool:
    """Whether two name keys differ at most in what is left aside and ``most`` slips."""
    (wa, na, ta), (wb, nb, tb) = a, b
    if na != nb:
        return ta == tb and bool(ta)
    if wa == wb:
        return bool(wa) or (bool(na) and ta == tb)
    if ta == tb:
        return True
    ra, rb = list(wa), list(wb)
    for w in wa:
        if w in rb:
            ra.remove(w)
            rb.remove(w)
    if len(ra) > most + 1 or len(rb) > most + 1:
        return False

    def cost(x: list[str], y: list[str], left: int) -> bool:
        if left < 0:
            return False
        if not x:
            return sum(_joining_slips(w, left) for w in y) <= left
        head, rest = x[0], x[1:]
        if any((c := slips(head, w, left)) <= left and cost(rest, y[:i] + y[i + 1 :], left - c) for i, w in enumerate(y)):
            return True
        return (c := _joining_slips(head, left)) <= left and cost(rest, y, left - c)

    if cost(ra, rb, most):
        return True
    # a lost or added space: the words left over, run together in some order
    def joined(x: list[str]) -> set[str]:
        return {"".join(x), "".join(reversed(x))} if len(x) > 1 else set(x)

    return len(ra) != len(rb) and bool(ra) and bool(rb) and any(slips(p, q, most - 1) <= most - 1 for p in joined(ra) for q in joined(rb))


def pieces(words: tuple[str, ...]) -> list[tuple[int, int, str]]:
    """(start, end, piece) of a passage of words run together: words of six letters and more are cut into
    three pieces, of four and more into two. A part's name is left out, as it may be spelt in other ways."""
    out, at = [], 0
    for w in words:
        if w not in _PART_NAMES:
            k = min(3, max(1, len(w) // 2))
            cuts = [at + len(w) * i // k for i in range(k + 1)]
            out += [(a, b, w[a - at : b - at]) for a, b in zip(cuts, cuts[1:])]
        at += len(w)
    return out


def coverage(parts: list[tuple[int, int, str]], found: set[str]) -> tuple[list[tuple[int, int]], float]:
    """The merged intervals of a passage's matched pieces, and the share of its letters that they cover."""
    merged: list[tuple[int, int]] = []
    for a, b, piece in parts:
        if piece in found:
            if merged and merged[-1][1] == a:
                merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
    total = sum(b - a for a, b, _ in parts)
    return merged, sum(b - a for a, b in merged) / total if total else 1.0


def uncovered(parts: list[tuple[int, int, str]], found: set[str], most: int) -> int:
    """How many pieces of a passage lie outside its matched intervals; most + 1 where there are more."""
    left = 0
    for _, _, piece in parts:
        if piece not in found:
            left += 1
            if left > most:
                break
    return left


def as_key(text: str) -> tuple[tuple[str, ...], tuple[str, ...], str]:
    """A name's key from the form in which it is shuffled."""
    words, numerals, together = text.split("\x1e")
    return tuple(words.split("\x1f")) if words else (), tuple(numerals.split("\x1f")) if numerals else (), together


def key_text(name: str | None) -> str | None:
    """A name's key as one string; None where it names nothing."""
    words, numerals, together = name_key(name)
    return "\x1e".join(("\x1f".join(words), "\x1f".join(numerals), together)) if together else None


def _scan(evaluation: pd.DataFrame, training: pd.DataFrame) -> list[tuple[str, str, float]]:
    """Pairs of keys of one shard, and how much of the evaluation passage is covered: the automaton of the
    shard's evaluation passages scans its training records."""
    if not len(evaluation) or not len(training):
        return []
    held: dict[str, list[str]] = {}
    for text, sig in zip(evaluation["key"], evaluation["sig"]):
        held.setdefault(sig, []).append(text)
    passages = {}
    automaton = ahocorasick.Automaton()
    for text in set(evaluation["key"]):
        key = as_key(text)
        passages[text] = key, pieces(key[0])
        for _, _, piece in passages[text][1]:
            automaton.add_word(piece, piece)
    if len(automaton):
        automaton.make_automaton()
    routed: dict[str, set[str]] = {}
    for text, sig in zip(training["key"], training["sig"]):
        if sig in held:
            routed.setdefault(text, set()).update(held[sig])
    out = []
    for text, candidates in routed.items():
        key = as_key(text)
        found = {piece for _, piece in automaton.iter(key[2])} if len(automaton) else set()
        for other in candidates:
            mine, parts = passages[other]
            if uncovered(parts, found, MOST_PIECES) <= MOST_PIECES and same_work(mine, key):
                out.append((other, text, round(coverage(parts, found)[1], 6)))
    return out


def records(sources: DataFrame) -> DataFrame:
    """decl_order, side, set_name (in one spelling), author, numbers, key of every row of a split. Kept
    once: all that follows reads these, not the sources."""
    spelt = F.regexp_replace(F.lower(F.trim(F.regexp_replace("set_name", r"\s+", " "))), r"[\s_-]+", "_")
    spelt = F.when(spelt == "held_out", "heldout").when(spelt == "noisepool", "noise_pool").when(spelt == "mixturesources", "mixture_sources").when(spelt == "text", "texts").otherwise(spelt)
    side = F.when(spelt.isin(*TRAINING), "training").when(spelt.isin(*EVALUATION), "evaluation")
    numbers = F.array_sort(F.array_distinct(F.filter("gutenberg_ids", lambda g: g > 0)))
    rows = sources.select(F.col("decl_order").cast("bigint"), side.alias("side"), spelt.alias("set_name"), F.col("author").cast("string"), numbers.cast("array<bigint>").alias("numbers"), F.col("id").cast("string").alias("name")).where(F.col("side").isNotNull())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([key_text(n) for n in b.column(5).to_pylist()], pa.string())], ["decl_order", "side", "set_name", "author", "numbers", "key"])

    return checkpointed(rows.mapInArrow(keys, "decl_order bigint, side string, set_name string, author string, numbers array<bigint>, key string"))


def _hash(signature: str) -> int:
    """A signature as it is shuffled. Two with one hash only bring records together that are then told apart."""
    return xxhash.xxh3_64_intdigest(signature) - (1 << 63)


def _signed(classes: DataFrame, refine: bool) -> DataFrame:
    """side, id, sig: hashes of the signatures of keys, or of those that refine the hash in column sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides, ids, sigs = [], [], []
            for s, i, text, sig in zip(*(b.column(k).to_pylist() for k in range(4))):
                key = as_key(text)
                own = signatures(*key, s)
                if refine:
                    own = [x for y in own if _hash(y) == sig for x in refined(key[0], y)]
                sides += [s] * len(own)
                ids += [i] * len(own)
                sigs += map(_hash, own)
            yield pa.RecordBatch.from_arrays([pa.array(sides, pa.string()), pa.array(ids, pa.int64()), pa.array(sigs, pa.int64())], ["side", "id", "sig"])

    return classes.select("side", "id", "key", "sig").mapInArrow(run, "side string, id bigint, sig bigint")


def _live(signed: DataFrame) -> DataFrame:
    """Signed records whose signature both sides hold, with how many hold it on each."""
    n = signed.groupBy("sig").agg(F.count_if(F.col("side") == "evaluation").alias("n_e"), F.count_if(F.col("side") == "training").alias("n_t"))
    return signed.join(n.where("n_e > 0 AND n_t > 0"), "sig")


def same_names(rows: DataFrame, hot_pairs: int = HOT_PAIRS, id_col: str = "decl_order") -> DataFrame:
    """key_e, key_t, coverage: keys of evaluation and training records (``records``) that name the same work, and how
    much of the evaluation passage the training record covers. Hashes and
    ids are shuffled to find who meets whom; keys join those that do."""
    spark = rows.sparkSession
    named = rows.where("key IS NOT NULL").groupBy("side", "key").agg(F.min(F.coalesce(F.col(id_col), F.xxhash64("key"))).alias("id"))
    live = checkpointed(_live(_signed(named.withColumn("sig", F.lit(0).cast("bigint")), False)))
    hot = F.col("n_e") * F.col("n_t") > hot_pairs
    again = _live(_signed(live.where(hot).join(named, ["side", "id"]), True))
    # blocks such that two of them make at most hot_pairs pairs: each evaluation block meets each training block
    side = int(hot_pairs**0.5)
    own, other = (F.when(F.col("side") == "evaluation", F.ceil(F.col(a) / side)).otherwise(F.ceil(F.col(b) / side)) for a, b in (("n_e", "n_t"), ("n_t", "n_e")))
    cold = F.col("n_e") * F.col("n_t") <= hot_pairs
    mine, all_ = F.when(cold, 0).otherwise(F.pmod(F.xxhash64("id"), own)), F.when(cold, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), other.cast("bigint") - 1))
    again = again.select("side", "id", "sig", mine.alias("mine"), F.explode(all_).alias("other"))
    pair = F.when(F.col("side") == "evaluation", F.struct(F.col("mine").alias("a"), F.col("other").alias("b"))).otherwise(F.struct(F.col("other").alias("a"), F.col("mine").alias("b")))
    again = again.select("side", "id", F.xxhash64("sig", pair).alias("sig"))
    signed = live.where(~hot).select("side", "id", "sig").unionByName(again)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-live.count() // SHARD_SIGNATURES))
    signed = signed.join(named, ["side", "id"]).withColumn("shard", F.pmod(F.xxhash64("sig"), F.lit(shards)))

    def match(evaluation: pd.DataFrame, training: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_scan(evaluation, training), columns=["key_e", "key_t", "coverage"])

    # columns of their own for each side
    left, right = (signed.where(F.col("side") == s).select(*[F.col(c).alias(c) for c in ("shard", "key", "sig")]).groupBy("shard") for s in ("evaluation", "training"))
    return left.cogroup(right).applyInPandas(match, "key_e string, key_t string, coverage double").distinct()


def _linked(rows: DataFrame, id_col: str) -> DataFrame:
    """e, t: ids of evaluation and training rows that name the same work or share a number, each pair once."""
    e, t = (rows.where(F.col("side") == s) for s in ("evaluation", "training"))
    by_name = same_names(rows, id_col=id_col).drop("coverage").join(e.select(F.col("key").alias("key_e"), F.col(id_col).alias("e")), "key_e").join(t.select(F.col("key").alias("key_t"), F.col(id_col).alias("t")), "key_t").select("e", "t")
    return by_name.unionByName(_shared_numbers(rows, id_col)).distinct()


def _shared_numbers(rows: DataFrame, id_col: str) -> DataFrame:
    """e, t: ids of evaluation and training rows that share a number, once for each number."""
    e, t = (rows.where(F.col("side") == s).select(F.col(id_col).alias(c), F.explode("numbers").alias("number")) for s, c in (("evaluation", "e"), ("training", "t")))
    return e.join(t, "number").select("e", "t")


def number_pairs(sources: DataFrame) -> DataFrame:
    """decl_a < decl_b of training and evaluation rows that share a number."""
    pairs = _shared_numbers(records(sources), "decl_order").distinct()
    return pairs.select(F.least("e", "t").alias("decl_a"), F.greatest("e", "t").alias("decl_b"))


def cross_split_pairs(sources: DataFrame) -> DataFrame:
    """decl_a < decl_b of training and evaluation rows that share a number or name the same work."""
    pairs = _linked(records(sources), "decl_order")
    return pairs.select(F.least("e", "t").alias("decl_a"), F.greatest("e", "t").alias("decl_b"))


def evaluation_coverage(sources: DataFrame) -> DataFrame:
    """decl_order, set_name, n_names, coverage of every evaluation row that names a work: how many names of
    training records name the same, and the most that one of them covers of it (0 where none does)."""
    rows = records(sources)
    best = same_names(rows).groupBy(F.col("key_e").alias("key")).agg(F.count(F.lit(1)).alias("n_names"), F.max("coverage").alias("coverage"))
    own = rows.where("side = 'evaluation' AND key IS NOT NULL").select("decl_order", "set_name", "key").join(best, "key", "left")
    return own.select("decl_order", "set_name", F.coalesce("n_names", F.lit(0)).cast("bigint").alias("n_names"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def overlap_classes(sources: DataFrame) -> DataFrame:
    """decl_order, side, class_id, n_links of every row of a split: rows of a side whose keys and numbers are
    equal are one class (``class_id``: the least decl_order in it), and n_links counts the rows of the other
    side that a row overlaps. Links are found between classes, so copies are never expanded into pairs."""
    rows = records(sources)
    own = ["side", "key", "numbers"]
    # a null key or array is one value of a group, as rows without one may still be equal in the other
    classes = checkpointed(rows.groupBy(*own).agg(F.min("decl_order").alias("class_id"), F.count(F.lit(1)).alias("n_rows")))
    links = checkpointed(_linked(classes, "class_id"))
    n = [links.join(classes.select(F.col("class_id").alias(b), "n_rows"), b).groupBy(F.col(a).alias("class_id")).agg(F.sum("n_rows").alias("n_links")) for a, b in (("e", "t"), ("t", "e"))]
    counted = classes.join(n[0].unionByName(n[1]), "class_id", "left").select(*[F.col(c).alias(f"_{c}") for c in own], "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    same = F.lit(True)
    for c in own:
        same = same & rows[c].eqNullSafe(counted[f"_{c}"])
    return rows.join(counted, same).select("decl_order", "side", "class_id", "n_links")


def overlap_counts(sources: DataFrame) -> DataFrame:
    """Evaluation rows, those that training holds too, and pairs, by evaluation set_name and author."""
    rows = records(sources)
    ends = _linked(rows, "decl_order").groupBy(F.col("e").alias("decl_order")).agg(F.count(F.lit(1)).alias("n_pairs"))
    e = rows.where("side = 'evaluation'").select("decl_order", "set_name", F.coalesce(F.trim("author"), F.lit("")).alias("author"))
    out = e.join(ends, "decl_order", "left")
    return out.groupBy("set_name", "author").agg(F.count(F.lit(1)).alias("n_rows"), F.count("n_pairs").alias("n_overlapping"), F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"))
