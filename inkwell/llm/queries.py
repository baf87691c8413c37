"""Queries over whole tables for the operators of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import canonical, encoding, overlap, packing, pairs, repetition, splitting, truncation


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


_rewrites, _calls, _chunks, _documents, _sources = map(_table, ("rewrites", "calls", "chunks", "documents", "text_sources"))


def p1_found(spark, d):
    return repetition.repetition(repetition.generated_texts(_rewrites(spark, d), _calls(spark, d))).where("NOT keep").select("tbl", "row_id")


def p1_shares(spark, d):
    return repetition.repetition(repetition.generated_texts(_rewrites(spark, d), _calls(spark, d)))


def p1_retention(spark, d):
    """Whether each text is retained by its share of content lines alone."""
    return repetition.repetition(repetition.generated_texts(_rewrites(spark, d), _calls(spark, d))).select("tbl", "row_id", "content_share", "retained")


def p1_repeated(spark, d):
    """Words and the share of them repeated, of each text."""
    r = repetition.repetition(repetition.generated_texts(_rewrites(spark, d), _calls(spark, d)))
    return r.select("tbl", "row_id", "n_words", F.round("repeated_share", 6).alias("repeated_share"))


def p2_found(spark, d):
    return splitting.split_oversized(_chunks(spark, d)).select("creation_id", "chunk_index").distinct()


def p2_pieces(spark, d):
    return splitting.split_oversized(_chunks(spark, d))


def p3_found(spark, d):
    return pairs.pair_defects(pairs.rewrite_pairs(_rewrites(spark, d), _calls(spark, d)))


def p3_measures(spark, d):
    return pairs.pair_measures(pairs.rewrite_pairs(_rewrites(spark, d), _calls(spark, d)))


def p4_found(spark, d):
    return truncation.cut_lines(_calls(spark, d)).where("is_cut").select("call_id")


def p4_sources(spark, d):
    return truncation.cut_shares(_calls(spark, d))


def p4_prefixes(spark, d):
    return truncation.prefix_lines(_calls(spark, d))


def p5_found(spark, d):
    return overlap.cross_split_pairs(_sources(spark, d))


def p5_numbers(spark, d):
    return overlap.number_pairs(_sources(spark, d))


def p5_counts(spark, d):
    return overlap.overlap_counts(_sources(spark, d))


def p5_classes(spark, d):
    return overlap.overlap_classes(_sources(spark, d))


def p5_coverage(spark, d):
    return overlap.evaluation_coverage(_sources(spark, d))


def p6_ids(spark, d):
    return encoding.encoded(_documents(spark, d))


def p7_containers(spark, d):
    return packing.packed(encoding.token_counts(_documents(spark, d)))


def p7_fill(spark, d):
    return packing.fill_report(packing.packed(encoding.token_counts(_documents(spark, d))))


def p8_found(spark, d):
    return canonical.lookalike_pairs(_documents(spark, d))


def p8_canonical(spark, d):
    return canonical.canonical_texts(_documents(spark, d))


def p8_classes(spark, d):
    return canonical.lookalike_classes(_documents(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_shares, p1_retention, p1_repeated, p2_found, p2_pieces, p3_found, p3_measures, p4_found, p4_sources, p4_prefixes, p5_found, p5_numbers, p5_counts, p5_classes, p5_coverage, p6_ids, p7_containers, p7_fill, p8_found, p8_canonical, p8_classes)}

_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: Of the other queries no SQL says the same: automata, alignments, tokenizers, canonical forms.
ORACLES: dict[str, str] = {
    "p1_found": r"""WITH t AS (SELECT 'rewrites' AS tbl, rewrite_id AS row_id, rewrite AS text FROM rewrites UNION ALL SELECT 'calls', call_id, response FROM calls),
        w AS (SELECT tbl, row_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM t), p AS (SELECT tbl, row_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2),
        g AS (SELECT tbl, row_id, i, row_number() OVER (PARTITION BY tbl, row_id, w[i], w[i + 1], w[i + 2] ORDER BY i) > 1 AS again FROM p),
        c AS (SELECT tbl, row_id, count(DISTINCT i + d) AS n FROM g, (SELECT unnest([0, 1, 2]) AS d) WHERE again GROUP BY tbl, row_id)
        SELECT c.tbl, c.row_id FROM c JOIN w USING (tbl, row_id) WHERE n >= 0.4 * len(w)""",
    "p1_repeated": r"""WITH t AS (SELECT 'rewrites' AS tbl, rewrite_id AS row_id, rewrite AS text FROM rewrites UNION ALL SELECT 'calls', call_id, response FROM calls),
        w AS (SELECT tbl, row_id, regexp_extract_all(replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), 'ς', 'σ'), '[\p{L}\p{N}]+') AS w FROM t), p AS (SELECT tbl, row_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2),
        g AS (SELECT tbl, row_id, i, row_number() OVER (PARTITION BY tbl, row_id, w[i], w[i + 1], w[i + 2] ORDER BY i) > 1 AS again FROM p),
        c AS (SELECT tbl, row_id, count(DISTINCT i + d) AS n FROM g, (SELECT unnest([0, 1, 2]) AS d) WHERE again GROUP BY tbl, row_id)
        SELECT w.tbl, w.row_id, len(w.w)::BIGINT AS n_words, CASE WHEN len(w.w) = 0 THEN 0.0 ELSE round(coalesce(n, 0) / len(w.w), 6) END::DOUBLE AS repeated_share FROM w LEFT JOIN c USING (tbl, row_id)""",
    "p2_found": f"SELECT DISTINCT creation_id, chunk_index FROM chunks WHERE len(list_filter(regexp_split_to_array(text, '[{_SPACE}]+'), lambda w: w <> '')) > 120",
    "p4_prefixes": """SELECT call_id, provider, model_id FROM calls a WHERE status = 'ok' AND response <> '' AND EXISTS (
        SELECT 1 FROM calls b WHERE b.status = 'ok' AND starts_with(b.response, a.response) AND length(b.response) > length(a.response))""",
    "p5_numbers": r"""WITH s AS (SELECT decl_order, gutenberg_ids, regexp_replace(lower(trim(regexp_replace(set_name, '\s+', ' ', 'g'))), '[\s_-]+', '_', 'g') AS s FROM text_sources),
        n AS (SELECT decl_order, s IN ('heldout', 'held_out', 'mixture_sources', 'mixturesources') AS is_e, s IN ('texts', 'text', 'noise_pool', 'noisepool') AS is_t, unnest(gutenberg_ids) AS g FROM s)
        SELECT DISTINCT least(a.decl_order, b.decl_order) AS decl_a, greatest(a.decl_order, b.decl_order) AS decl_b FROM n a JOIN n b ON a.g = b.g AND a.g > 0 AND a.is_e AND b.is_t""",
}
