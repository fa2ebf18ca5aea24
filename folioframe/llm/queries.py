"""The queries of this subpackage: opN_<name> over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import context_mixing, exact_dedup, media, mixing, pieces, quality, simhash, substrings, token_counts, toxicity
from .common import documents, labels


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct length in tokens as a context limit, with totals, quantile and truncated total."""
    return token_counts.suffix_sums(token_counts.histogram(documents(spark, sf_dir)))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text that they decode to, as digests."""
    return pieces.encode_decode(documents(spark, sf_dir))


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as Matroska audio, read back."""
    return media.media_digest(documents(spark, sf_dir))


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text under the context-mixing model, and its unigram base."""
    return context_mixing.score(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text, learnt from the labelled rows that are not held out."""
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text without the 100-byte strings that start earlier too."""
    return substrings.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and component of every document."""
    return simhash.near_duplicate_report(documents(spark, sf_dir))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that a 5:2:1 mix of the sources takes, none over three times."""
    return mixing.mix(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, learnt from the labelled rows that are not held out."""
    return quality.quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving row of every group of equal texts."""
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the mix that SQL can say: sizes of documents and sources, and the targets."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the media column that SQL can say: the payload as it is read back."""
    return media.media_digest(documents(spark, sf_dir)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_matroska": op3_matroska,
        "op4_context_mixing": op4_context_mixing,
        "op5_toxicity": op5_toxicity,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_simhash": op7_simhash,
        "op8_mix_sources": op8_mix_sources,
        "op9_quality_rules": op9_quality_rules,
        "op10_exact_dedup": op10_exact_dedup,
        "mix_targets": mix_targets,
        "media_payloads": media_payloads,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op10_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
                   sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
        "mix_targets": r"""
            WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
            s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
            p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pos, 3.0::DOUBLE * source_size AS cap FROM s),
            w AS (SELECT *, CASE pos % 3 WHEN 1 THEN 5.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM p),
            q AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_left, coalesce(sum(cap) OVER b, 0) AS used
                  FROM w WINDOW b AS (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            c AS (SELECT *, (total - used) / w_left AS level, (total - used) / w_left * w >= cap AS capped FROM q),
            f AS (SELECT *, (SELECT arg_min(level, cap / w) FROM c WHERE NOT capped) AS free FROM c)
            SELECT doc_id, size, source_size, CASE WHEN capped THEN cap ELSE free * w END AS target FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source""",
        "media_payloads": """
            WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
            n AS (SELECT doc_id, raw, CAST(octet_length(raw) AS BIGINT) AS n_bytes, CAST(greatest(64, (octet_length(raw) + 63) // 64 * 64) AS BIGINT) AS payload_bytes FROM b)
            SELECT doc_id, n_bytes, payload_bytes, sha256(raw || unhex(repeat('00', CAST(payload_bytes - n_bytes AS INTEGER)))) AS payload_sha256 FROM n""",
    }
