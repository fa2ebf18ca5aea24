"""Token counts: an exact histogram of encoded lengths and suffix sums over it.

Every text is encoded whole; documents are aggregated by their length in tokens, so all later
answers come from a table with one row per distinct length. Sums over the lengths at or above one
(and below it) give totals, quantiles and truncated totals for every context limit.

Defined results: a null text has no tokens, as the empty text; the id is not needed; a long run
without blanks is encoded whole; an empty table gives an empty histogram; other columns are never read.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import batches_by_bytes, stored, tokenizer_path

#: Lengths in a block of the two-level running sums; bytes encoded at a time (one text at least).
BLOCK, PIECE = 128, 4 << 20


@cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """length long: tokens of each row's whole text."""
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")

    def run(it):
        encode = _encoding(path).encode_ordinary
        for b in batches_by_bytes(it, 0, PIECE):
            yield pa.record_batch([pa.array([len(encode(t)) for t in b.column(0).to_pylist()], pa.int64())], ["length"])

    return docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("t")).mapInArrow(run, "length long")


def histogram(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """length, n_docs: one row per distinct length; summed per batch before the shuffle."""
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")

    def run(it):
        encode = _encoding(path).encode_ordinary
        for b in batches_by_bytes(it, 0, PIECE):
            lengths, counts = np.unique(np.array([len(encode(t)) for t in b.column(0).to_pylist()], np.int64), return_counts=True)
            yield pa.record_batch([pa.array(lengths), pa.array(counts.astype(np.int64))], ["length", "n"])

    texts = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("t"))
    return texts.mapInArrow(run, "length long, n long").groupBy("length").agg(F.sum("n").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each distinct length taken as a context limit:

    n_docs of that length; docs_ge, tokens_ge at or above it; docs_le, fraction_le at or below it
    (the quantile); truncated_tokens, the sum of min(length, limit); total_docs, total_tokens.
    Sums run inside blocks of lengths and over the few blocks' totals. The histogram is read twice, so
    it is stored first and every text is encoded once.
    """
    h = stored(hist).withColumn("blk", F.expr(f"length div {BLOCK}")).withColumn("tok", F.col("length") * F.col("n_docs"))
    blocks = h.groupBy("blk").agg(F.sum("n_docs").alias("bd"), F.sum("tok").alias("bt"))
    after = W.orderBy(F.col("blk").desc()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = blocks.select(
        F.col("blk").alias("b"), F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("ad"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("at"),
        F.sum("bd").over(whole).alias("total_docs"), F.sum("bt").over(whole).alias("total_tokens"),
    )
    inside = W.partitionBy("blk").orderBy(F.col("length").desc()).rowsBetween(W.unboundedPreceding, 0)
    s = h.withColumns({"sd": F.sum("n_docs").over(inside), "st": F.sum("tok").over(inside)}).join(blocks, F.col("blk") == F.col("b"))
    s = s.withColumns({"docs_ge": F.col("ad") + F.col("sd"), "tokens_ge": F.col("at") + F.col("st")})
    docs_le = F.col("total_docs") - F.col("docs_ge") + F.col("n_docs")
    return s.select(
        "length", "n_docs", "docs_ge", "tokens_ge", docs_le.alias("docs_le"), (docs_le / F.col("total_docs")).alias("fraction_le"),
        (F.col("total_tokens") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("truncated_tokens"), "total_docs", "total_tokens",
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_over, truncated_tokens, lost_tokens for any context limits, from the suffix sums."""
    stats = []
    for limit in limits:
        up = F.col("length") >= limit
        nearest = F.min_by(F.struct("docs_ge", "tokens_ge", "total_tokens"), F.when(up, F.col("length")))
        stats.append(F.struct(F.lit(limit).cast("long").alias("limit"), nearest.alias("s"), F.max("total_tokens").alias("total"), F.max("n_docs").alias("any")))
    rows = sums.agg(F.array(*stats).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    ge, tok, total = F.coalesce("s.docs_ge", F.lit(0)), F.coalesce("s.tokens_ge", F.lit(0)), F.coalesce("total", F.lit(0))
    return rows.select("limit", ge.alias("docs_ge"), (total - tok + F.col("limit") * ge).alias("truncated_tokens"), (tok - F.col("limit") * ge).alias("lost_tokens"))


def quantiles(sums: DataFrame, qs: list[float]) -> DataFrame:
    """q, length: the smallest length with at least a fraction q of documents at or below it."""
    picks = [F.struct(F.lit(float(q)).alias("q"), F.min(F.when(F.col("fraction_le") >= q, F.col("length"))).alias("length")) for q in qs]
    return sums.agg(F.array(*picks).alias("a")).select(F.explode("a").alias("x")).select("x.*")
