"""Mixing sources to target weights, with DataFrame functions only.

Words of a source form one stream (documents in pseudorandom order); the stream is packed into blocks
of BLOCK words. Every output slot takes one block. Each slot of an output shard draws a source by the
targets, so the counts of sources in a shard are multinomial; the totals are then corrected to the
targets by handing evenly spaced slots of the sources drawn too often to those drawn too seldom. A
source's k-th slot takes block pi(k mod n) of its n blocks, pi being a permutation of the source and
epoch; slots and blocks join on (source, block). The permutations are swap-or-not shuffles (Hoang,
Morris, Rogaway 2012): any domain size, a few hashes a slot, no sort and no state.

Defined results: a null text has size 0; a document without words takes nothing; a null source is
a source of its own, after all others; rows equal in all columns are interchangeable; an empty
table gives an empty table; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, durable, relieve_driver, stored

#: Words of a block.
BLOCK = 32
#: Slots of an output shard.
SHARD = 1024
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MAX_EPOCHS = 3
#: Rounds of the permutations.
ROUNDS = 12
#: Documents of a chunk, about; documents taken in part of a chunk; slots of a chunk; steps of a running sum that one task takes; sources that may be broadcast.
CHUNK_DOCS, CHUNK_PARTS, CHUNK_SLOTS, RUN, FEW_SOURCES = 512, 64, 1 << 16, 4096, 100_000


def _permuted(df: DataFrame, out: str, x: Column, n: Column, key: Column, seed: int, inverse: bool = False) -> DataFrame:
    """Add `out`: a pseudorandom permutation of 0..n-1, named by key and seed, applied to x.

    Each round swaps x with its partner (shift - x) mod n or leaves both, as a hash of the larger
    one says; a round is its own inverse, so the rounds backwards undo the permutation.
    """
    df = df.withColumns({"__x": x, "__n": n, "__key": F.xxhash64(F.lit(seed), key)})
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    keys = F.array(*[F.struct(F.pmod(F.xxhash64(F.lit(r), F.col("__key")), F.col("__n")).alias("shift"), F.lit(r).alias("r")) for r in order])

    def swap(value: Column, rnd: Column) -> Column:
        partner = F.pmod(rnd["shift"] - value, F.col("__n"))
        return F.when(F.xxhash64(F.col("__key"), rnd["r"], F.greatest(value, partner)) % 2 == 0, value).otherwise(partner)

    return df.withColumn(out, F.aggregate(keys, F.col("__x"), swap)).drop("__x", "__n", "__key")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> also target: weights by code point, capped, the excess shared again.

    A source is at its cap when the water level t = rest / weights is at least cap / weight. Sorted
    by cap / weight, the capped sources are a prefix, so one running sum finds them; no iteration.
    """
    by_code = W.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8"))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("pos", F.row_number().over(by_code) - 1)
    s = s.withColumn("weight", F.element_at(kinds, (F.col("pos") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = W.orderBy(F.col("cap") / F.col("weight"), "pos")
    everything = W.partitionBy(F.lit(1))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({
        "total": F.sum("source_size").over(everything).cast("double"),
        "w_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "used": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
    })
    # the level if all before this one are capped and this one and all after are not
    s = s.withColumn("level", (F.col("total") - F.col("used")) / F.col("w_left"))
    s = s.withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    s = s.withColumn("free_level", F.min_by("level", F.when(~F.col("capped"), F.col("cap") / F.col("weight"))).over(everything))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("free_level") * F.col("weight"))
    return s.select("source", "source_size", "pos", target.alias("target"))


def _before(df: DataFrame, key: str, step: str, value: str, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over the earlier steps (0, 1, ...) of the key; in runs of steps, so no task holds all of a key."""
    runs = df.withColumn("__run", F.expr(f"{step} div {RUN}"))
    totals = runs.groupBy(F.col(key).alias("__k"), F.col("__run").alias("__r")).agg(F.sum(value).alias("__t"))
    over_runs = W.partitionBy("__k").orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("__k", "__r", F.coalesce(F.sum("__t").over(over_runs), F.lit(0)).alias("__b"))
    inside = W.partitionBy(key, "__run").orderBy(step).rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("__i", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = runs.join(totals, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__run") == F.col("__r")))
    return joined.withColumn(out, (F.col("__b") + F.col("__i")).cast("long")).drop("__run", "__k", "__r", "__b", "__i")


def _documents_in_streams(docs: DataFrame, id_col: str, text_col: str, source_col: str, block: int) -> tuple[DataFrame, DataFrame]:
    """(documents with their place in the source's stream, sources with quota and block counts)."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    d = durable(docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("th"),
    ))
    n_chunks = d.count() // CHUNK_DOCS + 1
    d = d.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "th"), F.lit(n_chunks)))
    sources = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = sources.withColumns({
        "quota": F.round("target").cast("long"),
        "n": F.ceil(F.col("source_size") / block).cast("long"),
    }).withColumn("missing", F.col("n") * block - F.col("source_size"))
    # where the short last block stands in each epoch; slots until the quota is met
    at = []
    for e in range(MAX_EPOCHS):
        sources = _permuted(sources, f"at{e}", F.col("n") - 1, F.greatest("n", F.lit(1)), F.struct("pos", F.lit(e)), 1, inverse=True)
        at.append(F.col(f"at{e}") + F.col("n") * e)
    sources = sources.withColumn("slots", F.ceil(F.col("quota") / block).cast("long"))
    short = lambda: sum((F.when(x < F.col("slots"), 1).otherwise(0) for x in at), F.lit(0)) * F.col("missing")
    for _ in range(MAX_EPOCHS):
        sources = sources.withColumn("slots", F.ceil((F.col("quota") + short()) / block).cast("long"))
    sources = sources.withColumn("surplus", F.col("slots") * block - short() - F.col("quota"))
    before = W.orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    sources = sources.withColumn("first_slot", F.coalesce(F.sum("slots").over(before), F.lit(0)).cast("long"))
    sources = sources.withColumn("all_slots", F.sum("slots").over(W.partitionBy(F.lit(1))))
    sources = durable(sources.select("source", "source_size", "pos", "target", "quota", "n", "missing", "slots", "surplus", "first_slot", "all_slots"))
    offsets = _before(d.groupBy("source", "chunk").agg(F.sum("size").alias("t")), "source", "chunk", "t", "offset")
    offsets = offsets.select(F.col("source").alias("o_source"), F.col("chunk").alias("o_chunk"), "offset")
    inside = W.partitionBy("source", "chunk").orderBy(F.xxhash64("th", "doc_id"), "doc_id", "th", "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("chunk") == F.col("o_chunk")))
    d = d.withColumn("start", F.col("offset") + F.col("inside")).drop("chunk", "o_chunk", "o_source", "offset", "inside")
    s = sources.select(F.col("source").alias("s_source"), "pos", "source_size", "target")
    # rows here are narrow and blow up into blocks, so their number of partitions follows the blocks
    n_parts = _partitions(sources, "n", 4 * CHUNK_SLOTS)
    return durable(d.join(s, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source").repartition(n_parts, "pos", "start")), sources


def _partitions(sources: DataFrame, count: str, per_task: int) -> int:
    """Tasks for all sources' blocks or slots; an explicit number is not merged back by size."""
    total = sources.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    return max(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // per_task + 1)


def _owner(df: DataFrame, at: str, ranges: DataFrame, total: int, n_ranges: int) -> DataFrame:
    """Add pos and start of the range (pos, start, length; side by side from 0 to total) that the long `at` falls into.

    Ranges are dealt to as many buckets as there are ranges, so a row meets few of them.
    """
    width = max(1, total // max(1, n_ranges))
    r = ranges.filter("length > 0").select(F.col("pos"), F.col("start"), F.col("length"))
    r = r.withColumn("__bucket", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(start + length - 1) div {width}"))))
    r = F.broadcast(r) if n_ranges <= FEW_SOURCES else r
    met = df.withColumn("__b", F.expr(f"{at} div {width}")).join(r, F.col("__b") == F.col("__bucket"))
    return met.filter((F.col(at) >= F.col("start")) & (F.col(at) < F.col("start") + F.col("length"))).drop("__b", "__bucket", "length")


def shard_counts(sources: DataFrame, shard: int = SHARD) -> DataFrame:
    """The draw: out_shard, pos (of the source), drawn (its slots in the shard)."""
    total, n = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count(F.lit(1))).first()
    every = sources.sparkSession.range(0, total, 1, _partitions(sources, "slots", 4 * CHUNK_SLOTS))
    drawn = every.select(F.expr(f"id div {shard}").alias("out_shard"), F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(total)).alias("u"))
    drawn = _owner(drawn, "u", sources.select("pos", F.col("first_slot").alias("start"), F.col("slots").alias("length")), total, n)
    return drawn.groupBy("out_shard", "pos").agg(F.count(F.lit(1)).alias("drawn"))


def slots(sources: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mixture's plan: out_shard, slot, pos (of the source), epoch, block, take (its first words), is_last."""
    counts = durable(shard_counts(sources, shard))
    n_sources = sources.count()
    # of the slots drawn too often for a source, evenly spaced ones go to the sources that lack some
    totals = sources.join(counts.groupBy(F.col("pos").alias("t_pos")).agg(F.sum("drawn").alias("d")), F.col("pos") == F.col("t_pos"), "left").drop("t_pos").withColumn("d", F.coalesce("d", F.lit(0)))
    totals = totals.withColumns({"extra": F.greatest(F.col("d") - F.col("slots"), F.lit(0)), "lack": F.greatest(F.col("slots") - F.col("d"), F.lit(0))})
    before = W.orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumns({c: F.coalesce(F.sum(v).over(before), F.lit(0)) for c, v in (("extra_before", "extra"), ("lack_before", "lack"))})
    totals = durable(totals.select("pos", "d", "extra", "lack", "extra_before", "lack_before", "n", "missing", "slots", "surplus", "all_slots"))
    few = (lambda df: F.broadcast(df)) if n_sources <= FEW_SOURCES else (lambda df: df)
    c = _before(counts, "pos", "out_shard", "drawn", "offset")
    in_shard = W.partitionBy("out_shard").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumn("place", F.coalesce(F.sum("drawn").over(in_shard), F.lit(0)))
    c = c.repartition(_partitions(sources, "slots", 4 * CHUNK_SLOTS), "out_shard")
    c = c.join(few(totals.select(F.col("pos").alias("c_pos"), "d", "extra", "extra_before", "all_slots")), F.col("pos") == F.col("c_pos")).drop("c_pos")
    k = c.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("drawn") - 1)))
    k = k.withColumn("i", F.col("offset") + F.col("r")).withColumn("gone", F.expr("i * extra div d")).withColumn("goes", F.expr("(i + 1) * extra div d > gone"))
    shard_size = F.least(F.lit(shard), F.col("all_slots") - F.col("out_shard") * shard)
    k = k.withColumn("slot", F.pmod((F.col("place") + F.col("r")) * 1000003 + F.pmod(F.xxhash64("out_shard"), F.lit(1 << 20)), shard_size))
    stays = k.filter(~F.col("goes")).select("out_shard", "slot", "pos", (F.col("i") - F.col("gone")).alias("k"))
    moved = k.filter("goes").select("out_shard", "slot", (F.col("extra_before") + F.col("gone")).alias("u"))
    n_moved = totals.agg(F.coalesce(F.sum("lack"), F.lit(0))).first()[0]
    moved = _owner(moved, "u", totals.select("pos", F.col("lack_before").alias("start"), F.col("lack").alias("length")), n_moved, n_sources)
    moved = moved.join(few(totals.select(F.col("pos").alias("m_pos"), "d")), F.col("pos") == F.col("m_pos"))
    moved = moved.select("out_shard", "slot", "pos", (F.col("d") + F.col("u") - F.col("start")).alias("k"))
    k = stays.unionByName(moved).join(few(totals.select(F.col("pos").alias("s_pos"), "n", "missing", "slots", "surplus")), F.col("pos") == F.col("s_pos")).drop("s_pos")
    k = k.withColumn("epoch", F.expr("k div n"))
    k = _permuted(k, "block", F.col("k") % F.col("n"), F.col("n"), F.struct("pos", F.col("epoch").cast("int")), 1)
    last = F.col("k") == F.col("slots") - 1
    length = F.lit(block) - F.when(F.col("block") == F.col("n") - 1, F.col("missing")).otherwise(0)
    take = length - F.when(last, F.col("surplus")).otherwise(0)
    return k.select("out_shard", "slot", "pos", "epoch", "block", take.cast("long").alias("take"), last.alias("is_last"))


def _uses(sources: DataFrame, block: int, shard: int, hold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """How often each (source, block) is taken whole, and the words its cut use takes; hold gets the slots."""
    return hold(slots(sources, block, shard).select("out_shard", "pos", "block", "take", "is_last")).groupBy(F.col("pos").alias("u_pos"), F.col("block").alias("u_block")).agg(
        F.sum(F.when(F.col("is_last"), 0).otherwise(1)).alias("whole"),
        F.max(F.when(F.col("is_last"), F.col("take")).otherwise(0)).alias("cut"),
        F.min("out_shard").alias("first_shard"),
    )


def _blocks(d: DataFrame, block: int) -> DataFrame:
    """One row for each block that a document with words reaches into, with the overlap in it."""
    d = d.filter("size > 0").withColumn("b0", F.expr(f"start div {block}")).withColumn("b1", F.expr(f"(start + size - 1) div {block}"))
    d = d.withColumn("g", F.explode(F.sequence(F.expr(f"b0 div {CHUNK_SLOTS}"), F.expr(f"b1 div {CHUNK_SLOTS}"))))
    d = d.withColumn("block", F.explode(F.sequence(F.greatest("b0", F.col("g") * CHUNK_SLOTS), F.least("b1", (F.col("g") + 1) * CHUNK_SLOTS - 1))))
    lo = F.greatest(F.col("start"), F.col("block") * block) - F.col("block") * block
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("block") * block
    return d.select("pos", "start", "block", lo.alias("lo"), hi.alias("hi"))


def _held(df: DataFrame) -> DataFrame:
    """The rows stored, so that what follows is planned without what led to them, and the driver has its memory back."""
    out = stored(df)
    relieve_driver(df.sparkSession)
    return out


def _taken(docs: DataFrame, id_col: str, text_col: str, source_col: str, block: int, shard: int, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The documents in their streams, with taken (the words that the plan takes of each) and first_shard."""
    d, sources = _documents_in_streams(docs, id_col, text_col, source_col, block)
    uses = _uses(sources, block, shard, hold)
    hit = _blocks(d, block).join(uses, (F.col("pos") == F.col("u_pos")) & (F.col("block") == F.col("u_block")))
    words = (F.col("hi") - F.col("lo")) * F.col("whole") + F.greatest(F.lit(0), F.least("hi", "cut") - F.col("lo"))
    taken = hit.groupBy(F.col("pos").alias("t_pos"), F.col("start").alias("t_start")).agg(F.sum(words).alias("t"), F.min("first_shard").alias("fs"))
    # a document without words shares its start with its successor, so it is told apart by its size
    out = d.join(taken, (F.col("pos") == F.col("t_pos")) & (F.col("start") == F.col("t_start")) & (F.col("size") > 0), "left")
    return out.select(*d.columns, F.coalesce("t", F.lit(0)).cast("long").alias("taken"), F.col("fs").alias("first_shard"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_shard (null if not taken)."""
    out = _taken(docs, id_col, text_col, source_col, block, shard)
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def _whole(d: DataFrame) -> DataFrame:
    """Documents with words, with copies: what the plan took of them, rounded to whole documents.

    A document is copied as often as the plan took it whole. What is left over of a source's taken
    words goes to documents that were taken in part, in the order of a Pareto sample, which chooses
    each about as likely as the part says, up to the document that comes nearest.
    """
    d = d.filter("size > 0").withColumn("over", F.col("taken") % F.col("size"))
    part = F.col("over") / F.col("size")
    u = (F.pmod(F.xxhash64(F.lit(4), "pos", "start"), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    # odds of the number drawn against odds of the part, as a share
    d = durable(d.withColumn("rank", u * (1 - part) / (u * (1 - part) + part * (1 - u))))
    n_chunks = d.filter("over > 0").count() // CHUNK_PARTS + 1
    some = d.filter("over > 0").withColumn("chunk", F.floor(F.col("rank") * n_chunks).cast("long"))
    offsets = _before(some.groupBy("pos", "chunk").agg(F.sum("size").alias("t")), "pos", "chunk", "t", "offset")
    offsets = offsets.select(F.col("pos").alias("o_pos"), F.col("chunk").alias("o_chunk"), "offset")
    inside = W.partitionBy("pos", "chunk").orderBy("rank", "start").rowsBetween(W.unboundedPreceding, -1)
    some = some.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    some = some.join(offsets, (F.col("pos") == F.col("o_pos")) & (F.col("chunk") == F.col("o_chunk")))
    over = d.groupBy(F.col("pos").alias("s_pos")).agg(F.sum("over").alias("left_over"))
    some = some.join(over, F.col("pos") == F.col("s_pos"))
    more = (F.col("offset") + F.col("before") + F.col("size") / 2 <= F.col("left_over")).cast("int")
    some = some.select(*d.columns, more.alias("more"))
    d = d.filter("over = 0").withColumn("more", F.lit(0)).unionByName(some)
    return d.withColumn("copies", (F.expr("taken div size") + F.col("more")).cast("int")).drop("over", "rank", "more")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The rows of `docs`, all columns, as often as the mix takes them: 0 to MAX_EPOCHS times.

    The plan of `mix` says how many words of each document are taken; these are rounded to whole
    documents, so that a source misses its target by half of one document at most. Rows without
    words are not taken.
    """
    d = _whole(_taken(docs, id_col, text_col, source_col, block, shard, _held)).filter("copies > 0")
    copies = d.select(F.xxhash64("doc_id", "th", "source").alias("__key"), F.col("copies").alias("__n"))
    # rows equal in id, text and source take these counts in turn
    copies = _held(copies.groupBy("__key").agg(F.sort_array(F.collect_list("__n"), asc=False).alias("__ns")))
    names = docs.columns
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("__row"), F.xxhash64(docs[id_col].cast("long"), F.xxhash64(text), docs[source_col].cast("string")).alias("__key"))
    joined = packed.join(copies, "__key")
    joined = joined.withColumn("__i", F.row_number().over(W.partitionBy("__key").orderBy("__row")))
    joined = joined.withColumn("__n", F.coalesce(F.get("__ns", F.col("__i") - 1), F.lit(0)))
    return joined.select("__row", F.explode(F.expr("array_repeat(0, __n)")).alias("__c")).select("__row.*")
