"""Exact duplicates: counting quotient filters, then byte verification.

A 64-bit fingerprint of every text goes into counting quotient filters, one per input chunk and
fingerprint range. Filters of a range merge losslessly, as their remainders are sorted. Fingerprints
that the merged filters count more than once go to all tasks as a bitmap of bounded size. A text that
the bitmap does not hold has no equal and goes out from the scan; the others are verified byte by
byte, grouped by their whole text with partial results before the shuffle. A full bitmap lets more
texts through to the verification, and loses none.

Defined results: a null text equals the empty text; of equal texts the largest id stays (a null id
is below all others); rows equal in id and text are told apart by nothing, so exactly one of them
is kept; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, keyed, stored

#: Fingerprints held by a worker before it emits its filters.
CHUNK = 1 << 18
#: Expected fingerprints of one range, so of one merge task.
PER_RANGE = 1 << 16
#: Bits of the bitmap that goes to all tasks, at most (16 MB), and of a part of it; equal rows written by one task.
FILTER_BITS, PART_BITS, SAME_ROWS = 1 << 27, 1 << 16, 1 << 18


class CountingQuotientFilter:
    """A packed counting quotient filter over `bits`-bit fingerprints.

    The upper q bits (quotient) choose a run, the lower bits (remainder) are stored, sorted, in the
    run. `occupied` has a bit for each quotient with a run, `run_ends` a bit for each slot that ends
    one. Slots hold distinct remainders; the counters of those met more than once follow in slot
    order, marked by `repeated`. The filter is static, so no slot is left empty and none shifts.
    """

    def __init__(self, bits: int, fingerprints: np.ndarray, counts: np.ndarray):
        """fingerprints: sorted and distinct, uint64 below 2**bits."""
        n = len(fingerprints)
        self.bits, self.n = bits, n
        self.q = max(1, min(bits - 1, int(n - 1).bit_length() if n > 1 else 1))
        self.r = bits - self.q
        quotients = (fingerprints >> np.uint64(self.r)).astype(np.int64)
        occupied = np.zeros(1 << self.q, bool)
        occupied[quotients] = True
        ends = np.ones(n, bool)
        ends[:-1] = quotients[1:] != quotients[:-1]
        self.occupied, self.run_ends = np.packbits(occupied), np.packbits(ends)
        rest = fingerprints & np.uint64((1 << self.r) - 1)
        width = (self.r + 7) // 8
        self.remainders = rest.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        self.repeated = np.packbits(counts > 1)
        self.counters = counts[counts > 1].astype(np.int64)

    @classmethod
    def of(cls, bits: int, fingerprints: np.ndarray) -> CountingQuotientFilter:
        return cls(bits, *np.unique(fingerprints, return_counts=True))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted fingerprints and their counts."""
        ends = np.unpackbits(self.run_ends, count=self.n).astype(bool)
        runs = np.flatnonzero(np.unpackbits(self.occupied, count=1 << self.q))
        run_of_slot = np.zeros(self.n, np.int64)
        if self.n:
            run_of_slot[1:] = np.cumsum(ends[:-1])
        width = (self.r + 7) // 8
        rest = np.zeros((self.n, 8), np.uint8)
        rest[:, :width] = np.frombuffer(self.remainders, np.uint8).reshape(self.n, width)
        quotients = runs[run_of_slot].astype(np.uint64) if self.n else np.zeros(0, np.uint64)
        counts = np.ones(self.n, np.int64)
        counts[np.unpackbits(self.repeated, count=self.n).astype(bool)] = self.counters
        return (quotients << np.uint64(self.r)) | rest.view(np.uint64).ravel(), counts

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """The filter of both multisets: a merge of two sorted sequences, counts added."""
        (a, m), (b, n) = self.items(), other.items()
        keys, counts = np.concatenate([a, b]), np.concatenate([m, n])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(first)
        return CountingQuotientFilter(self.bits, keys[at], np.add.reduceat(counts, at) if len(at) else counts)

    def to_bytes(self) -> bytes:
        head = np.array([self.bits, self.n, self.q, len(self.counters)], np.int64).tobytes()
        return b"".join((head, self.occupied.tobytes(), self.run_ends.tobytes(), self.remainders, self.repeated.tobytes(), self.counters.tobytes()))

    @classmethod
    def from_bytes(cls, blob: bytes) -> CountingQuotientFilter:
        self = cls.__new__(cls)
        self.bits, self.n, self.q, extra = (int(x) for x in np.frombuffer(blob, np.int64, 4))
        self.r = self.bits - self.q
        at = 32
        for name, size in (("occupied", ((1 << self.q) + 7) // 8), ("run_ends", (self.n + 7) // 8), ("remainders", self.n * ((self.r + 7) // 8)), ("repeated", (self.n + 7) // 8)):
            part = blob[at : at + size]
            setattr(self, name, part if name == "remainders" else np.frombuffer(part, np.uint8))
            at += size
        self.counters = np.frombuffer(blob[at : at + 8 * extra], np.int64)
        return self


def _build(range_bits: int):
    bits = 64 - range_bits

    def emit(values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        fps = np.sort(np.concatenate(values))
        ranges = (fps >> np.uint64(bits)).astype(np.int64) if range_bits else np.zeros(len(fps), np.int64)
        low = fps & np.uint64((1 << bits) - 1)
        starts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]])
        ends = np.r_[starts[1:], len(fps)]
        blobs = [CountingQuotientFilter.of(bits, low[a:b]).to_bytes() for a, b in zip(starts, ends, strict=True)]
        yield pa.record_batch([pa.array(ranges[starts], pa.int64()), pa.array(blobs, pa.binary())], ["bin", "cqf"])

    def build(it):
        held, n = [], 0
        for batch in it:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += batch.num_rows
            if n >= CHUNK:
                yield from emit(held)
                held, n = [], 0
        if n:
            yield from emit(held)

    return build


def _merge(range_bits: int):
    bits = 64 - range_bits

    def merge(table: pa.Table) -> pa.Table:
        filters = [CountingQuotientFilter.from_bytes(b.as_py()) for b in table.column("cqf")]
        while len(filters) > 1:
            filters = [a.merge(b) for a, b in zip(filters[::2], filters[1::2], strict=False)] + filters[len(filters) & ~1 :]
        low, counts = filters[0].items()
        base = np.uint64(table.column("bin")[0].as_py() << bits if range_bits else 0)
        full = (low[counts > 1] | base).view(np.int64)
        return pa.table({"fp": pa.array(full, pa.int64()), "n": pa.array(counts[counts > 1], pa.int64())})

    return merge


def repeated_fingerprints(fingerprints: DataFrame, n_rows: int) -> DataFrame:
    """(fp, n) of the fingerprints met more than once; fingerprints: one long column."""
    range_bits = max(3, min(40, (max(1, n_rows) // PER_RANGE).bit_length()))
    built = fingerprints.mapInArrow(_build(range_bits), "bin long, cqf binary")
    return built.groupBy("bin").applyInArrow(_merge(range_bits), "fp long, n long")


def _positions(fingerprints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    a = (fingerprints * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    b = (fingerprints * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
    return (a % np.uint64(bits)).astype(np.int64), (b % np.uint64(bits)).astype(np.int64)


def repeated_bitmap(repeated: DataFrame, n: int) -> np.ndarray:
    """A bitmap of bounded size that holds all of the n fingerprints (column fp), and by chance a few others."""
    bits = min(FILTER_BITS, max(PART_BITS, 1 << (12 * max(1, n)).bit_length()))

    def set_bits(it):
        held = np.zeros(bits, bool)
        for b in it:
            for at in _positions(b.column(0).to_numpy().view(np.uint64), bits):
                held[at] = True
        blobs = [(i // PART_BITS, np.packbits(held[i : i + PART_BITS]).tobytes()) for i in range(0, bits, PART_BITS) if held[i : i + PART_BITS].any()]
        if blobs:
            yield pa.record_batch([pa.array([i for i, _ in blobs], pa.int64()), pa.array([x for _, x in blobs], pa.binary())], ["part", "blob"])

    def merge(t: pa.Table) -> pa.Table:
        total = np.zeros(PART_BITS // 8, np.uint8)
        for blob in t.column("blob"):
            total |= np.frombuffer(blob.as_py(), np.uint8)
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int64()), "blob": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    rows = repeated.select("fp").coalesce(32).mapInArrow(set_bits, "part long, blob binary").groupBy("part").applyInArrow(merge, "part long, blob binary")
    for row in rows.toLocalIterator():
        out[row.part * PART_BITS // 8 : (row.part + 1) * PART_BITS // 8] = np.frombuffer(row.blob, np.uint8)
    return out


def holds(bitmap: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    """Whether the bitmap holds each fingerprint (uint64)."""
    out = np.ones(len(fingerprints), np.uint8)
    for at in _positions(fingerprints, 8 * len(bitmap)):
        out &= bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)
    return (out & 1).astype(bool)


def fingerprint(text) -> F.Column:
    return F.xxhash64(text)


def _perhaps_repeated(fingerprints: DataFrame, n_rows: int):
    """A function of a fingerprint column (one long column, as in `fingerprints`): false only if it is met once."""
    repeated = stored(repeated_fingerprints(fingerprints, n_rows))
    shared = fingerprints.sparkSession.sparkContext.broadcast(repeated_bitmap(repeated, repeated.count()))

    @F.pandas_udf("boolean")
    def perhaps(fp: pd.Series) -> pd.Series:  # only the fingerprints go to Python
        return pd.Series(holds(shared.value, fp.to_numpy(np.int64).view(np.uint64)))

    return perhaps


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Whole texts are shuffled only if their fingerprint may be repeated, and then once for each task
    and text. Rows find their group by fingerprint and digest; groups of any size stay spread.
    """
    rows = keyed(docs, id_col, text_col).withColumn("fp", fingerprint(F.col("text")))
    n_rows = docs.count()
    perhaps = _perhaps_repeated(rows.select("fp"), n_rows)
    digest = F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256")
    marked = rows.withColumn("rep", perhaps("fp"))
    singles = marked.filter(~F.col("rep")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest)
    again = marked.filter(F.col("rep"))
    # the text, not its digest, makes a group
    groups = again.groupBy("fp", "text").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    groups = stored(groups.select("fp", digest, "group_size", "keep_id"))
    copies = join_hot(again.select("doc_id", "fp", digest), groups, ["fp", "text_sha256"], F.col("group_size"), n_rows)
    is_last = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = ["doc_id", "keep_id", "group_size"]
    dropped = copies.filter(~is_last).select(*out, F.lit(False).alias("kept"), "text_sha256")
    # rows equal in id and text: one of them stays, the others are written again by their number
    last = copies.filter(is_last).groupBy("fp", "text_sha256", *out).agg(F.count(F.lit(1)).alias("m"))
    last = last.select(*out, "text_sha256", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(SAME_ROWS).cast("long"))).alias("i0"))
    many = last.filter(f"m > {SAME_ROWS}").repartition("text_sha256", "i0")
    spread = last.filter(f"m <= {SAME_ROWS}").unionByName(many)
    kept = spread.select(*out, "text_sha256", F.explode(F.sequence("i0", F.least(F.col("m"), F.col("i0") + SAME_ROWS) - 1)).alias("i"))
    return singles.unionByName(dropped).unionByName(kept.select(*out, (F.col("i") == 0).alias("kept"), "text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, all columns: of equal texts the row with the largest id.

    Among rows with that id the largest row, compared column by column, stays, so reruns agree.
    """
    names = docs.columns
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    packed = docs.select(F.struct(docs[id_col].alias("k"), F.struct(*[docs[c] for c in names]).alias("row")).alias("cand"), text.alias("__text"))
    packed = packed.withColumn("__fp", fingerprint(F.col("__text")))
    perhaps = _perhaps_repeated(packed.select("__fp"), docs.count())
    marked = packed.withColumn("__rep", perhaps("__fp"))
    singles = marked.filter(~F.col("__rep")).select("cand")
    kept = marked.filter(F.col("__rep")).groupBy("__fp", "__text").agg(F.max("cand").alias("cand")).select("cand")
    return singles.unionByName(kept).select("cand.row.*")
