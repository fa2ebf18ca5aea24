"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed character n-grams inside a document's distinct words, word ends
marked. The model is fitted on a bounded sample of the labelled training rows: the COUNTED ids with
the smallest hash enter the log-count ratios; the most telling features, each scaled by its ratio,
then get logistic weights, fitted with an L2 penalty on SAMPLE rows of them. Ids are chosen from the
labels alone, so no text is shuffled to find its label. Characters fold to 12 bits inside an n-gram,
so rare scripts may share features; FEATURES bounds what the model keeps.

Defined results: a null text is the empty text, whose score is the sigmoid of the intercept; null
labels and labels of unknown documents are skipped; several labels of an id count each; without
labelled rows of both classes all scores are the base rate (0 without any); a text of any length is
read whole, in pieces; an empty table gives an empty table; only id, text and label are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, fold, give_back, keyed, stored

#: Hash slots, n-gram lengths, features kept, labelled ids of the counts, labelled rows of the logistic fit.
SLOT_BITS, LENGTHS, FEATURES, COUNTED, SAMPLE = 19, (3, 4, 5), 1 << 12, 40_000, 10_000
#: Characters of a piece of a text, bytes of texts read at a time; labelled ids of a task.
PIECE, READ, IDS_A_TASK = 1 << 18, 1 << 18, 1250
#: Slots of a range in the merge of counts; rows a telling feature needs; penalty; threshold.
RANGE, SUPPORT, L2, THRESHOLD = 1 << 14, 5, 1.0, 0.3


def ngram_slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, slot) of all n-grams of the texts' distinct words; repeats possible."""
    reach = max(LENGTHS) - 1  # what an n-gram needs of the next piece
    groups, size = [[]], 0
    for i, t in enumerate(texts):
        marked = " " + " ".join(sorted(set(t.lower().split()))) + " "
        for k in range(0, max(1, len(marked) - 2), PIECE):
            if size > PIECE:
                groups.append([])
                size = 0
            groups[-1].append((i, marked[k : k + PIECE + reach]))
            size += len(groups[-1][-1][1])
    if len(groups) == 1:
        return _piece_slots(groups[0])
    found = [_distinct(*_piece_slots(g)) for g in groups]
    return np.concatenate([d for d, _ in found]), np.concatenate([x for _, x in found])


def _piece_slots(pieces: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    parts = [p for _, p in pieces]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.array([len(p) for p in parts])
    n = int(lengths.sum())
    data = np.zeros(n + max(LENGTHS), np.uint64)
    data[:n] = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)
    space = data == 32
    data &= np.uint64((1 << 12) - 1)  # five characters fit a word; rare scripts fold together
    doc = np.repeat(np.array([i for i, _ in pieces]), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    out_doc, out_slot = [], []
    at = np.arange(n)
    key = data[:n].copy()
    inner = np.zeros(n, bool)  # a space inside the n-gram, not at its ends
    for k in range(2, max(LENGTHS) + 1):
        key |= data[k - 1 : n + k - 1] << np.uint64(12 * (k - 1))
        if k > 2:
            inner |= space[k - 2 : n + k - 2]
        if k in LENGTHS:
            ok = ~inner & (at + k <= ends)
            h = (key[ok] ^ np.uint64(k << 60)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out_slot.append((h >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
            out_doc.append(doc[ok])
    return np.concatenate(out_doc), np.concatenate(out_slot)


def _distinct(doc: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc << SLOT_BITS | slot)
    return both >> SLOT_BITS, both & ((1 << SLOT_BITS) - 1)


def class_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Rows of label 1 and of label 0 that hold each slot, and the rows of each label.

    labelled: text, label, n (how often the row counts). Counted per partition, merged by range of
    slots; what reaches the driver is two fixed-size arrays.
    """
    slots = 1 << SLOT_BITS

    def count(it):
        give_back()
        held = np.zeros((2, slots), np.int64)
        rows = np.zeros(2, np.int64)
        for b in batches_by_bytes(it, "text", READ):
            label, n = (b.column(c).to_numpy() for c in ("label", "n"))
            rows += np.bincount(label, weights=n, minlength=2).astype(np.int64)
            doc, slot = _distinct(*ngram_slots(b.column("text").to_pylist()))
            for y in (0, 1):
                mine = label[doc] == y
                held[y] += np.bincount(slot[mine], weights=n[doc[mine]], minlength=slots).astype(np.int64)
        if rows.sum():
            blobs = [held[:, i : i + RANGE].tobytes() for i in range(0, slots, RANGE)]
            tail = [0] * (len(blobs) - 1)
            yield pa.record_batch([pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary()), pa.array([rows[0], *tail], pa.int64()), pa.array([rows[1], *tail], pa.int64())], ["rng", "blob", "n0", "n1"])

    def merge(t: pa.Table) -> pa.Table:
        total = np.zeros(2 * RANGE, np.int64)
        for blob in t.column("blob"):
            total += np.frombuffer(blob.as_py(), np.int64)
        n0, n1 = (int(np.sum(t.column(c).to_numpy())) for c in ("n0", "n1"))
        return pa.table({"rng": [t.column("rng")[0].as_py()], "blob": [total.tobytes()], "n0": [n0], "n1": [n1]}, pa.schema([("rng", pa.int32()), ("blob", pa.binary()), ("n0", pa.int64()), ("n1", pa.int64())]))

    schema = "rng int, blob binary, n0 long, n1 long"
    rows = labelled.select("text", F.col("label").cast("int").alias("label"), _times(labelled))
    counts, n0, n1 = np.zeros((2, slots), np.int64), 0, 0
    for row in rows.mapInArrow(count, schema).groupBy("rng").applyInArrow(merge, schema).collect():
        counts[:, row.rng * RANGE : (row.rng + 1) * RANGE] = np.frombuffer(row.blob, np.int64).reshape(2, RANGE)
        n0, n1 = n0 + row.n0, n1 + row.n1
    return counts[1], counts[0], n1, n0


def _times(labelled: DataFrame) -> Column:
    return (F.col("n") if "n" in labelled.columns else F.lit(1)).cast("long").alias("n")


def logistic(doc: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, times: np.ndarray, n_cols: int, l2: float = L2, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2-penalised logistic fit by accelerated gradient steps; row i counts times[i]."""
    n = len(y)
    u = np.ones(n_cols) / np.sqrt(max(1, n_cols))
    top, extra = 1.0, 1.0  # largest eigenvalue of the Gram matrix with the intercept's column
    for _ in range(30):
        z = times * (np.bincount(doc, weights=u[col] * value, minlength=n) + extra)
        u, extra = np.bincount(col, weights=z[doc] * value, minlength=n_cols), z.sum()
        top = float(np.sqrt((u * u).sum() + extra * extra))
        u, extra = u / top, extra / top
    rate = 1.0 / (0.26 * top + l2)
    w, b = np.zeros(n_cols), 0.0
    vw, vb = w.copy(), b
    for k in range(1, steps + 1):
        z = np.bincount(doc, weights=vw[col] * value, minlength=n) + vb
        err = times * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(col, weights=err[doc] * value, minlength=n_cols) + l2 * vw
        w2, b2 = vw - rate * g, vb - rate * err.sum()
        vw, vb = w2 + (k - 1) / (k + 2) * (w2 - w), b2 + (k - 1) / (k + 2) * (b2 - b)
        w, b = w2, b2
    return w, float(b)


class ToxicityModel:
    """Weight per slot, and the intercept."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def scores(self, texts: list[str]) -> np.ndarray:
        doc, slot = ngram_slots(texts)
        hit = self.weights[slot] != 0
        doc, slot = _distinct(doc[hit], slot[hit])
        z = np.bincount(doc, weights=self.weights[slot], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(labelled: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """labelled: doc_id, text, label (0 or 1) and, if rows count several times, n. Without both classes the score is the base rate."""
    ones, zeros, n1, n0 = class_counts(labelled)
    if not n0 or not n1:
        return ToxicityModel(np.zeros(1 << SLOT_BITS), 30.0 if n1 else -30.0)
    ratio = np.log((ones + 0.5) / (n1 + 1.0)) - np.log((zeros + 0.5) / (n0 + 1.0))
    telling = np.abs(ratio) * np.sqrt(ones + zeros) * (ones + zeros >= SUPPORT)
    best = np.argsort(-telling, kind="stable")[:FEATURES]
    best = np.sort(best[telling[best] > 0])
    column = np.full(1 << SLOT_BITS, -1, np.int32)
    column[best] = np.arange(len(best))

    def features(it):
        give_back()
        for b in batches_by_bytes(it, "text", READ):
            doc, slot = ngram_slots(b.column("text").to_pylist())
            hit = column[slot] >= 0
            doc, slot = _distinct(doc[hit], slot[hit])
            cuts = np.searchsorted(doc, np.arange(b.num_rows + 1))
            cols = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(column[slot], pa.int32()))
            yield pa.record_batch([b.column("k"), b.column("label"), b.column("n"), cols], ["k", "label", "n", "cols"])

    # the rows with the smallest hashes, in a fixed order
    rows = labelled.select(F.xxhash64("doc_id", "text").alias("k"), "text", F.col("label").cast("int").alias("label"), _times(labelled))
    rows = rows.mapInArrow(features, "k long, label int, n long, cols array<int>").orderBy("k", "label", "n").limit(sample).toArrow()
    y, times = rows.column("label").to_numpy().astype(float), rows.column("n").to_numpy().astype(float)
    lists = rows.column("cols").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(np.asarray(lists.offsets))
    doc, col = np.repeat(np.arange(len(y)), sizes), np.asarray(lists.flatten()).astype(np.int64)
    r = ratio[best]
    w, b = logistic(doc, col, r[col], y, times, len(best))
    weights = np.zeros(1 << SLOT_BITS)
    weights[best] = w * r
    return ToxicityModel(weights, b)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row; the model has a fixed size and goes with the tasks."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)

    def run(it):
        give_back()
        for b in batches_by_bytes(it, "text", READ):
            yield pa.record_batch([b.column("doc_id"), pa.array(shared.value.scores(b.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, training: Column, ids: int = COUNTED) -> DataFrame:
    """doc_id, text, label, n: texts of the `ids` labelled ids with the smallest hash that `training` (over doc_id) admits.

    n says how often an id has the label. Ids and their labels, at most 2 * ids rows, are taken from
    the narrow labels and broadcast; texts of other documents are dropped in the scan.
    """
    own = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    own = own.filter(training)
    chosen = own.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(ids)
    tally = own.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return keyed(docs).join(F.broadcast(tally), "doc_id").select("doc_id", "text", "label", "n")


def learn(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model of a bounded sample of the labelled rows whose fold is not 2 of 4."""
    rows = labelled_rows(docs, labels, "toxic", fold(F.col("doc_id"), 4) != 2)
    return train(stored(rows.repartition(-(-COUNTED // IDS_A_TASK))))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from the rows whose fold is not 2 of 4."""
    model = learn(docs, labels)
    scored = score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    n = len(docs.columns)

    def run(it):
        give_back()
        for b in batches_by_bytes(it, n, READ):
            keep = shared.value.scores(b.column(n).to_pylist()) < THRESHOLD
            yield pa.record_batch(b.columns[:n], names=b.schema.names[:n]).filter(pa.array(keep))

    texts = F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("__toxicity_text")
    return docs.select(*[docs[c] for c in docs.columns], texts).mapInArrow(run, docs.schema)
