"""Quality: a sparse ensemble of rules over text statistics, scored by Spark expressions.

Statistics of a text are Spark columns. Small boosted trees over them, fitted on a bounded sample
of labelled rows (SAMPLE, the rows with the smallest hash of their id), give one conjunctive rule
per tree node; lasso logistic regression keeps few of them; the kept rules become one Spark column.

Defined results: a null text is the empty text, with all counts 0; null labels and labels of
unknown documents are skipped; without labelled rows of both classes the score is 1 or 0 for the
class there is (0 without any); several labels of an id count each; an empty table gives an empty table; only id, text and label are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fold, keyed
from .toxicity import labelled_rows

#: Labelled rows of the fit, trees, their depth, candidate thresholds per statistic.
SAMPLE, TREES, DEPTH, BINS, LEAF = 20_000, 24, 3, 48, 20
#: Shrinkage of the trees, lasso penalty per row, threshold of the prediction.
SHRINK, LASSO, THRESHOLD = 0.3, 2e-4, 0.3

#: A rule: (statistic, whether above, threshold) of each condition.
Rule = tuple[tuple[str, bool, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Statistic columns of a text; shares are 0 for the empty text."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    chars, words = F.length(text).cast("double"), count(WORD)
    share = lambda x, of: F.when(of > 0, x / of).otherwise(F.lit(0.0))
    lines = F.split(text, "\n")
    return {
        "chars": chars,
        "words": words,
        "word_length": share(chars, words),
        "symbols": share(count(r"[^\p{L}\p{N}\s.,;:!?'\"()-]"), words),
        "symbol_runs": share(count(r"[^\p{L}\p{N}\s.,;:!?'\"()-]{3,}"), words),
        "separators": share(count(r"\s[^\p{L}\p{N}\s]\s"), words),
        "digits": share(count(r"[0-9]"), chars),
        "capitals": share(count(r"[A-Z]"), words),
        "stops": share(count(r"[.!?]"), words),
        "commas": share(count(r"[,;:]"), words),
        "lines": share(F.size(lines).cast("double"), words),
        "distinct_lines": share(F.size(F.array_distinct(lines)).cast("double"), F.size(lines).cast("double")),
        "distinct_words": share(F.size(F.array_distinct(F.split(text, r"[\x20\x09-\x0D]+"))).cast("double"), words),
    }


def _grow(x: np.ndarray, cuts: list[np.ndarray], names: list[str], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, rule: Rule, rules: list[Rule], out: np.ndarray) -> None:
    """One regression tree on gradients; adds the rule of every node below the root."""
    g, h = grad[rows].sum(), hess[rows].sum()
    out[rows] = -g / (h + 1.0)
    if depth == 0 or len(rows) < 2 * LEAF:
        return
    best, at = 1e-6, None
    for j, c in enumerate(cuts):
        bins = np.searchsorted(c, x[rows, j], side="left")  # bin i: above i of the thresholds
        n = np.bincount(bins, minlength=len(c) + 1)[:-1].cumsum()
        gl = np.bincount(bins, weights=grad[rows], minlength=len(c) + 1)[:-1].cumsum()
        hl = np.bincount(bins, weights=hess[rows], minlength=len(c) + 1)[:-1].cumsum()
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        gain[(n < LEAF) | (len(rows) - n < LEAF)] = 0
        if len(gain) and gain.max() > best:
            best, at = gain.max(), (j, float(c[gain.argmax()]))
    if at is None:
        return
    j, t = at
    above = x[rows, j] > t
    for side in (False, True):
        child = (*rule, (names[j], side, t))
        rules.append(child)
        _grow(x, cuts, names, grad, hess, rows[above == side], depth - 1, child, rules, out)


def extract_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> list[Rule]:
    """Conjunctions on the paths of boosted trees, simplified, each once."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    margin, found = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        _grow(x, cuts, names, p - y, p * (1 - p), np.arange(len(y)), DEPTH, (), found, step)
        margin += SHRINK * step
    out = {}
    for rule in found:
        tight: dict[tuple[str, bool], float] = {}
        for name, above, t in rule:
            key = (name, above)
            tight[key] = t if key not in tight else (max if above else min)(tight[key], t)
        out[tuple(sorted((n, a, t) for (n, a), t in tight.items()))] = None
    return list(out)


def holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    return np.logical_and.reduce([(x[:, names.index(n)] > t) == above for n, above, t in rule])


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights by accelerated proximal gradient steps; the intercept is free."""
    n, k = z.shape
    v = np.ones(n) / np.sqrt(n)
    for _ in range(20):  # largest eigenvalue of the Gram matrix
        u = z @ (z.T @ v) + v.sum()
        top = np.linalg.norm(u)
        v = u / top
    rate = 4.0 * n / max(top, 1e-9)
    w, b = np.zeros(k), 0.0
    vw, vb = w, b
    for i in range(1, steps + 1):
        err = (1 / (1 + np.exp(-np.clip(z @ vw + vb, -30, 30))) - y) / n
        w2 = vw - rate * (z.T @ err)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * penalty, 0)
        b2 = vb - rate * err.sum()
        vw, vb = w2 + (i - 1) / (i + 2) * (w2 - w), b2 + (i - 1) / (i + 2) * (b2 - b)
        w, b = w2, b2
    return w, float(b)


class RuleEnsemble:
    """Rules with weights, and the intercept."""

    def __init__(self, rules: list[tuple[Rule, float]], bias: float):
        self.rules, self.bias = rules, bias

    def column(self, stats: dict[str, Column]) -> Column:
        """The score as a Spark column over statistic columns."""
        terms = [F.when(reduce(Column.__and__, [stats[n] > t if above else stats[n] <= t for n, above, t in rule]), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules]
        margin = reduce(Column.__add__, terms, F.lit(self.bias))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def train(labelled: DataFrame, sample: int = SAMPLE) -> RuleEnsemble:
    """labelled: doc_id, text, label, n (how often the row counts). Statistics of at most `sample` rows reach the driver."""
    stats = statistics(F.col("text"))
    names = list(stats)
    rows = labelled.select(F.xxhash64("doc_id", "text").alias("k"), "label", "n", *[c.alias(n) for n, c in stats.items()]).orderBy("k", "label").limit(sample)
    # a row counts as often as its id has the label; the bound holds for all of them
    rows = rows.withColumn("i", F.explode(F.array_repeat(F.lit(0), F.least("n", F.lit(sample)).cast("int")))).drop("n", "i").orderBy("k", "label").limit(sample).toPandas()
    rows = rows.sort_values(["label", *names])
    y, x = rows["label"].to_numpy(float), rows[names].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        return RuleEnsemble([], 30.0 if len(y) and y[0] == 1 else -30.0)
    rules = extract_rules(x, y, names)
    if not rules:
        return RuleEnsemble([], float(np.log(y.mean() / (1 - y.mean()))))
    w, b = lasso_logistic(np.stack([holds(r, x, names) for r in rules], 1).astype(float), y)
    return RuleEnsemble([(r, float(v)) for r, v in zip(rules, w, strict=True) if v], b)


def score(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row; statistics are columns of their own, so each is computed once."""
    stats = statistics(F.col("text"))
    used = {n for rule, _ in model.rules for n, _, _ in rule}
    rows = keyed(docs, id_col, text_col)
    rows = rows.select("doc_id", F.struct(*[stats[n].alias(n) for n in sorted(used)], F.lit(0).alias("none")).alias("s"))
    return rows.select("doc_id", model.column({n: F.col(f"s.{n}") for n in used}).alias("score"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from the rows whose fold is not 0 of 5."""
    model = train(labelled_rows(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0, SAMPLE))
    scored = score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
