import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import DATA
from folioframe.llm import context_mixing, mixing, quality, toxicity
from folioframe.llm import common
from folioframe.llm.common import documents


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def held(d, mod):
    return zlib.crc32(("" if d is None else str(d)).encode()) % mod


def test_base_scores_and_counts(spark, odd):
    for df in (odd, documents(spark, DATA)):
        rows = [(d, t.encode().lower().split() + [b""]) for d, t in texts_of(df)]
        counts = Counter(w for d, ws in rows if held(d, 7) != 2 for w in ws)
        n, v = sum(counts.values()), len(counts)
        want = Counter((d, held(d, 7) == 2, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 5)) for d, ws in rows)
        got = context_mixing.score(df).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
        assert all(r.score < 0 and abs(r.score + r.n_bits * math.log10(2)) < 1e-6 * abs(r.score) for r in got)


def test_rare_and_frequent_words_add_up(spark, monkeypatch):
    df = documents(spark, DATA)
    all_frequent = {r.doc_id: r for r in context_mixing.score(df).collect()}
    monkeypatch.setattr(context_mixing, "FREQUENT", 50)  # nearly all words are joined
    for r in context_mixing.score(df).collect():
        assert r.n_known == all_frequent[r.doc_id].n_known and abs(r.base_score - all_frequent[r.doc_id].base_score) < 1e-6


def test_probabilities_sum_to_one():
    """Over all next bytes, behind a context, the coded probabilities are a distribution."""
    pairs = np.random.default_rng(0).integers(0, 50, (256, 256))
    coder = context_mixing.Coder(*context_mixing.code_trees(pairs))
    rng = np.random.default_rng(1)
    logits = [rng.integers(-60, 60, 1 << context_mixing.SLOT_BITS).astype(np.int8) for _ in range(context_mixing.CONTEXTS)]
    mixer = context_mixing.Mixer(logits, np.full((context_mixing.CONTEXTS + 1, context_mixing.GATES), 0.3), rng.integers(0, 9, (2, 256 * context_mixing.BUCKETS)).astype(float))
    total = 0.0
    for c in range(256):
        bits, at, before, _ = coder.decisions([b"some co" + bytes([c])])
        x, gate = mixer.inputs(at)
        p = mixer.refine(mixer.mix(x, gate), before)
        n = int(coder.lengths[ord("o"), c])
        total += float(np.prod(np.where(bits == 1, p, 1 - p)[-n:].astype(float)))
    assert abs(total - 1) < 1e-4


def test_texts_are_coded_apart():
    coder = context_mixing.Coder(*context_mixing.code_trees(np.ones((256, 256), int)))
    alone = coder.decisions([b"second text\n"])
    both = coder.decisions([b"first one\n", b"second text\n"])
    k = both[3][0]
    assert (both[0][k:] == alone[0]).all() and all((b[k:] == a).all() for a, b in zip(alone[1], both[1], strict=True))


def test_the_mixture_beats_the_unigram_base_on_held_out_text(spark):
    got = context_mixing.score(documents(spark, "/root/testdata/sf0.1")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def naive_units(text):
    """Each word with its class, one by one: the class is named by the last word of up to three bytes."""
    kind = 0
    for w in text.encode().lower().split():
        yield w + b" ", kind
        if len(w) <= context_mixing.SHORT:
            kind = 1 + zlib.crc32(w) % (context_mixing.CLASSES - 1)
    yield b"\n", kind


def counts_of(df):
    pairs = context_mixing._count_corpus(df).cache()
    return pairs, context_mixing.word_counts(pairs).cache()


def test_predictor_tables_grow_with_the_corpus(spark, monkeypatch):
    """Two slots for every key at least; tables hold the counts of all training words, taken one by one here."""
    monkeypatch.setattr(context_mixing, "SLOT_BITS", 8)
    monkeypatch.setattr(context_mixing, "SORTED", 5000)
    monkeypatch.setattr(context_mixing, "HELD", 3000)
    training = documents(spark, DATA).select("doc_id", "text")
    sizes = []
    for df in (training.filter("doc_id % 8 = 0"), training):
        coder, mixer = context_mixing.learn(df, *counts_of(df))
        units = [u for _, t in texts_of(df) for u in naive_units(t)]
        bits, at, _, _ = coder.decisions([u for u, _ in units], np.array([c for _, c in units]))
        pair, hashes, _ = coder.symbols([u for u, _ in units], np.array([c for _, c in units]))
        pos, _, node = coder.paths(pair)
        for k, table in enumerate(mixer.logits):
            assert len(table) >= 2 * len(np.unique(hashes[k][pos].astype(np.uint64) << np.uint64(32) | node))
            counts = np.zeros((len(table), 2))
            np.add.at(counts, (at[k], bits), 1)
            assert (context_mixing.logits_of(counts) == table).all()
        sizes.append(sum(map(len, mixer.logits)))
    assert sizes[1] > sizes[0]


def test_scores_bit_by_bit(spark, odd):
    """The mixture of every decision by plain arithmetic, word after word; a text's bits are their sum."""
    for df, n in ((odd, 25), (documents(spark, DATA), 6)):
        training = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(common.fold(F.col("doc_id"), 7) != 2)
        coder, m = context_mixing.learn(training, *counts_of(training))
        got = {}
        for r in context_mixing.score(df).collect():
            got.setdefault(r.doc_id, []).append(r)
        for d, t in [x for x in texts_of(df) if len(x[1]) < 4000][:n]:
            nats, size = 0.0, 0
            for unit, kind in naive_units(t):
                bits, at, before, _ = coder.decisions([unit], np.array([kind]))
                size += len(unit)
                for i, bit in enumerate(bits.tolist()):
                    raw = [int(m.logits[k][at[k][i]]) for k in range(context_mixing.CONTEXTS)]
                    sure = [sum(abs(x) >= level for level in (1, 16, 44)) for x in raw]
                    gate = 4 * sure[1] + sure[2]
                    z = m.weights[-1][gate] + sum(m.weights[k][gate] * raw[k] / context_mixing.SCALE for k in range(context_mixing.CONTEXTS))
                    z = min(12.0, max(-12.0, z))
                    spot = int(before[i]) * context_mixing.BUCKETS + round((min(8.0, max(-8.0, z)) + 8) * (context_mixing.BUCKETS - 1) / 16)
                    zeros, ones = m.hits[0][spot], m.hits[1][spot]
                    p = 1 / (1 + math.exp(-z))
                    p += (zeros + ones) / (zeros + ones + 32) / 2 * ((ones + 0.5) / (zeros + ones + 1) - p)
                    nats += math.log(p if bit else 1 - p)
            assert any(abs(r.n_bits + nats / math.log(2)) < 2e-3 * r.n_bits and abs(r.bits_per_byte - r.n_bits / size) < 1e-9 for r in got[d])


def test_long_texts_are_scored_in_pieces(spark):
    """Pieces carry the class on; base scores, tokens and bits are those of the whole text."""
    rng = np.random.default_rng(4)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(1, 9, 3000)]
    long = " ".join(words[i] for i in rng.integers(0, 3000, 2_000_000)) + "  " + "x" * 9_000_000
    assert len(long) > 3 * context_mixing.PIECE
    rows = [(1, "a few words"), (2, long), (3, None), (4, " ".join(words[:500]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in context_mixing.score(df).collect()}
    tokens = {d: (t or "").encode().split() + [b""] for d, t in rows}
    counts = Counter(w for d, ws in tokens.items() if held(d, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in tokens.items():
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        assert got[d].n_tokens == len(ws) and got[d].n_known == sum(counts[w] > 0 for w in ws) and abs(got[d].base_score - base) < 1e-6 * abs(base) + 1e-6
        assert abs(got[d].bits_per_byte * sum(len(w) + 1 for w in ws) - got[d].n_bits) < 1e-6 * got[d].n_bits
    head, tail = tokens[2][:1000], tokens[2][1000:2000]
    whole, one = context_mixing.Pairs([head + tail], True), context_mixing.Pairs([head], False)
    two = context_mixing.Pairs([tail], True, one.last_class)
    seen = lambda p: [(int(p.classes[i]), p.words[p.word[i]]) for i in p.of_token]
    assert seen(one) + seen(two) == seen(whole) == [(c, u[:-1] if u != b"\n" else b"") for u, c in naive_units(b" ".join(head + tail).decode())]


def test_weights_do_not_depend_on_the_split(spark):
    """Many small partitions learn the gates and the map as one does."""
    got = []
    for n in (1, 40):
        df = documents(spark, DATA).select("doc_id", "text").repartition(n)
        got.append(context_mixing.learn(df, *counts_of(df))[1])
        assert np.abs(got[-1].weights[: context_mixing.CONTEXTS] - 0.35).max() > 0.02
    assert got[0].hits.sum() == got[1].hits.sum() > 0 and np.abs(got[0].weights - got[1].weights).max() < 0.1


def test_scores_of_nothing(empty):
    assert context_mixing.score(empty).count() == 0


def test_toxicity_learns_what_marks_it(spark):
    d = "/root/testdata/sf0.1"
    scored = toxicity.toxicity(documents(spark, d), common.labels(spark, d)).join(common.labels(spark, d).select("doc_id", "toxic"), "doc_id").filter("held_out")
    c = {(r.toxic, r.predicted): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    assert c[(1, 1)] / (c[(1, 1)] + c.get((1, 0), 0)) > 0.7 and c.get((0, 1), 0) / c[(0, 0)] < 0.03


def naive_grams(text):
    """The 3- to 5-character strings of a text's words, ends marked; as slots by the same arithmetic on one string."""
    out = set()
    for w in set(text.lower().split()):
        marked = f" {w} "
        for k in (3, 4, 5):
            out |= {marked[i : i + k] for i in range(len(marked) - k + 1)}
    return out


def naive_slot(gram):
    key, mask = len(gram) << 60 & (1 << 64) - 1, (1 << 64) - 1
    for i, c in enumerate(gram):
        key ^= (ord(c) & 0xFFF) << 12 * i
    h = key * 0x9E3779B97F4A7C15 & mask
    h ^= h >> 29
    h = h * 0xBF58476D1CE4E5B9 & mask
    return h >> 64 - toxicity.SLOT_BITS


def test_toxicity_against_plain_counts(spark, odd):
    """n-grams, counts by label, log-count ratios and scores, text by text."""
    docs = documents(spark, DATA)
    labelled = toxicity.labelled_rows(docs, common.labels(spark, DATA), "toxic", common.fold(F.col("doc_id"), 4) != 2).cache()
    rows = [({naive_slot(g) for g in naive_grams(r.text)}, r.label, r.n) for r in labelled.collect()]
    n = Counter()
    held_by = (Counter(), Counter())
    for slots, y, times in rows:
        n[y] += times
        held_by[y].update({x: times for x in slots})
    ones, zeros, n1, n0 = toxicity.class_counts(labelled)
    assert (n1, n0) == (n[1], n[0])
    assert {i: int(c) for i, c in enumerate(ones) if c} == held_by[1] and {i: int(c) for i, c in enumerate(zeros) if c} == held_by[0]
    model = toxicity.train(labelled)
    kept = np.flatnonzero(model.weights)
    ratio = {i: math.log((held_by[1][i] + 0.5) / (n1 + 1)) - math.log((held_by[0][i] + 0.5) / (n0 + 1)) for i in kept.tolist()}
    telling = {i: abs(ratio[i]) * (held_by[1][i] + held_by[0][i]) ** 0.5 for i in ratio}
    others = [abs(math.log((held_by[1][i] + 0.5) / (n1 + 1)) - math.log((held_by[0][i] + 0.5) / (n0 + 1))) * (held_by[1][i] + held_by[0][i]) ** 0.5 for i in set(held_by[0]) | set(held_by[1]) if i not in ratio and held_by[1][i] + held_by[0][i] >= toxicity.SUPPORT]
    assert len(kept) <= toxicity.FEATURES and min(telling.values()) >= max(others, default=0) - 1e-9
    for df in (docs, odd):
        texts = [t for _, t in texts_of(df)]
        want = [1 / (1 + math.exp(-min(30, max(-30, model.bias + sum(float(model.weights[naive_slot(g)]) for g in {naive_slot(x): x for x in naive_grams(t)}.values()))))) for t in texts]
        assert np.allclose(model.scores(texts), want, atol=1e-5)
    # a fit of weights leaves no gradient: of the penalised likelihood, in scaled features
    at = {int(i): j for j, i in enumerate(kept)}
    grad = np.array([toxicity.L2 * model.weights[i] / ratio[i] for i in at])
    for slots, y, times in rows:
        z = model.bias + sum(float(model.weights[i]) for i in slots if i in at)
        for i in slots:
            if i in at:
                grad[at[i]] += times * (1 / (1 + math.exp(-z)) - y) * ratio[i]
    assert np.abs(grad).max() < 0.05 * sum(times for _, _, times in rows)


def test_toxicity_reads_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5000)), "short one", "", " ".join(str(i) for i in range(3000))]
    whole = [set(s.tolist()) for s in (toxicity.ngram_slots([t])[1] for t in texts)]
    monkeypatch.setattr(toxicity, "PIECE", 100)
    doc, slot = toxicity.ngram_slots(texts)
    assert [set(slot[doc == i].tolist()) for i in range(len(texts))] == whole == [{naive_slot(g) for g in naive_grams(t)} for t in texts]


def test_labels_count_as_often_as_they_stand(spark):
    docs = spark.createDataFrame([(1, "bad"), (1, "worse"), (2, "good"), (3, "unlabelled")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (9, 1), (None, 1), (2, None), (3, 7)], "doc_id long, toxic int")
    got = toxicity.labelled_rows(docs, labels, "toxic", F.lit(True))
    assert sorted(map(tuple, got.collect())) == [(1, "bad", 0, 1), (1, "bad", 1, 2), (1, "worse", 0, 1), (1, "worse", 1, 2), (2, "good", 0, 1)]
    assert toxicity.labelled_rows(docs, labels, "toxic", F.lit(True), ids=1).select("doc_id").distinct().count() == 1


def test_toxicity_of_odd_rows(odd, empty, labels):
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (held(r.doc_id, 4) == 2) for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert all(r.score < 1e-9 for r in toxicity.toxicity(odd, labels.limit(0)).collect())
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    assert toxicity.drop_toxic(empty, labels).count() == 0


def test_quality_learns_what_marks_it(spark):
    d = "/root/testdata/sf0.1"
    scored = quality.quality(documents(spark, d), common.labels(spark, d)).join(common.labels(spark, d).select("doc_id", F.col("quality").alias("y")), "doc_id").filter("held_out")
    c = {(r.y, r.predicted): r["count"] for r in scored.groupBy("y", "predicted").count().collect()}
    assert (c[(1, 1)] + c[(0, 0)]) / sum(c.values()) > 0.97


def test_quality_of_odd_rows(odd, empty, labels):
    got = quality.quality(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (held(r.doc_id, 5) == 0) for r in got)
    assert quality.quality(empty, labels).count() == 0
    assert quality.quality(odd, labels.limit(0)).filter("predicted = 1").count() == 0


def test_statistics_against_plain_counts(spark, odd):
    """All statistics of whole texts, one by one; 300,000 characters without a blank among them."""
    import regex

    def naive(t):
        words, lines = regex.findall(common.WORD, t), t.split("\n")
        n, blank = len(words), r"\x20\t\n\x0b\f\r"
        symbol = rf"[^\p{{L}}\p{{N}}{blank}.,;:!?'\"()-]"
        share = lambda x, of: x / of if of else 0.0
        count = lambda p: len(regex.findall(p, t))
        return {
            "chars": len(t), "words": n, "word_length": share(len(t), n), "symbols": share(count(symbol), n), "symbol_runs": share(count(symbol + "{3,}"), n),
            "separators": share(count(rf"[{blank}][^\p{{L}}\p{{N}}{blank}][{blank}]"), n), "digits": share(sum("0" <= c <= "9" for c in t), len(t)), "capitals": share(sum("A" <= c <= "Z" for c in t), n),
            "stops": share(sum(c in ".!?" for c in t), n), "commas": share(sum(c in ",;:" for c in t), n), "lines": share(len(lines), n),
            "distinct_lines": share(len(set(lines)), len(lines)), "distinct_words": share(len(set(regex.split(r"[\x20\x09-\x0D]+", t))), n),
        }

    long = spark.createDataFrame([(1, "x" * 300_000), (2, "a b. " * 60_000), (3, "### $$$ " * 5000)], "doc_id long, text string")
    for df in (odd, documents(spark, DATA), long):
        stats = quality.statistics(F.col("text"))
        for r in df.select(F.coalesce("text", F.lit("")).alias("text")).select("text", *[c.alias(n) for n, c in stats.items()]).collect():
            want = naive(r.text)
            assert list(want) == list(stats) and all(abs(r[k] - v) < 1e-9 for k, v in want.items()), (r.text[:80], want)


def test_ties_at_a_threshold_are_not_above_it(spark):
    model = quality.RuleEnsemble([((("a", True, 1.0),), 2.0), ((("a", False, 1.0),), -2.0)], 0.0)
    got = [r.s for r in spark.createDataFrame([(1.0,), (1.0000001,), (0.5,)], "a double").select(model.column({"a": F.col("a")}).alias("s")).collect()]
    assert got[0] < 0.5 < got[1] and got[2] < 0.5
    assert quality.holds((("a", True, 1.0),), np.array([[1.0]]), ["a"]).tolist() == [False]


def test_rules_in_columns_equal_rules_in_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] <= 0.5)).astype(float)
    names = ["a", "b", "c"]
    rules = quality.extract_rules(x, y, names)
    z = np.stack([quality.holds(r, x, names) for r in rules], 1).astype(float)
    w, b = quality.lasso_logistic(z, y)
    assert 0 < (w != 0).sum() < len(rules)
    p = 1 / (1 + np.exp(-(z @ w + b)))
    assert ((p > 0.5) == (y == 1)).mean() > 0.98
    model = quality.RuleEnsemble([(r, float(v)) for r, v in zip(rules, w, strict=True) if v], b)
    df = spark.createDataFrame(x[:50].tolist(), "a double, b double, c double")
    got = [r.s for r in df.select(model.column({n: F.col(n) for n in names}).alias("s")).collect()]
    assert np.allclose(got, p[:50])


def water_fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by raising one level at a time, the slow way."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] >= cap * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in free}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= full
    return out


@pytest.mark.parametrize("block", [mixing.BLOCK, 3])
def test_mix_meets_its_targets(spark, odd, block):
    for df in (odd, documents(spark, DATA)):
        sizes = Counter()
        for r in df.collect():
            sizes[r.source] += len((r.text or "").encode().split())
        want = water_fill(sizes)
        got = mixing.mix(df, block=block).collect()
        assert len(got) == df.count() and all(0 <= r.taken <= 3 * r["size"] for r in got)
        taken, by_target = Counter(), {}
        for r in got:
            key = (r.source_size, round(r.target, 6))
            taken[key] += r.taken
            by_target[key] = r.target
        expected = Counter()
        for s, t in want.items():
            expected[(sizes[s], round(t, 6))] += round(t + 1e-9)
        assert {k: v for k, v in taken.items() if v} == {k: v for k, v in expected.items() if v}
        assert Counter(map(tuple, mixing.mix(df.repartition(5), block=block).collect())) == Counter(map(tuple, got))


def test_block_plan(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 50), "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    _, sources = mixing._documents_in_streams(docs, "doc_id", "text", "source", 8)
    plan = mixing.slots(sources, 8, 16).collect()
    total = sources.first().all_slots
    assert sorted((r.out_shard, r.slot) for r in plan) == [(t // 16, t % 16) for t in range(total)]
    n = {r.pos: (r.n, r.slots) for r in sources.collect()}
    uses = Counter((r.pos, r.epoch, r.block) for r in plan)
    assert set(uses.values()) == {1}
    for pos, (blocks, slots) in n.items():
        mine = [(r.epoch, r.block) for r in plan if r.pos == pos]
        assert len(mine) == slots and all(0 <= b < blocks for _, b in mine)
        assert all({b for e, b in mine if e == k} == set(range(blocks)) for k in range(slots // blocks))


def test_words_taken_by_document(spark, odd):
    """The plan carried out word by word takes from every document what mix says."""
    for df in (odd, documents(spark, DATA)):
        d, sources = mixing._documents_in_streams(df, "doc_id", "text", "source", 8)
        streams, rows = {}, d.collect()
        for i, r in enumerate(rows):
            stream = streams.setdefault(r.pos, [None] * r.source_size)
            stream[r.start : r.start + r["size"]] = [i] * r["size"]
        assert all(None not in s for s in streams.values())
        taken = Counter()
        for r in mixing.slots(sources, 8, 16).collect():
            words = streams[r.pos][8 * r.block : 8 * r.block + 8][: r["take"]]
            assert len(words) == r["take"]
            taken.update(words)
        want = Counter((r.doc_id, r["size"], r.source_size, taken[i]) for i, r in enumerate(rows))
        assert Counter((r.doc_id, r["size"], r.source_size, r.taken) for r in mixing.mix(df, block=8, shard=16).collect()) == want


def test_counts_of_a_shard_are_drawn(spark):
    """Counts of each shard add up to it and scatter as multinomial draws do; the plan's totals are exact all the same."""
    docs = spark.createDataFrame([(i, "w " * 400, "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    _, sources = mixing._documents_in_streams(docs, "doc_id", "text", "source", 8)
    want = {r.pos: (r.slots, r.all_slots) for r in sources.collect()}
    total = next(iter(want.values()))[1]
    drawn = {(r.out_shard, r.pos): r.drawn for r in mixing.shard_counts(sources, 100).collect()}
    shards = total // 100
    for j in range(shards):
        assert sum(drawn.get((j, p), 0) for p in want) == 100
    for p, (n, _) in want.items():
        x = np.array([drawn.get((j, p), 0) for j in range(shards)])
        share = n / total
        assert abs(x.mean() - 100 * share) < 5 * (100 * share * (1 - share) / shards) ** 0.5 and 0.6 < x.var() / (100 * share * (1 - share)) < 1.5
    assert Counter(r.pos for r in mixing.slots(sources, 8, 100).collect()) == {p: n for p, (n, _) in want.items()}


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_permutations(spark, n):
    df = spark.range(n)
    there = mixing._permuted(df, "p", F.col("id"), F.lit(n).cast("long"), F.lit("k"), 3)
    back = mixing._permuted(there, "q", F.col("p"), F.lit(n).cast("long"), F.lit("k"), 3, inverse=True).collect()
    assert sorted(r.p for r in back) == list(range(n)) and all(r.q == r.id for r in back)


def test_mixed_documents_keep_their_rows(odd, empty):
    got = mixing.mix_documents(odd)
    assert got.columns == odd.columns
    have = Counter(map(tuple, odd.collect()))
    assert all(have[k] * 3 >= v for k, v in Counter(map(tuple, got.collect())).items())
    assert mixing.mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_mixed_documents_meet_their_targets(spark):
    """Whole documents miss a source's target by half of its longest document at most, be it as long as the rest together."""
    rows = [(i, "w " * (1 + i * 7 % 90), "abcd"[i % 4]) for i in range(400)] + [(1000, "w " * 4000, "d"), (1001, "w " * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, longest, got = Counter(), Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
        longest[s] = max(longest[s], len(t.split()))
    for r in mixing.mix_documents(docs).collect():
        got[r.source] += len(r.text.split())
    assert all(abs(got[s] - t) <= longest[s] / 2 + 1 for s, t in water_fill(sizes).items())


def test_mixed_documents_follow_the_plan(spark):
    """Copies of a document are the words that the plan of mix takes, rounded up or down to whole documents; parts taken raise the chance of one more."""
    rows = [(i, "w " * (1 + i * 7 % 200), "abcd"[i % 4]) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = Counter(r.doc_id for r in mixing.mix_documents(docs).collect())
    part, more = [], []
    for r in mixing.mix(docs).collect():
        least = r.taken // r["size"]
        assert least <= copies[r.doc_id] <= -(-r.taken // r["size"]), (r, copies[r.doc_id])
        if r.taken % r["size"]:
            part.append(r.taken % r["size"] / r["size"])
            more.append(copies[r.doc_id] - least)
    assert len(part) > 100 and np.corrcoef(part, more)[0, 1] > 0.2
    assert Counter(r.doc_id for r in mixing.mix_documents(docs.repartition(7)).collect()) == copies


def test_toxicity_takes_little_memory():
    """Texts of some MB, one or many, need a small multiple of a piece; caches of other operators leave the worker."""
    import tracemalloc

    from folioframe.llm import pieces

    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 9)) for _ in range(120_000)]
    long = " ".join(words)
    model = toxicity.ToxicityModel(np.zeros(1 << toxicity.SLOT_BITS), 0.0)
    for texts in ([long], [long[i : i + 2000] for i in range(0, len(long), 2000)]):
        tracemalloc.start()
        assert (model.scores(texts) == 0.5).all()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 110 << 20
    pieces.model(common.tokenizer_path("piece_bpe_32k.model"))
    common.give_back()
    assert pieces.model.cache_info().currsize == 0


def test_shared_heads_are_coded_once(monkeypatch):
    """Edges give every byte the pair and hashes that it has alone, and are as many as there are distinct heads behind a class."""
    rng = np.random.default_rng(5)
    words = sorted({bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in rng.integers(0, 9, 3000)} | {b"a" * 9000, b"a" * 4096, b"", b"\xff" * 5})
    chosen = [(c, w) for c in range(4) for w in words if rng.random() < 0.7]
    coder = context_mixing.Coder(*context_mixing.code_trees(rng.integers(0, 50, (256, 256))))
    monkeypatch.setattr(context_mixing, "CODED", 1 << 20)
    (units, owner), = context_mixing.units_of([w for _, w in chosen])
    classes = np.array([c for c, _ in chosen])[owner]
    pair, hashes, unit = coder.symbols(units, classes)
    e_pair, e_hashes, e_unit, edge = coder.edges(units, classes)
    assert (e_unit == unit).all() and (e_pair[edge] == pair).all() and all((e[edge] == h).all() for e, h in zip(e_hashes, hashes, strict=True))
    heads = {(c, u[: i + 1]) for c, u in zip(classes.tolist(), units, strict=True) if len(u) < 100 for i in range(len(u))}
    assert len(heads) <= len(e_pair) < 0.6 * len([x for u in units if len(u) < 100 for x in u]) + sum(len(u) for u in units if len(u) >= 100)
    mixer = context_mixing.Mixer([rng.integers(-60, 60, 1 << context_mixing.SLOT_BITS).astype(np.int8) for _ in range(context_mixing.CONTEXTS)], np.full((context_mixing.CONTEXTS + 1, context_mixing.GATES), 0.3), rng.integers(0, 9, (2, 256 * context_mixing.BUCKETS)).astype(float))
    got = np.bincount(unit, weights=mixer.nats(coder, e_pair, e_hashes)[edge])
    bits, at, before, per_unit = coder.decisions(units, classes)
    q = mixer.refine(mixer.mix(*mixer.inputs(at)), before)
    want = np.bincount(np.repeat(np.arange(len(units)), per_unit), weights=np.log(np.where(bits == 1, q, 1 - q)))
    assert np.abs(got - want).max() < 1e-3


def test_words_split_in_arrow_are_those_of_the_text():
    """Batches are split without an object for each token; ids, classes and ends are those of words_of, text by text."""
    texts = [" a\x0bb  The\tthe\x0c ", "", " \r\n", "x\x1cy\x85z\u3000w\xa0 ÄÖ äö", "of THE word", "word"]
    split = context_mixing.split_words(pa.array(["cut off", *texts]).slice(1))
    pairs = context_mixing.Pairs(split, True)
    lists = [context_mixing.words_of(t) for t in texts]
    assert [pairs.words[i] for i in pairs.ids] == [w for t in lists for w in [*t, b""]]
    assert pairs.sizes.tolist() == [len(t) + 1 for t in lists] and pairs.words == sorted({b"", *(w for t in lists for w in t)})
    other = context_mixing.Pairs(lists, True)
    for name in ("ids", "sizes", "classes", "word", "counts", "of_token", "lengths"):
        assert (getattr(pairs, name) == getattr(other, name)).all()
    got = [(pairs.words[pairs.word[i]], pairs.classes[i]) for i in pairs.of_token]
    assert [((w + b" ") if w else b"\n", k) for w, k in got] == [x for t in texts for x in naive_units(t)]


@pytest.mark.parametrize("marked", [context_mixing.MARKED, 0])
def test_classes_share_what_is_known_without_them(monkeypatch, marked):
    """Of a word in many classes all contexts but the last are looked up once; pairs have the bits that they have alone."""
    monkeypatch.setattr(context_mixing, "MARKED", marked)
    monkeypatch.setattr(context_mixing, "CODED", 2000)
    rng = np.random.default_rng(6)
    words = sorted({bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in rng.integers(4, 9, 400)} | {b"ab" * 5000})
    short = [b"%d" % i for i in range(30)]
    texts = [[s, *(words[i] for i in rng.integers(0, len(words), 200))] for s in short]
    pairs = context_mixing.Pairs(texts, True)
    coder = context_mixing.Coder(*context_mixing.code_trees(rng.integers(0, 50, (256, 256))))
    mixer = context_mixing.Mixer([rng.integers(-60, 60, 1 << context_mixing.SLOT_BITS).astype(np.int8) for _ in range(context_mixing.CONTEXTS)], rng.normal(0.3, 0.1, (context_mixing.CONTEXTS + 1, context_mixing.GATES)), rng.integers(0, 9, (2, 256 * context_mixing.BUCKETS)).astype(float))
    looked, slots = Counter(), context_mixing.Coder.slots
    with monkeypatch.context() as m:
        m.setattr(context_mixing.Coder, "slots", lambda self, k, hashes, node: looked.update({k: len(node)}) or slots(self, k, hashes, node))
        got = pairs.nats(coder, mixer)
    alone = {}
    for i, (w, k) in enumerate(zip(pairs.word.tolist(), pairs.classes.tolist(), strict=True)):
        coded = pairs.words[w] + b" " if pairs.words[w] else b"\n"
        units = [coded[j : j + context_mixing.LONGEST] for j in range(0, len(coded), context_mixing.LONGEST)]
        bits, at, before, _ = coder.decisions(units, np.full(len(units), k))
        q = mixer.refine(mixer.mix(*mixer.inputs(at)), before)
        assert abs(got[i] - np.log(np.where(bits == 1, q, 1 - q)).sum()) < 1e-3 * abs(got[i])
        alone[w] = len(bits)
    assert len(got) > 3 * len(words) and looked[context_mixing.CONTEXTS - 1] > sum(alone.values())
    assert all(0 < looked[k] <= sum(alone.values()) for k in range(context_mixing.CONTEXTS - 1))


def test_counts_of_equal_symbols_are_summed():
    """Merged runs have every symbol once, in order, with exact sums; nothing gives nothing."""
    rng = np.random.default_rng(7)
    runs = [np.stack([rng.integers(0, 50, n), *rng.integers(0, 1 << 40, (2, n))]).astype(np.uint64) for n in (0, 300, 1, 500)]
    want = {}
    for run in runs:
        for s, *n in run.T.tolist():
            want[s] = [x + y for x, y in zip(want.get(s, [0, 0]), n, strict=True)]
    assert context_mixing._merged(runs).tolist() == [[s, *want[s]] for s in sorted(want)]
    assert context_mixing._merged([]).shape == context_mixing._merged(runs[:1]).shape == (0, 3)
