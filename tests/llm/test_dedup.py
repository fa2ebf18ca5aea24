import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from helpers import DATA, same_rows
from folioframe.llm import exact_dedup, queries, simhash, substrings
from folioframe.llm.common import documents
from folioframe.llm.components import components
from folioframe.llm.suffixes import permuted_common_prefixes, suffix_array


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 20, 3000, dtype=np.uint64), rng.integers(0, 1 << 20, 5000, dtype=np.uint64)
    a[:500] = 77
    f, g = (exact_dedup.CountingQuotientFilter.of(61, x) for x in (a, b))
    m = exact_dedup.CountingQuotientFilter.from_bytes(f.merge(g).to_bytes())
    assert dict(zip(*(x.tolist() for x in m.items()), strict=True)) == Counter(np.concatenate([a, b]).tolist())
    one = exact_dedup.CountingQuotientFilter.of(61, np.array([5], np.uint64))
    assert [x.tolist() for x in one.merge(one).items()] == [[5], [2]]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, duck, name):
    same_rows(queries.queries()[name](spark, DATA), duck.sql(queries.oracle_sql()[name]))


def test_exact_duplicates_of_odd_rows(odd, empty):
    groups = defaultdict(list)
    for d, t in texts_of(odd):
        groups[t].append(d)
    got = exact_dedup.exact_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    for t, ids in groups.items():
        rows = by[hashlib.sha256(t.encode()).hexdigest()]
        best = max((i for i in ids if i is not None), default=None)
        assert Counter(r.doc_id for r in rows) == Counter(ids) and {r.keep_id for r in rows} == {best} and {r.group_size for r in rows} == {len(ids)}
        assert [r.doc_id for r in rows if r.kept] == [best]
    assert exact_dedup.exact_duplicates(empty).count() == 0
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and sorted((r.text or "") for r in kept.collect()) == sorted(groups)
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_equal_fingerprints_of_different_texts_are_told_apart(odd, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "fingerprint", lambda text: F.length(text).cast("long"))
    got = exact_dedup.exact_duplicates(odd)
    assert got.count() == odd.count() and got.filter("kept").count() == len({t for _, t in texts_of(odd)})


def brute_fingerprint(text):
    w = text.encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows, distance=3):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    best = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        best[find(i)] += [d] if d is not None else []
    return [min(best[find(i)], default=None) for i in range(len(rows))]


def test_simhash_against_brute_force(spark, odd):
    for df in (odd, documents(spark, DATA)):
        rows = [(d, brute_fingerprint(t)) for d, t in texts_of(df)]
        want = Counter((d, f"{fp:016x}", c) for (d, fp), c in zip(rows, brute_components(rows), strict=True))
        assert Counter(map(tuple, simhash.near_duplicate_report(df).collect())) == want


@pytest.mark.parametrize("leaf", [4, 64])
def test_trees_lose_no_link(leaf):
    rng = np.random.default_rng(leaf)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = np.concatenate([base[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) for _ in range(4)])
    ball = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 90).astype(np.uint64))
    points = np.unique(np.concatenate([base, near, ball]))
    nodes = simhash.build_tree(points[::3], leaf)
    at, shard = simhash.shards_of(points, nodes)
    shared = defaultdict(set)
    for i, s in zip(at.tolist(), shard.tolist(), strict=True):
        shared[i].add(s)
    want = brute_components([(i, int(p)) for i, p in enumerate(points)])
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 3).tolist():
            assert shared[i] & shared[j]
    up = simhash.spanning_links(points, leaf=leaf)
    groups = defaultdict(set)
    for i, r in enumerate(up.tolist()):
        groups[r].add(i)
    assert {frozenset(g) for g in groups.values()} == {frozenset(i for i, c in enumerate(want) if c == k) for k in set(want)}


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (-5, 110)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[k] for k in (-5, *range(100, 130))} == {-5}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_leave_one_row_each(odd, empty):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    rows = [(d, brute_fingerprint(t)) for d, t in texts_of(odd)]
    assert kept.count() == len({next(j for j in range(len(rows)) if brute_linked(rows, j, i)) for i in range(len(rows))})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def brute_linked(rows, a, b):
    seen, todo = {a}, [a]
    while todo:
        i = todo.pop()
        for j in range(len(rows)):
            if j not in seen and (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                seen.add(j)
                todo.append(j)
    return b in seen


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for _ in range(150):
        s = np.r_[rng.integers(1, rng.integers(2, 6), rng.integers(1, 70)), 0]
        sa = suffix_array(s)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        p = permuted_common_prefixes(s.astype(np.uint8), sa, 20)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
            k = 0
            while k < 20 and max(a, b) + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            assert p[b] == k
    run = np.r_[np.full(5000, 3), 2, np.full(4999, 3), 0]
    assert suffix_array(run)[:3].tolist() == [10000, 5000, 9999]


def brute_removal(rows):
    """Rows in order of id (null first) and text hash; equal rows follow each other."""
    seen, out = set(), []
    for d, t in rows:
        b = t.encode()
        gone = np.zeros(len(b) + 1, np.int8)
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = 1
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("block", [substrings.BLOCK, 2])
def test_repeated_substrings_against_brute_force(spark, odd, monkeypatch, block):
    monkeypatch.setattr(substrings, "BLOCK", block)
    from pyspark.sql import functions as F

    for df in (odd, documents(spark, DATA)):
        ordered = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text")).orderBy(F.col("doc_id").asc_nulls_first(), "th")
        want = brute_removal([(r.doc_id, r.text) for r in ordered.collect()])
        assert Counter(map(tuple, substrings.remove_repeats(df).drop("kept").collect())) == want


def test_repeated_substrings_of_long_texts(spark):
    """Pieces and pages of a text meet: repeats across their edges, inside one text and between texts; a passage in all rows."""
    rng = np.random.default_rng(3)
    words = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))
    passage, text = words(40), words(70_000)
    assert len(text) > 3 * substrings.PIECE > 5 * substrings.PAGE
    rows = [(1, text), (2, text[substrings.PIECE - 300 : substrings.PIECE + 300]), (3, "x" + text[3 * substrings.PAGE - 150 : 3 * substrings.PAGE + 90] + "y")]
    rows += [(4, text[:200_000] + words(5) + text[100_000:]), (5, None), (6, text[:99])] + [(7 + i, words(i % 7) + passage + words(i % 5)) for i in range(200)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).drop("kept")
    assert Counter(map(tuple, got.collect())) == brute_removal([(d, t or "") for d, t in rows])


def test_many_equal_rows(spark):
    """All but one row of equal rows are removed, wherever they stand."""
    text = "".join(chr(97 + i * i % 26) for i in range(500))
    df = spark.createDataFrame([(1, text)] * 300 + [(2, text)] * 5 + [(3, "short")] * 40, "doc_id long, text string").repartition(7)
    got = Counter((r.doc_id, r.n_removed) for r in substrings.remove_repeats(df).collect())
    assert got == brute_by_rows([(1, text)] * 300 + [(2, text)] * 5 + [(3, "short")] * 40)


def brute_by_rows(rows):
    return Counter((d, removed) for (d, _, removed, _, _), n in brute_removal(rows).items() for _ in range(n))


def test_repeated_substrings_of_nothing(empty):
    assert substrings.remove_repeats(empty).count() == 0


def test_folds():
    from folioframe.llm.common import fold
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    s = SparkSession.getActiveSession()
    got = {r.i: r.f for r in s.range(50).select(F.col("id").alias("i"), fold(F.col("id"), 7).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 7 for i in range(50)}
