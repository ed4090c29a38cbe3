"""Pivot-permutation index against all pairs, on odd vectors, long lists and empty tables."""

import math

import numpy as np
import pytest

from reitlens.llm import pivot_index

SCHEMA = "vec_id long, embedding array<float>, label int"


def unit(a):
    return a / np.linalg.norm(a, axis=-1, keepdims=True)


def some_vectors(seed=1, n=1500, d=64):
    """Random vectors; some have neighbours at cosines from 0.90 to 0.99, one group is large, one vector has many copies."""
    r = np.random.default_rng(seed)
    x = unit(r.normal(size=(n, d)))
    rows, labels = [*x], [*r.integers(0, 3, n)]
    for i in range(200):
        c = r.uniform(0.90, 0.99)
        z = r.normal(size=d)
        z = unit(z - (z @ x[i]) * x[i])
        rows.append((c * x[i] + math.sqrt(1 - c * c) * z) * r.uniform(0.1, 50))
        labels.append(labels[i] if i % 10 else 3)
    heart = unit(r.normal(size=d))
    for _ in range(300):
        z = r.normal(size=d)
        z = unit(z - (z @ heart) * heart)
        rows.append(math.sqrt(0.97) * heart + math.sqrt(0.03) * z)
        labels.append(1)
    rows += [x[7]] * 400
    labels += [labels[7]] * 400
    ids = r.permutation(len(rows)) * 3
    return [(int(i), np.asarray(v, np.float32).tolist(), int(k)) for i, v, k in zip(ids, rows, labels)]


def plain(rows, least=0.93):
    links, comp = [0] * len(rows), list(range(len(rows)))
    use = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            use.setdefault((label, len(v)), []).append(k)
    pairs = []
    for group in use.values():
        e = np.array([rows[k][1] for k in group], np.float64)
        e = unit(e / np.abs(e).max(axis=1, keepdims=True))
        i, j = np.nonzero(np.triu(e @ e.T >= least, 1))
        pairs += [(group[a], group[b]) for a, b in zip(i, j)]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    def root(k):
        while comp[k] != k:
            comp[k] = comp[comp[k]]
            k = comp[k]
        return k
    for a, b in pairs:
        a, b = root(a), root(b)
        comp[max(a, b)] = min(a, b)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return sorted(((i, links[k], low.get(root(k))) for k, (i, _, _) in enumerate(rows)), key=str), pairs


def result(df):
    got = pivot_index.classes(df).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


def test_recall_against_all_pairs(spark):
    rows = some_vectors()
    want, pairs = plain(rows)
    got = result(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert len(got) == len(want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))  # no link below the bound
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    assert sum(g == w for g, w in zip(got, want)) >= 0.99 * len(want) and len(pairs) > 40_000


def test_long_lists_are_cut_into_blocks(spark, monkeypatch):
    df = spark.createDataFrame(some_vectors(seed=2), SCHEMA).repartition(4)
    whole = result(df)
    monkeypatch.setattr(pivot_index, "BLOCK", 60)
    assert result(df) == whole


def test_odd_vectors(spark):
    a = [1.0, 2.0, 3.0]
    rows = [(1, a, 1), (2, [2.0, 4.0, 6.0], 1), (3, a, 2), (4, a, None), (5, None, 1), (6, [], 1), (7, [0.0] * 3, 1), (8, [1.0, None, 3.0], 1),
            (9, [1.0, float("nan"), 3.0], 1), (10, [float("inf"), 2.0, 3.0], 1), (11, a + [0.5], 1), (12, [1.0, 2.0], 1), (None, a, 1), (None, a, 1),
            (None, [9.0, -1.0, 0.0], 1), (13, [0.0, 1.0, 0.0], 3), (14, [-0.0, 1.0, 0.0], 3), (14, [-0.0, 1.0, 0.0], 3), (15, [1e-38, 2e-38, 3e-38], 1), (16, [1e38, 2e38, 3e38], 1),
            (17, a + [0.5], 1), (18, [-1.0, -2.0, -3.0], 1), (None, None, None), (None, [3.0, 3.0, 9.0], 7), (None, [3.0, 3.0, 9.0], 7)]
    df = spark.createDataFrame([(*r, b"n", 5, "l") for r in rows], SCHEMA + ", node binary, n int, lists string").repartition(2)
    assert result(df) == plain(rows)[0]
    assert pivot_index.classes(df.where("false")).count() == 0
    wide = df.withColumn("embedding", df.embedding.cast("array<double>"))
    assert result(wide) == plain(rows)[0]


def test_dimension_that_no_pivot_has():
    index = pivot_index.Pivots([np.ones(4)], 8)
    lists, prefix = index.describe(np.ones((2, 7)))
    assert lists.tolist() == [[-8, -1, -1, -1]] * 2 and (prefix == -1).all() and index.shared(7) == 0


@pytest.mark.parametrize("needed", [0, 1, 3, 5])
def test_candidates_equal_set_counts(needed):
    r = np.random.default_rng(needed)
    a, b = (np.array([r.permutation(30)[:16] for _ in range(n)], np.int16) for n in (40, 33))
    a[3, 5:] = -1
    got = set(zip(*(x.tolist() for x in pivot_index.candidates(a, b, 9, needed))))
    want = set()
    for i, x in enumerate(a.tolist()):
        for j, y in enumerate(b.tolist()):
            common = (set(x) & set(y)) - {-1}
            if len(common) >= needed and not any(0 <= p < 9 for p in set(x[:4]) & set(y[:4])):
                want.add((i, j))
    assert got == want
