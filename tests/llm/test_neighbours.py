import itertools
import math

import numpy as np
import pytest

from tokenloom.llm import neighbours


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_all_cells_step_by_step(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = neighbours.hilbert_keys(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    assert np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1).max() == 1


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        near = sorted({(-float((np.array(v) * np.array(w)).sum()), i) for i, w in rows if i != q})[:k]
        seen, rank = set(), 0
        for s, i in near:
            if i not in seen:
                rank += 1
                seen.add(i)
                out.append((q, rank, i, -s))
    return sorted(out)


def test_windows_of_all_rows_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0] * 8) for i in range(50)] + [(5, rows[5][1])]
    bad = [(300, None), (301, [0.0] * 8), (302, [math.nan] + [1.0] * 7), (303, [math.inf] + [1.0] * 7), (304, [None] + [1.0] * 7), (None, [1.0] * 8), (305, [1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as id", "3 as ids")
    got = neighbours.search(df, df.where("vec_id % 20 = 0"), k=20, window=0.5).collect()
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [w[:3] for w in want]
    assert [r.score for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))] == pytest.approx([w[3] for w in want], abs=1e-12)
    few = df.where("vec_id in (0, 1, 2)")
    assert [r.vec_id for r in neighbours.search(few, few.where("vec_id = 0"), k=20).orderBy("rank").collect()] == [w[2] for w in brute(rows[:3], rows[:1], 20)]
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


def test_longer_vectors_of_unequal_length_norms(spark):
    """Inner products favour long vectors; the lifted curve must find them."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * rng.uniform(0.2, 3)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = [r for r in rows if r[0] % 100 == 0]
    got = {}
    for r in neighbours.search(df, df.where("vec_id % 100 = 0"), k=10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = np.array([v for _, v in rows])
    hits = sum(len(got[q] & {int(i) for i in np.argsort(-(x @ np.array(v)))[:11] if i != q}) for q, v in queries)
    assert hits >= 0.9 * 10 * len(queries)


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    got = {}
    for r in neighbours.op6_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.array(t.embedding.tolist(), dtype=np.float64), t.vec_id.to_numpy()
    hits = 0
    for q, found in got.items():
        s = x @ x[np.flatnonzero(ids == q)[0]]
        order = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        hits += len({f[1] for f in found} & set(order))
        ordered = sorted(found)
        assert [f[0] for f in ordered] == list(range(1, 21))
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(ordered, ordered[1:]))
    assert len(got) == (ids % 20 == 0).sum() and hits >= 0.93 * 20 * len(got)


def found_by_windows(x, queries, window, k=20):
    """Share of the true neighbours within the windows, the share of rows looked at, and the largest cell."""
    size = np.sqrt((x * x).sum(1))
    reach = np.quantile(size, 1 - neighbours.LONG / 2) * (1 + 1e-9)
    curves, cells = neighbours.Curves(x.shape[1], reach), neighbours.Cells(len(x), window, 2 * k)
    s = x[queries] @ x.T
    s[np.arange(len(queries)), queries] = -np.inf
    top = np.argpartition(-s, k, axis=1)[:, :k]
    seen, work, largest = np.isin(top, np.flatnonzero(size > reach)), 0.0, 0
    for key, asked in zip(curves.keys(x, False), curves.keys(x[queries], True)):
        bounds = np.quantile(key, np.arange(1, cells.n) / cells.n, method="lower")
        cell = np.searchsorted(bounds, key, side="right")
        low, high = cells.window(np.searchsorted(bounds, asked, side="right"))
        seen |= (cell[top] >= low[:, None]) & (cell[top] <= high[:, None])
        count = np.bincount(cell, minlength=cells.n)
        at = np.concatenate([[0], np.cumsum(count)])
        work += (at[high + 1] - at[low]).mean() / len(x)
        largest = max(largest, count.max())
    return seen.mean(), work, largest


@pytest.mark.parametrize("n", [2000, 10_000, 50_000])
def test_recall_of_directions_without_structure(n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    recall, work, largest = found_by_windows(x, rng.choice(n, 200, replace=False), neighbours.WINDOW)
    assert recall >= 0.93 and work < 2.0 and largest <= 2 + 2 * n / neighbours.CELLS


def test_constant_windows_find_clusters_at_linear_cost():
    rng = np.random.default_rng(3)
    for n in (10_000, 50_000):
        centres = rng.normal(size=(n // 100, 64))
        x = centres[rng.integers(0, len(centres), n)] + 0.3 * rng.normal(size=(n, 64))
        recall, work, _ = found_by_windows(x, rng.choice(n, 200, replace=False), 2000)
        assert recall >= 0.9 and work * n < 17 * 2200


def test_cells_stay_even_beside_a_few_long_vectors():
    """One vector ten thousand times as long as the rest, and a third of all rows nearly equal."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12_000, 32))
    x /= np.sqrt((x * x).sum(1))[:, None]
    x[:4000] = x[0] + 1e-9 * rng.normal(size=(4000, 32))
    x[5000] *= 1e4
    recall, _, largest = found_by_windows(x, np.arange(6000, 6200), neighbours.WINDOW)
    assert recall >= 0.9 and largest <= 300


def test_long_vectors_are_compared_with_every_query(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 8))
    x[[17, 1234]] *= 1000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for r in neighbours.search(df, df.where("vec_id % 100 = 0"), k=5).where("rank <= 2").collect():
        best = [i for i in np.argsort(-(x @ x[r.query_id])) if i != r.query_id]
        if best[r["rank"] - 1] in (17, 1234):
            assert r.vec_id == best[r["rank"] - 1]


def test_repeated_rows_hide_no_ids(spark):
    """A vector with 30 ids of 30 rows each, and one row more often than there are places."""
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(30) for _ in range(30)] + [(100, [3.0, 1.0, 1.0])] * 50 + [(i, [3.0, 1.0, 1.0]) for i in range(101, 130)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, df.where("vec_id in (0, 29, 100)"), k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: list(range(1, 21)), 29: list(range(20)), 100: list(range(101, 121))}
