"""Embedding near copies and nearest neighbours against all pairs."""

import math

import numpy as np
import pytest

from sondage.llm import crosspolytope, multiindex

SCHEMA = "vec_id long, embedding array<float>, label string, key long, n int"


def clustered(n=600, d=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, d))
    x = centres[rng.integers(0, 40, n)] + rng.standard_normal((n, d)) * rng.choice([0.02, 0.12, 0.8], n)[:, None]
    return (x * rng.choice([0.5, 1.0, 3.0], n)[:, None]).astype(np.float32)


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(9001, None), (9002, []), (9003, [0.0] * 24), (9004, [1.0, None] + [0.0] * 22), (9005, [nan] + [1.0] * 23), (9006, [inf] + [1.0] * 23), (9007, [1.0, 2.0]), (9008, [2.0, 4.0])]


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA).repartition(3)


def plain_links(ids, x, threshold=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    group = np.array(ids)
    while True:
        new = np.where(near | np.eye(len(ids), dtype=bool), group[None, :], 1 << 60).min(axis=1)
        if (new == group).all():
            return near.sum(axis=1), group
        group = new


@pytest.mark.parametrize("most", [4096, 16])
def test_links_and_classes(spark, most):
    x = clustered()
    x[50:80] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in crosspolytope.near_duplicates(table(spark, rows + odd_rows()), most=most).collect()}
    links, group = plain_links(list(range(len(x))), x.astype(np.float64))
    found = sum(got[i].n_links for i in range(len(x)))
    assert found <= links.sum() and found >= 0.98 * links.sum()
    assert np.mean([got[i].component_id == group[i] for i in range(len(x))]) > 0.98
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(x)))
    for i, _ in odd_rows()[:6]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[9008].n_links, got[9008].component_id) == (1, 9007)


def test_repeated_rows_and_empty_table(spark):
    one = [(i, [1.0, 0.0, 0.5]) for i in (5, 5, 3, 8)] + [(None, [1.0, 0.0, 0.5]), (None, None)]
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in crosspolytope.near_duplicates(table(spark, one)).collect())
    assert got == [("3", 4, 3), ("5", 4, 3), ("5", 4, 3), ("8", 4, 3), ("None", 0, None), ("None", 4, 3)]
    assert crosspolytope.near_duplicates(table(spark, one).limit(0)).count() == 0


def test_hadamard_is_orthogonal():
    m = crosspolytope.hadamard(np.eye(16)) / 4
    assert np.allclose(m @ m.T, np.eye(16))


@pytest.mark.parametrize("shard", [65_536, 200])
def test_search_against_all(spark, shard):
    x = clustered(900, 24, 3)
    x[100:130] = x[100]
    df = table(spark, [(i, v.tolist()) for i, v in enumerate(x)] + odd_rows())
    got = multiindex.nearest(df, df.where("vec_id % 20 = 0"), k=20, depth=150, shard=shard, block=16).collect()
    lists = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        lists.setdefault(r.query_id, []).append(r)
    y = x.astype(np.float64)
    hit = total = 0
    for q in range(0, 900, 20):
        s = y @ y[q]
        order = [i for i in np.lexsort((np.arange(len(y)), -s)) if i != q][:20]
        own = lists[q]
        assert [r.rank for r in own] == list(range(1, len(own) + 1)) and all(math.isclose(r.score, s[r.vec_id], rel_tol=1e-12) for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hit += len({r.vec_id for r in own} & set(order))
        total += 20
    assert hit / total >= 0.9 and 9003 not in lists


def test_search_takes_all_when_there_are_few(spark):
    df = table(spark, [(i, [1.0, float(i)]) for i in range(5)] + [(0, [1.0, 0.0])])
    got = multiindex.nearest(df, df.where("vec_id = 0")).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert multiindex.nearest(df.limit(0), df).count() == 0


def test_index_meets_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (3000, 16), dtype=np.uint8)
    codes[:200] = codes[0] ^ np.packbits(rng.random((200, 128)) < 0.08, axis=1)
    index = multiindex.Index(codes)
    for i in (0, 7, 2000):
        away = np.bitwise_count(codes ^ codes[i]).sum(axis=1)
        rows = index.near(codes[i], 100)
        radius = np.sort(away)[99]
        assert set(rows.tolist()) == set(np.flatnonzero(away <= radius).tolist())


def test_vectors_that_share_an_id(spark):
    """Two vectors of id 1 and one each of 2 and 3, all linked: three links each; an unlinked vector of id 3 keeps to itself."""
    rows = [(1, [1.0, 0.0, 0.01]), (1, [1.0, 0.01, 0.0]), (2, [1.0, 0.02, 0.0]), (3, [1.0, 0.0, 0.02]), (3, [0.0, 1.0, 0.0]), (7, [0.0, 0.99, 0.01])]
    for most in (4096, 2):
        got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in crosspolytope.near_duplicates(table(spark, rows), tables=12, most=most).collect())
        assert got == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 1, 3, True), (3, 3, 1, False), (7, 1, 3, False)]
