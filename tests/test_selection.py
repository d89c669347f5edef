"""Neighbours by cells, pruned selection, reverse insertion and the navigable graph against plain versions."""

import numpy as np
import pytest

from tracklens.operators import navigable, selection, vectors

SLOTS, ALPHA = 3, 1500


def clustered(seed=1, groups=12, each=40, dim=8, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    return np.concatenate([c + spread * rng.standard_normal((each, dim)) for c in centres])


def table(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")


def similarities(v):
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    return np.round(u @ u.T, 6)


def plain_neighbours(s, k):
    return {(i, j, n + 1) for i in range(len(s)) for n, j in enumerate(sorted((x for x in range(len(s)) if x != i), key=lambda x: (-s[i, x], x))[:k])}


@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_neighbours_of_many_cells(spark, monkeypatch, spread):
    v = np.concatenate([clustered(spread=spread), clustered(spread=spread)[:5], np.zeros((2, 8))])
    met = []
    best = vectors._best

    def watched(queries, rows, k):
        met.append(len(queries) * len(rows))
        return best(queries, rows, k)

    monkeypatch.setattr(vectors, "BLOCK", 37)
    rows = table(spark, v)
    got = vectors.neighbours(rows, rows, 4, cell_rows=40)
    s = similarities(v)
    assert {(r.vec_id, r.neighbour, r.place) for r in got.collect()} == plain_neighbours(s, 4)
    some = rows.where("vec_id < 9")
    assert {(r.vec_id, r.neighbour, r.place) for r in vectors.neighbours(some, rows, 4, cell_rows=40).collect()} == {x for x in plain_neighbours(s, 4) if x[0] < 9}
    assert vectors.neighbours(rows, rows.limit(0), 4).count() == 0 == vectors.neighbours(rows.limit(0), rows, 4).count()


def plain_rule(order, s, slots):
    keep = []
    d = lambda a, b: 1_000_000 - round(s[a, b] * 1e6)
    for seed, c in order:
        if len(keep) < slots and not any(ALPHA * d(k, c) <= 1000 * d(seed, c) for k in keep):
            keep.append(c)
    return keep + [c for _, c in order if c not in keep][: slots - len(keep)]


def plain_graph(s, pool, reverse):
    n = len(s)
    near = {i: [] for i in range(n)}
    for i, j, _ in sorted(plain_neighbours(s, pool), key=lambda x: (x[0], x[2])):
        near[i].append(j)
    rows = {i: plain_rule([(i, c) for c in near[i]], s, SLOTS) for i in range(n)}
    if reverse:
        offers = {i: [] for i in range(n)}
        for i, row in rows.items():
            for j in row:
                offers[j].append(i)
        for i, sources in offers.items():
            more = [x for x in sources if x not in rows[i]]
            if more and len(rows[i]) + len(more) <= SLOTS:
                rows[i] = rows[i] + more
            elif more:
                rows[i] = plain_rule([(i, c) for c in sorted(rows[i] + more, key=lambda c: (-s[i, c], c))], s, SLOTS)
    return {(i, j) for i, row in rows.items() for j in row}


@pytest.mark.parametrize("rounds", [selection.ROUND, 2])
def test_selected(spark, monkeypatch, rounds):
    """Hubs are offered more edges than a round looks at."""
    monkeypatch.setattr(selection, "ROUND", rounds)
    v = clustered(each=15, spread=0.4)
    s = similarities(v)
    rows = table(spark, v)
    assert {(r.vec_id, r.neighbour) for r in selection.selected(rows, pool=8, reverse=False).collect()} == plain_graph(s, 8, False)
    assert {(r.vec_id, r.neighbour) for r in selection.selected(rows, pool=8).collect()} == plain_graph(s, 8, True)


def test_candidate_recall(spark):
    """Where signatures follow the vectors, a small share of all rows holds nearly all neighbours."""
    rng = np.random.default_rng(3)
    v = np.concatenate([np.repeat(rng.standard_normal((300, 4)) / 8, 10, axis=0), np.zeros((3000, 4))], axis=1)
    v += 0.01 * rng.standard_normal(v.shape)
    rows = table(spark, v)
    got = {(r.vec_id, r.neighbour) for r in selection.approximate_neighbours(rows, 9, limit=256).collect()}
    u = similarities(v)
    np.fill_diagonal(u, -9)
    wanted = {(i, int(j)) for i in range(len(v)) for j in np.argsort(-u[i], kind="stable")[:9]}
    assert len(got & wanted) / len(wanted) > 0.9


@pytest.mark.parametrize("cell", [64, 4096])
def test_navigable(spark, cell):
    v = clustered()
    s = similarities(v)
    rows = table(spark, v)
    edges = navigable.navigable(rows, cell=cell).cache()
    got = {(r.vec_id, r.neighbour): r.similarity for r in edges.collect()}
    degree = np.bincount([a for a, _ in got], minlength=len(v))
    assert degree.max() <= SLOTS and degree.min() >= 2 and all(a != b for a, b in got)
    assert all(abs(x - s[a, b]) < 2e-6 for (a, b), x in got.items())
    # Nothing is left that no edge points at, and the nearest two are kept but for edges that such rows were given.
    assert {b for _, b in got} == set(range(len(v)))
    nearest = {(i, j) for i, j, n in plain_neighbours(s, 2)}
    assert nearest <= set(got)
    walks = navigable.routed(edges, rows, rows.where("vec_id % 10 = 0").select("vec_id")).collect()
    plain = navigable.routed(selection.selected(rows, pool=8), rows, rows.where("vec_id % 10 = 0").select("vec_id")).collect()
    assert len(walks) == 48
    # Long edges let walks leave the group they start in.
    assert sum(r.hops for r in walks) > sum(r.hops for r in plain)
    assert sum(r.found for r in walks) >= sum(r.found for r in plain)


def test_build_is_reproducible():
    u = clustered(each=10)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    graph = navigable.built(u)
    assert (graph == navigable.built(u)).all()
    assert all(len(set(row[row >= 0].tolist())) == (row >= 0).sum() for row in graph)
    assert navigable.built(u[:2]).tolist() == [[1, -1, -1], [0, -1, -1]]


@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_neighbours_travel_in_few_pieces(spark, monkeypatch, spread):
    """With many cells, slabs and parts the exact neighbours come out, and a task is given a part and a slab as bytes, not a row for each
    query and cell."""
    v = np.concatenate([clustered(spread=spread), clustered(spread=spread)[:5], np.zeros((2, 8))])
    for name, value in (("BLOCK", 16), ("SLAB", 100), ("PART", 64)):
        monkeypatch.setattr(vectors, name, value)
    rows, s = table(spark, v), similarities(v)
    for queries in (rows, rows.where("vec_id % 3 = 0")):
        got = {(r.vec_id, r.neighbour, r.place) for r in vectors.neighbours(queries, rows, 6, cell_rows=40).collect()}
        wanted = {r.vec_id for r in queries.collect()}
        assert got == {x for x in plain_neighbours(s, 6) if x[0] in wanted}
    own, x = np.arange(len(v)), v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    best, names = vectors._best(own, x, np.full(len(v), -2.0), iter([(own[:200], x[:200], None, 0.0), (own[200:], x[200:], None, 0.0)]), 6)
    assert {(i, int(j), n + 1) for i in range(len(v)) for n, j in enumerate(names[i])} == plain_neighbours(s, 6) and (best > -9).all()


def test_neighbours_come_one_block_at_a_time(spark, monkeypatch):
    """Each part reads the table as a stream of blocks, in single precision where that says the same, and lists with vectors need no join."""
    v = np.float32(clustered(spread=3.0)).astype(float)
    v[-1] += 1e-9  # not in single precision
    for name, value in (("BLOCK", 16), ("PART", 64)):
        monkeypatch.setattr(vectors, name, value)
    rows, s, seen = table(spark, v), similarities(v), []

    def finish(own, sims, ids, near):
        import pandas as pd

        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        return pd.DataFrame({"vec_id": own, "ids": ids.tolist(), "same": np.abs(near - u[ids]).max(axis=(1, 2)) < 1e-12})

    got = vectors.neighbours(rows, rows, 5, cell_rows=40, finish=finish, kind="vec_id long, ids array<long>, same boolean", carry=True).collect()
    assert {(r.vec_id, j, n + 1) for r in got for n, j in enumerate(r.ids)} == plain_neighbours(s, 5) and all(r.same for r in got)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)

    def blocks():
        for at in range(0, len(u), 16):
            seen.append(at)
            yield np.arange(at, at + 16), u[at : at + 16], None, 0.0, v[at : at + 16]

    held = []
    best, names = vectors._best(np.arange(len(u)), u, np.full(len(u), -2.0), blocks(), 5, held)
    assert {(i, int(j), n + 1) for i in range(len(u)) for n, j in enumerate(names[i])} == plain_neighbours(s, 5)
    assert (held[0] == v[names]).all() and len(seen) == len(u) / 16
    alike = np.ones((600, 4)) / 2  # equal vectors: the smallest ids
    best, names = vectors._best(np.arange(600), alike, np.full(600, -2.0), iter([(np.arange(at, at + 200), alike[:200], None, 0.0) for at in (400, 0, 200)]), 3)
    assert names[[0, 1, 599]].tolist() == [[1, 2, 3], [0, 2, 3], [0, 1, 2]] and (best == 1).all()
