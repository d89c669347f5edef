"""Degrees of the whole neighbour graph against brute force."""

import numpy as np

from tracklens.operators import stations


def test_degrees(spark):
    v = np.random.default_rng(2).standard_normal((57, 8))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    close = np.round(unit @ unit.T, 6)
    np.fill_diagonal(close, -9)
    wanted = np.bincount(np.argsort(-close, axis=1, kind="stable")[:, :1].ravel(), minlength=57)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    got = {r.vec_id: r.degree for r in stations.degrees(rows, 1).collect()}
    assert got == dict(enumerate(wanted.tolist())) and sum(got.values()) == 57 and 0 in got.values()


def test_whole_graph(spark):
    got = stations.neighbour_graph_degrees(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 500 and sum(r.degree for r in got) == 5 * 500
