"""The learnt metric: gradients, reruns, held-out triplets, versions."""

import numpy as np
import pytest

from tracklens.operators import training


def labelled(spark, parts=3):
    """Vectors of which only four elements tell the label; the others are larger."""
    rng = np.random.default_rng(9)
    labels = rng.integers(0, 4, 240)
    v = np.concatenate([np.eye(4)[labels] * 0.8 + 0.25 * rng.standard_normal((240, 4)), 0.5 * rng.standard_normal((240, 8))], axis=1)
    return spark.createDataFrame([(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, labels, strict=True))], "vec_id long, v array<double>, label int").repartition(parts)


def test_gradient():
    rng = np.random.default_rng(1)
    metric = training.Metric.fresh(5, 3)
    a, p, n = rng.standard_normal((3, 4, 5))
    loss, grads = metric.gradient(a, p, n)
    x, step = metric.flat(), 1e-6
    for i in range(0, len(x), 7):
        moved = [training.Metric.of(x + s * step * (np.arange(len(x)) == i), 5).gradient(a, p, n)[0] for s in (1, -1)]
        assert (moved[0] - moved[1]) / (2 * step) == pytest.approx(grads[:, i], abs=1e-4)
    assert (loss >= 0).all() and (grads[loss == 0] == 0).all()


def test_learning_is_reproducible_and_helps(spark, tmp_path):
    rows = labelled(spark).cache()
    every = training.triplets(rows).cache()
    fit, holdout = every.where("anchor % 5 != 0"), every.where("anchor % 5 = 0")
    metric, losses = training.learnt(rows, fit, epochs=12)
    assert losses[-1] < losses[0]
    again, _ = training.learnt(rows.repartition(7), fit.repartition(5), epochs=12)
    assert (again.flat() == metric.flat()).all()
    after = training.transformed(rows, metric)
    found = training.gates(rows.select("vec_id", "v"), after, holdout)
    got = {r.metric: r for r in found.collect()}
    assert got["feedback_correlation"].value > 0 and got["feedback_correlation"].passed and got["diversity"].value == 1.0
    assert training.promotes(found) == (sum(r.passed for r in got.values()) >= 3)
    path = str(tmp_path / "models")
    training.save(training.Metric.fresh(12, 1), spark, path, 1, promoted=False)
    assert training.champion(spark, path) is None
    training.save(metric, spark, path, 2, promoted=True)
    training.save(training.Metric.fresh(12, 2), spark, path, 3, promoted=False)
    version, best = training.champion(spark, path)
    assert version == 2 and (best.flat() == metric.flat()).all()
    with pytest.raises(Exception, match="already exists"):
        training.save(metric, spark, path, 2, promoted=True)
    none = training.learnt(rows, fit.limit(0))
    assert none[1] == []


def test_weights(spark):
    rows = labelled(spark)
    w = {r.i: r.weight for r in training.element_weights(rows).collect()}
    assert min(w[i] for i in range(4)) > 3 * max(w[i] for i in range(4, 12)) and sum(w.values()) == pytest.approx(12, abs=1e-6)


def test_gates_search_once_and_leave_out_what_is_not_asked(spark, monkeypatch):
    """The neighbours of the held-out anchors are sought once, for these alone, and no cluster where no diversity is asked for."""
    asked, search = [], training.neighbours

    def watched(queries, rows, k):
        asked.append(queries.count())
        return search(queries, rows, k)

    monkeypatch.setattr(training, "neighbours", watched)
    monkeypatch.setattr(training, "_diversity", lambda *_: pytest.fail("not asked for"))
    found = training.challenger_gates(spark, "/root/testdata/sf0.001").collect()
    assert {r.metric for r in found} == set(training.GATES) - {"diversity"} and asked == [spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id % 5 = 0").count()]
