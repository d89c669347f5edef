"""The compact export and the rating model: round trips, and what later records change."""

import numpy as np
import pytest

from tracklens.operators import deterministic
from tracklens.operators.vectors import neighbours
from tracklens.sources import lite

SCHEMA = "vec_id long, v array<double>, e int, m int, c int, p int, path string, more int"


def test_lite_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lite, "BLOCK", 50)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((333, 7)) * [1, 2, 3, 0.1, 1, 1, 0]
    rows = [(i * 10**12, x.tolist(), i % 5 + 1, 1, 5, None if i % 4 else 3, None if i % 9 == 0 else f"/a/é{i // 3}.sid", 1) for i, x in enumerate(v)]
    lite.write_lite(spark.createDataFrame(rows, SCHEMA).repartition(4), str(tmp_path / "x"))
    got = {r.vec_id: r for r in lite.read_lite(spark, str(tmp_path / "x")).collect()}
    books = np.array([r.levels for r in spark.read.parquet(str(tmp_path / "x/codebooks")).orderBy("i").collect()])
    assert len(got) == len(rows)
    for r in rows:
        back = got[r[0]]
        assert tuple(back[c] for c in ("e", "m", "c", "p", "path")) == r[2:7]
        # Each element is the nearest of its levels.
        assert np.abs(np.array(back.v) - r[1]) == pytest.approx(np.abs(books - np.array(r[1])[:, None]).min(axis=1), abs=1e-12)
    some = lite.read_lite(spark, str(tmp_path / "x"), ["path", "e"])
    assert some.columns == ["path", "e"] and sorted(map(tuple, some.collect()), key=repr) == sorted(((r[6], r[2]) for r in rows), key=repr)
    assert "codes" not in some._jdf.queryExecution().executedPlan().toString()


def test_lite_recall(spark, tmp_path):
    """Most of the 25 nearest stay the 25 nearest in four bits an element."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((20, 24))[rng.integers(0, 20, 600)] + 0.7 * rng.standard_normal((600, 24))
    rows = spark.createDataFrame([(i, x.tolist(), 1, 1, 1, 1, "p", 1) for i, x in enumerate(v)], SCHEMA)
    lite.write_lite(rows, str(tmp_path / "x"))
    back = lite.read_lite(spark, str(tmp_path / "x"), ["vec_id", "v"])
    near, far = ({(r.vec_id, r.neighbour) for r in neighbours(t, t, 25).collect()} for t in (rows.select("vec_id", "v"), back))
    assert len(near & far) / len(near) > 0.8


def test_later_records_change_nothing(spark, tmp_path):
    records = deterministic.measured(spark, "/root/testdata/sf0.001")
    deterministic.fitted(records.where("vec_id % 2 = 0")).write.parquet(str(tmp_path / "model"))
    model = spark.read.parquet(str(tmp_path / "model"))
    before = {r.vec_id: (r.c, r.e, r.m) for r in deterministic.rated_by(records.where("vec_id % 2 = 0"), model).collect()}
    after = {r.vec_id: (r.c, r.e, r.m) for r in deterministic.rated_by(records, model).collect()}
    assert before.items() <= after.items() and len(after) == records.count()
    counts = np.bincount([c for c, _, _ in before.values()], minlength=6)[1:]
    assert counts.min() > 0.15 * len(before)  # five even levels
    few = records.where("vec_id < 40")
    got = deterministic.rated_by(few, deterministic.fitted(few)).collect()
    assert all(r.e == int(1.5 + 4 * r.raw_e) for r in got)  # too few for breakpoints
    same = few.withColumn("rms", deterministic.F.lit(0.0))
    assert deterministic.fitted(same).first().sd_rms is None
