"""Hard negatives against brute force in whole numbers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracklens.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>, norm string, uid int"


def slow(rows, anchor=lambda i: i % 10 == 0, k=5, m=10):
    sound = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in sound:
        if not anchor(a):
            continue
        scores = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, y) for i, y, w in sound if i != a and len(w) == len(v))
        for s, i, _ in [x for x in scores if x[2] == label][:k]:
            found = [x for x in scores if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:m]
            out += [(a, i, r + 1, x[1], -s, -x[0]) for r, x in enumerate(found)]
    return sorted(out)


def rows_of(draw, n, dim, spread):
    """Vectors of very different norms, ties and copies among them."""
    rows = []
    for i in range(n):
        size = math.exp(draw.gauss(0, spread))
        rows.append((i, draw.choice([0, 0, 0, 1, 2]), [round(size * draw.gauss(0.1, 1), 2) for _ in range(dim)]))
    for i in range(n, n + 30):
        rows.append((i, draw.randrange(3), rows[i % 4][2]))
    return rows


@pytest.mark.parametrize("spread", [0.0, 1.5])
@pytest.mark.parametrize("block", [negatives.BLOCK, 16])
def test_against_brute_force(spark, monkeypatch, spread, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "TILE", 500)
    draw = random.Random(5)
    rows = rows_of(draw, 150, 6, spread)
    rows += [(500, None, [1.0] * 6), (510, 1, None), (520, 1, []), (530, 1, [None] * 6), (540, 1, [float("nan")] * 6), (550, 1, [float("inf")] + [1.0] * 5), (560, 1, [0.0] * 6), (570, 1, [1.0, 2.0]), (571, 1, [1.5, 2.0]), (572, 0, [0.5, 1.0]), (None, 1, [1.0] * 6)]
    rows.append(rows[1])
    table = spark.createDataFrame([(*r, "n", 3) for r in rows], SCHEMA)
    got = negatives.hard_negatives(table, F.col("vec_id") % 10 == 0)
    wanted = slow(rows)
    assert sorted(map(tuple, got.collect())) == wanted
    assert len(wanted) > 300
    assert negatives.hard_negatives(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_large_numbers(spark):
    """Beyond 2**53 scores are computed in whole numbers."""
    draw = random.Random(2)
    rows = [(i, i % 2, [float(draw.randrange(1 << 19)) for _ in range(3)]) for i in range(24)]
    rows = [(i, y, [x * (1 if i % 3 else -0.5) for x in v]) for i, y, v in rows]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    wanted = slow(rows)
    assert sorted(map(tuple, negatives.hard_negatives(table, F.col("vec_id") % 10 == 0).collect())) == wanted and max(r[4] for r in wanted) > 2**53


def test_buckets_are_left_out(spark, monkeypatch):
    """Small vectors are far below the running last score of a large anchor."""
    monkeypatch.setattr(negatives, "BLOCK", 16)
    sent = []
    wave = negatives.NormBuckets.wave

    def watched(self, anchors, first, end, *rest):
        found = wave(self, anchors, first, end, *rest)
        sent.append((first, end, len({r.uid for r in found.select("uid").collect()})))
        return found

    monkeypatch.setattr(negatives.NormBuckets, "wave", watched)
    rows = [(i, i % 2, [10.0 / (1 + i), 1.0 / (1 + i)]) for i in range(160)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, negatives.hard_negatives(table, F.col("vec_id") == 0).collect())) == slow(rows, lambda i: i == 0)
    assert sum(n for first, _, n in sent if first > 1) == 0 < len([s for s in sent if s[0] > 1])


def test_plans_grow_with_the_buckets(spark, monkeypatch):
    """A condition on the block must not hold the expressions of all buckets once for each of them: the driver keeps and compiles it."""
    monkeypatch.setattr(negatives, "BLOCK", 16)
    size = {}
    for buckets in (4, 64):
        rows = spark.range(16 * buckets).select(F.col("id").alias("uid"), F.sqrt("id").alias("norm"))
        space = negatives.NormBuckets(rows)
        assert len(space.known) == buckets and sum(members for _, members, _ in space.known) == 16 * buckets
        assert [top for _, _, top in space.known] == sorted((top for _, _, top in space.known), reverse=True)
        size[buckets] = len(space.rows.where("bucket IS NOT NULL AND block IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString())
    assert size[64] < 16 * size[4]
