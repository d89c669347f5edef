"""Stations from few tracks or none, walks that lead nowhere, styles that exclude each other."""

import pytest
from pyspark.sql import functions as F

from tracklens.operators import assembly, sequences, styles, walks

V = [[1.0, 0.0], [0.9, 0.1], [0.8, 0.3], [0.0, 1.0], [-1.0, 0.2]]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(V)), "vec_id long, v array<double>")


def stations(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.vec_id, {})[r.place] = r.track
    return {i: [x[p] for p in sorted(x)] for i, x in out.items()}


def test_few_tracks(rows):
    lists = assembly.shortlists(rows, 20)
    for fold in (assembly.novel(8), assembly.flowing(0)):
        got = stations(assembly._exploded(fold, lists))
        assert {i: sorted(x) for i, x in got.items()} == {i: [j for j in range(5) if j != i] for i in range(5)}
    assert stations(assembly._exploded(assembly.novel(1), lists))[0] == [1]  # the nearest comes first
    assert assembly._exploded(assembly.novel(8), assembly.shortlists(rows.limit(0), 20)).count() == 0
    one = assembly.shortlists(rows.where("vec_id < 2"), 20)
    assert stations(assembly._exploded(assembly.flowing(), one)) == {0: [1], 1: [0]}


def test_diverse_fills_up(spark):
    tracks = [{"place": i + 1, "id": i, "e": e, "m": 3, "c": 3} for i, e in enumerate([3, 3, 4, 4, 3, 3])]
    rows = spark.createDataFrame([(1, tracks), (2, tracks[:1])], "vec_id long, list array<struct<place int, id long, e int, m int, c int>>")
    assert stations(assembly._exploded(assembly.diverse(5), rows)) == {1: [0, 2, 4, 1, 3], 2: [0]}
    assert stations(assembly._exploded(assembly.diverse(2), rows)) == {1: [0, 2], 2: [0]}


def test_walks(spark):
    edges = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.5), (3, 1, 0.8), (8, 9, 0.9)], "vec_id long, neighbour long, similarity double")
    liked = spark.createDataFrame([(1, 0, 1.0), (2, 77, 1.0), (3, 0, 1.0), (3, 9, 2.0)], "listener int, track long, weight double")
    got = {(r.listener, r.track): r.score for r in walks.walked(edges, liked).collect()}
    # A path's similarity is the product of its edges, walked in either direction; favourites are left out, and a lost one leads nowhere.
    assert got == {(1, 1): 0.9, (1, 2): 0.45, (1, 3): 0.72, (3, 1): 0.9, (3, 2): 0.45, (3, 3): 0.72, (3, 8): 0.9}
    assert walks.walked(edges, liked.limit(0)).count() == 0 == walks.walked(edges.limit(0), liked).count()


def test_no_track_has_both(spark):
    rows = spark.range(200).select(F.explode(F.array(F.lit("fast_paced"), F.lit("slow_ambient"), F.lit("melodic"), F.lit("experimental"), F.lit("nostalgic"))).alias("persona"), F.col("id").alias("track"))
    score = F.when(F.col("persona") == "slow_ambient", F.floor(F.col("track") / 50)).otherwise(F.floor(F.col("track") / 20)).cast("double")
    got = {}
    for r in styles.resolved(rows.withColumn("score", score)).collect():
        got.setdefault(r.persona, set()).add(r.track)
    assert {p: len(x) for p, x in got.items()} == dict.fromkeys(("fast_paced", "slow_ambient", "melodic", "experimental", "nostalgic"), 40)
    assert not got["fast_paced"] & got["slow_ambient"] and not got["melodic"] & got["experimental"]


def test_training_counts_are_carried(spark):
    log = spark.createDataFrame([(t,) for t in [0] + [3700] * 30 + [7300] * 30 + [11000] * 10 + [200_000]], "s long").select(F.timestamp_seconds("s").alias("ts"))
    got = [(r.events, r.reason) for r in sequences.training_runs(log, 3600).orderBy("polled").collect()]
    assert got == [(1, "first"), (60, "events"), (10, "time"), (0, "time"), (1, "time")][: len(got)] and got[:3] == [(1, "first"), (60, "events"), (10, "time")]
    assert sequences.training_runs(log.limit(0), 3600).count() == 0
