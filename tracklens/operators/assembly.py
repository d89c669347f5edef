"""Stations that are put together one track after the other: novelty, flow, diversity, and moods that change."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.operators.catalogue import CALIBRATED, calibrated_ratings
from tracklens.operators.feedback import FEEDBACK_TOTALS, feedback_totals
from tracklens.operators.selection import _SIGNED, signed
from tracklens.operators.stations import MOODS
from tracklens.operators.vectors import neighbours, vectors
from tracklens.plans.define import family

QUERIES, ORACLES, query = family()

#: Tracks of a station, and of the shortlist that it is chosen from.
SIZE, SHORTLIST = 8, 20
#: What relevance weighs against novelty (in tenths), continuity against score (in hundredths), the least distance
#: between tracks that follow each other (its square), and the share of the shortlist that adventure opens.
LAMBDA, CONTINUITY, APART, ADVENTURE = 7, 72, 1, 5


def shortlists(rows: DataFrame, size: int = SHORTLIST) -> DataFrame:
    """vec_id, list: for each of ``rows`` (vec_id, v) its ``size`` nearest in order, as (place, id, s, between): similarity to
    the seed and to each of the list, in millionths. Lists are bounded, so each seed is a row and all are worked on at once."""

    def listed(own: np.ndarray, sims: np.ndarray, ids: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        between, s = (np.rint(np.round(x, 6) * 1e6).astype(np.int64) for x in (v @ v.transpose(0, 2, 1), sims))
        many = (sims > -9).sum(axis=1).tolist()
        lists = [[{"place": c + 1, "id": ids[i, c], "s": s[i, c], "between": between[i, c, :n].tolist()} for c in range(n)] for i, n in enumerate(many)]
        some = np.flatnonzero(many)
        return pd.DataFrame({"vec_id": own[some], "list": [lists[i] for i in some]})

    return neighbours(rows, rows, size, finish=listed, kind="vec_id long, list array<struct<place int, id long, s long, between array<long>>>", carry=True)


def _exploded(chosen: Column, rows: DataFrame) -> DataFrame:
    found = rows.select("vec_id", F.posexplode(chosen).alias("at", "x"))
    return found.select("vec_id", (F.col("at") + 1).alias("place"), F.col("x.id").alias("track"))


def novel(size: int = SIZE) -> Column:
    """The fold that builds a station of ``size`` from ``list``: each next track has the most of 0.7 of its nearness to the
    seed and 0.3 of its distance from the nearest chosen one; ties go to the nearer to the seed."""

    def step(chosen: Column, _: Column) -> Column:
        def score(x: Column) -> Column:
            nearest = F.array_min(F.transform(chosen, lambda c: 1_000_000 - x["between"][c["place"] - 1]))
            return F.struct((-LAMBDA * (1_000_000 - x["s"]) + (10 - LAMBDA) * F.coalesce(nearest, F.lit(0))).alias("score"), (-x["place"]).alias("first"), x.alias("x"))

        rest = F.filter("list", lambda x: ~F.exists(chosen, lambda c: c["place"] == x["place"]))
        best = F.array_max(F.transform(rest, score))
        return F.when(F.size(rest) > 0, F.concat(chosen, F.array(best["x"]))).otherwise(chosen)

    return F.aggregate(F.sequence(F.lit(1), F.lit(size)), F.filter("list", lambda x: F.lit(False)), step)


def _draw(at: Column, many: Column) -> Column:
    """A seeded number below ``many`` for each seed and step."""
    return F.floor(F.pmod(F.col("vec_id") * 7919 + at * 104729, F.lit(1000)) * many / 1000).cast("int")


def flowing(adventure: int = ADVENTURE) -> Column:
    """The fold that orders ``list``: first the best score, then each time one of the 1 + adventure / 2 tracks with the most of
    0.72 of the likeness to the last and 0.28 of the score, drawn by a number of seed and step."""

    def step(chosen: Column, at: Column) -> Column:
        last = F.element_at(chosen, -1)
        rest = F.filter("list", lambda x: ~F.exists(chosen, lambda c: c["place"] == x["place"]))
        scored = F.array_sort(F.transform(rest, lambda x: F.struct((-(CONTINUITY * x["between"][last["place"] - 1] + (100 - CONTINUITY) * x["s"])).alias("blended"), (-x["s"]).alias("s"), x["place"].alias("place"), x.alias("x"))))
        pick = F.element_at(scored, 1 + _draw(at, F.least(F.size(rest), F.lit(max(1, 1 + adventure // 2)))))
        return F.concat(chosen, F.array(pick["x"]))

    rest = F.when(F.size("list") > 1, F.sequence(F.lit(2), F.size("list"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rest, F.slice("list", 1, 1), step)


_LISTS = f"""n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM n a JOIN n b ON a.vec_id != b.vec_id),
near AS (SELECT vec_id, neighbour, CAST(round(similarity * 1e6) AS BIGINT) AS s, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS INTEGER) AS place FROM s QUALIFY place <= {SHORTLIST}),
b AS (SELECT x.vec_id, x.place, list(CASE WHEN x.neighbour = y.neighbour THEN 1000000 ELSE CAST(round(similarity * 1e6) AS BIGINT) END ORDER BY y.place) AS between_
  FROM near x JOIN near y ON y.vec_id = x.vec_id LEFT JOIN s ON s.vec_id = x.neighbour AND s.neighbour = y.neighbour GROUP BY x.vec_id, x.place),
l AS (SELECT near.*, between_ FROM near JOIN b USING (vec_id, place))"""


@query(f"""WITH RECURSIVE {_LISTS}, g AS (SELECT DISTINCT vec_id, 0 AS step, []::INTEGER[] AS chosen FROM near UNION ALL
  SELECT g.vec_id, g.step + 1, list_append(any_value(g.chosen), list(l.place ORDER BY -{LAMBDA} * (1000000 - s) + {10 - LAMBDA} * coalesce(list_min(list_transform(g.chosen, lambda c: 1000000 - l.between_[c])), 0) DESC, l.place)[1])
  FROM g JOIN l ON l.vec_id = g.vec_id AND NOT list_contains(g.chosen, l.place) WHERE g.step < {SIZE} GROUP BY g.vec_id, g.step),
c AS (SELECT vec_id, unnest(chosen) AS at, generate_subscripts(chosen, 1) AS place FROM g WHERE step = {SIZE})
SELECT c.vec_id, CAST(c.place AS INTEGER) AS place, neighbour AS track FROM c JOIN near ON near.vec_id = c.vec_id AND near.place = c.at""")
def novel_stations(spark, sf_dir):
    """A station of 8 for every seed that balances nearness with novelty."""
    return _exploded(novel(), shortlists(vectors(spark, sf_dir).select("vec_id", "v")))


@query(f"""WITH RECURSIVE {_LISTS}, z AS (SELECT vec_id, CAST(count(*) AS INTEGER) AS n FROM near GROUP BY vec_id), g AS (SELECT vec_id, 1 AS step, [1]::INTEGER[] AS chosen FROM z UNION ALL
  SELECT g.vec_id, g.step + 1, list_append(any_value(g.chosen), list(l.place ORDER BY {CONTINUITY} * l.between_[g.chosen[-1]] + {100 - CONTINUITY} * s DESC, s DESC, l.place)
    [1 + CAST(floor((g.vec_id * 7919 + (g.step + 1) * 104729) % 1000 * least(count(*), {1 + ADVENTURE // 2}) / 1000) AS INTEGER)])
  FROM g JOIN l ON l.vec_id = g.vec_id AND NOT list_contains(g.chosen, l.place) GROUP BY g.vec_id, g.step),
c AS (SELECT g.vec_id, unnest(chosen) AS at, generate_subscripts(chosen, 1) AS place FROM g JOIN z ON z.vec_id = g.vec_id AND g.step = z.n)
SELECT c.vec_id, CAST(c.place AS INTEGER) AS place, neighbour AS track FROM c JOIN near ON near.vec_id = c.vec_id AND near.place = c.at""")
def flowing_stations(spark, sf_dir):
    """The shortlist of every seed in an order in which tracks follow from each other."""
    return _exploded(flowing(), shortlists(vectors(spark, sf_dir).select("vec_id", "v")))


def diverse(size: int = SIZE, apart: int = APART) -> Column:
    """The fold over ``list`` (place, id, e, m, c): a track goes behind the last kept one if its ratings are ``apart`` (squared) from
    that one's; where too few are left, those left out fill up in order."""

    def away(x: Column, y: Column) -> Column:
        return sum(((x[r] - y[r]) * (x[r] - y[r]) for r in "emc"), F.lit(0))

    none = F.filter("list", lambda x: F.lit(False))
    both = F.struct(F.slice("list", 1, 1).alias("kept"), none.alias("left"))

    def step(state: Column, x: Column) -> Column:
        far = away(x, F.element_at(state["kept"], -1)) >= apart
        return F.struct(F.when(far, F.concat(state["kept"], F.array(x))).otherwise(state["kept"]).alias("kept"), F.when(far, state["left"]).otherwise(F.concat(state["left"], F.array(x))).alias("left"))

    return F.aggregate(F.slice("list", 2, F.greatest(F.size("list") - 1, F.lit(0))), both, step, lambda s: F.slice(F.concat(s["kept"], s["left"]), 1, size))


@query(f"""WITH RECURSIVE {_SIGNED}, {_LISTS}, t AS (SELECT near.vec_id, near.place, e, m, c FROM near JOIN r ON r.vec_id = near.neighbour),
g AS (SELECT vec_id, 1 AS step, [1]::INTEGER[] AS kept, []::INTEGER[] AS out_, e, m, c FROM t WHERE place = 1 UNION ALL
  SELECT g.vec_id, t.place, CASE WHEN far THEN list_append(kept, t.place) ELSE kept END, CASE WHEN far THEN out_ ELSE list_append(out_, t.place) END,
    CASE WHEN far THEN t.e ELSE g.e END, CASE WHEN far THEN t.m ELSE g.m END, CASE WHEN far THEN t.c ELSE g.c END
  FROM (SELECT g.*, (t.e - g.e) ** 2 + (t.m - g.m) ** 2 + (t.c - g.c) ** 2 >= {APART} AS far FROM g JOIN t ON t.vec_id = g.vec_id AND t.place = g.step + 1) g JOIN t ON t.vec_id = g.vec_id AND t.place = g.step + 1),
f AS (SELECT vec_id, arg_max(list_concat(kept, out_), step)[1:{SIZE}] AS chosen FROM g GROUP BY vec_id), c AS (SELECT vec_id, unnest(chosen) AS at, generate_subscripts(chosen, 1) AS place FROM f)
SELECT c.vec_id, CAST(c.place AS INTEGER) AS place, neighbour AS track FROM c JOIN near ON near.vec_id = c.vec_id AND near.place = c.at""")
def diverse_stations(spark, sf_dir):
    """A station of 8 for every seed in which tracks that follow each other differ in their ratings."""
    rows = vectors(spark, sf_dir).select("vec_id", "v")
    rated = signed(rows).select(F.col("vec_id").alias("neighbour"), "e", "m", "c")
    near = neighbours(rows, rows, SHORTLIST).join(rated, "neighbour")
    lists = near.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("neighbour").alias("id"), "e", "m", "c"))).alias("list"))  # SHORTLIST at most
    return _exploded(diverse(), lists)


#: Steps between two moods; tracks near a step that are looked up, and that are weighed.
STEPS, LOOKED_UP, WEIGHED = 7, 100, 20
_PAIRS = [(a, b) for a in MOODS for b in MOODS if a != b]


def mood_targets() -> list[tuple]:
    """start, end, step, and the mood of the step times STEPS - 1, so that all are whole numbers."""
    return [(a, b, i, *[MOODS[a][d] * (STEPS - 1 - i) + MOODS[b][d] * i for d in range(3)]) for a, b in _PAIRS for i in range(STEPS)]


def mood_paths_between(tracks: DataFrame, likes: DataFrame) -> DataFrame:
    """first_mood, last_mood, step, track, e, m, c: for every two moods one track for each step between them.

    ``tracks`` (track, e, m, c), ``likes`` (track, likes, dislikes). A step's candidates are the LOOKED_UP nearest within 1 of it in
    every rating, of these the WEIGHED best by nearness and likes; one that is not yet used is taken, by the same less half of
    the jump from the track before. Ratings are whole, so only the first LOOKED_UP tracks of each combination can be
    among the nearest: they leave the tasks, the rest don't.
    """
    n = STEPS - 1
    turn = F.row_number().over(Window.partitionBy("e", "m", "c").orderBy("track"))
    first = tracks.withColumn("turn", turn).where(F.col("turn") <= LOOKED_UP).drop("turn")
    first = first.join(likes, "track", "left").fillna(0, ["likes", "dislikes"])
    targets = tracks.sparkSession.createDataFrame(mood_targets(), "first_mood string, last_mood string, step int, te int, tm int, tc int")  # 210 rows
    inside = [F.abs(F.col(r) * n - F.col(f"t{r}")) <= n for r in "emc"]
    met = first.join(F.broadcast(targets), inside[0] & inside[1] & inside[2])
    away = sum(((F.col(r) * n - F.col(f"t{r}")) * (F.col(r) * n - F.col(f"t{r}")) for r in "emc"), F.lit(0))
    met = met.withColumn("away", away)
    by = ["first_mood", "last_mood", "step"]
    met = met.withColumn("near", F.row_number().over(Window.partitionBy(*by).orderBy("away", "track"))).where(F.col("near") <= LOOKED_UP)
    merit = F.round(1 / (F.sqrt("away") / n + 0.1) + F.col("likes") * 0.1 - F.col("dislikes") * 0.05, 9)
    met = met.withColumn("merit", merit).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("merit"), "track"))).where(F.col("place") <= WEIGHED)
    steps = met.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "merit", "track", "e", "m", "c"))).alias("list"))
    pairs = steps.groupBy("first_mood", "last_mood").agg(F.array_sort(F.collect_list(F.struct("step", "list"))).alias("steps"))

    def take(chosen: Column, at: Column) -> Column:
        last = F.get(chosen, F.size(chosen) - 1)
        rest = F.filter(at["list"], lambda x: ~F.exists(chosen, lambda c: c["track"] == x["track"]))

        def score(x: Column) -> Column:
            jump = F.sqrt(sum(((x[r] - last[r]) * (x[r] - last[r]) for r in "emc"), F.lit(0)).cast("double"))
            return F.struct(F.round(x["merit"] - 0.5 * F.coalesce(jump, F.lit(0.0)), 9).alias("score"), (-x["place"]).alias("first"), x.alias("x"))

        best = F.array_max(F.transform(rest, score))["x"]
        taken = F.struct(at["step"].alias("step"), *[best[c].alias(c) for c in ("track", "e", "m", "c")])
        return F.when(F.size(rest) > 0, F.concat(chosen, F.array(taken))).otherwise(chosen)

    kind = F.from_json(F.lit("[]"), f"array<struct<step:int,track:{dict(tracks.dtypes)['track']},e:{dict(tracks.dtypes)['e']},m:{dict(tracks.dtypes)['m']},c:{dict(tracks.dtypes)['c']}>>")
    path = F.explode(F.aggregate("steps", kind, take)).alias("x")
    return pairs.select("first_mood", "last_mood", path).select("first_mood", "last_mood", "x.*")


_TARGETS = ", ".join(f"('{a}', '{b}', {', '.join(map(str, rest))})" for a, b, *rest in mood_targets())
_PATHS = f"""t AS (SELECT l_partkey AS track, e, m, c, coalesce(likes, 0) AS likes, coalesce(dislikes, 0) AS dislikes FROM ({CALIBRATED}) x LEFT JOIN ({FEEDBACK_TOTALS}) y ON y.track = x.l_partkey),
met AS (SELECT *, (e * 6 - te) ** 2 + (m * 6 - tm) ** 2 + (c * 6 - tc) ** 2 AS away FROM t, (VALUES {_TARGETS}) z(first_mood, last_mood, step, te, tm, tc) WHERE abs(e * 6 - te) <= 6 AND abs(m * 6 - tm) <= 6 AND abs(c * 6 - tc) <= 6),
near AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY first_mood, last_mood, step ORDER BY away, track) <= {LOOKED_UP}),
w AS (SELECT *, round(1 / (sqrt(away) / 6 + 0.1::DOUBLE) + likes * 0.1::DOUBLE - dislikes * 0.05::DOUBLE, 9) AS merit FROM near),
p AS (SELECT *, row_number() OVER (PARTITION BY first_mood, last_mood, step ORDER BY merit DESC, track) AS place FROM w QUALIFY place <= {WEIGHED}),
g AS (SELECT DISTINCT first_mood, last_mood, -1 AS step, []::STRUCT(step INTEGER, track BIGINT, e BIGINT, m BIGINT, c BIGINT)[] AS chosen FROM p UNION ALL
  SELECT g.first_mood, g.last_mood, g.step + 1, list_concat(any_value(g.chosen), coalesce(list({{'step': p.step, 'track': p.track::BIGINT, 'e': p.e::BIGINT, 'm': p.m::BIGINT, 'c': p.c::BIGINT}}
    ORDER BY round(merit - 0.5::DOUBLE * coalesce(sqrt((p.e - g.chosen[-1].e) ** 2 + (p.m - g.chosen[-1].m) ** 2 + (p.c - g.chosen[-1].c) ** 2), 0), 9) DESC, place) FILTER (p.track IS NOT NULL), [])[1:1])
  FROM g LEFT JOIN p ON p.first_mood = g.first_mood AND p.last_mood = g.last_mood AND p.step = g.step + 1 AND NOT list_contains(list_transform(g.chosen, lambda x: x.track), p.track) WHERE g.step < {STEPS - 1} GROUP BY g.first_mood, g.last_mood, g.step),
paths AS (SELECT first_mood, last_mood, unnest(chosen, recursive := true) FROM g WHERE step = {STEPS - 1})"""


def _paths(spark, sf_dir) -> DataFrame:
    tracks = calibrated_ratings(spark, sf_dir).select(F.col("l_partkey").alias("track"), "e", "m", "c")
    return mood_paths_between(tracks, feedback_totals(spark, sf_dir).select("track", "likes", "dislikes"))


@query(f"WITH RECURSIVE {_PATHS} SELECT first_mood, last_mood, step, track, e, m, c FROM paths")
def mood_transitions(spark, sf_dir):
    """Tracks that lead from each mood to each other."""
    return _paths(spark, sf_dir)


@query(f"""WITH RECURSIVE {_PATHS}, j AS (SELECT *, sqrt((e - lag(e) OVER w) ** 2 + (m - lag(m) OVER w) ** 2 + (c - lag(c) OVER w) ** 2) AS jump FROM paths WINDOW w AS (PARTITION BY first_mood, last_mood ORDER BY step))
SELECT first_mood, last_mood, count(*) AS tracks, round(coalesce(sum(jump), 0), 6) AS length, round(coalesce(max(jump), 0), 6) AS longest FROM j GROUP BY first_mood, last_mood""")
def mood_path_lengths(spark, sf_dir):
    """How far the ways between moods are, and their longest jump."""
    before = Window.partitionBy("first_mood", "last_mood").orderBy("step")
    jump = F.sqrt(sum(((F.col(r) - F.lag(r).over(before)) * (F.col(r) - F.lag(r).over(before)) for r in "emc"), F.lit(0)).cast("double"))
    rows = _paths(spark, sf_dir).withColumn("jump", jump)
    return rows.groupBy("first_mood", "last_mood").agg(F.count("*").alias("tracks"), F.round(F.coalesce(F.sum("jump"), F.lit(0.0)), 6).alias("length"), F.round(F.coalesce(F.max("jump"), F.lit(0.0)), 6).alias("longest"))
