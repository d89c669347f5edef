"""Stations and discovery: the neighbour graph's shape, hidden gems, and mood seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklens.operators.catalogue import CALIBRATED, calibrated_ratings
from tracklens.operators.feedback import FEEDBACK_BALANCE, FEEDBACK_TOTALS, feedback_balance, feedback_totals
from tracklens.operators.vectors import NEAREST, nearest, neighbours, vectors


def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each vector is a neighbour of those that ``nearest`` asks for, a tenth of all, and its
    greatest similarity as one; neighbour_graph_degrees is over the whole graph."""
    found = nearest(spark, sf_dir)
    return found.groupBy("neighbour").agg(F.count("*").alias("degree"), F.max("similarity").alias("similarity"))


DEGREES = f"SELECT neighbour, count(*) AS degree, max(similarity) AS similarity FROM ({NEAREST}) GROUP BY neighbour"


def degrees(rows: DataFrame, k: int) -> DataFrame:
    """vec_id, degree for every row of ``rows`` (vec_id, v): how many of all the vectors have it among
    their ``k`` nearest; 0 where none has."""
    found = neighbours(rows, rows, k).groupBy(F.col("neighbour").alias("_n")).agg(F.count("*").alias("degree"))
    return rows.join(found, F.col("vec_id") == F.col("_n"), "left").select("vec_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def neighbour_graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-degrees over the whole graph of the 5 nearest neighbours of all vectors."""
    return degrees(vectors(spark, sf_dir).select("vec_id", "v"), 5)


GRAPH_DEGREES = """WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM n a JOIN n b ON a.vec_id != b.vec_id),
g AS (SELECT neighbour FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) <= 5)
SELECT n.vec_id, count(g.neighbour) AS degree FROM n LEFT JOIN g ON g.neighbour = n.vec_id GROUP BY n.vec_id"""


def hidden_gems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of a predicted rating of at least 4 (0.3 e + 0.4 m + 0.3 c) whose plays are at or below the 20th percentile,
    with the gem score. Tracks without feedback have no plays."""
    told = feedback_totals(spark, sf_dir).select("track", "likes", "dislikes", "skips", "plays")
    rated = calibrated_ratings(spark, sf_dir).select(F.col("l_partkey").alias("track"), "e", "m", "c", (0.3 * F.col("e") + 0.4 * F.col("m") + 0.3 * F.col("c")).alias("predicted"))
    rows = rated.join(told, "track", "left").fillna(0, ["likes", "dislikes", "skips", "plays"])
    counts = rows.groupBy("plays").agg(F.count("*").alias("n"))  # a row for each number of plays
    below = F.coalesce(F.sum("n").over(Window.orderBy("plays").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.select("plays", (below / F.sum("n").over(Window.partitionBy())).alias("percentile"))
    gem = F.expr("greatest(0e0, predicted * 10 + (1 - percentile) * 30 + least(likes, 5) * 2 - dislikes * 5 - least(skips, 3) * 2)")
    found = rows.join(ranked, "plays").where("round(predicted, 6) >= 4 AND percentile <= 0.2")
    return found.select("track", "plays", F.round("predicted", 6).alias("predicted"), F.round(gem, 6).alias("gem_score"))


GEMS = f"""WITH r AS (SELECT l_partkey AS track, 0.3::DOUBLE * e + 0.4::DOUBLE * m + 0.3::DOUBLE * c AS predicted, coalesce(likes, 0) AS likes, coalesce(dislikes, 0) AS dislikes, coalesce(skips, 0) AS skips, coalesce(plays, 0) AS plays
  FROM ({CALIBRATED}) x LEFT JOIN ({FEEDBACK_TOTALS}) y ON y.track = x.l_partkey),
p AS (SELECT *, (rank() OVER (ORDER BY plays) - 1) / count(*) OVER ()::DOUBLE AS percentile FROM r)
SELECT track, plays, round(predicted, 6) AS predicted, round(greatest(0, predicted * 10 + (1 - percentile) * 30 + least(likes, 5) * 2 - dislikes * 5 - least(skips, 3) * 2), 6) AS gem_score
FROM p WHERE round(predicted, 6) >= 4 AND percentile <= 0.2"""

# Moods as ratings of energy, mood and complexity; preference is 3. Weights of the score, and the share of exploration.
MOODS = {"quiet": (1, 2, 1), "ambient": (2, 3, 2), "energetic": (5, 5, 4), "dark": (3, 1, 3), "bright": (4, 5, 3), "complex": (3, 3, 5)}
ALPHA, BETA, GAMMA, EXPLORE = 0.6, 0.3, 0.1, 0.2


def mood_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations from each mood: the 100 tracks nearest to its (e, m, c, p) vector (ties: lower track), scored by
    cosine, song feedback, the listener's preference and exploration, without tracks of energy 1 (a filter after the nearest
    were taken, so fewer may be left), the best 20.

    Spark keeps a hundred for each mood in every task before the shuffle (a window group limit)."""
    moods = spark.createDataFrame([(k, *v) for k, v in MOODS.items()], "mood string, me int, mm int, mc int")  # 6 rows
    told = feedback_balance(spark, sf_dir)
    away = F.expr("(e - me) * (e - me) + (m - mm) * (m - mm) + (c - mc) * (c - mc)")
    scored = calibrated_ratings(spark, sf_dir).select(F.col("l_partkey").alias("track"), "e", "m", "c").crossJoin(F.broadcast(moods))
    near = scored.withColumn("n", F.row_number().over(Window.partitionBy("mood").orderBy(away, "track"))).where("n <= 100")
    similarity = F.expr("(e * me + m * mm + c * mc + 9) / (sqrt(e * e + m * m + c * c + 9) * sqrt(me * me + mm * mm + mc * mc + 9))")
    rows = near.join(told, "track", "left").withColumn("similarity", similarity).where("e >= 2")
    score = ALPHA * F.col("similarity") + BETA * F.coalesce("balance", F.lit(0.5)) + GAMMA * 0.5 + EXPLORE * (1 - F.col("similarity")) * 0.2
    best = F.row_number().over(Window.partitionBy("mood").orderBy(F.desc("score"), "track"))
    return rows.select("mood", "track", F.round(score, 6).alias("score")).withColumn("place", best).where("place <= 20")


_VALUES = ", ".join(f"('{k}', {a}, {b}, {c})" for k, (a, b, c) in MOODS.items())
SEEDS = f"""WITH r AS ({CALIBRATED}), n AS (SELECT mood, l_partkey AS track, e, m, c, me, mm, mc FROM r, (VALUES {_VALUES}) t(mood, me, mm, mc)
  QUALIFY row_number() OVER (PARTITION BY mood ORDER BY (e - me) * (e - me) + (m - mm) * (m - mm) + (c - mc) * (c - mc), l_partkey) <= 100),
s AS (SELECT *, list_cosine_similarity([e, m, c, 3]::DOUBLE[], [me, mm, mc, 3]::DOUBLE[]) AS s FROM n WHERE e >= 2),
b AS (SELECT mood, s.track, round(0.6::DOUBLE * s + 0.3::DOUBLE * coalesce(balance, 0.5) + 0.05::DOUBLE + 0.2::DOUBLE * (1 - s) * 0.2::DOUBLE, 6) AS score FROM s LEFT JOIN ({FEEDBACK_BALANCE}) f ON f.track = s.track)
SELECT mood, track, score, CAST(row_number() OVER (PARTITION BY mood ORDER BY score DESC, track) AS INTEGER) AS place FROM b QUALIFY place <= 20"""


QUERIES = {"graph_degrees": graph_degrees, "neighbour_graph_degrees": neighbour_graph_degrees, "hidden_gems": hidden_gems, "mood_seeds": mood_seeds}
ORACLES = {"graph_degrees": DEGREES, "neighbour_graph_degrees": GRAPH_DEGREES, "hidden_gems": GEMS, "mood_seeds": SEEDS}
