"""Personas that weigh what is known of a track with how it sounds, and scores that lean towards a listener's taste."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklens.operators.feedback import _A, all_actions
from tracklens.operators.joins import STARS
from tracklens.operators.personas import METRICS, PERSONAS, fit, fit_of
from tracklens.operators.scalars import RATED, THEMELESS, rated
from tracklens.plans.define import family

QUERIES, ORACLES, query = family()

# Weight and direction of each metric, ratings aimed at, and what else counts; shares of what else counts, and its weight in all.
HYBRIDS = {
    "composer_focus": ({"melodic": (0.25, 1), "timbral": (0.20, 1), "rhythmic": (0.20, 0), "nostalgic": (0.15, 0), "experimental": (0.20, 0)}, {"e": 3, "m": 4, "c": 4}, ("composer",)),
    "era_explorer": ({"melodic": (0.20, 0), "rhythmic": (0.20, 0), "timbral": (0.20, 0), "nostalgic": (0.20, 0), "experimental": (0.20, 0)}, {"e": 3, "m": 3, "c": 3}, ("year",)),
    "deep_discovery": ({"melodic": (0.25, 1), "timbral": (0.20, 1), "rhythmic": (0.20, 0), "nostalgic": (0.15, -1), "experimental": (0.20, 1)}, {"e": 3, "m": 3, "c": 4}, ("rarity",)),
    "theme_hunter": ({"melodic": (0.25, 1), "rhythmic": (0.15, 0), "timbral": (0.20, 0), "nostalgic": (0.20, 0), "experimental": (0.20, 0)}, {"e": 3, "m": 4, "c": 3}, ("themes", "year")),
}
BUDGETS, KNOWN = {"composer": 0.05, "year": 0.04, "themes": 0.10, "rarity": 0.10}, 0.55
#: What likeness to a listener's taste and what skipping moves a score by.
TASTE, SKIPPED = 0.10, 0.03


def hybrid(persona: str) -> str:
    """A track's score as an SQL expression over e, m, c and what is known (0 to 1, null: nothing): sound alone where nothing is."""
    weights, targets, fields = HYBRIDS[persona]
    sound = fit_of(weights, targets)
    budget = " + ".join(f"CASE WHEN {f} IS NOT NULL THEN {BUDGETS[f]}e0 ELSE 0e0 END" for f in fields)
    achieved = " + ".join(f"coalesce({f}, 0e0) * {BUDGETS[f]}e0" for f in fields)
    return f"CASE WHEN {budget} > 0 THEN greatest(0e0, least(1e0, {sound} * {1 - KNOWN}e0 + ({achieved}) / ({budget}) * {KNOWN}e0)) ELSE {sound} END"


def known(tracks: DataFrame) -> DataFrame:
    """``tracks`` (track, title, composer, category, size, ratings) with composer's prominence, the year's place, theme words and
    the folder's rarity, from 0 to 1. Composers, years and folders are counted; only these counts (a row for each) are put side by side."""
    rows = tracks.withColumn("released", F.when(F.col("track") % 10 != 0, 1980 + F.col("size") % 15))
    composers = rows.groupBy("composer").agg(F.count("*").alias("n"))
    most = composers.agg(F.max("n").alias("most"))
    composers = composers.join(F.broadcast(most)).select(F.col("composer").alias("by"), F.coalesce(F.when(F.col("most") > 1, F.ln("n") / F.ln("most")), F.lit(1.0)).alias("prominence"))
    years = rows.where("released IS NOT NULL").groupBy("released").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("released").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each year
    years = years.select(F.col("released").alias("in"), ((before + F.col("n") / 2.0) / F.sum("n").over(Window.partitionBy())).alias("year"))
    folders = rows.groupBy(F.col("category").alias("_category"), F.col("composer").alias("_composer")).agg(F.count("*").alias("n"))
    ends = folders.agg(F.min("n").alias("low"), F.max("n").alias("high"))
    folders = folders.join(F.broadcast(ends)).select("_category", "_composer", F.when(F.col("high") > F.col("low"), 1 - (F.col("n") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.5).alias("rarity"))
    words = F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " ")), " "), lambda x: (F.length(x) >= 4) & ~x.isin(THEMELESS)))
    themes = F.least(F.size(words), F.lit(6))
    out = rows.join(composers, F.col("composer") == F.col("by"), "left").join(years, F.col("released") == F.col("in"), "left").join(folders, (F.col("category") == F.col("_category")) & (F.col("composer") == F.col("_composer")), "left")
    return out.withColumn("themes", F.when(themes > 0, F.least(F.lit(1.0), themes / 4.0))).drop("composer").withColumnRenamed("prominence", "composer")


_KNOWN = f"""{RATED}, k AS (SELECT *, CASE WHEN track % 10 != 0 THEN 1980 + size % 15 END AS released FROM r),
co AS (SELECT composer AS by_, CASE WHEN max(count(*)) OVER () > 1 THEN ln(count(*)) / ln(max(count(*)) OVER ()) ELSE 1 END AS prominence FROM k GROUP BY composer),
ye AS (SELECT released AS in_, (coalesce(sum(count(*)) OVER (ORDER BY released ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + count(*) / 2.0::DOUBLE) / sum(count(*)) OVER () AS year FROM k WHERE released IS NOT NULL GROUP BY released),
fo AS (SELECT category AS c_, composer AS b_, count(*) AS n FROM k GROUP BY ALL), fr AS (SELECT c_, b_, CASE WHEN max(n) OVER () > min(n) OVER () THEN 1 - (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ())::DOUBLE ELSE 0.5 END AS rarity FROM fo),
th AS (SELECT track AS t_, least(6, len(list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 4 AND x NOT IN ({', '.join(repr(x) for x in THEMELESS)}))))) AS words FROM k),
known AS (SELECT k.* EXCLUDE (composer), prominence AS composer, year, rarity, CASE WHEN words > 0 THEN least(1.0::DOUBLE, words / 4.0::DOUBLE) END AS themes FROM k LEFT JOIN co ON by_ = k.composer LEFT JOIN ye ON in_ = released LEFT JOIN fr ON c_ = category AND b_ = k.composer JOIN th ON t_ = track)"""
_EVERY = {p: fit(p) for p in PERSONAS} | {p: hybrid(p) for p in HYBRIDS}


@query(f"WITH {_KNOWN} " + " UNION ALL ".join(f"SELECT '{p}' AS persona, track, round({hybrid(p)}, 9) AS score FROM known" for p in HYBRIDS))
def hybrid_scores(spark, sf_dir):
    """The score of every track for the personas that weigh what is known of it."""
    rows = known(rated(spark, sf_dir))
    fits = F.explode(F.array(*[F.struct(F.lit(p).alias("persona"), F.expr(hybrid(p)).alias("score")) for p in HYBRIDS]))
    return rows.select("track", fits.alias("x")).select("x.persona", "track", F.round("x.score", 9).alias("score"))


def tastes_of(stars: DataFrame, rows: DataFrame) -> DataFrame:
    """listener, skipped and the mean metrics of what each listener of ``stars`` (listener, track, stars) rated 4 or more (null: nothing)."""
    liked = F.col("stars") >= 4
    metrics = [F.avg(F.when(liked, F.expr(x))).alias(f"like_{name}") for name, x in METRICS.items()]
    return stars.join(rows.select("track", "e", "m", "c"), "track").groupBy("listener").agg(F.avg((F.col("stars") <= 2).cast("double")).alias("skipped"), *metrics)


def leaning(score: str) -> str:
    """``score`` moved by how like the track's metrics are to the listener's, and down by how often they skip."""
    like = " + ".join(f"(1e0 - abs({x} - like_{name}))" for name, x in METRICS.items())
    return f"greatest(0e0, least(1e0, ({score}) + CASE WHEN like_rhythmic IS NOT NULL THEN (({like}) / {len(METRICS)}e0 - 0.5e0) * {TASTE}e0 ELSE 0e0 END - skipped * {SKIPPED}e0))"


_STARRED = f"""{_A}, st AS (SELECT user_id AS listener, track, max(CASE act {' '.join(f"WHEN '{a}' THEN {n}" for a, n in STARS.items())} END) AS stars FROM a GROUP BY ALL)"""
_TASTES = f"""ta AS (SELECT listener, avg((stars <= 2)::INT) AS skipped, {', '.join(f'avg(CASE WHEN stars >= 4 THEN {x} END) AS like_{name}' for name, x in METRICS.items())} FROM st JOIN known USING (track) GROUP BY listener)"""


@query(f"WITH {_STARRED}, {_KNOWN}, {_TASTES}, j AS (SELECT * FROM st JOIN known USING (track) JOIN ta USING (listener)) " + " UNION ALL ".join(f"SELECT listener, track, '{p}' AS persona, round({leaning(x)}, 9) AS score FROM j" for p, x in _EVERY.items()))
def leaning_scores(spark, sf_dir):
    """What each listener's rated tracks score for every persona, leaning towards the listener's taste."""
    stars = F.create_map(*[F.lit(x) for pair in STARS.items() for x in pair])[F.col("act")]
    told = all_actions(spark, sf_dir).groupBy(F.col("user_id").alias("listener"), "track").agg(F.max(stars).alias("stars"))
    rows = known(rated(spark, sf_dir))
    met = told.join(rows, "track").join(tastes_of(told, rows), "listener")
    fits = F.explode(F.array(*[F.struct(F.lit(p).alias("persona"), F.expr(leaning(x)).alias("score")) for p, x in _EVERY.items()]))
    return met.select("listener", "track", fits.alias("x")).select("listener", "track", "x.persona", F.round("x.score", 9).alias("score"))
