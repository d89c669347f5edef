"""Feedback logs: decayed totals, trends, charts, validation, sessions and pairs for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklens.functions.columns import action, age_days, clamp, decay, track
from tracklens.sources.tables import table

NOW = "2024-01-31 00:00:00"


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, user_id, track, act, value: the event log as feedback."""
    raw = table(spark, sf_dir, "events")
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", track(F.col("props")).alias("track"), action(F.col("event_type")).alias("act"), "value")


def _count(*acts: str) -> Column:
    return F.sum(F.col("act").isin(*acts).cast("long"))


def all_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with all eight actions: of the early skips, those of small value are dislikes, late skips and plain skips."""
    early = F.col("act") == "skip_early"
    split = F.when(early & (F.col("value") < 3), "dislike").when(early & (F.col("value") < 6), "skip_late").when(early & (F.col("value") < 9), "skip").otherwise(F.col("act"))
    return events(spark, sf_dir).withColumn("act", split)


# What an action adds to the decayed sums, in units of its decay weight.
DECAYED = {
    "likes": {"like": 1.0, "play_complete": 0.6, "replay": 1.2},
    "dislikes": {"dislike": 1.0},
    "skips": {"skip": 1.0, "skip_early": 1.2, "skip_late": 0.6},
    "plays": {"play": 1.0, "play_complete": 1.1, "replay": 1.2},
    "recent_plays": {"play": 1.0, "play_complete": 1.0, "replay": 1.1},
}
COUNTED = {"likes": ["like"], "dislikes": ["dislike"], "skips": ["skip", "skip_early", "skip_late"], "plays": ["play", "play_complete", "replay"]}


def aggregate_feedback(log: DataFrame, key: str, now: Column) -> DataFrame:
    """Counts and decayed sums of ``log`` (ts, act) for each ``key``. Recent plays are those since seven days before ``now``;
    last_played is the latest play, completion, replay or like. A row without a time counts, with no decayed weight.

    Sums combine before the shuffle, so a key that holds most rows is one row of each task."""
    weight, recent = decay(F.col("ts"), now), F.coalesce(F.col("ts") >= now - F.expr("INTERVAL 7 DAYS"), F.lit(False))

    def units(name: str) -> Column:
        scale = F.lit(0.0)
        for act, unit in DECAYED[name].items():
            scale = F.when(F.col("act") == act, unit).otherwise(scale)
        return F.sum(F.when(recent, weight * scale).otherwise(0.0) if name == "recent_plays" else weight * scale).alias(f"decayed_{name}")

    counts = [_count(*acts).alias(name) for name, acts in COUNTED.items()]
    plays = F.sum((F.col("act").isin(*COUNTED["plays"]) & recent).cast("long")).alias("recent_plays")
    last = F.max(F.when(F.col("act").isin("like", *COUNTED["plays"]), F.col("ts"))).cast("timestamp_ntz").alias("last_played")
    return log.groupBy(key).agg(*counts, plays, *[units(name) for name in DECAYED], last)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c.startswith("decayed_") else F.col(c) for c in df.columns])


def feedback_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback aggregated for each track."""
    return _rounded(aggregate_feedback(all_actions(spark, sf_dir), "track", _now()))


def feedback_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same aggregate under another key: the user."""
    return _rounded(aggregate_feedback(all_actions(spark, sf_dir), "user_id", _now()))


_E = """e AS (SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS track, value,
  CASE event_type WHEN 'view' THEN 'play' WHEN 'click' THEN 'like' WHEN 'purchase' THEN 'replay' WHEN 'signup' THEN 'play_complete' WHEN 'error' THEN 'skip_early' ELSE event_type END AS act,
  (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 86400000000.0::DOUBLE AS age,
  power(0.5::DOUBLE, greatest((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 86400000000.0::DOUBLE, 0) / 90.0) AS w FROM events)"""

_A = f"""{_E}, a AS (SELECT * REPLACE (CASE WHEN act != 'skip_early' OR value >= 9 THEN act WHEN value < 3 THEN 'dislike' WHEN value < 6 THEN 'skip_late' ELSE 'skip' END AS act) FROM e)"""


def _aggregated(key: str) -> str:
    """The eight cases, written out."""
    return f"""SELECT {key}, count(*) FILTER (act = 'like') AS likes, count(*) FILTER (act = 'dislike') AS dislikes,
  count(*) FILTER (act IN ('skip', 'skip_early', 'skip_late')) AS skips, count(*) FILTER (act IN ('play', 'play_complete', 'replay')) AS plays,
  count(*) FILTER (act IN ('play', 'play_complete', 'replay') AND age <= 7) AS recent_plays,
  sum(CASE act WHEN 'like' THEN w WHEN 'play_complete' THEN w * 0.6::DOUBLE WHEN 'replay' THEN w * 1.2::DOUBLE ELSE 0 END) AS decayed_likes,
  sum(CASE act WHEN 'dislike' THEN w ELSE 0 END) AS decayed_dislikes,
  sum(CASE act WHEN 'skip' THEN w WHEN 'skip_early' THEN w * 1.2::DOUBLE WHEN 'skip_late' THEN w * 0.6::DOUBLE ELSE 0 END) AS decayed_skips,
  sum(CASE act WHEN 'play' THEN w WHEN 'play_complete' THEN w * 1.1::DOUBLE WHEN 'replay' THEN w * 1.2::DOUBLE ELSE 0 END) AS decayed_plays,
  sum(CASE WHEN age > 7 THEN 0 WHEN act IN ('play', 'play_complete') THEN w WHEN act = 'replay' THEN w * 1.1::DOUBLE ELSE 0 END) AS decayed_recent_plays,
  max(CASE WHEN act IN ('play', 'play_complete', 'replay', 'like') THEN ts END) AS last_played FROM a GROUP BY {key}"""


_G = f"{_A}, g AS ({_aggregated('track')})"
_ROUND = ", ".join(f"round(decayed_{c}, 6) AS decayed_{c}" for c in DECAYED)
FEEDBACK_TOTALS = f"WITH {_G} SELECT * REPLACE ({_ROUND}) FROM g"
FEEDBACK_BY_USER = f"WITH {_A}, g AS ({_aggregated('user_id')}) SELECT * REPLACE ({_ROUND}) FROM g"


def _by_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_feedback(all_actions(spark, sf_dir), "track", _now())


def feedback_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised song feedback, 0 to 1: likes less dislikes and 0.3 of skips, by plays (one at least), all decayed."""
    score = (F.col("decayed_likes") - F.col("decayed_dislikes") - 0.3 * F.col("decayed_skips")) / F.greatest("decayed_plays", F.lit(1.0))
    return _by_track(spark, sf_dir).select("track", F.round(clamp((score + 2) / 4, 0.0, 1.0), 6).alias("balance"))


FEEDBACK_BALANCE = f"WITH {_G} SELECT track, round(greatest(0, least(1, ((decayed_likes - decayed_dislikes - 0.3::DOUBLE * decayed_skips) / greatest(decayed_plays, 1) + 2) / 4)), 6) AS balance FROM g"


def average_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Community rating of each track: likes weigh 5, skips 3, dislikes 1; 3 where there are none."""
    total = F.col("decayed_likes") + F.col("decayed_skips") + F.col("decayed_dislikes")
    mean = (5 * F.col("decayed_likes") + 3 * F.col("decayed_skips") + F.col("decayed_dislikes")) / total
    return _by_track(spark, sf_dir).select("track", F.round(F.when(total == 0, 3.0).otherwise(mean), 6).alias("average"), F.round(total, 6).alias("total"))


AVERAGE = f"WITH {_G}, t AS (SELECT *, decayed_likes + decayed_skips + decayed_dislikes AS n FROM g) SELECT track, round(CASE WHEN n = 0 THEN 3 ELSE (5 * decayed_likes + 3 * decayed_skips + decayed_dislikes) / n END, 6) AS average, round(n, 6) AS total FROM t"


def ratings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates looked up for a list of tracks (parts 90 to 119); those without feedback get zeros and the rating 3."""
    wanted = table(spark, sf_dir, "part").where("p_partkey BETWEEN 90 AND 119").select(F.col("p_partkey").alias("track"))
    found = average_rating(spark, sf_dir).join(feedback_totals(spark, sf_dir).select("track", "likes", "plays"), "track")
    known = wanted.join(found, "track", "left")
    return known.select("track", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("average", 3.0), ("total", 0.0), ("likes", 0), ("plays", 0))])


RATINGS_OF = f"""SELECT p_partkey AS track, coalesce(average, 3) AS average, coalesce(total, 0) AS total, coalesce(likes, 0) AS likes, coalesce(plays, 0) AS plays
FROM part LEFT JOIN ({AVERAGE}) x ON x.track = p_partkey LEFT JOIN ({FEEDBACK_TOTALS}) y ON y.track = p_partkey WHERE p_partkey BETWEEN 90 AND 119"""


def chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 tracks with most plays in the last 7 days (only plain plays count; ties: lower track)."""
    recent = events(spark, sf_dir).where((F.col("act") == "play") & (age_days(F.col("ts"), _now()) <= 7))
    counted = recent.groupBy("track").agg(F.count("*").alias("plays"))
    top = counted.orderBy(F.desc("plays"), "track").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("plays"), "track")))  # 20 rows


CHART = f"""WITH {_E}, c AS (SELECT track, count(*) AS plays FROM e WHERE act = 'play' AND age <= 7 GROUP BY track)
SELECT track, plays, CAST(row_number() OVER (ORDER BY plays DESC, track) AS INTEGER) AS place FROM c QUALIFY place <= 20"""


def chart_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five tracks with most plain plays of the week, of this calendar month and of all time (ties: first played first)."""
    plays = events(spark, sf_dir).where("act = 'play'")
    spans = F.array_compact(F.array(F.when(age_days(F.col("ts"), _now()) <= 7, F.lit("week")), F.when(F.date_trunc("month", "ts") == F.date_trunc("month", _now()), F.lit("month")), F.lit("all")))
    counted = plays.select("track", "ts", F.explode(spans).alias("span")).groupBy("span", "track").agg(F.count("*").alias("plays"), F.min("ts").alias("first"))
    place = F.row_number().over(Window.partitionBy("span").orderBy(F.desc("plays"), "first"))
    return counted.select("span", "track", "plays", place.alias("place")).where("place <= 5")


SPANS = f"""WITH {_E}, p AS (SELECT 'week' AS span, * FROM e WHERE act = 'play' AND age <= 7 UNION ALL SELECT 'month', * FROM e WHERE act = 'play' AND date_trunc('month', ts) = DATE '2024-01-01' UNION ALL SELECT 'all', * FROM e WHERE act = 'play'),
c AS (SELECT span, track, count(*) AS plays, min(ts) AS first FROM p GROUP BY span, track)
SELECT span, track, plays, CAST(row_number() OVER (PARTITION BY span ORDER BY plays DESC, first) AS INTEGER) AS place FROM c QUALIFY place <= 5"""


def trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent plays by the share of likes (0.5 without any), out of 20; trending above 0.7."""
    likes = F.col("decayed_likes")
    ratio = F.when(likes > 0, likes / (likes + F.col("decayed_dislikes") + 1)).otherwise(0.5)
    score = F.round(F.least(F.lit(1.0), F.col("decayed_recent_plays") * ratio / 20), 6)
    return _by_track(spark, sf_dir).select("track", score.alias("score"), (score > 0.7).alias("trending"))


TRENDING = f"""WITH {_G}, s AS (SELECT track, round(least(1, decayed_recent_plays * CASE WHEN decayed_likes > 0 THEN decayed_likes / (decayed_likes + decayed_dislikes + 1) ELSE 0.5 END / 20), 6) AS score FROM g)
SELECT track, score, score > 0.7 AS trending FROM s"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user: events less than or just 24 hours apart belong together."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(by_user))
    numbered = events(spark, sf_dir).withColumn("session", F.sum((F.coalesce(gap, F.lit(1 << 62)) > 86_400_000_000).cast("long")).over(by_user))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.countDistinct("track").alias("tracks"), F.min("ts").cast("timestamp_ntz").alias("started"), F.max("ts").cast("timestamp_ntz").alias("ended"))


SESSIONS = f"""WITH {_E}, g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM e),
s AS (SELECT *, CAST(sum(CASE WHEN coalesce(gap, 86400000001) > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g)
SELECT user_id, session, count(*) AS events, count(DISTINCT track) AS tracks, min(ts) AS started, max(ts) AS ended FROM s GROUP BY user_id, session"""


def weekly_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and listeners of each action in each week."""
    by = events(spark, sf_dir).groupBy(F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week"), "act")
    return by.agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("listeners"), F.round(F.avg("value"), 6).alias("mean_value"))


WEEKLY = f"WITH {_E} SELECT date_trunc('week', ts)::TIMESTAMP AS week, act, count(*) AS events, count(DISTINCT user_id) AS listeners, round(avg(value), 6) AS mean_value FROM e GROUP BY ALL"


def latest_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user and track (ties in time: the higher event_id), by one aggregation."""
    last = events(spark, sf_dir).groupBy("user_id", "track").agg(F.max(F.struct("ts", "event_id", "act")).alias("last"))
    return last.select("user_id", "track", F.col("last.ts").cast("timestamp_ntz").alias("ts"), "last.event_id", "last.act")


LATEST = f"WITH {_E} SELECT user_id, track, ts, event_id, act FROM e QUALIFY row_number() OVER (PARTITION BY user_id, track ORDER BY ts DESC, event_id DESC) = 1"


def temporal_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifth of all events, by time and record, held out: floor(0.2 n) rows.

    Hours are counted first, a row each; only the hour in which the cut falls is ranked, so no task sorts the log."""
    log = events(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts"))
    later = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = log.groupBy("hour").agg(F.count("*").alias("n")).select("hour", later.alias("later"), "n", F.floor(F.sum("n").over(Window.partitionBy()) * 0.2).alias("held"))
    placed = log.join(hours, "hour")
    inside = F.row_number().over(Window.partitionBy("hour").orderBy(F.desc("ts"), F.desc("event_id")))
    cut = placed.where("later < held AND later + n > held").withColumn("test", F.col("later") + inside <= F.col("held"))
    rest = placed.where("NOT (later < held AND later + n > held)").withColumn("test", F.col("later") < F.col("held"))
    split = cut.unionByName(rest).withColumn("part", F.when(F.col("test"), "test").otherwise("train"))
    return split.groupBy("act", "part").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.min("ts").cast("timestamp_ntz").alias("first"))


HOLDOUT = f"""WITH {_E}, n AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER () AS c FROM e)
SELECT act, CASE WHEN n <= floor(c * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part, count(*) AS events, count(DISTINCT user_id) AS users, min(ts) AS first FROM n GROUP BY ALL"""


def play_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rank - 1) / n of each track's plays. Distinct play counts are ranked, not the tracks themselves."""
    plays = events(spark, sf_dir).where(F.col("act").isin("play", "play_complete", "replay")).groupBy("track").agg(F.count("*").alias("plays"))
    counts = plays.groupBy("plays").agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("plays").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.select("plays", (below / F.sum("n").over(Window.partitionBy())).alias("percentile"))
    return plays.join(ranked, "plays").select("track", "plays", F.round("percentile", 6).alias("percentile"))


PERCENTILE = f"""WITH {_E}, p AS (SELECT track, count(*) AS plays FROM e WHERE act IN ('play', 'play_complete', 'replay') GROUP BY track)
SELECT track, plays, round((rank() OVER (ORDER BY plays) - 1) / count(*) OVER ()::DOUBLE, 6) AS percentile FROM p"""


def orphan_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of tracks that the catalogue (parts but the promotional ones) does not have."""
    parts = table(spark, sf_dir, "part").where("p_type != 'PROMO'").select(F.col("p_partkey").alias("track"))
    return events(spark, sf_dir).join(parts, "track", "left_anti").groupBy("track").agg(F.count("*").alias("events"))


ORPHANS = f"WITH {_E} SELECT track, count(*) AS events FROM e WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = track AND p_type != 'PROMO') GROUP BY track"


def session_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks liked or finished by the same user within one day, as unordered pairs with how many such
    days. Tracks of a user and day are made distinct before they are paired."""
    good = events(spark, sf_dir).where(F.col("act").isin("like", "play_complete", "replay")).select("user_id", F.to_date("ts").alias("day"), "track").distinct()
    other = good.select("user_id", "day", F.col("track").alias("other"))
    return good.join(other, ["user_id", "day"]).where("track < other").groupBy("track", "other").agg(F.count("*").alias("days"))


PAIRS = f"""WITH {_E}, g AS (SELECT DISTINCT user_id, ts::DATE AS day, track FROM e WHERE act IN ('like', 'play_complete', 'replay'))
SELECT a.track, b.track AS other, count(*) AS days FROM g a JOIN g b ON a.user_id = b.user_id AND a.day = b.day AND a.track < b.track GROUP BY a.track, b.track"""


QUERIES = {
    "feedback_totals": feedback_totals,
    "feedback_balance": feedback_balance,
    "feedback_by_user": feedback_by_user,
    "average_rating": average_rating,
    "ratings_of": ratings_of,
    "chart_spans": chart_spans,
    "chart": chart,
    "trending": trending,
    "sessions": sessions,
    "weekly_engagement": weekly_engagement,
    "latest_feedback": latest_feedback,
    "temporal_holdout": temporal_holdout,
    "play_percentile": play_percentile,
    "orphan_feedback": orphan_feedback,
    "session_pairs": session_pairs,
}
ORACLES = {
    "feedback_totals": FEEDBACK_TOTALS,
    "feedback_balance": FEEDBACK_BALANCE,
    "feedback_by_user": FEEDBACK_BY_USER,
    "average_rating": AVERAGE,
    "ratings_of": RATINGS_OF,
    "chart_spans": SPANS,
    "chart": CHART,
    "trending": TRENDING,
    "sessions": SESSIONS,
    "weekly_engagement": WEEKLY,
    "latest_feedback": LATEST,
    "temporal_holdout": HOLDOUT,
    "play_percentile": PERCENTILE,
    "orphan_feedback": ORPHANS,
    "session_pairs": PAIRS,
}
