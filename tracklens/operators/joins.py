"""Joins of the catalogue with feedback, pairs and triplets for training, and what keeps one record of many."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklens.functions.columns import action
from tracklens.functions.kept import kept
from tracklens.operators.catalogue import CALIBRATED, calibrated_ratings
from tracklens.operators.feedback import _A, FEEDBACK_TOTALS, all_actions, feedback_totals
from tracklens.operators.scalars import RATED, TRACKS, rated, tracks
from tracklens.plans.define import family
from tracklens.sources.tables import table

QUERIES, ORACLES, query = family()

_ZERO = ("likes", "dislikes", "skips", "plays")


@query(f"""WITH {RATED} SELECT r.track, sid_path, song_index, e, m, c, coalesce(likes, 0) AS likes, coalesce(dislikes, 0) AS dislikes, coalesce(skips, 0) AS skips, coalesce(plays, 0) AS plays,
  coalesce(decayed_likes, 0) AS decayed_likes, coalesce(decayed_plays, 0) AS decayed_plays, last_played FROM r LEFT JOIN ({FEEDBACK_TOTALS}) f ON f.track = r.track""")
def track_rows(spark, sf_dir):
    """Tracks with ratings and the feedback on them; zeros where there is none."""
    told = feedback_totals(spark, sf_dir).select("track", *_ZERO, "decayed_likes", "decayed_plays", "last_played")
    rows = rated(spark, sf_dir).join(told, "track", "left").fillna(0, [*_ZERO, "decayed_likes", "decayed_plays"])
    return rows.select("track", "sid_path", "song_index", "e", "m", "c", *_ZERO, "decayed_likes", "decayed_plays", "last_played")


@query(f"""WITH {TRACKS}, f AS (SELECT sid_path, sum(likes)::BIGINT AS likes, sum(plays)::BIGINT AS plays FROM t JOIN ({FEEDBACK_TOTALS}) x USING (track) GROUP BY sid_path)
SELECT t.track, t.sid_path, coalesce(likes, 0) AS likes, coalesce(plays, 0) AS plays FROM t LEFT JOIN f ON f.sid_path = t.sid_path""")
def path_feedback(spark, sf_dir):
    """Tracks with the feedback on their file: all songs of a path share one sum."""
    own = tracks(spark, sf_dir).select("track", "sid_path")
    shared = own.join(feedback_totals(spark, sf_dir), "track").groupBy("sid_path").agg(F.sum("likes").alias("likes"), F.sum("plays").alias("plays"))
    return own.join(shared, "sid_path", "left").fillna(0, ["likes", "plays"]).select("track", "sid_path", "likes", "plays")


@query("""WITH l AS (SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, CASE WHEN l_orderkey % 9 = 0 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS dated FROM lineitem)
SELECT l_partkey, dated, l_orderkey, l_linenumber, l_quantity FROM l QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY dated DESC, l_orderkey DESC, l_linenumber DESC) = 1""")
def latest_records(spark, sf_dir):
    """Of a part's records the one of the latest date (as text; none: empty), of equal ones the last. One aggregation, no sort."""
    at = F.when(F.col("l_orderkey") % 9 == 0, "").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    last = F.max(F.struct(at.alias("dated"), "l_orderkey", "l_linenumber", "l_quantity")).alias("x")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(last).select("l_partkey", "x.*")


@query("SELECT p_type, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS engines, count(DISTINCT p_brand) > 1 AS mixed FROM part WHERE p_size < 3 GROUP BY p_type")
def engines(spark, sf_dir):
    """Which engines (brands) the records of a corpus (type) were made with; more than one must not be mixed."""
    found = table(spark, sf_dir, "part").where("p_size < 3").groupBy("p_type").agg(F.sort_array(F.collect_set("p_brand")).alias("e"))
    return found.select("p_type", F.array_join("e", ",").alias("engines"), (F.size("e") > 1).alias("mixed"))


# Training pairs ----------------------------------------------------------------------------------------------------

# How strongly an action speaks for or against a track.
POSITIVE = {"replay": 1.0, "like": 0.7, "play_complete": 0.7}
NEGATIVE = {"skip_late": 0.5, "skip": 1.0, "skip_early": 1.0, "dislike": 1.0}


def _weight(weights: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for act, w in weights.items():
        out = F.when(F.col("act") == act, w).otherwise(out)
    return out


def signals(log: DataFrame, gap_hours: int) -> DataFrame:
    """started, user_id, track, kind (0 positive, 1 negative), ts, event_id, weight: the first signal of each kind that a session
    has for a track; only first ones can make a pair's first occurrence. Sessions are runs of a user without a longer gap."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(by_user))
    new = (F.coalesce(gap, F.lit(1 << 62)) > gap_hours * 3_600_000_000).cast("long")
    numbered = log.withColumn("session", F.sum(new).over(by_user))
    numbered = numbered.withColumn("started", F.min("ts").over(Window.partitionBy("user_id", "session")))
    kinds = numbered.withColumn("weight", F.coalesce(_weight(POSITIVE), _weight(NEGATIVE))).where("weight IS NOT NULL")
    kinds = kinds.withColumn("kind", F.when(F.col("act").isin(*POSITIVE), 0).otherwise(1))
    first = F.min(F.struct("ts", "event_id", "weight")).alias("x")
    return kinds.groupBy("started", "user_id", "track", "kind").agg(first).select("started", "user_id", "track", "kind", "x.*")


def training_pairs(found: DataFrame) -> DataFrame:
    """low, high, anchor, other, kind, weight, seq for each two tracks of ``signals``: the first pair that they make, over sessions in
    order, in each of them positives with positives first (kind 0), then positives with negatives (kind 1).

    The first session in which two tracks make a pair is found by a number that orders sessions, so this is an aggregate of numbers
    that needs no sorting; what the pair is, is then worked out for that session only.
    """
    signal = F.struct("ts", "event_id", "weight")
    wide = found.groupBy("started", "user_id", "track").agg(*[F.min(F.when(F.col("kind") == kind, signal)).alias(name) for kind, name in ((0, "p"), (1, "n"))])
    # Users of one moment stay apart: their ids are less than 2e19 from each other.
    order = F.unix_micros(F.col("started").cast("timestamp")).cast("decimal(18,0)") * F.lit(Decimal(2 * 10**19)) + F.col("user_id").cast("decimal(19,0)")
    wide = kept(wide.withColumn("session", order.cast("decimal(38,0)")), "signals")
    x, y = (wide.select("session", *[F.col(c).alias(f"{c}{side}") for c in ("track", "p", "n")]) for side in "xy")

    def pair(kind: int, i: str, j: str) -> Column:
        """``i`` before ``j``, null where one is missing, and whether the greater track is the anchor."""
        weight = F.least(F.lit(1.0), (F.col(f"{i}.weight") + F.col(f"{j}.weight")) / 2)
        row = F.struct(F.lit(kind).alias("kind"), *[F.col(f"{s}.{c}").alias(f"{n}_{c}") for s, n in ((i, "i"), (j, "j")) for c in ("ts", "event_id")], F.lit(i[1] == "y").alias("high_first"), weight.alias("weight"))
        there = F.col(i).isNotNull() & F.col(j).isNotNull()
        return F.when(there & (F.struct(f"{i}.ts", f"{i}.event_id") < F.struct(f"{j}.ts", f"{j}.event_id")) if kind == 0 else there, row)

    best = F.least(pair(0, "px", "py"), pair(0, "py", "px"), pair(1, "px", "ny"), pair(1, "py", "nx"))
    small = [side.select("session", f"track{i}", F.struct(f"p{i}.ts", f"p{i}.event_id").alias(f"k{i}"), *[F.col(f"{c}{i}").isNotNull().alias(f"{c}{i}") for c in "pn"]) for side, i in ((x, "x"), (y, "y"))]
    met = small[0].join(small[1], "session").where("trackx < tracky AND (px AND py AND kx != ky OR px AND ny OR py AND nx)")
    first = met.groupBy("trackx", "tracky").agg(F.min("session").alias("session"))
    sessions = wide.select("session", "started", "user_id", F.col("track").alias("trackx"))
    first = first.join(x, ["session", "trackx"]).join(y, ["session", "tracky"]).join(sessions, ["session", "trackx"])
    first = first.select(F.col("trackx").alias("low"), F.col("tracky").alias("high"), "started", "user_id", best.alias("x")).select("low", "high", "started", "user_id", "x.*")
    seq = F.struct("started", "user_id", "kind", *[F.struct(F.col(f"{n}_ts").alias("ts"), F.col(f"{n}_event_id").alias("event_id")).alias(n) for n in "ij"])
    ends = [F.when(F.col("high_first"), F.col(a)).otherwise(F.col(b)) for a, b in (("high", "low"), ("low", "high"))]
    return first.select("low", "high", seq.alias("seq"), ends[0].alias("anchor"), ends[1].alias("other"), "kind", "weight")


_SIGNALS = f"""{_A}, n AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM a),
u AS (SELECT *, sum(CASE WHEN coalesce(gap, 172800000001) > 172800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM n),
k AS (SELECT *, min(ts) OVER (PARTITION BY user_id, session) AS started, CASE WHEN act IN ('replay', 'like', 'play_complete') THEN 0 WHEN act LIKE 'skip%' OR act = 'dislike' THEN 1 END AS kind,
  CASE act WHEN 'replay' THEN 1.0::DOUBLE WHEN 'like' THEN 0.7::DOUBLE WHEN 'play_complete' THEN 0.7::DOUBLE WHEN 'skip_late' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM u),
s AS (SELECT started, user_id, track, kind, ts, event_id, weight FROM k WHERE kind IS NOT NULL),
m AS (SELECT x.started, x.user_id, x.track AS anchor, y.track AS other, y.kind, x.ts AS i, x.event_id AS ii, y.ts AS j, y.event_id AS jj, least(1, (x.weight + y.weight) / 2) AS weight
  FROM s x JOIN s y ON x.started = y.started AND x.user_id = y.user_id AND x.kind = 0 AND x.track != y.track AND (y.kind = 1 OR (x.ts, x.event_id) < (y.ts, y.event_id))),
p AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY least(anchor, other), greatest(anchor, other) ORDER BY started, user_id, kind, i, ii, j, jj) = 1)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_pairs(signals(all_actions(spark, sf_dir), 48))


@query(f"WITH {_SIGNALS} SELECT anchor, other, CASE kind WHEN 0 THEN 'positive' ELSE 'negative' END AS kind, round(weight, 6) AS weight FROM p")
def first_pairs(spark, sf_dir):
    """Pairs of tracks for training, each with the first kind, anchor and weight that the log gives it."""
    return _pairs(spark, sf_dir).select("anchor", "other", F.when(F.col("kind") == 0, "positive").otherwise("negative").alias("kind"), F.round("weight", 6).alias("weight"))


@query(f"WITH {_SIGNALS}, r AS (SELECT * FROM m WHERE kind = 1 QUALIFY row_number() OVER (PARTITION BY anchor, other ORDER BY started, user_id, i, ii, j, jj) = 1) SELECT anchor AS higher, other AS lower, round(weight, 6) AS weight FROM r")
def rank_pairs(spark, sf_dir):
    """Which track is preferred to which: a positive signal over a negative one in the same session; first weight wins."""
    found = signals(all_actions(spark, sf_dir), 48)
    a = found.where("kind = 0").select("started", "user_id", F.col("track").alias("higher"), F.struct("ts", "event_id").alias("i"), F.col("weight").alias("wa"))
    b = found.where("kind = 1").select("started", "user_id", F.col("track").alias("lower"), F.struct("ts", "event_id").alias("j"), F.col("weight").alias("wb"))
    met = a.join(b, ["started", "user_id"]).where("higher != lower")
    first = F.min(F.struct("started", "user_id", "i", "j", F.least(F.lit(1.0), (F.col("wa") + F.col("wb")) / 2).alias("weight"))).alias("x")
    return met.groupBy("higher", "lower").agg(first).select("higher", "lower", F.round("x.weight", 6).alias("weight"))


@query(f"""WITH {_SIGNALS} SELECT x.anchor, x.other AS positive, y.other AS negative, round(least(1, (x.weight + y.weight) / 2), 6) AS weight FROM p x JOIN p y ON x.anchor = y.anchor AND x.kind = 0 AND y.kind = 1 AND x.other != y.other
ORDER BY x.started, x.user_id, x.i, x.ii, x.j, x.jj, y.started, y.user_id, y.i, y.ii, y.j, y.jj LIMIT 10000""")
def triplets(spark, sf_dir):
    """Anchor, positive and negative from pairs of the same anchor; the first 10,000 in the order of the pairs (a limit of the operator)."""
    pairs = _pairs(spark, sf_dir)
    a = pairs.where("kind = 0").select("anchor", F.col("other").alias("positive"), F.col("seq").alias("s"), F.col("weight").alias("wa"))
    b = pairs.where("kind = 1").select("anchor", F.col("other").alias("negative"), F.col("seq").alias("t"), F.col("weight").alias("wb"))
    met = a.join(b, "anchor").where("positive != negative").withColumn("weight", F.round(F.least(F.lit(1.0), (F.col("wa") + F.col("wb")) / 2), 6))
    return met.orderBy("s", "t").limit(10_000).select("anchor", "positive", "negative", "weight")


@query("SELECT track, act, count(*) OVER (PARTITION BY track) >= 5 AS eligible, count(*) AS events FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS track, event_type AS act FROM events) GROUP BY track, act")
def eligible_tracks(spark, sf_dir):
    """Events of each track and kind, and whether the track has enough kinds of them."""
    raw = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("track"), F.col("event_type").alias("act"))
    kinds = raw.groupBy("track", "act").agg(F.count("*").alias("events"))
    return kinds.withColumn("eligible", F.count("*").over(Window.partitionBy("track")) >= 5)


# The rating that an action stands for.
STARS = {"replay": 5, "like": 4, "play_complete": 4, "play": 3, "skip_late": 2, "skip": 1, "skip_early": 1, "dislike": 1}


@query(f"""WITH {_A}, s AS (SELECT track, act, CASE WHEN act = 'replay' THEN 5 WHEN act IN ('like', 'play_complete') THEN 4 WHEN act = 'play' THEN 3 WHEN act = 'skip_late' THEN 2 ELSE 1 END AS stars FROM a)
SELECT track, round(avg(stars), 6) AS rating, count(*) FILTER (stars >= 4) AS positive, count(*) FILTER (act = 'skip_early') AS early_skips FROM s GROUP BY track""")
def track_stars(spark, sf_dir):
    """The mean rating that a track's actions stand for, and how many were positive or early skips."""
    stars = F.create_map(*[F.lit(x) for pair in STARS.items() for x in pair])[F.col("act")]
    rows = all_actions(spark, sf_dir).select("track", "act", stars.alias("stars"))
    return rows.groupBy("track").agg(F.round(F.avg("stars"), 6).alias("rating"), F.sum((F.col("stars") >= 4).cast("long")).alias("positive"), F.sum((F.col("act") == "skip_early").cast("long")).alias("early_skips"))


# Lookups -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {TRACKS}, b AS (SELECT sid_path, [60 + any_value(size), 200] AS l FROM t WHERE category IN ('PROMO', 'SMALL') GROUP BY sid_path), h AS (SELECT md5(sid_path) AS h, [300] AS l FROM t WHERE category IN ('SMALL', 'LARGE') GROUP BY 1)
SELECT track, coalesce(CASE WHEN len(b.l) > 0 THEN CASE WHEN song_index >= 2 THEN 200 ELSE NULL END END, CASE WHEN b.l IS NULL THEN h.l[1] END) AS seconds FROM t LEFT JOIN b ON b.sid_path = t.sid_path LEFT JOIN h ON h.h = md5(t.sid_path) WHERE song_index >= 2""")
def song_lengths(spark, sf_dir):
    """Lengths of songs (from the second on), by path or else by digest; beyond the last length of a file the last holds."""
    rows = tracks(spark, sf_dir)
    by_path = rows.where("category IN ('PROMO', 'SMALL')").groupBy("sid_path").agg(F.array(60 + F.min("size"), F.lit(200)).alias("l"))
    by_hash = rows.where("category IN ('SMALL', 'LARGE')").select(F.md5("sid_path").alias("h")).distinct().withColumn("k", F.array(F.lit(300)))
    joined = rows.where("song_index >= 2").withColumn("h", F.md5("sid_path")).join(by_path, "sid_path", "left").join(by_hash, "h", "left")
    lengths = F.coalesce("l", "k")
    return joined.select("track", F.when(lengths.isNotNull(), F.element_at(lengths, F.least("song_index", F.size(lengths)))).alias("seconds"))


@query("""WITH b AS (SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 20), c AS (SELECT p_brand, p_partkey FROM part WHERE p_brand != 'Brand#7' QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey) <= 20),
x AS (SELECT b.p_brand, count(*) AS n, count(c.p_partkey) AS shared FROM b LEFT JOIN c USING (p_brand, p_partkey) GROUP BY b.p_brand), y AS (SELECT p_brand, count(*) AS k FROM c GROUP BY p_brand)
SELECT p_brand, shared, round(shared / (n + coalesce(k, 0) - shared)::DOUBLE, 6) AS jaccard, round(shared / n::DOUBLE, 6) AS recall FROM x LEFT JOIN y USING (p_brand)""")
def station_recall(spark, sf_dir):
    """Stations of one ranking against those of another, by seed: Jaccard and recall; a seed that the other lacks has 0."""
    parts = table(spark, sf_dir, "part")

    def best(rows: DataFrame, *order) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("p_brand").orderBy(*order))
        return rows.withColumn("place", place).where("place <= 20").groupBy("p_brand").agg(F.collect_set("p_partkey").alias("s"))

    a = best(parts, F.desc("p_retailprice"), F.col("p_partkey"))
    b = best(parts.where("p_brand != 'Brand#7'"), F.desc("p_size"), F.desc("p_retailprice"), F.col("p_partkey")).withColumnRenamed("s", "t")
    both = a.join(b, "p_brand", "left").withColumn("t", F.coalesce("t", F.array().cast("array<bigint>")))
    shared = F.size(F.array_intersect("s", "t"))
    return both.select("p_brand", shared.cast("long").alias("shared"), F.round(shared / F.size(F.array_union("s", "t")), 6).alias("jaccard"), F.round(shared / F.size("s"), 6).alias("recall"))


@query(f"""WITH a AS ({CALIBRATED}), b AS (SELECT l_partkey, CASE WHEN l_partkey % 6 = 0 THEN least(5, e + 1) ELSE e END AS e, m, CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE c END AS c FROM a WHERE l_partkey % 10 != 3)
SELECT count(*) AS n, round(avg((a.e = b.e)::INT), 6) AS e, round(avg((a.m = b.m)::INT), 6) AS m, round(avg((a.c = b.c)::INT), 6) AS c, round(avg(abs(a.c - b.c)), 6) AS apart FROM a JOIN b USING (l_partkey)""")
def paired_engines(spark, sf_dir):
    """Two engines' ratings of the tracks that both have: shares that agree, and how far apart they are."""
    a = calibrated_ratings(spark, sf_dir)
    other = {"e": F.when(F.col("l_partkey") % 6 == 0, F.least(F.lit(5), F.col("e") + 1)).otherwise(F.col("e")), "m": F.col("m"), "c": F.when(F.col("l_partkey") % 9 == 0, 1).otherwise(F.col("c"))}
    b = a.where("l_partkey % 10 != 3").select("l_partkey", *[x.alias(f"b_{c}") for c, x in other.items()])
    both = a.join(b, "l_partkey")
    return both.agg(F.count("*").alias("n"), *[F.round(F.avg((F.col(c) == F.col(f"b_{c}")).cast("int")), 6).alias(c) for c in "emc"], F.round(F.avg(F.abs(F.col("c") - F.col("b_c"))), 6).alias("apart"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(p_name, 'unknown') AS title, coalesce(p_size, 0) AS size FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_type != 'SMALL') ON p_partkey = l_partkey WHERE l_orderkey % 20 = 0""")
def enriched(spark, sf_dir):
    """Rows with what a table of files knows about their track; unknown where it has none."""
    files = table(spark, sf_dir, "part").where("p_type != 'SMALL'").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    rows = table(spark, sf_dir, "lineitem").where("l_orderkey % 20 = 0").join(files, "l_partkey", "left")
    return rows.select("l_orderkey", "l_linenumber", F.coalesce("p_name", F.lit("unknown")).alias("title"), F.coalesce("p_size", F.lit(0)).alias("size"))


@query(f"WITH {TRACKS}, x AS (SELECT regexp_replace(concat('C64Music/', sid_path), '^C64Music/', '') AS path, track FROM t), s AS (SELECT DISTINCT sid_path AS path FROM t WHERE category = 'LARGE' AND composer < 'Brand#15') SELECT track, path FROM x JOIN s USING (path)")
def subset_by_path(spark, sf_dir):
    """Records of a subset of files, matched by path without the collection's folder in front; others are left out."""
    plain = lambda c: F.regexp_replace(c, "^C64Music/", "")
    records = tracks(spark, sf_dir).select("track", plain(F.concat(F.lit("C64Music/"), "sid_path")).alias("path"))
    subset = tracks(spark, sf_dir).where("category = 'LARGE' AND composer < 'Brand#15'").select(plain(F.col("sid_path")).alias("path")).distinct()
    return records.join(subset, "path", "left_semi").select("track", "path")


@query("SELECT 'recovered' AS source, vec_id AS id, label::BIGINT AS value, NULL::VARCHAR AS text FROM embeddings WHERE label < 3 UNION ALL SELECT 'classified', doc_id, NULL, lang FROM documents")
def all_sources(spark, sf_dir):
    """Records of two kinds as one table; what a kind lacks is null."""
    a = table(spark, sf_dir, "embeddings").where("label < 3").select(F.lit("recovered").alias("source"), F.col("vec_id").alias("id"), F.col("label").cast("long").alias("value"))
    b = table(spark, sf_dir, "documents").select(F.lit("classified").alias("source"), F.col("doc_id").alias("id"), F.col("lang").alias("text"))
    return a.unionByName(b, allowMissingColumns=True)


@query(f"WITH {TRACKS}, d AS (SELECT DISTINCT sid_path FROM t) SELECT sid_path, row_number() OVER (ORDER BY sid_path) - 1 AS ordinal FROM d")
def path_ordinals(spark, sf_dir):
    """Distinct paths in bytewise order, numbered from 0. Folders are counted first, so each is numbered on its own."""
    paths = tracks(spark, sf_dir).select("sid_path").distinct().withColumn("folder", F.regexp_extract("sid_path", "^(.*/)[^/]*$", 1))
    before = Window.orderBy("folder").rowsBetween(Window.unboundedPreceding, -1)
    offset = paths.groupBy("folder").agg(F.count("*").alias("n")).select("folder", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))  # a row for each folder
    inside = F.row_number().over(Window.partitionBy("folder").orderBy("sid_path"))
    return paths.join(offset, "folder").select("sid_path", (F.col("ahead") + inside - 1).alias("ordinal"))


@query(f"WITH {TRACKS} SELECT track, sid_path, song_index FROM t WHERE song_index != 3 QUALIFY row_number() OVER (PARTITION BY sid_path, song_index ORDER BY price DESC, track) = 1")
def songs_once(spark, sf_dir):
    """A queue (dearest first) with each song once: the first stays."""
    first = F.min_by(F.struct("track", "sid_path", "song_index"), F.struct(-F.col("price"), "track")).alias("x")
    return tracks(spark, sf_dir).where("song_index != 3").groupBy("sid_path", "song_index").agg(first).select("x.*")


@query("SELECT vec_id, len(v) AS dims FROM (SELECT vec_id // 2 AS vec_id, vec_id AS row, embedding[1:CASE WHEN vec_id % 5 = 0 THEN 24 ELSE 24 + vec_id % 3 END] AS v FROM embeddings) WHERE len(v) = 24 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY row DESC) = 1")
def perceptual_vectors(spark, sf_dir):
    """Vectors of exactly 24 elements; of a track's several the last."""
    width = F.when(F.col("vec_id") % 5 == 0, 24).otherwise(24 + F.col("vec_id") % 3).cast("int")
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("track"), "vec_id", F.slice("embedding", F.lit(1), width).alias("v")).where("size(v) = 24")
    return rows.groupBy("track").agg(F.max_by("v", "vec_id").alias("v")).select(F.col("track").alias("vec_id"), F.size("v").cast("long").alias("dims"))


@query("SELECT p_partkey, p_name, 0::BIGINT AS decayed_plays FROM part WHERE p_partkey IN (3, 14, 15, 92, 65)")
def tracks_by_id(spark, sf_dir):
    """Tracks looked up by a list of ids; columns that an old table lacks are constants."""
    wanted = [3, 14, 15, 92, 65]
    parts = table(spark, sf_dir, "part")
    absent = [F.lit(0).cast("long").alias(c) for c in ("decayed_plays",) if c not in parts.columns]
    return parts.where(F.col("p_partkey").isin(wanted)).select("p_partkey", "p_name", *absent)
