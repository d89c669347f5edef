"""Aggregates that describe a corpus: statistics of features, profiles, spreads, retrieval, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions.ranks import counted
from tracklens.operators.catalogue import CALIBRATED, calibrated_ratings
from tracklens.operators.feedback import _E, events
from tracklens.operators.scalars import RATED, TRACKS, rated, tracks
from tracklens.operators.vectors import neighbours, vectors
from tracklens.plans.define import family
from tracklens.sources.tables import table

QUERIES, ORACLES, query = family()


@query("""WITH p AS (SELECT unnest(embedding[1:24])::DOUBLE AS x, generate_subscripts(embedding[1:24], 1) - 1 AS i FROM embeddings)
SELECT i AS feature, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sigma, count(*) FILTER (abs(x) > 1e-12) AS nonzero FROM p GROUP BY i HAVING stddev_pop(x) > 0""")
def feature_statistics(spark, sf_dir):
    """Count, mean, population deviation and non-zero values of each feature; features without a deviation are left out."""
    rows = table(spark, sf_dir, "embeddings").select(F.posexplode(F.slice("embedding", 1, 24)).alias("feature", "x")).withColumn("x", F.col("x").cast("double"))
    stats = rows.groupBy("feature").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sigma"), F.sum((F.abs("x") > 1e-12).cast("long")).alias("nonzero"))
    return stats.where("sigma > 0").select(F.col("feature").cast("long").alias("feature"), "n", F.round("mean", 6).alias("mean"), F.round("sigma", 6).alias("sigma"), "nonzero")


@query("""SELECT event_id, round(CASE WHEN event_id % 5 = 0 AND event_id % 3 = 0 THEN 0 ELSE (CASE WHEN event_id % 5 = 0 THEN 0 ELSE 0.7::DOUBLE * value END + CASE WHEN event_id % 3 = 0 THEN 0 ELSE 0.3::DOUBLE * user_id END) / (CASE WHEN event_id % 5 = 0 THEN 0 ELSE 0.7::DOUBLE END + CASE WHEN event_id % 3 = 0 THEN 0 ELSE 0.3::DOUBLE END) END, 6) AS average, NOT (event_id % 5 = 0 AND event_id % 3 = 0) AS present FROM events""")
def present_averages(spark, sf_dir):
    """The weighted mean of the terms that a row has; none: 0 and not present."""
    terms = [(0.7, F.when(F.col("event_id") % 5 != 0, F.col("value"))), (0.3, F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("double")))]
    weight = sum(F.when(x.isNotNull(), w).otherwise(0.0) for w, x in terms)
    total = sum(F.coalesce(w * x, F.lit(0.0)) for w, x in terms)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.when(weight > 0, total / weight).otherwise(0.0), 6).alias("average"), (weight > 0).alias("present"))


@query(f"""WITH {RATED}, p AS (SELECT composer, avg(e) AS e, avg(m) AS m, avg(c) AS c, count(*) AS n FROM r GROUP BY composer HAVING count(*) >= 3)
SELECT b.composer, b.n AS tracks, round(1 - sqrt((a.e - b.e) * (a.e - b.e) + (a.m - b.m) * (a.m - b.m) + (a.c - b.c) * (a.c - b.c)) / 8.66::DOUBLE, 6) AS similarity FROM p a JOIN p b ON a.composer = 'Brand#12' AND b.composer != a.composer ORDER BY similarity DESC, b.composer LIMIT 10""")
def similar_composers(spark, sf_dir):
    """The ten composers (three tracks at least) whose mean ratings are nearest to one composer's."""
    profiles = rated(spark, sf_dir).groupBy("composer").agg(*[F.avg(x).alias(x) for x in "emc"], F.count("*").alias("tracks")).where("tracks >= 3")
    seed = profiles.where("composer = 'Brand#12'").select(*[F.col(x).alias(f"s{x}") for x in "emc"])  # one row
    away = F.expr("sqrt((e - se) * (e - se) + (m - sm) * (m - sm) + (c - sc) * (c - sc))")
    others = profiles.where("composer != 'Brand#12'").crossJoin(F.broadcast(seed))
    return others.select("composer", "tracks", F.round(1 - away / 8.66, 6).alias("similarity")).orderBy(F.desc("similarity"), "composer").limit(10)


@query(f"WITH {RATED}, w AS (SELECT *, track % 4 AS w FROM r WHERE track < 40) SELECT composer, round(sum(w * e) / sum(w), 6) AS e, round(sum(w * m) / sum(w), 6) AS m, round(sum(w * c) / sum(w), 6) AS c FROM w GROUP BY composer HAVING sum(w) > 0")
def rating_centroids(spark, sf_dir):
    """Weighted means of the ratings; no weight, no mean."""
    rows = rated(spark, sf_dir).where("track < 40").withColumn("w", F.col("track") % 4)
    mean = [F.round(F.sum(F.col("w") * F.col(x)) / F.sum("w"), 6).alias(x) for x in "emc"]
    return rows.groupBy("composer").agg(F.sum("w").alias("all"), *mean).where(F.col("all") > 0).drop("all")


@query(f"""WITH {TRACKS}, d AS (SELECT category, composer, count(*) AS n FROM t GROUP BY ALL), c AS (SELECT composer, count(*) AS n FROM t GROUP BY composer)
SELECT (SELECT min(n) FROM d) AS least, (SELECT max(n) FROM d) AS most, (SELECT max(n) FROM c) AS prolific, (SELECT count(DISTINCT size) FROM t) AS years, (SELECT min(size) FROM t) AS first_year""")
def corpus_context(spark, sf_dir):
    """Tracks of the emptiest and the fullest folder, of the most prolific composer, and the years that occur."""
    rows = tracks(spark, sf_dir)
    folders = rows.groupBy("category", "composer").agg(F.count("*").alias("n"))
    composers = folders.groupBy("composer").agg(F.sum("n").alias("n")).agg(F.max("n").alias("prolific"))
    years = rows.agg(F.countDistinct("size").alias("years"), F.min("size").alias("first_year"))
    return folders.agg(F.min("n").alias("least"), F.max("n").alias("most")).crossJoin(composers).crossJoin(years)  # a row each


@query(f"""WITH r AS ({CALIBRATED}), l AS (SELECT 'e' AS dim, e AS level FROM r UNION ALL SELECT 'm', m FROM r UNION ALL SELECT 'c', least(3, c) FROM r), n AS (SELECT dim, level, count(*) AS n FROM l GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY dim) AS p FROM n)
SELECT dim, count(*) AS levels, round(max(p), 6) AS largest, round(sum(-p * log2(p)), 6) AS bits FROM s GROUP BY dim""")
def rating_spread(spark, sf_dir):
    """Levels in use, the share of the commonest, and the entropy of each rating."""
    dims = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), x.alias("level")) for d, x in (("e", F.col("e")), ("m", F.col("m")), ("c", F.least(F.lit(3), F.col("c"))))])).alias("x")
    counts = calibrated_ratings(spark, sf_dir).select(dims).groupBy("x.dim", "x.level").agg(F.count("*").alias("n"))
    shares = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("dim")))  # a row for each level
    return shares.groupBy("dim").agg(F.count("*").alias("levels"), F.round(F.max("p"), 6).alias("largest"), F.round(F.sum(-F.col("p") * F.log2("p")), 6).alias("bits"))


@query("""WITH n AS (SELECT vec_id, label, vec_id // 3 AS file, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT a.vec_id, a.label, b.label AS other, a.file = b.file AS sibling, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.vec_id) AS place FROM n a JOIN n b ON a.vec_id != b.vec_id QUALIFY place <= 10),
g AS (SELECT label, count(*) AS n FROM n GROUP BY label), f AS (SELECT file, count(*) AS n FROM n GROUP BY file), lf AS (SELECT label, file, count(*) AS n FROM n GROUP BY ALL),
c AS (SELECT ((SELECT sum(n * (n - 1)) FROM g) - (SELECT sum(n * (n - 1)) FROM lf)) / ((SELECT count(*) * (count(*) - 1) FROM n) - (SELECT sum(n * (n - 1)) FROM f))::DOUBLE AS chance)
SELECT round(avg((label = other)::INT) FILTER (NOT sibling), 6) AS precision, round(any_value(chance), 6) AS chance, round(avg((label = other)::INT) FILTER (NOT sibling) / any_value(chance), 4) AS lift FROM s, c""")
def retrieval_lift(spark, sf_dir):
    """Of the ten nearest that are in another file, the share of the same label; what chance would give, from counts of pairs; and their ratio."""
    rows = vectors(spark, sf_dir).withColumn("file", F.floor(F.col("vec_id") / 3))
    own = rows.select("vec_id", "v")
    near = neighbours(own, own, 10).where("floor(vec_id / 3) != floor(neighbour / 3)")
    found = near.join(rows.select("vec_id", "label"), "vec_id").join(rows.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("other")), "neighbour")
    pairs = lambda *by: rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("-".join(by) or "all"))
    counts = pairs("label").crossJoin(pairs("label", "file")).crossJoin(pairs()).crossJoin(pairs("file"))  # a row each
    chance = (F.col("label") - F.col("label-file")) / (F.col("all") - F.col("file"))
    hits = found.agg(F.avg((F.col("label") == F.col("other")).cast("int")).alias("precision"))
    return hits.crossJoin(counts.select(chance.alias("chance"))).select(F.round("precision", 6).alias("precision"), F.round("chance", 6).alias("chance"), F.round(F.col("precision") / F.col("chance"), 4).alias("lift"))


@query(f"WITH {_E} SELECT user_id, count(*) FILTER (act IN ('play', 'play_complete', 'replay')) AS played, count(*) FILTER (act = 'skip_early') AS skipped, count(*) FILTER (act = 'like') AS liked, round(sum(value), 4) AS seconds FROM e GROUP BY user_id")
def playback_counts(spark, sf_dir):
    """What each listener played, skipped and liked."""
    count = lambda *a: F.sum(F.col("act").isin(*a).cast("long"))
    return events(spark, sf_dir).groupBy("user_id").agg(count("play", "play_complete", "replay").alias("played"), count("skip_early").alias("skipped"), count("like").alias("liked"), F.round(F.sum("value"), 4).alias("seconds"))


@query(f"SELECT count(*) AS rated, count(*) FILTER (e <= 2) AS low, count(*) FILTER (e >= 3) AS fair, count(*) FILTER (e >= 4) AS high FROM ({CALIBRATED})")
def rating_anchors(spark, sf_dir):
    """How many tracks are rated low, fair and high."""
    count = lambda test: F.sum(F.expr(test).cast("long"))
    return calibrated_ratings(spark, sf_dir).agg(F.count("*").alias("rated"), count("e <= 2").alias("low"), count("e >= 3").alias("fair"), count("e >= 4").alias("high"))


@query("SELECT event_type AS label, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def timers(spark, sf_dir):
    """Count, sum, least, most and mean of a measure by label."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))


@query("""WITH s AS (SELECT o_orderpriority AS station, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT station, max(x) FILTER (i = CAST(floor(0.1::DOUBLE * (n - 1)) AS BIGINT)) AS p10, max(x) FILTER (i = CAST(floor(0.5::DOUBLE * (n - 1)) AS BIGINT)) AS p50, max(x) FILTER (i = CAST(floor(0.9::DOUBLE * (n - 1)) AS BIGINT)) AS p90 FROM s GROUP BY station""")
def station_quantiles(spark, sf_dir):
    """Tenth, half and nine tenths of a station's values, taken at floor(f (n - 1)) without interpolation."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("station"), F.col("o_totalprice").alias("x"))
    known = counted(rows, ["station"], "x")
    at = lambda f: F.max(F.when((F.floor(f * (F.col("total") - 1)) >= F.col("below")) & (F.floor(f * (F.col("total") - 1)) < F.col("below") + F.col("n")), F.col("x")))
    return known.groupBy("station").agg(*[at(f).alias(name) for name, f in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))])


@query("""WITH p AS (SELECT p_brand, p_type, p_name, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 20), g AS (SELECT p_brand, p_type, count(*) AS n FROM p GROUP BY ALL)
SELECT p_brand AS station, count(*) AS groups, round(max(n) / sum(n), 6) AS largest, (SELECT count(DISTINCT p_name) FROM p WHERE p.p_brand = g.p_brand) AS files FROM g GROUP BY p_brand""")
def station_variety(spark, sf_dir):
    """Groups of a station, the share of the largest, and how many different files it has."""
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    rows = table(spark, sf_dir, "part").withColumn("place", place).where("place <= 20")
    groups = rows.groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).groupBy("p_brand").agg(F.count("*").alias("groups"), F.round(F.max("n") / F.sum("n"), 6).alias("largest"))
    files = rows.groupBy("p_brand").agg(F.countDistinct("p_name").alias("files"))
    return groups.join(files, "p_brand").withColumnRenamed("p_brand", "station")
