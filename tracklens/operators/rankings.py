"""Stations, samples and splits: scores, the best of them, and who is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions.columns import title_similarity, tokens
from tracklens.operators.catalogue import _TITLE_SIMILARITY, _WORDS
from tracklens.operators.feedback import FEEDBACK_TOTALS, feedback_totals
from tracklens.operators.scalars import _FNV, RATED, TRACKS, fnv1a, rated, tracks
from tracklens.operators.vectors import vectors
from tracklens.plans.define import family
from tracklens.sources.tables import table

QUERIES, ORACLES, query = family()

_COUNTS = ("likes", "dislikes", "skips", "plays")


def _told(spark, sf_dir) -> DataFrame:
    """Rated tracks with their feedback, zeros without, and a year."""
    told = feedback_totals(spark, sf_dir).select("track", *_COUNTS)
    return rated(spark, sf_dir).join(told, "track", "left").fillna(0, list(_COUNTS)).withColumn("year", F.col("size") % 15 + 1980)


_TOLD = f"""{RATED}, q AS (SELECT r.*, coalesce(likes, 0) AS likes, coalesce(dislikes, 0) AS dislikes, coalesce(skips, 0) AS skips, coalesce(plays, 0) AS plays, size % 15 + 1980 AS year FROM r LEFT JOIN ({FEEDBACK_TOTALS}) f ON f.track = r.track)"""
_QUALITY = "(e + m + c) / 3{0} * 10 + likes * 5 - dislikes * 3 - least(skips, 5) * 0.5{0} + least(plays, 10) * 0.2{0}"


@query(f"WITH {_TOLD}, o AS (SELECT * FROM q WHERE year BETWEEN 1985 AND 1989 ORDER BY track LIMIT 60) SELECT track, year, round({_QUALITY.format('::DOUBLE')}, 6) AS quality FROM o ORDER BY quality DESC, track LIMIT 20")
def era_station(spark, sf_dir):
    """The best 20 of an era's first 60 tracks (three times the limit, in catalogue order), by quality."""
    first = _told(spark, sf_dir).where("year BETWEEN 1985 AND 1989").orderBy("track").limit(60)
    return first.select("track", "year", F.round(F.expr(_QUALITY.format("D")), 6).alias("quality")).orderBy(F.desc("quality"), "track").limit(20)


@query(f"WITH {_TOLD} SELECT track, round({_QUALITY.format('::DOUBLE')}, 6) AS quality FROM (SELECT * FROM q ORDER BY e * e + m * m + c * c, track LIMIT 500) WHERE e >= 2 AND m >= 2 AND c >= 2 AND contains(lower(category), 'sta') ORDER BY quality DESC, track LIMIT 20")
def chip_station(spark, sf_dir):
    """Tracks of one chip model among the 500 of smallest rating vectors, with all ratings at two or more, by quality."""
    sample = _told(spark, sf_dir).orderBy(F.expr("e * e + m * m + c * c"), "track").limit(500)
    chosen = sample.where(F.expr("e >= 2 AND m >= 2 AND c >= 2") & F.contains(F.lower("category"), F.lit("sta")))
    return chosen.select("track", F.round(F.expr(_QUALITY.format("D")), 6).alias("quality")).orderBy(F.desc("quality"), "track").limit(20)


def boosted(rows: DataFrame, seed: DataFrame, limit: int, like: float, dislike: float, least: float) -> DataFrame:
    """track, similarity, score: the ``limit`` tracks nearest to ``seed`` (one row) by squared distance of ratings, whose similarity
    is then raised for likes and lowered for dislikes and skips; the cut comes before that."""
    away = F.expr("(e - se) * (e - se) + (m - sm) * (m - sm) + (c - sc) * (c - sc)")
    near = rows.crossJoin(F.broadcast(seed)).where("track != seed").withColumn("d", away).orderBy("d", "track").limit(limit)
    similarity = F.greatest(F.lit(0.0), 1 - F.col("d") / 10.0)
    score = similarity * F.pow(F.lit(like), F.least("likes", F.lit(5))) * F.pow(F.lit(dislike), F.least("dislikes", F.lit(5))) * F.pow(F.lit(0.9), F.least("skips", F.lit(3)))
    return near.select("track", similarity.alias("similarity"), score.alias("score")).where(F.col("similarity") >= least)


def _boost_sql(seed: int, limit: int, like: float, dislike: float, least: float, where: str = "true") -> str:
    return f"""WITH {_TOLD}, s AS (SELECT e AS se, m AS sm, c AS sc FROM q WHERE track = {seed}), n AS (SELECT q.*, (e - se) * (e - se) + (m - sm) * (m - sm) + (c - sc) * (c - sc) AS d FROM q, s WHERE track != {seed} AND {where} ORDER BY d, track LIMIT {limit}),
b AS (SELECT track, greatest(0, 1 - d / 10.0::DOUBLE) AS s, likes, dislikes, skips FROM n)
SELECT track, round(s, 6) AS similarity, round(s * pow({like}::DOUBLE, least(likes, 5)) * pow({dislike}::DOUBLE, least(dislikes, 5)) * pow(0.9::DOUBLE, least(skips, 3)), 6) AS score FROM b WHERE s >= {least}"""


def _boosted(spark, sf_dir, seed: int, limit: int, like: float, dislike: float, least: float, where: str = "true") -> DataFrame:
    rows = _told(spark, sf_dir)
    own = rows.where(F.col("track") == seed).select(F.col("track").alias("seed"), *[F.col(x).alias(f"s{x}") for x in "emc"])
    found = boosted(rows.where(where), own, limit, like, dislike, least)
    return found.select("track", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


@query(_boost_sql(5, 200, 1.1, 0.8, 0.5))
def similar_tracks(spark, sf_dir):
    """Tracks like one, those that others like first in score."""
    return _boosted(spark, sf_dir, 5, 200, 1.1, 0.8, 0.5)


@query(_boost_sql(11, 300, 1.3, 0.5, 0.3, "(likes > 0 OR plays > 5) AND (dislikes = 0 OR likes / greatest(dislikes, 1)::DOUBLE > 1.5)"))
def collaborative(spark, sf_dir):
    """The same among tracks that others like, with stronger boosts."""
    return _boosted(spark, sf_dir, 11, 300, 1.3, 0.5, 0.3, "(likes > 0 OR plays > 5) AND (dislikes = 0 OR likes / greatest(dislikes, 1) > 1.5)")


@query(f"WITH {TRACKS}, n AS (SELECT track, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS name FROM t), s AS (SELECT name AS own FROM n WHERE track = 2) SELECT n.track, n.name FROM n, s WHERE track != 2 AND (contains(name, substr(own, 1, 4)) OR contains(own, name))")
def game_soundtrack(spark, sf_dir):
    """Tracks whose name contains the game's or is contained in it."""
    names = tracks(spark, sf_dir).select("track", F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "").alias("name"))
    own = names.where("track = 2").select(F.col("name").alias("own"))  # one row
    return names.where("track != 2").crossJoin(F.broadcast(own)).where(F.contains("name", F.substring("own", 1, 4)) | F.contains("own", "name")).select("track", "name")


@query(f"""WITH {_TOLD}, w AS (SELECT *, {_WORDS.format("concat(title, ' ', category)")} AS w FROM q), s AS (SELECT w AS sw, composer AS sc, e AS se, m AS sm, c AS scc FROM w WHERE track = 40),
x AS (SELECT track, {_TITLE_SIMILARITY.format('w', 'sw')} AS title, 1 - sqrt((e - se) * (e - se) + (m - sm) * (m - sm) + (c - scc) * (c - scc)) / 6.93::DOUBLE AS style,
  greatest(0, least(1, likes / 10.0::DOUBLE) * 0.6::DOUBLE + least(1, plays / 50.0::DOUBLE) * 0.4::DOUBLE - least(1, dislikes / 10.0::DOUBLE) * 0.7::DOUBLE) AS feedback FROM w, s WHERE track != 40 AND composer != sc),
y AS (SELECT track, title, 0.7::DOUBLE * title + 0.25::DOUBLE * style + 0.05::DOUBLE * feedback AS score FROM x WHERE title >= 0.55)
SELECT track, round(title, 6) AS title_similarity, round(score, 6) AS score FROM y ORDER BY round(score, 6) DESC, track LIMIT 12""")
def remix_radar(spark, sf_dir):
    """The 12 likeliest remixes of a track: titles at 0.55 or more by other composers, scored by title, style and feedback."""
    rows = _told(spark, sf_dir).withColumn("w", tokens(F.concat_ws(" ", "title", "category")))
    own = rows.where("track = 40").select(F.col("w").alias("sw"), F.col("composer").alias("sc"), *[F.col(x).alias(f"s_{x}") for x in "emc"])  # one row
    met = rows.where("track != 40").crossJoin(F.broadcast(own)).where("composer != sc").withColumn("title_similarity", title_similarity(F.col("w"), F.col("sw"))).where("title_similarity >= 0.55")
    style = F.expr("1 - sqrt((e - s_e) * (e - s_e) + (m - s_m) * (m - s_m) + (c - s_c) * (c - s_c)) / 6.93D")
    share = lambda c, n: F.least(F.lit(1.0), F.col(c) / float(n))
    feedback = F.greatest(F.lit(0.0), share("likes", 10) * 0.6 + share("plays", 50) * 0.4 - share("dislikes", 10) * 0.7)
    score = F.round(0.7 * F.col("title_similarity") + 0.25 * style + 0.05 * feedback, 6)
    return met.select("track", F.round("title_similarity", 6).alias("title_similarity"), score.alias("score")).orderBy(F.desc("score"), "track").limit(12)


@query("SELECT p_name, p_partkey, CAST(row_number() OVER (ORDER BY p_name, p_partkey) AS INTEGER) AS place FROM part ORDER BY p_name, p_partkey LIMIT 50")
def bytewise_order(spark, sf_dir):
    """The first 50 names by the bytes of their UTF-8."""
    first = table(spark, sf_dir, "part").select("p_name", "p_partkey").orderBy("p_name", "p_partkey").limit(50)
    return first.withColumn("place", F.row_number().over(Window.orderBy("p_name", "p_partkey")))  # 50 rows


# Samples and splits ------------------------------------------------------------------------------------------------


def drawn(key: Column, seed: str) -> Column:
    """What orders rows as if at random, the same in every run: a digest of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


@query("SELECT p_partkey FROM part WHERE p_type != 'PROMO' ORDER BY md5('sample:' || p_partkey) LIMIT 40")
def random_sample(spark, sf_dir):
    """Forty tracks at random, without those that are excluded."""
    return table(spark, sf_dir, "part").where("p_type != 'PROMO'").select("p_partkey").orderBy(drawn(F.col("p_partkey"), "sample")).limit(40)


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%bolt%' ORDER BY md5('one:' || p_partkey) LIMIT 1")
def random_one(spark, sf_dir):
    """One track at random."""
    return table(spark, sf_dir, "part").where("p_name LIKE '%bolt%'").select("p_partkey").orderBy(drawn(F.col("p_partkey"), "one")).limit(1)


@query("SELECT p_partkey, CASE WHEN row_number() OVER (ORDER BY md5('split:' || p_partkey)) <= floor(count(*) OVER () * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM part")
def train_test_split(spark, sf_dir):
    """Exactly a fifth of the rows (rounded down) held out at random. Digests are cut into ranges by their first digits and
    counted; only the range of the cut is ranked."""
    rows = table(spark, sf_dir, "part").select("p_partkey", drawn(F.col("p_partkey"), "split").alias("k")).withColumn("r", F.substring("k", 1, 3))
    counts = rows.groupBy("r").agg(F.count("*").alias("n"))  # at most 4,096 rows
    before = F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.select(F.col("r").alias("_r"), before.alias("before"), F.floor(F.sum("n").over(Window.partitionBy()) * 0.2).alias("cut"))
    placed = rows.join(F.broadcast(ranges), F.col("r") == F.col("_r"))
    inside = F.row_number().over(Window.partitionBy("r").orderBy("k"))
    return placed.select("p_partkey", F.when(F.col("before") + inside <= F.col("cut"), "test").otherwise("train").alias("part"))


@query(f"WITH h AS (SELECT p_partkey, p_brand, CAST({_FNV.format('p_brand')} AS BIGINT) % 10000 AS h FROM part) SELECT p_brand, CASE WHEN h < 5000 THEN 'train' WHEN h < 7500 THEN 'validation' ELSE 'test' END AS part, count(*) AS n FROM h GROUP BY ALL")
def group_split(spark, sf_dir):
    """Whole groups (brands) to train, validation and test by a hash: half, a quarter, a quarter."""
    h = fnv1a("p_brand") % 10_000
    part = F.when(h < 5000, "train").when(h < 7500, "validation").otherwise("test")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).select("p_brand", part.alias("part"), "n")


@query("""WITH g AS (SELECT p_brand, count(*) AS n, md5('groups:' || p_brand) AS k FROM part GROUP BY p_brand), s AS (SELECT *, sum(n) OVER (ORDER BY k) AS upto FROM g), t AS (SELECT sum(n) * 0.4::DOUBLE AS most FROM g)
SELECT p_brand, n, CAST(upto AS BIGINT) AS upto FROM s, t WHERE upto <= most""")
def group_sample(spark, sf_dir):
    """Whole groups in random order while they fit into two fifths of the rows; the first that does not ends it."""
    groups = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))  # a row for each group
    upto = F.sum("n").over(Window.orderBy(drawn(F.col("p_brand"), "groups")))
    return groups.select("p_brand", "n", upto.alias("upto"), (F.sum("n").over(Window.partitionBy()) * 0.4).alias("most")).where("upto <= most").drop("most")


@query("""WITH b AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY sha256('subset:' || p_partkey)) AS round, count(*) OVER (PARTITION BY p_type) AS n FROM part WHERE p_size % 4 = 0)
SELECT p_partkey, p_type, round FROM b ORDER BY round, n, p_type LIMIT 100""")
def round_robin_subset(spark, sf_dir):
    """A hundred tracks, one of each bucket (type) in every round, small buckets first, in random order within. Each task keeps
    a hundred of a bucket (a window group limit)."""
    rows = table(spark, sf_dir, "part").where("p_size % 4 = 0")
    sizes = rows.groupBy("p_type").agg(F.count("*").alias("n"))
    key = F.sha2(F.concat(F.lit("subset:"), F.col("p_partkey").cast("string")), 256)
    placed = rows.select("p_partkey", "p_type", F.row_number().over(Window.partitionBy("p_type").orderBy(key)).cast("long").alias("round")).where("round <= 100")
    return placed.join(sizes, "p_type").orderBy("round", "n", "p_type").limit(100).select("p_partkey", "p_type", "round")


@query("WITH u AS (SELECT p_partkey, p_retailprice, (CAST(('0x' || substr(md5('weigh:' || p_partkey), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM part) SELECT p_partkey, round(-ln(u) / p_retailprice, 9) AS key FROM u ORDER BY -ln(u) / p_retailprice, p_partkey LIMIT 30")
def weighted_sample(spark, sf_dir):
    """Thirty tracks without replacement, the dearer the likelier: the smallest of -ln(u) / weight."""
    u = (F.conv(F.substring(drawn(F.col("p_partkey"), "weigh"), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    rows = table(spark, sf_dir, "part").select("p_partkey", (-F.ln(u) / F.col("p_retailprice")).alias("k"))
    return rows.orderBy("k", "p_partkey").limit(30).select("p_partkey", F.round("k", 9).alias("key"))


@query("""WITH a AS (SELECT p_partkey, 0 AS source, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS i FROM part WHERE p_type = 'PROMO' QUALIFY i <= 10), b AS (SELECT p_partkey, 1 AS source, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS i FROM part WHERE p_type = 'SMALL' QUALIFY i <= 6)
SELECT p_partkey, source, CAST(row_number() OVER (ORDER BY i, source) AS INTEGER) AS place FROM (FROM a UNION ALL FROM b)""")
def interleaved(spark, sf_dir):
    """Two lists in turn; what is left of the longer follows."""

    def best(kind: str, n: int, source: int) -> DataFrame:
        top = table(spark, sf_dir, "part").where(F.col("p_type") == kind).orderBy(F.desc("p_retailprice"), "p_partkey").limit(n)
        return top.select("p_partkey", F.lit(source).alias("source"), F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("i"))  # n rows

    both = best("PROMO", 10, 0).unionByName(best("SMALL", 6, 1))
    return both.select("p_partkey", "source", F.row_number().over(Window.orderBy("i", "source")).alias("place"))


@query("""WITH c AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS i FROM part WHERE p_type = 'LARGE' QUALIFY i <= 15), w(id, place) AS (VALUES (999999, 1)), o AS (SELECT p_partkey, CASE WHEN i = 4 THEN 0 ELSE i END AS k FROM c)
SELECT p_partkey, CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS place FROM o""")
def pinned_queue(spark, sf_dir):
    """A queue rebuilt around the track that plays (its fourth), which comes first and not twice."""
    top = table(spark, sf_dir, "part").where("p_type = 'LARGE'").orderBy(F.desc("p_retailprice"), "p_partkey").limit(15)
    placed = top.select("p_partkey", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("i"))  # 15 rows
    return placed.select("p_partkey", F.row_number().over(Window.orderBy(F.when(F.col("i") == 4, 0).otherwise(F.col("i")))).alias("place"))


@query("SELECT page_id, url FROM pages WHERE contains(url, '/en') ORDER BY page_id DESC LIMIT 10 OFFSET 10")
def second_page(spark, sf_dir):
    """The second page of ten, newest first, of what matches."""
    return table(spark, sf_dir, "pages").where(F.contains("url", F.lit("/en"))).select("page_id", "url").orderBy(F.desc("page_id")).offset(10).limit(10)


@query("SELECT vec_id FROM embeddings QUALIFY row_number() OVER (ORDER BY round(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE)), 6), vec_id) <= 50")
def smallest_vectors(spark, sf_dir):
    """The 50 vectors nearest to zero."""
    norm = F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6)
    return vectors(spark, sf_dir).orderBy(norm, "vec_id").limit(50).select("vec_id")


@query(f"""WITH {RATED}, s AS (SELECT e AS se, m AS sm, c AS sc FROM r WHERE track = 8), x AS (SELECT track, unnest([{{'dim': 'energy', 's': 100 - abs(e - se) * 25}}, {{'dim': 'mood', 's': 100 - abs(m - sm) * 25}}, {{'dim': 'complexity', 's': 100 - abs(c - sc) * 25}}]) AS f FROM r, s WHERE track BETWEEN 9 AND 30)
SELECT track, f.dim AS feature, f.s AS percent, CAST(row_number() OVER (PARTITION BY track ORDER BY f.s DESC, f.dim) AS INTEGER) AS place FROM x QUALIFY place <= 2""")
def explained(spark, sf_dir):
    """In what a track resembles the seed: its two most similar features, in percent."""
    rows = rated(spark, sf_dir)
    own = rows.where("track = 8").select(*[F.col(x).alias(f"s{x}") for x in "emc"])  # one row
    names = {"energy": "e", "mood": "m", "complexity": "c"}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), (100 - F.abs(F.col(c) - F.col(f"s{c}")) * 25).alias("percent")) for n, c in names.items()])).alias("x")
    found = rows.where("track BETWEEN 9 AND 30").crossJoin(F.broadcast(own)).select("track", each).select("track", "x.*")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("percent"), "feature"))).where("place <= 2")
