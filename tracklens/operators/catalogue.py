"""The catalogue: ratings by quantiles, normalisation, search, prominence, rarity and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklens.functions.columns import STOP_WORDS, title_similarity, tokens
from tracklens.functions.kept import kept
from tracklens.functions.ranks import counted, quantiles
from tracklens.sources.tables import table

MEASURES = {"e": "l_quantity", "m": "l_extendedprice", "c": "l_discount"}


def part_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three raw measures of each part: energy, mood, complexity."""
    means = [F.round(F.avg(col), 6).alias(name) for name, col in MEASURES.items()]
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(*means)


_M = "r AS (SELECT l_partkey, round(avg(l_quantity), 6) AS e, round(avg(l_extendedprice), 6) AS m, round(avg(l_discount), 6) AS c FROM lineitem GROUP BY l_partkey)"


def calibrated_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings from 1 to 5 by the quintiles of each measure over the corpus; a value on a break falls below.

    Breaks (a row for each measure) are exact and come from counts by range; they go to every executor.
    """
    raw = part_measures(spark, sf_dir)
    long = raw.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in MEASURES])).alias("x")).select("x.*")
    breaks = quantiles(long, ["measure"], "value", [0.2, 0.4, 0.6, 0.8])
    row = breaks.agg(*[F.max(F.when(F.col("measure") == c, F.col("breaks"))).alias(f"{c}_breaks") for c in MEASURES])

    def level(c: str):
        return (sum((F.col(c) > F.col(f"{c}_breaks")[i]).cast("int") for i in range(4)) + 1).alias(c)

    return raw.crossJoin(F.broadcast(row)).select("l_partkey", *[level(c) for c in MEASURES])


CALIBRATED = f"""WITH {_M}, b AS (SELECT quantile_cont(e, [0.2, 0.4, 0.6, 0.8]) AS eb, quantile_cont(m, [0.2, 0.4, 0.6, 0.8]) AS mb, quantile_cont(c, [0.2, 0.4, 0.6, 0.8]) AS cb FROM r)
SELECT l_partkey, CAST(len(list_filter(eb, lambda x: e > x)) + 1 AS INTEGER) AS e, CAST(len(list_filter(mb, lambda x: m > x)) + 1 AS INTEGER) AS m, CAST(len(list_filter(cb, lambda x: c > x)) + 1 AS INTEGER) AS c FROM r, b"""


def z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures less their mean, by the population deviation (0: 1)."""
    raw = part_measures(spark, sf_dir)
    stats = raw.agg(*[f(c).alias(f"{c}_{n}") for c in MEASURES for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    scaled = [F.round((F.col(c) - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_sd") > 0, F.col(f"{c}_sd")).otherwise(1.0), 4).alias(c) for c in MEASURES]
    return raw.crossJoin(F.broadcast(stats)).select("l_partkey", *scaled)


ZSCORES = f"""WITH {_M}, s AS (SELECT avg(e) AS ea, stddev_pop(e) AS es, avg(m) AS ma, stddev_pop(m) AS ms, avg(c) AS ca, stddev_pop(c) AS cs FROM r)
SELECT l_partkey, round((e - ea) / CASE WHEN es > 0 THEN es ELSE 1 END, 4) AS e, round((m - ma) / CASE WHEN ms > 0 THEN ms ELSE 1 END, 4) AS m, round((c - ca) / CASE WHEN cs > 0 THEN cs ELSE 1 END, 4) AS c FROM r, s"""


def rank_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's place among all by mean quantity: ties share the middle of their ranks."""
    raw = part_measures(spark, sf_dir).select("l_partkey", "e")
    placed = counted(raw, [], "e").select("e", ((F.col("below") + F.col("n") / 2.0) / F.col("total")).alias("place"))
    return raw.join(placed, "e").select("l_partkey", F.round("place", 6).alias("place"))


RANKS = f"WITH {_M} SELECT l_partkey, round((rank() OVER (ORDER BY e) - 1 + count(*) OVER (PARTITION BY e) / 2.0::DOUBLE) / count(*) OVER (), 6) AS place FROM r"


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name, brand or type has a word of the query, those with more hits first (top 50)."""
    words = ["blue", "brass", "small"]
    parts = table(spark, sf_dir, "part")
    field = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    hits = sum(F.contains(field, F.lit(w)).cast("int") for w in words)
    return parts.select("p_partkey", "p_name", hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "p_partkey").limit(50)


SEARCH = """WITH h AS (SELECT p_partkey, p_name, lower(concat_ws(' ', p_name, p_brand, p_type)) AS f FROM part)
SELECT p_partkey, p_name, CAST(contains(f, 'blue') AS INTEGER) + CAST(contains(f, 'brass') AS INTEGER) + CAST(contains(f, 'small') AS INTEGER) AS hits FROM h WHERE hits > 0 ORDER BY hits DESC, p_partkey LIMIT 50"""


def prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ln(tracks of a composer) by that of the most prolific one; null where that one has a single track."""
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy())  # a row for each brand
    return counts.select("p_brand", "n", F.round(F.when(most > 1, F.ln("n") / F.ln(most)), 6).alias("prominence"))


PROMINENCE = "SELECT p_brand, count(*) AS n, round(CASE WHEN max(count(*)) OVER () > 1 THEN ln(count(*)) / ln(max(count(*)) OVER ()) END, 6) AS prominence FROM part GROUP BY p_brand"


def rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How thinly a directory (type and brand) is filled: 1 for the emptiest, 0 for the fullest, 0.5 if all are alike."""
    counts = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    low, high = (f("n").over(Window.partitionBy()) for f in (F.min, F.max))  # a row for each directory
    return counts.select("p_type", "p_brand", "n", F.round(F.when(high > low, 1 - (F.col("n") - low) / (high - low)).otherwise(0.5), 6).alias("rarity"))


RARITY = """WITH d AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT min(n) AS a, max(n) AS b FROM d)
SELECT p_type, p_brand, n, round(CASE WHEN b > a THEN 1 - (n - a) / (b - a)::DOUBLE ELSE 0.5 END, 6) AS rarity FROM d, m"""


def per_file_cap(rows: DataFrame, file: str, order: list, target: int) -> DataFrame:
    """``rows`` with at most one row of each ``file`` (the first by ``order``), or two, or three: the least cap that keeps
    ``target`` rows; all rows where none does. ``place`` is the row's place in its file, ``cap`` the cap (null: none)."""
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(file).orderBy(*order)))
    kept = placed.agg(*[F.sum((F.col("place") <= c).cast("long")).alias(f"k{c}") for c in (1, 2, 3)])  # one row
    cap = F.when(F.col("k1") >= target, 1).when(F.col("k2") >= target, 2).when(F.col("k3") >= target, 3)
    return placed.crossJoin(F.broadcast(kept.select(cap.alias("cap")))).where("cap IS NULL OR place <= cap")


def brand_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At least 60 parts, the dearest of each brand first, as few of each as will do."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    return per_file_cap(parts, "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 60)


CAP = """WITH p AS (SELECT p_partkey, p_brand, p_retailprice, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS place FROM part),
c AS (SELECT CASE WHEN count(*) FILTER (place <= 1) >= 60 THEN 1 WHEN count(*) FILTER (place <= 2) >= 60 THEN 2 WHEN count(*) FILTER (place <= 3) >= 60 THEN 3 END AS cap FROM p)
SELECT p.*, CAST(cap AS INTEGER) AS cap FROM p, c WHERE cap IS NULL OR place <= cap"""


#: Words of a title that make a key together, at most.
TOGETHER = 3


def _subsets(words: Column, n: Column) -> Column:
    """All sets of ``n`` (1 to TOGETHER) of a list of words, each in the list's order."""
    after = lambda i: F.slice(words, i, F.greatest(F.size(words) - i + 1, F.lit(0)))
    ones = F.transform(words, lambda x: F.array(x))
    twos = F.flatten(F.transform(words, lambda x, i: F.transform(after(i + 2), lambda y: F.array(x, y))))
    threes = F.flatten(F.flatten(F.transform(words, lambda x, i: F.transform(after(i + 2), lambda y, j: F.transform(after(i + j + 3), lambda z: F.array(x, y, z))))))
    return F.when(n == 1, ones).when(n == 2, twos).otherwise(threes)


def title_pairs(titles: DataFrame, least: float) -> DataFrame:
    """title, other, similarity >= ``least`` for pairs of ``titles`` (title) with a word in common: Jaccard of their words, or what share of
    the longer the shorter makes up where it is contained in it (four characters at least).

    1. Titles of a and b words are so similar only if they share c = least * (a + b) / (1 + least) words. Of the a - c + l rarest of a title
       (the same order for all) l must then be shared, l up to TOGETHER: a key is the two numbers with l such words. Where c is
       not above TOGETHER, what meets is similar, so very common words alone join nothing.
    2. A title of y characters can make up so much only of one of x <= y / least, which then holds the first least * x of them: a key is x
       with these. Each title gives as many keys as it has places for them.
    """
    bound = least - 1e-6
    own = titles.select("title").distinct().withColumn("words", tokens(F.col("title"))).where(F.size("words") > 0)
    own = kept(own, "titles")
    often = own.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    ranked = own.select("title", F.explode("words").alias("w")).join(often, "w")
    ordered = ranked.groupBy("title").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("by")).select("title", F.transform("by", lambda x: x["w"]).alias("by"), F.size("by").alias("a"))
    sized = ordered.withColumn("b", F.explode(F.sequence(F.ceil(F.col("a") * bound).cast("int"), F.floor(F.col("a") / bound).cast("int"))))
    sized = sized.withColumn("c", F.ceil((F.col("a") + F.col("b")) * (bound / (1 + bound)) - 1e-9).cast("int")).withColumn("l", F.least("c", F.lit(TOGETHER)))
    rarest = F.slice("by", 1, F.col("a") - F.col("c") + F.col("l"))
    keyed = kept(sized.select("title", "a", "b", F.explode(_subsets(rarest, F.col("l"))).alias("some")).select("title", "a", "b", F.xxhash64(F.least("a", "b"), F.greatest("a", "b"), "some").alias("key")), "title-keys")
    fewer, more = keyed.where("a <= b").select("key", "title", (F.col("a") == F.col("b")).alias("level")), keyed.where("a >= b").select("key", F.col("title").alias("other"))
    alike = fewer.join(more, "key").where("title != other AND (NOT level OR title < other)").select("title", "other")

    joined = own.select("title", F.array_join("words", " ").alias("text")).withColumn("long", F.length("text")).where("long >= 4")
    wide = joined.withColumn("x", F.explode(F.sequence("long", F.floor(F.col("long") / bound).cast("int"))))
    head = lambda x: F.ceil(x * bound).cast("int")
    inner = wide.select("title", F.xxhash64("x", F.substring(F.col("text"), F.lit(1), head(F.col("x")))).alias("key"))
    places = joined.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("long") - head(F.col("long")) + 1)))
    outer = places.select(F.col("title").alias("other"), F.xxhash64("long", F.substring(F.col("text"), F.col("at"), head(F.col("long")))).alias("key"))
    within = inner.join(outer, "key").where("title != other").select("title", "other")

    met = alike.unionByName(within).select(F.least("title", "other").alias("title"), F.greatest("title", "other").alias("other")).distinct()
    met = met.withColumns({"words": tokens(F.col("title")), "others": tokens(F.col("other"))}).where(F.arrays_overlap("words", "others"))
    return met.select("title", "other", F.round(title_similarity(F.col("words"), F.col("others")), 6).alias("similarity")).where(F.col("similarity") >= least)


def similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles (first 30 characters of documents in English or German) at a similarity of 0.55 or more."""
    rows = table(spark, sf_dir, "documents").where("lang IN ('en', 'de')")
    return title_pairs(rows.select(F.substring("text", 1, 30).alias("title")), 0.55)


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_WORDS = f"list_sort(list_distinct(list_filter(regexp_split_to_array(lower({{}}), '[^a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({_STOP}))))"
_TITLE_SIMILARITY = """greatest(len(list_intersect({0}, {1})) / len(list_distinct({0} || {1}))::DOUBLE,
  CASE WHEN least(length(array_to_string({0}, ' ')), length(array_to_string({1}, ' '))) >= 4 AND (contains(array_to_string({0}, ' '), array_to_string({1}, ' ')) OR contains(array_to_string({1}, ' '), array_to_string({0}, ' ')))
  THEN least(length(array_to_string({0}, ' ')), length(array_to_string({1}, ' '))) / greatest(length(array_to_string({0}, ' ')), length(array_to_string({1}, ' ')))::DOUBLE ELSE 0 END)"""
TITLES = f"""WITH n AS (SELECT DISTINCT substr(text, 1, 30) AS title FROM documents WHERE lang IN ('en', 'de')), w AS (SELECT title, {_WORDS.format('title')} AS w FROM n)
SELECT a.title, b.title AS other, round({_TITLE_SIMILARITY.format('a.w', 'b.w')}, 6) AS similarity FROM w a JOIN w b ON a.title < b.title AND len(list_intersect(a.w, b.w)) > 0 WHERE len(a.w) > 0 AND len(b.w) > 0 AND similarity >= 0.55"""


def era(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each year, and the year's place among all orders (middle of its ranks)."""
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("value"))
    before = F.coalesce(F.sum("orders").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return years.select("year", "orders", "value", F.round((before + F.col("orders") / 2.0) / F.sum("orders").over(Window.partitionBy()), 6).alias("position"))


ERA = """WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS orders, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1)
SELECT year, orders, value, round((coalesce(sum(orders) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + orders / 2.0::DOUBLE) / sum(orders) OVER (), 6) AS position FROM y"""


QUERIES = {
    "calibrated_ratings": calibrated_ratings,
    "z_scores": z_scores,
    "rank_uniform": rank_uniform,
    "search": search,
    "prominence": prominence,
    "rarity": rarity,
    "brand_cap": brand_cap,
    "similar_titles": similar_titles,
    "era": era,
}
ORACLES = {
    "calibrated_ratings": CALIBRATED,
    "z_scores": ZSCORES,
    "rank_uniform": RANKS,
    "search": SEARCH,
    "prominence": PROMINENCE,
    "rarity": RARITY,
    "brand_cap": CAP,
    "similar_titles": TITLES,
    "era": ERA,
}
