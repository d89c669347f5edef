"""Personas: scores of listening styles from ratings, stations of the best tracks, and how stations overlap."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklens.functions.ranks import counted
from tracklens.operators.catalogue import CALIBRATED, calibrated_ratings
from tracklens.operators.scalars import _FNV, fnv1a

#: Tracks of a station.
STATION = 50

# Weight and direction of each metric (1: more is better, -1: less, 0: no matter), and the ratings aimed at.
PERSONAS = {
    "fast_paced": ({"rhythmic": (0.60, 1), "experimental": (0.15, -1), "melodic": (0.10, -1), "timbral": (0.10, -1), "nostalgic": (0.05, -1)}, {"e": 5, "m": 2, "c": 3}),
    "slow_ambient": ({"rhythmic": (0.60, -1), "melodic": (0.15, 1), "experimental": (0.10, -1), "nostalgic": (0.10, -1), "timbral": (0.05, 0)}, {"e": 2, "m": 4, "c": 4}),
    "melodic": ({"melodic": (0.60, 1), "timbral": (0.15, 1), "rhythmic": (0.10, 0), "nostalgic": (0.10, -1), "experimental": (0.05, -1)}, {"e": 3, "m": 5, "c": 5}),
    "experimental": ({"experimental": (0.60, 1), "timbral": (0.15, 1), "rhythmic": (0.10, 0), "nostalgic": (0.10, -1), "melodic": (0.05, -1)}, {"e": 5, "m": 2, "c": 5}),
    "nostalgic": ({"nostalgic": (0.60, 1), "melodic": (0.15, 1), "rhythmic": (0.10, 1), "experimental": (0.10, -1), "timbral": (0.05, -1)}, {"e": 3, "m": 5, "c": 3}),
}

#: The metrics from ratings of 1 to 5; a preference is not known and counts as the middle.
METRICS = {
    "rhythmic": "(e - 1) / 4e0",
    "melodic": "(c - 1) / 4e0",
    "timbral": "((c - 1) / 4e0 + 0.5e0) / 2e0",
    "nostalgic": "(m - 1) / 4e0",
    "experimental": "((c - 1) / 4e0 + (1e0 - (m - 1) / 4e0) + 0.5e0) / 3e0",
}


def fit_of(weights: dict, targets: dict) -> str:
    """How well ratings e, m, c fit weighted metrics and the ratings aimed at (0 to 1), as an SQL expression: 82% by metrics, 18% by nearness."""
    part = {1: "({})", -1: "(1e0 - ({}))", 0: "0.5e0"}
    metrics = " + ".join(f"{part[way].format(METRICS[name])} * {weight}e0" for name, (weight, way) in weights.items())
    total = round(sum(weight for weight, _ in weights.values()), 6)
    away = " + ".join(f"abs(({name} - 1) / 4e0 - {(aim - 1) / 4}e0)" for name, aim in targets.items())
    return f"greatest(0e0, least(1e0, ({metrics}) / {total}e0 * 0.82e0 + (1e0 - ({away}) / 3e0) * 0.18e0))"


def fit(persona: str) -> str:
    """How well a track's ratings fit a persona, as an SQL expression."""
    return fit_of(*PERSONAS[persona])


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """persona, track, score and ratings: one row for each track and persona, made without a shuffle."""
    fits = F.explode(F.array(*[F.struct(F.lit(p).alias("persona"), F.expr(fit(p)).alias("score")) for p in PERSONAS]))
    return calibrated_ratings(spark, sf_dir).select(F.col("l_partkey").alias("track"), "e", "m", "c", fits.alias("x")).select("x.persona", "track", "x.score", "e", "m", "c")


def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tracks of each persona. Every task keeps its own best before the shuffle (a window group limit)."""
    place = F.row_number().over(Window.partitionBy("persona").orderBy(F.desc("score"), "track"))
    return _scored(spark, sf_dir).withColumn("place", place).where(F.col("place") <= STATION)


_ALL = " UNION ALL ".join(f"SELECT '{p}' AS persona, l_partkey AS track, {fit(p)} AS score, e, m, c FROM ratings" for p in PERSONAS)
_SCORED = f"ratings AS ({CALIBRATED}), scored AS ({_ALL})"
_STATIONS = f"""{_SCORED}, stations AS (SELECT *, CAST(row_number() OVER (PARTITION BY persona ORDER BY score DESC, track) AS INTEGER) AS place FROM scored QUALIFY place <= {STATION})"""


def persona_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every track for every persona."""
    return _scored(spark, sf_dir).select("persona", "track", F.round("score", 6).alias("score"))


SCORES = f"WITH {_SCORED} SELECT persona, track, round(score, 6) AS score FROM scored"


def persona_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A station of 50 tracks for each persona (ties: lower track)."""
    return _stations(spark, sf_dir).select("persona", "place", "track", F.round("score", 6).alias("score"))


STATIONS = f"WITH {_STATIONS} SELECT persona, place, track, round(score, 6) AS score FROM stations"


def persona_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means of the metrics over each station."""
    return _stations(spark, sf_dir).groupBy("persona").agg(*[F.round(F.avg(F.expr(x)), 6).alias(name) for name, x in METRICS.items()])


DISTRIBUTION = f"WITH {_STATIONS} SELECT persona, {', '.join(f'round(avg({x}), 6) AS {name}' for name, x in METRICS.items())} FROM stations GROUP BY persona"


def persona_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every two personas, the tracks that their stations share and their percentage of a station; pairs that share none stay."""
    own = _stations(spark, sf_dir).select("persona", "track")
    a, b = own.select(F.col("persona").alias("persona_a"), "track"), own.select(F.col("persona").alias("persona_b"), "track")
    shared = a.join(b, "track").groupBy("persona_a", "persona_b").agg(F.count("*").alias("n"))
    pairs = spark.createDataFrame(list(combinations(PERSONAS, 2)), "persona_a string, persona_b string")  # 10 rows
    found = pairs.join(shared, ["persona_a", "persona_b"], "left").withColumn("shared", F.coalesce("n", F.lit(0)).cast("long"))
    return found.select("persona_a", "persona_b", "shared", F.round(F.col("shared") * 100.0 / STATION, 1).alias("percent"))


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in combinations(PERSONAS, 2))
OVERLAP = f"""WITH {_STATIONS}, shared AS (SELECT a.persona AS persona_a, b.persona AS persona_b, count(*) AS n FROM stations a JOIN stations b USING (track) GROUP BY ALL)
SELECT persona_a, persona_b, coalesce(n, 0)::BIGINT AS shared, round(coalesce(n, 0) * 100.0::DOUBLE / {STATION}, 1) AS percent FROM (VALUES {_PAIRS}) p(persona_a, persona_b) LEFT JOIN shared USING (persona_a, persona_b)"""


#: The share of all tracks that belong to a persona.
SHARE = 0.2


def members(scored: DataFrame, share: float = SHARE) -> DataFrame:
    """The best ``share`` (rounded) of the tracks of each persona, of equal scores those of the lower hash: rows of ``scored`` (persona,
    track, score). Scores are counted to find the cut; only the tracks at the cut are ranked."""
    known = counted(scored.withColumn("loss", -F.col("score")), ["persona"], "loss").withColumn("wanted", F.floor(F.col("total") * share + 0.5))
    cuts = known.where("below < wanted AND below + n >= wanted").select("persona", F.col("loss").alias("cut"), "below", "wanted")  # a row for each persona
    rows = scored.join(F.broadcast(cuts), "persona")
    tied = rows.where("-score = cut").withColumn("i", F.row_number().over(Window.partitionBy("persona").orderBy(fnv1a("CAST(track AS STRING)"), "track")))
    columns = ["persona", "track", "score"]
    return rows.where("-score < cut").select(*columns).unionByName(tied.where("below + i <= wanted").select(*columns))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are read twice, and so are members where populations are compared: both are kept on the executors (and computed anew if
    one is lost)."""
    scored = _scored(spark, sf_dir).select("persona", "track", F.round("score", 6).alias("score")).persist()
    return members(scored).persist()


_MEMBERS = f"""{_SCORED}, h AS (SELECT persona, track, round(score, 6) AS score, CAST({_FNV.format("track::VARCHAR")} AS BIGINT) AS h FROM scored), members AS (SELECT persona, track, score FROM h QUALIFY row_number() OVER (PARTITION BY persona ORDER BY score DESC, h, track) <= floor(count(*) OVER (PARTITION BY persona) * 0.2::DOUBLE + 0.5))"""
_BITS = {name: 1 << i for i, name in enumerate(PERSONAS)}
_BIT_SQL = "CASE persona " + " ".join(f"WHEN '{name}' THEN {bit}" for name, bit in _BITS.items()) + " END"


def style_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personas of each track as bits; a track of none has 0."""
    bits = _members(spark, sf_dir).groupBy("track").agg(F.sum(F.expr(_BIT_SQL)).cast("int").alias("mask"))
    every = calibrated_ratings(spark, sf_dir).select(F.col("l_partkey").alias("track"))
    return every.join(bits, "track", "left").fillna(0, ["mask"])


MASKS = f"WITH {_MEMBERS}, b AS (SELECT track, CAST(sum({_BIT_SQL}) AS INTEGER) AS mask FROM members GROUP BY track) SELECT l_partkey AS track, CAST(coalesce(mask, 0) AS INTEGER) AS mask FROM ratings LEFT JOIN b ON b.track = l_partkey"


def style_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each persona, how many of them have no other, their different scores, and the share at the lowest one."""
    rows = _members(spark, sf_dir)
    alone = rows.groupBy("track").agg(F.count("*").alias("k"))
    least = rows.groupBy("persona").agg(F.min("score").alias("least"))  # a row for each persona
    both = rows.join(alone, "track").join(F.broadcast(least), "persona")
    return both.groupBy("persona").agg(F.count("*").alias("tracks"), F.sum((F.col("k") == 1).cast("long")).alias("exclusive"), F.countDistinct("score").alias("scores"), F.round(F.avg((F.col("score") == F.col("least")).cast("int")), 6).alias("tied"))


POPULATIONS = f"""WITH {_MEMBERS}, k AS (SELECT *, count(*) OVER (PARTITION BY track) AS k, min(score) OVER (PARTITION BY persona) AS least FROM members)
SELECT persona, count(*) AS tracks, count(*) FILTER (k = 1) AS exclusive, count(DISTINCT score) AS scores, round(avg((score = least)::INT), 6) AS tied FROM k GROUP BY persona"""


def style_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the members of every two personas overlap."""
    masks = style_masks(spark, sf_dir).groupBy("mask").agg(F.count("*").alias("n"))  # at most 32 rows
    pairs = spark.createDataFrame([(a, b, _BITS[a], _BITS[b]) for a, b in combinations(PERSONAS, 2)], "persona_a string, persona_b string, x int, y int")
    x, y = F.col("mask").bitwiseAND(F.col("x")) > 0, F.col("mask").bitwiseAND(F.col("y")) > 0
    sums = masks.crossJoin(F.broadcast(pairs)).groupBy("persona_a", "persona_b").agg(F.sum(F.when(x & y, F.col("n")).otherwise(0)).alias("shared"), F.sum(F.when(x | y, F.col("n")).otherwise(0)).alias("any"))
    return sums.select("persona_a", "persona_b", "shared", F.round(F.col("shared") / F.col("any"), 6).alias("jaccard"))


JACCARD = f"""WITH {_MEMBERS}, s AS (SELECT a.persona AS persona_a, b.persona AS persona_b, count(*) AS n FROM members a JOIN members b USING (track) GROUP BY ALL), c AS (SELECT persona, count(*) AS n FROM members GROUP BY persona)
SELECT persona_a, persona_b, coalesce(s.n, 0)::BIGINT AS shared, round(coalesce(s.n, 0) / (x.n + y.n - coalesce(s.n, 0))::DOUBLE, 6) AS jaccard
FROM (VALUES {_PAIRS}) p(persona_a, persona_b) LEFT JOIN s USING (persona_a, persona_b) JOIN c x ON x.persona = persona_a JOIN c y ON y.persona = persona_b"""


def population_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the populations: too few or too many tracks, too few exclusive ones or different scores, too many ties,
    too much overlap. No row: nothing."""
    every = calibrated_ratings(spark, sf_dir).agg(F.count("*").alias("n"))  # one row
    rules = {"floor": "tracks < 0.15 * n", "ceiling": "tracks > 0.25 * n", "exclusivity": "exclusive < 0.1 * tracks", "spread": "scores < 10", "ties": "tied > 0.05"}
    one = style_populations(spark, sf_dir).crossJoin(F.broadcast(every))
    broken = one.select("persona", F.explode(F.array_compact(F.array(*[F.when(F.expr(test), F.lit(rule)) for rule, test in rules.items()]))).alias("rule"))
    overlap = style_jaccard(spark, sf_dir).where("jaccard > 0.4").select(F.concat_ws("+", "persona_a", "persona_b").alias("persona"), F.lit("overlap").alias("rule"))
    return broken.unionByName(overlap)


GATE = f"""WITH p AS ({POPULATIONS}), n AS (SELECT count(*) AS n FROM ({CALIBRATED})) SELECT persona, 'floor' AS rule FROM p, n WHERE tracks < 0.15 * n UNION ALL SELECT persona, 'ceiling' FROM p, n WHERE tracks > 0.25 * n
UNION ALL SELECT persona, 'exclusivity' FROM p WHERE exclusive < 0.1 * tracks UNION ALL SELECT persona, 'spread' FROM p WHERE scores < 10 UNION ALL SELECT persona, 'ties' FROM p WHERE tied > 0.05
UNION ALL SELECT concat(persona_a, '+', persona_b), 'overlap' FROM ({JACCARD}) WHERE jaccard > 0.4"""


QUERIES = {"persona_scores": persona_scores, "persona_stations": persona_stations, "persona_distribution": persona_distribution, "persona_overlap": persona_overlap, "style_masks": style_masks, "style_populations": style_populations, "style_jaccard": style_jaccard, "population_gate": population_gate}
ORACLES = {"persona_scores": SCORES, "persona_stations": STATIONS, "persona_distribution": DISTRIBUTION, "persona_overlap": OVERLAP, "style_masks": MASKS, "style_populations": POPULATIONS, "style_jaccard": JACCARD, "population_gate": GATE}
