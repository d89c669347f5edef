"""Row-wise operators: filters and their grammar, checks of records, paths, names, hashes, formats. No query here shuffles
but to count."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.functions.columns import clamp
from tracklens.operators.catalogue import CALIBRATED, calibrated_ratings
from tracklens.operators.feedback import FEEDBACK_TOTALS, feedback_totals
from tracklens.plans.define import family
from tracklens.sources.tables import table

QUERIES, ORACLES, query = family()


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tracks: track, sid_path (type/letter/brand/name), song_index, title, composer, category, size, price."""
    path = F.expr("concat(p_type, '/', substr(p_name, 1, 1), '/', p_brand, '/', replace(p_name, ' ', '_'), '.sid')")
    song = (F.col("p_partkey") % 3 + 1).cast("int")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("track"), path.alias("sid_path"), song.alias("song_index"), F.col("p_name").alias("title"), F.col("p_brand").alias("composer"), F.col("p_type").alias("category"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


TRACKS = """t AS (SELECT p_partkey AS track, concat(p_type, '/', substr(p_name, 1, 1), '/', p_brand, '/', replace(p_name, ' ', '_'), '.sid') AS sid_path, CAST(p_partkey % 3 + 1 AS INTEGER) AS song_index,
  p_name AS title, p_brand AS composer, p_type AS category, p_size AS size, p_retailprice AS price FROM part)"""


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with their ratings e, m and c."""
    return tracks(spark, sf_dir).join(calibrated_ratings(spark, sf_dir).withColumnRenamed("l_partkey", "track"), "track")


RATED = f"{TRACKS}, r AS (SELECT t.*, e, m, c FROM t JOIN ({CALIBRATED}) x ON x.l_partkey = t.track)"

# Filters -----------------------------------------------------------------------------------------------------------

#: The dimensions of a filter, in the order in which it is written.
DIMENSIONS = ("e", "m", "c", "p", "bpm")
MOST = 999


def parse_filters(text: str) -> dict[str, tuple[int, int]]:
    """Inclusive ranges by dimension from text like ``e>=3,bpm=120-140``; a range of two numbers may follow any operator.
    Anything else is an error."""
    found = {}
    for part in filter(None, [text.strip()] and [x.strip() for x in text.split(",")] if text.strip() else []):
        match = re.fullmatch(r"([emcp]|bpm)\s*(>=?|<=?|=)\s*(\d+)(?:-(\d+))?", part, re.IGNORECASE)
        if not match:
            raise ValueError(f"no filter: {part}")
        name, sign, low, high = match[1].lower(), match[2], int(match[3]), match[4]
        bounds = {">=": (low, MOST), ">": (low + 1, MOST), "<=": (0, low), "<": (0, low - 1), "=": (low, low)}
        found[name] = (low, int(high)) if high else bounds[sign]
    return found


def format_filters(ranges: dict[str, tuple[int, int]]) -> str:
    """The text that parse_filters reads as ``ranges``."""

    def one(name: str, low: int, high: int) -> str:
        if low == high:
            return f"{name}={low}"
        return f"{name}>={low}" if high >= MOST else f"{name}<={high}" if low == 0 else f"{name}={low}-{high}"

    return ",".join(one(name, *ranges[name]) for name in DIMENSIONS if name in ranges)


def in_ranges(ranges: dict[str, tuple[int, int]], features: str = "features_json") -> Column:
    """Rows whose e, m, c and (in JSON) bpm lie in ``ranges``; no bpm fails a bpm range. A range of p is read and not applied."""
    out = F.lit(True)
    for name, (low, high) in ranges.items():
        if name != "p":
            value = F.get_json_object(features, "$.bpm").try_cast("double") if name == "bpm" else F.col(name)
            out = out & F.coalesce(value.between(low, high), F.lit(False))
    return out


@query(f"""WITH {RATED}, j AS (SELECT *, CASE WHEN track % 7 = 0 THEN NULL WHEN track % 7 = 1 THEN '{{"bpm": "fast"}}' ELSE concat('{{"bpm": ', 60 + size * 2, '}}') END AS features_json FROM r)
SELECT track, e, m, c, features_json FROM j WHERE e >= 3 AND c <= 3 AND TRY_CAST(json_extract_string(features_json, '$.bpm') AS DOUBLE) BETWEEN 100 AND 150""")
def filtered_ranges(spark, sf_dir):
    """Tracks in the ranges of a filter expression."""
    features = F.expr("""CASE WHEN track % 7 = 0 THEN NULL WHEN track % 7 = 1 THEN '{"bpm": "fast"}' ELSE concat('{"bpm": ', 60 + size * 2, '}') END""")
    rows = rated(spark, sf_dir).withColumn("features_json", features)
    return rows.where(in_ranges(parse_filters("e>=3, c<4, bpm=100-150, p=1"))).select("track", "e", "m", "c", "features_json")


def written_ranges(ranges: dict[str, tuple[Column, Column]]) -> Column:
    """What format_filters writes, for ranges (low, high) that are columns; a dimension without a low is left out."""

    def one(name: str, low: Column, high: Column) -> Column:
        text = [F.concat(F.lit(f"{name}{sign}"), x.cast("string")) for sign, x in (("=", low), (">=", low), ("<=", high))]
        both = F.concat(text[0], F.lit("-"), high.cast("string"))
        return F.when(low == high, text[0]).when(high >= MOST, text[1]).when(low == 0, text[2]).when(low.isNotNull(), both)

    return F.concat_ws(",", *[one(name, *ranges[name]) for name in DIMENSIONS if name in ranges])


@query(f"""WITH {RATED} SELECT track, concat_ws(',', CASE WHEN e >= 4 THEN concat('e>=', e) WHEN e > 1 THEN concat('e=', e) END, concat('m<=', m), CASE WHEN c = 5 THEN 'c=5' ELSE concat('c=', c, '-5') END,
  CASE WHEN size = 50 THEN 'bpm=110' ELSE concat('bpm=', 60 + size, '-110') END) AS written FROM r""")
def filter_texts(spark, sf_dir):
    """For each track the filter that asks for tracks like it."""
    high = F.when(F.col("e") >= 4, MOST).otherwise(F.col("e"))
    ranges = {"e": (F.when(F.col("e") > 1, F.col("e")), high), "m": (F.lit(0), F.col("m")), "c": (F.col("c"), F.lit(5)), "bpm": (60 + F.col("size"), F.lit(110))}
    return rated(spark, sf_dir).select("track", written_ranges(ranges).alias("written"))


@query(f"WITH {RATED} SELECT track, e, m, c FROM r WHERE track % 11 != 0 AND track % 13 != 0")
def valid_ratings(spark, sf_dir):
    """Records with all three ratings; of the tracks here, some have lost one."""
    lossy = rated(spark, sf_dir).withColumn("e", F.when(F.col("track") % 11 != 0, F.col("e"))).withColumn("c", F.when(F.col("track") % 13 != 0, F.col("c")))
    return lossy.dropna(subset=["e", "m", "c"]).select("track", "e", "m", "c")


@query(f"WITH {RATED} SELECT track, e, m, c FROM r, (SELECT avg(e) AS ae, avg(m) AS am, avg(c) AS ac FROM r WHERE track < 5) WHERE abs(e - ae) <= 1.5 AND abs(m - am) <= 1.5 AND abs(c - ac) <= 1.5")
def near_favourites(spark, sf_dir):
    """Tracks whose ratings deviate by at most 1.5 from the mean of five favourites."""
    rows = rated(spark, sf_dir)
    centre = rows.where("track < 5").agg(*[F.avg(x).alias(f"a{x}") for x in "emc"])  # one row
    close = F.expr("ae IS NULL OR (abs(e - ae) <= 1.5 AND abs(m - am) <= 1.5 AND abs(c - ac) <= 1.5)")
    return rows.crossJoin(F.broadcast(centre)).where(close).select("track", "e", "m", "c")


@query("""SELECT user_id, user_id % 12 AS adventure, count(DISTINCT props) AS ratings, round(greatest(0.5::DOUBLE, 0.82::DOUBLE - 0.03::DOUBLE * (user_id % 12)), 6) AS least,
CASE WHEN count(DISTINCT props) < 10 THEN 0.82::DOUBLE ELSE 0.75::DOUBLE END AS legacy FROM events GROUP BY user_id""")
def similarity_cuts(spark, sf_dir):
    """The least similarity that a listener's station accepts, by adventure, and where there is none by how much was rated."""
    told = table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct("props").alias("ratings")).withColumn("adventure", F.col("user_id") % 12)
    least = F.round(F.greatest(F.lit(0.5), 0.82 - 0.03 * F.col("adventure")), 6)
    return told.select("user_id", "adventure", "ratings", least.alias("least"), F.when(F.col("ratings") < 10, 0.82).otherwise(0.75).alias("legacy"))


@query(f"WITH {RATED} SELECT track, title, size * 9000 AS duration_ms FROM r WHERE size * 9000 >= 180000 AND (contains(lower(title), 'blue') OR contains(lower(composer), 'blue')) AND e >= 3")
def text_star_filter(spark, sf_dir):
    """Tracks of three minutes at least that have the text in their title or composer and three stars."""
    found = F.contains(F.lower("title"), F.lit("blue")) | F.contains(F.lower("composer"), F.lit("blue"))
    return rated(spark, sf_dir).withColumn("duration_ms", F.col("size") * 9000).where(found & (F.col("duration_ms") >= 180_000) & (F.col("e") >= 3)).select("track", "title", "duration_ms")


@query(f"""WITH {RATED}, s AS (SELECT *, CASE WHEN track % 10 = 0 THEN 0 ELSE 1980 + size % 15 END AS year FROM r)
SELECT track, title, CAST(year AS INTEGER) AS year FROM s WHERE contains(lower(concat_ws(' ', title, composer, sid_path)), 'ring') AND year != 0 AND year BETWEEN 1983 AND 1990 AND size >= 10 AND (e + m + c) / 3.0 >= 2 ORDER BY track LIMIT 40""")
def filtered_search(spark, sf_dir):
    """The first 40 tracks, in catalogue order, whose title, artist or path contains the text, within years, length and mean
    rating; a missing year (0) fails."""
    rows = rated(spark, sf_dir).withColumn("year", F.when(F.col("track") % 10 == 0, 0).otherwise(1980 + F.col("size") % 15).cast("int"))
    field = F.lower(F.concat_ws(" ", "title", "composer", "sid_path"))
    wanted = F.contains(field, F.lit("ring")) & (F.col("year") != 0) & F.col("year").between(1983, 1990) & (F.col("size") >= 10) & ((F.col("e") + F.col("m") + F.col("c")) / 3.0 >= 2)
    return rows.where(wanted).select("track", "title", "year").orderBy("track").limit(40)


@query(f"SELECT track, likes, dislikes, plays FROM ({FEEDBACK_TOTALS}) WHERE (likes > 0 OR plays > 5) AND (dislikes = 0 OR likes / greatest(dislikes, 1)::DOUBLE > 1.5)")
def well_liked(spark, sf_dir):
    """Tracks that others like: some likes or plays, and likes well above dislikes."""
    liked = F.expr("(likes > 0 OR plays > 5) AND (dislikes = 0 OR likes / greatest(dislikes, 1) > 1.5)")
    return feedback_totals(spark, sf_dir).where(liked).select("track", "likes", "dislikes", "plays")


@query(f"WITH {TRACKS} SELECT track, sid_path FROM t WHERE sid_path = 'PROMO/b' OR starts_with(sid_path, 'PROMO/b/')")
def under_prefix(spark, sf_dir):
    """Tracks of one folder; a folder of a longer name is not it."""
    return tracks(spark, sf_dir).where((F.col("sid_path") == "PROMO/b") | F.col("sid_path").startswith("PROMO/b/")).select("track", "sid_path")


# Words of a path that suggest a mood.
MOOD_WORDS = {"calm": ["small", "soft", "blue"], "bright": ["red", "hot", "new"], "heavy": ["large", "steel", "big"]}


@query(f"WITH {TRACKS} SELECT track, mood FROM t, (VALUES ('calm', 'small|soft|blue'), ('bright', 'red|hot|new'), ('heavy', 'large|steel|big')) w(mood, p) WHERE regexp_matches(lower(sid_path), p)")
def mood_paths(spark, sf_dir):
    """Moods that the words of a path suggest."""
    moods = F.explode(F.array_compact(F.array(*[F.when(F.lower("sid_path").rlike("|".join(words)), F.lit(mood)) for mood, words in MOOD_WORDS.items()])))
    return tracks(spark, sf_dir).select("track", moods.alias("mood"))


# Checks of records -------------------------------------------------------------------------------------------------


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, f: the first 24 elements as features, some of them missing, not finite or zero."""
    value = "CASE WHEN vec_id % 17 = 3 AND i % 6 = 2 THEN NULL WHEN vec_id % 19 = 5 AND i = 4 THEN CAST('NaN' AS DOUBLE) WHEN vec_id % 23 = 7 THEN 0e0 ELSE CAST(x AS DOUBLE) END"
    return table(spark, sf_dir, "embeddings").select("vec_id", F.expr(f"transform(slice(embedding, 1, 24), (x, i) -> {value})").alias("f"))


_F = "f AS (SELECT vec_id, i - 1 AS i, CASE WHEN vec_id % 17 = 3 AND (i - 1) % 6 = 2 THEN NULL WHEN vec_id % 19 = 5 AND i - 1 = 4 THEN 'NaN'::DOUBLE WHEN vec_id % 23 = 7 THEN 0 ELSE x::DOUBLE END AS x FROM (SELECT vec_id, unnest(embedding[1:24]) AS x, generate_subscripts(embedding[1:24], 1) AS i FROM embeddings))"


@query(f"WITH {_F} SELECT vec_id, count(*) FILTER (x IS NULL) AS missing, count(*) FILTER (isnan(x)) AS not_finite, coalesce(string_agg(CASE WHEN x IS NULL THEN concat('f', i, '=missing') WHEN isnan(x) THEN concat('f', i, '=not-finite') END, ',' ORDER BY i), '') AS issues FROM f GROUP BY vec_id")
def vector_health(spark, sf_dir):
    """What is wrong with a vector of 24 required features."""
    issues = F.expr("array_compact(transform(f, (x, i) -> CASE WHEN x IS NULL THEN concat('f', i, '=missing') WHEN isnan(x) OR abs(x) = double('Infinity') THEN concat('f', i, '=not-finite') END))")
    count = lambda kind: F.size(F.filter("i", lambda x: x.endswith(kind))).cast("long")
    return _features(spark, sf_dir).select("vec_id", issues.alias("i")).select("vec_id", count("=missing").alias("missing"), count("=not-finite").alias("not_finite"), F.array_join("i", ",").alias("issues"))


def _violations(spark, sf_dir):
    playing, tonal = F.slice("f", 1, 12), F.slice("f", 13, 12)
    zero = lambda a: F.forall(a, lambda x: F.coalesce(x, F.lit(0.0)) == 0)
    kinds = F.array_compact(
        F.array(
            F.when((F.col("vec_id") % 2 == 0) & zero(playing), F.lit("silent-trace")),
            F.when((F.col("vec_id") % 3 == 0) & zero(tonal), F.lit("tonal-all-zero")),
            F.when(F.exists("f", lambda x: F.isnan(x)), F.lit("non-finite")),
        )
    )
    return _features(spark, sf_dir).select("vec_id", kinds.alias("kinds"))


_V = f"""{_F}, k AS (SELECT vec_id, vec_id % 2 = 0 AND bool_and(coalesce(x, 0) = 0) FILTER (i < 12) AS a, vec_id % 3 = 0 AND bool_and(coalesce(x, 0) = 0) FILTER (i >= 12) AS b, coalesce(bool_or(isnan(x)), false) AS c FROM f GROUP BY vec_id),
v AS (SELECT vec_id, 'silent-trace' AS kind FROM k WHERE a UNION ALL SELECT vec_id, 'tonal-all-zero' FROM k WHERE b UNION ALL SELECT vec_id, 'non-finite' FROM k WHERE c)"""


@query(f"WITH {_V} SELECT vec_id, kind FROM v")
def feature_integrity(spark, sf_dir):
    """Records that contradict themselves: a trace without features, tones claimed and all zero, numbers that are none."""
    return _violations(spark, sf_dir).select("vec_id", F.explode("kinds").alias("kind"))


@query(f"WITH {_V}, n AS (SELECT count(DISTINCT vec_id) AS n FROM f) SELECT kind, count(*) AS found, array_to_string(list_sort(list(vec_id))[1:5], ',') AS examples, n >= 500 AND count(*) / n::DOUBLE > 0.01 AS breach FROM v, n GROUP BY kind, n")
def integrity_tally(spark, sf_dir):
    """Violations by kind, the five first examples, and whether over 1 % of at least 500 records have one. Examples are the
    least ids, kept as five for each task before they meet."""
    rows = _violations(spark, sf_dir)
    checked = rows.agg(F.count("*").alias("n"))  # one row
    found = rows.select("vec_id", F.explode("kinds").alias("kind"))
    first = found.withColumn("place", F.expr("row_number() OVER (PARTITION BY kind ORDER BY vec_id)")).where("place <= 5").groupBy("kind").agg(F.array_join(F.sort_array(F.collect_list("vec_id")).cast("array<string>"), ",").alias("examples"))
    counts = found.groupBy("kind").agg(F.count("*").alias("found"))
    return counts.join(first, "kind").crossJoin(F.broadcast(checked)).select("kind", "found", "examples", ((F.col("n") >= 500) & (F.col("found") / F.col("n") > 0.01)).alias("breach"))


@query("""WITH l AS (SELECT event_id, ts::DATE AS day, CASE WHEN event_id % 31 = 0 THEN NULL ELSE user_id END AS sid_path, CASE WHEN event_id % 37 = 0 THEN 'dance' ELSE event_type END AS action, concat('u', event_id // 2 * 2 + CASE WHEN event_id % 41 = 1 THEN 0 ELSE event_id % 2 END) AS uuid FROM events),
d AS (SELECT uuid FROM l WHERE sid_path IS NOT NULL GROUP BY uuid HAVING count(*) > 1),
p AS (SELECT day, event_id, CASE WHEN sid_path IS NULL THEN 'missing field' WHEN action NOT IN ('view', 'click', 'purchase', 'signup', 'error') THEN 'invalid action' END AS problem FROM l
  UNION ALL SELECT day, event_id, 'duplicate uuid' FROM l WHERE sid_path IS NOT NULL AND uuid IN (SELECT uuid FROM d))
SELECT day, problem, count(*) AS n, min(event_id) AS first FROM p WHERE problem IS NOT NULL GROUP BY day, problem""")
def feedback_problems(spark, sf_dir):
    """Problems of the feedback log by day: missing fields, unknown actions, ids used twice. A row with an unknown action takes
    part in the search for duplicates; one with missing fields does not."""
    log = table(spark, sf_dir, "events").selectExpr("event_id", "to_date(ts) AS day", "CASE WHEN event_id % 31 = 0 THEN NULL ELSE user_id END AS sid_path", "CASE WHEN event_id % 37 = 0 THEN 'dance' ELSE event_type END AS action", "concat('u', event_id div 2 * 2 + CASE WHEN event_id % 41 = 1 THEN 0 ELSE event_id % 2 END) AS uuid")
    twice = log.where("sid_path IS NOT NULL").groupBy("uuid").agg(F.count("*").alias("n")).where("n > 1").select("uuid")
    duplicate = log.where("sid_path IS NOT NULL").join(twice, "uuid", "left_semi").select("day", "event_id", F.lit("duplicate uuid").alias("problem"))
    kinds = F.when(F.col("sid_path").isNull(), "missing field").when(~F.col("action").isin("view", "click", "purchase", "signup", "error"), "invalid action")
    return log.select("day", "event_id", kinds.alias("problem")).where("problem IS NOT NULL").unionByName(duplicate).groupBy("day", "problem").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


# Paths, names, ids -------------------------------------------------------------------------------------------------


@query(f"WITH {TRACKS}, i AS (SELECT track, concat(sid_path, '#', song_index) AS track_id FROM t) SELECT track, track_id, regexp_extract(track_id, '^(.*)#([0-9]+)$', 1) AS sid_path, CAST(regexp_extract(track_id, '^(.*)#([0-9]+)$', 2) AS INTEGER) AS song_index FROM i")
def track_ids(spark, sf_dir):
    """Ids built from path and song, and taken apart again at their last #."""
    parts = r"^(.*)#([0-9]+)$"
    ids = tracks(spark, sf_dir).select("track", F.concat_ws("#", "sid_path", F.col("song_index").cast("string")).alias("track_id"))
    return ids.select("track", "track_id", F.regexp_extract("track_id", parts, 1).alias("sid_path"), F.regexp_extract("track_id", parts, 2).cast("int").alias("song_index"))


@query(f"""WITH {TRACKS}, s AS (SELECT *, string_split(sid_path, '/') AS s FROM t)
SELECT track, replace(s[-2], '_', ' ') AS artist, replace(regexp_replace(s[-1], '\\.sid$', '', 'i'), '_', ' ') AS title, upper(s[1]) AS category, CASE WHEN len(s) > 3 THEN s[3] END AS composer, concat(s[1], '/', s[2]) AS bucket, array_to_string(s[1:3], '/') AS grouped FROM s""")
def path_parts(spark, sf_dir):
    """Artist, title, category, composer, bucket and group from a path."""
    s = F.split("sid_path", "/")
    return tracks(spark, sf_dir).select(
        "track",
        F.replace(F.element_at(s, -2), F.lit("_"), F.lit(" ")).alias("artist"),
        F.replace(F.regexp_replace(F.element_at(s, -1), r"(?i)\.sid$", ""), F.lit("_"), F.lit(" ")).alias("title"),
        F.upper(s[0]).alias("category"),
        F.when(F.size(s) > 3, F.get(s, F.lit(2))).alias("composer"),
        F.concat_ws("/", s[0], s[1]).alias("bucket"),
        F.array_join(F.slice(s, 1, 3), "/").alias("grouped"),
    )


# Words that carry no theme.
THEMELESS = ["the", "and", "for", "with", "from", "part", "song", "theme", "sid", "demo"]


@query(f"SELECT doc_id, array_to_string(list_filter(w, (x, i) -> list_position(w, x) = i)[1:6], ',') AS tags FROM (SELECT doc_id, list_filter(string_split_regex(trim(regexp_replace(lower(substr(text, 1, 120)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 4 AND x NOT IN ({', '.join(repr(x) for x in THEMELESS)})) AS w FROM documents)".replace("(x, i) -> list_position(w, x) = i", "lambda x, i: list_position(w, x) = i"))
def theme_tags(spark, sf_dir):
    """The first six words of a heading that may carry a theme, each once."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.substring("text", 1, 120)), "[^a-z0-9]+", " ")), " ")
    kept = F.array_distinct(F.filter(words, lambda x: (F.length(x) >= 4) & ~x.isin(THEMELESS)))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(kept, 1, 6), ",").alias("tags"))


_RELEASED = "concat(CASE WHEN track % 5 = 0 THEN '' ELSE CAST(CASE WHEN track % 7 = 0 THEN 1901 ELSE 1970 + size END AS {0}) END, CASE WHEN track % 3 = 0 THEN 'x' ELSE ' ' END, composer)"


@query(f"""WITH {TRACKS}, y AS (SELECT track, {_RELEASED.format('VARCHAR')} AS released FROM t)
SELECT track, CAST(nullif(regexp_extract(released, '\\b(19|20)[0-9][0-9]\\b'), '') AS INTEGER) AS bounded, CAST(nullif(regexp_extract(released, '(19|20)[0-9][0-9]'), '') AS INTEGER) AS anywhere,
  CAST(list_filter(regexp_extract_all(released, '[0-9][0-9][0-9][0-9]'), lambda x: x::INTEGER BETWEEN 1978 AND 2026)[1] AS INTEGER) AS in_range,
  coalesce(concat(CAST(CAST(nullif(regexp_extract(released, '(19|20)[0-9][0-9]'), '') AS INTEGER) // 10 * 10 AS VARCHAR) || 's'), 'unknown') AS decade FROM y""".replace("concat(CAST(CAST(", "(CAST(CAST("))
def release_years(spark, sf_dir):
    """A release text's year by three rules (a whole word, anywhere, the first from 1978 to 2026), and its decade."""
    rows = tracks(spark, sf_dir).select("track", F.expr(_RELEASED.format("STRING")).alias("released"))
    year = lambda pattern: F.nullif(F.regexp_extract("released", pattern, 0), F.lit("")).cast("int")
    first = F.get(F.filter(F.regexp_extract_all("released", F.lit(r"([0-9]{4})"), F.lit(1)), lambda x: x.cast("int").between(1978, 2026)), F.lit(0)).cast("int")
    anywhere = year("(19|20)[0-9]{2}")
    decade = F.coalesce(F.concat((F.floor(anywhere / 10) * 10).cast("string"), F.lit("s")), F.lit("unknown"))
    return rows.select("track", year(r"\b(19|20)[0-9]{2}\b").alias("bounded"), anywhere.alias("anywhere"), first.alias("in_range"), decade.alias("decade"))


@query(f"""WITH {TRACKS} SELECT track, trim(regexp_replace(lower(composer), '[^a-z0-9]+', ' ', 'g')) AS composer, trim(regexp_replace(lower(concat(title, ' (', category, ')')), '\\(.*\\)|[^a-z0-9 ]', '', 'g')) AS game,
  CASE WHEN contains(lower(category), 'eco') THEN '8580' WHEN contains(lower(category), 'sta') THEN '6581' ELSE 'unknown' END AS chip FROM t""")
def normal_names(spark, sf_dir):
    """Names made comparable: composers, games without brackets, chip models."""
    low = F.lower("category")
    return tracks(spark, sf_dir).select(
        "track",
        F.trim(F.regexp_replace(F.lower("composer"), "[^a-z0-9]+", " ")).alias("composer"),
        F.trim(F.regexp_replace(F.lower(F.concat("title", F.lit(" ("), "category", F.lit(")"))), r"\(.*\)|[^a-z0-9 ]", "")).alias("game"),
        F.when(F.contains(low, F.lit("eco")), "8580").when(F.contains(low, F.lit("sta")), "6581").otherwise("unknown").alias("chip"),
    )


def duration_ms(text: Column) -> Column:
    """Milliseconds of m:ss or m:ss.fff; null for anything else."""
    pattern = r"^(\d+):(\d{2})(?:\.(\d{1,3}))?$"
    number = lambda i: F.regexp_extract(text, pattern, i)
    whole = (number(1).cast("long") * 60 + number(2).cast("long")) * 1000
    return F.when(text.rlike(pattern), whole + F.rpad(number(3), 3, "0").cast("long"))


def duration_text(ms: Column) -> Column:
    seconds = F.floor(ms / 1000)
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


@query("""SELECT event_id, written, (CAST(string_split(written, ':')[1] AS BIGINT) * 60 + CAST(substr(string_split(written, ':')[2], 1, 2) AS BIGINT)) * 1000 + CAST(rpad(substr(string_split(written, '.')[2], 1, 3), 3, '0') AS BIGINT) AS ms,
  concat(CAST(value AS BIGINT) % 9, ':', lpad(CAST(event_id % 60 AS VARCHAR), 2, '0')) AS shown FROM (SELECT event_id, value, concat(CAST(value AS BIGINT) % 9, ':', lpad(CAST(event_id % 60 AS VARCHAR), 2, '0'), '.', event_id % 100) AS written FROM (SELECT event_id, floor(value) AS value FROM events))""")
def durations(spark, sf_dir):
    """Durations read from text (m:ss.fff) and shown again (m:ss)."""
    written = F.expr("concat(CAST(floor(value) AS BIGINT) % 9, ':', lpad(CAST(event_id % 60 AS STRING), 2, '0'), '.', event_id % 100)")
    rows = table(spark, sf_dir, "events").select("event_id", written.alias("written")).withColumn("ms", duration_ms(F.col("written")))
    return rows.select("event_id", "written", "ms", duration_text(F.col("ms")).alias("shown"))


@query("""SELECT event_id, round(greatest(1, least(5, value / 10)), 6) AS clamped, round(1 / (1 + exp(-value / 50)), 6) AS sigmoid, round(2 + (7 - 2) * least(1, value / 100), 6) AS lerp, round(sqrt(value * value + 9), 6) AS hypot, round(log2(1 + value), 6) AS log2, round(pow(1 + value, 0.5), 6) AS power FROM events""")
def numbers(spark, sf_dir):
    """Clamp, sigmoid, linear interpolation, hypotenuse, logarithm and power of a value."""
    v = F.col("value")
    found = {"clamped": clamp(v / 10, 1.0, 5.0), "sigmoid": 1 / (1 + F.exp(-v / 50)), "lerp": 2 + (7 - 2) * F.least(F.lit(1.0), v / 100), "hypot": F.hypot(v, F.lit(3.0)), "log2": F.log2(1 + v), "power": F.pow(1 + v, F.lit(0.5))}
    return table(spark, sf_dir, "events").select("event_id", *[F.round(x, 6).alias(name) for name, x in found.items()])


def fnv1a(text: str) -> Column:
    """The 32-bit FNV-1a hash of a column of ASCII text."""
    return F.expr(f"aggregate(transform(filter(split({text}, ''), x -> x != ''), x -> CAST(ascii(x) AS BIGINT)), 2166136261L, (h, x) -> ((h ^ x) * 16777619L) & 4294967295L)")


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"


@query(f"WITH {TRACKS} SELECT track, CAST({_FNV.format('sid_path')} AS BIGINT) AS fnv, sha256(sid_path) AS sha, substr(md5(sid_path), 1, 12) AS md5_48 FROM t")
def path_hashes(spark, sf_dir):
    """FNV-1a, SHA-256 and the first 48 bits of MD5 of a path."""
    return tracks(spark, sf_dir).select("track", fnv1a("sid_path").alias("fnv"), F.sha2("sid_path", 256).alias("sha"), F.substring(F.md5("sid_path"), 1, 12).alias("md5_48"))


@query("SELECT page_id, substr(sha256(url), 1, 16) AS session, CASE WHEN contains(url, '/en/') THEN '/en' ELSE substr(sha256(url), 1, 12) END AS place, coalesce(nullif(regexp_extract(url, '\\.(com|net|org)(/|$)', 1), ''), 'other') AS family FROM pages")
def anonymous_pages(spark, sf_dir):
    """Addresses without what tells whose they are: prefixes of digests, a known root kept, a family."""
    place = F.when(F.contains("url", F.lit("/en/")), "/en").otherwise(F.substring(F.sha2("url", 256), 1, 12))
    family = F.coalesce(F.nullif(F.regexp_extract("url", r"\.(com|net|org)(/|$)", 1), F.lit("")), F.lit("other"))
    return table(spark, sf_dir, "pages").select("page_id", F.substring(F.sha2("url", 256), 1, 16).alias("session"), place.alias("place"), family.alias("family"))


@query("""SELECT s_suppkey, concat('{"balance":', CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR), ',"name":"', s_name, '","nation":{"key":', s_nationkey, '}}') AS json FROM supplier""")
def canonical_json(spark, sf_dir):
    """Records as JSON with sorted keys, at each level."""
    record = F.struct(F.floor("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.struct(F.col("s_nationkey").alias("key")).alias("nation"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(record).alias("json"))


@query("SELECT vec_id, CAST(floor((x + 1) / 2 * 255 + 0.5) AS INTEGER) AS code, round(CAST(floor((x + 1) / 2 * 255 + 0.5) AS INTEGER) / 255.0::DOUBLE * 2 - 1, 6) AS decoded FROM (SELECT vec_id, greatest(-1, least(1, embedding[1]::DOUBLE)) AS x FROM embeddings)")
def quantised(spark, sf_dir):
    """Similarities from -1 to 1 as a byte, and back."""
    x = clamp(F.col("embedding")[0].cast("double"), -1.0, 1.0)
    code = F.floor((x + 1) / 2 * 255 + 0.5).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", code.alias("code"), F.round(code / 255.0 * 2 - 1, 6).alias("decoded"))


@query("SELECT event_id, round(skip, 6) AS skip, round(greatest(0, least(15, value - skip)), 6) AS length FROM (SELECT event_id, value, CASE WHEN value <= 10 THEN 0 WHEN value >= 30 THEN 15 ELSE (value - 10) / 20 * 15 END AS skip FROM events)")
def analysis_windows(spark, sf_dir):
    """What of a recording is analysed: no intro is skipped up to 10 s, all 15 s of it from 30 s, between in proportion."""
    skip = F.when(F.col("value") <= 10, 0.0).when(F.col("value") >= 30, 15.0).otherwise((F.col("value") - 10) / 20 * 15)
    return table(spark, sf_dir, "events").select("event_id", F.round(skip, 6).alias("skip"), F.round(clamp(F.col("value") - skip, 0.0, 15.0), 6).alias("length"))


@query("SELECT l_orderkey, l_linenumber, round(hz, 6) AS hz, round(69 + 12 * log2(hz / 440), 6) AS midi FROM (SELECT l_orderkey, l_linenumber, (1000 + l_partkey % 50000) * 985248.0::DOUBLE / 16777216 AS hz FROM lineitem)")
def midi_notes(spark, sf_dir):
    """Frequency words of the sound chip as hertz and MIDI notes."""
    rows = table(spark, sf_dir, "lineitem").withColumn("hz", (1000 + F.col("l_partkey") % 50000) * 985248.0 / 16777216)
    return rows.select("l_orderkey", "l_linenumber", F.round("hz", 6).alias("hz"), F.round(69 + 12 * F.log2(F.col("hz") / 440), 6).alias("midi"))


@query("""SELECT event_id, (r & 1) = 1 AS gate, CASE WHEN (r & 128) != 0 THEN 'noise' WHEN (r & 64) != 0 THEN 'pulse' WHEN (r & 32) != 0 THEN 'saw' WHEN (r & 16) != 0 THEN 'triangle' ELSE 'none' END AS waveform,
  CAST(r >> 4 AS INTEGER) AS attack, CAST(r & 15 AS INTEGER) AS decay FROM (SELECT event_id, CAST((event_id * 37) % 256 AS INTEGER) AS r FROM events)""")
def registers(spark, sf_dir):
    """Fields of a register byte: gate, waveform, and two rates of an envelope."""
    r = ((F.col("event_id") * 37) % 256).cast("int")
    bit = lambda n: r.bitwiseAND(F.lit(n)) != 0
    wave = F.when(bit(128), "noise").when(bit(64), "pulse").when(bit(32), "saw").when(bit(16), "triangle").otherwise("none")
    return table(spark, sf_dir, "events").select("event_id", bit(1).alias("gate"), wave.alias("waveform"), F.shiftright(r, 4).alias("attack"), r.bitwiseAND(F.lit(15)).alias("decay"))


@query("SELECT event_id, CASE WHEN ts < d + INTERVAL 210 MINUTE THEN d + INTERVAL 210 MINUTE ELSE d + INTERVAL 1650 MINUTE END AS next_run FROM (SELECT event_id, ts, date_trunc('day', ts)::TIMESTAMP AS d FROM events)")
def next_runs(spark, sf_dir):
    """The next daily run (03:30 UTC) strictly after a time."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    today = day + F.expr("INTERVAL 210 MINUTES")
    run = F.when(F.col("ts").cast("timestamp") < today, today).otherwise(day + F.expr("INTERVAL 1650 MINUTES"))
    return table(spark, sf_dir, "events").select("event_id", run.cast("timestamp_ntz").alias("next_run"))


@query(f"WITH {RATED} SELECT track, CAST(e | (m << 4) | (c << 8) | (3 << 12) AS INTEGER) AS packed, e, m, c, 3 AS p FROM r")
def packed_ratings(spark, sf_dir):
    """Four ratings in sixteen bits, and out of them again."""
    packed = F.expr("e | shiftleft(m, 4) | shiftleft(c, 8) | shiftleft(3, 12)")
    nibble = lambda k: F.shiftright("packed", 4 * k).bitwiseAND(F.lit(15))
    return rated(spark, sf_dir).select("track", packed.alias("packed")).select("track", "packed", *[nibble(k).alias(x) for k, x in enumerate("emcp")])


@query(f"""WITH {RATED}, b AS (SELECT track, CASE WHEN track % 4 = 0 THEN 5 WHEN track % 4 = 1 THEN 4 END AS me, CASE WHEN track % 4 = 0 THEN 1 END AS mm, CASE WHEN track % 4 = 0 THEN 2 END AS mc, e, m, c FROM r)
SELECT track, coalesce(me, e) AS e, coalesce(mm, m) AS m, coalesce(mc, c) AS c, CASE WHEN me IS NOT NULL AND mm IS NOT NULL AND mc IS NOT NULL THEN 'manual' WHEN coalesce(me, mm, mc) IS NOT NULL THEN 'mixed' ELSE 'auto' END AS source FROM b""")
def merged_ratings(spark, sf_dir):
    """Manual ratings over automatic ones, each dimension for itself, and where they come from."""
    manual = {"e": F.expr("CASE WHEN track % 4 = 0 THEN 5 WHEN track % 4 = 1 THEN 4 END"), "m": F.expr("CASE WHEN track % 4 = 0 THEN 1 END"), "c": F.expr("CASE WHEN track % 4 = 0 THEN 2 END")}
    given = sum(x.isNotNull().cast("int") for x in manual.values())
    source = F.when(given == 3, "manual").when(given > 0, "mixed").otherwise("auto")
    return rated(spark, sf_dir).select("track", *[F.coalesce(x, F.col(name)).alias(name) for name, x in manual.items()], source.alias("source"))


@query("""SELECT vec_id, len(v) AS kept, round(list_sum(p), 6) AS total, round(p[64], 6) AS last FROM (SELECT vec_id, v, list_concat(v, list_transform(range(64 - len(v)), lambda i: CASE WHEN len(v) + i < 24 THEN 0.5 ELSE 0 END::DOUBLE)) AS p
  FROM (SELECT vec_id, list_filter(list_transform(embedding[1:20 + vec_id % 45], lambda x: x::DOUBLE), lambda x: x < 1.5) AS v FROM embeddings))""")
def padded_vectors(spark, sf_dir):
    """Vectors cut to what is finite and fit, padded to 64 elements: up to 24 from a fallback, then zeros."""
    kept = F.filter(F.slice("embedding", F.lit(1), (20 + F.col("vec_id") % 45).cast("int")).cast("array<double>"), lambda x: ~F.isnan(x) & (x < 1.5))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", kept.alias("v"))
    fill = F.expr("concat(v, array_repeat(0.5D, greatest(0, 24 - size(v))))")
    padded = F.concat(fill, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), 64 - F.size(fill))))
    return rows.select("vec_id", F.size("v").cast("long").alias("kept"), F.round(F.aggregate(padded, F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.element_at(padded, 64), 6).alias("last"))
