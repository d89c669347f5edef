"""The neighbour graph: its shape, walks over it, distances corrected by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklens.functions.kept import kept
from tracklens.operators.vectors import neighbours, vectors
from tracklens.plans.define import family

QUERIES, ORACLES, query = family()

K = 3


def edges(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """vec_id, neighbour, similarity, place: the graph of the ``k`` nearest of all vectors."""
    rows = vectors(spark, sf_dir).select("vec_id", "v")
    return neighbours(rows, rows, k).select("vec_id", "neighbour", "similarity", "place")


_N = "n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM n a JOIN n b ON a.vec_id != b.vec_id)"


def _g(k: int = K) -> str:
    return f"{_N}, g AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS INTEGER) AS place FROM s QUALIFY place <= {k})"


@query(f"WITH {_g()}, r AS (SELECT place, EXISTS (SELECT 1 FROM g h WHERE h.vec_id = g.neighbour AND h.neighbour = g.vec_id) AS back FROM g) SELECT place, count(*) AS edges, count(*) FILTER (back) AS reciprocal, round(avg(back::INT), 6) AS share FROM r GROUP BY place")
def reciprocity(spark, sf_dir):
    """Edges by rank whose reverse is an edge too."""
    g = edges(spark, sf_dir)
    back = g.select(F.col("neighbour").alias("vec_id"), F.col("vec_id").alias("neighbour"), F.lit(1).alias("back"))
    both = g.join(back, ["vec_id", "neighbour"], "left").withColumn("back", F.coalesce("back", F.lit(0)))
    return both.groupBy("place").agg(F.count("*").alias("edges"), F.sum("back").alias("reciprocal"), F.round(F.avg("back"), 6).alias("share"))


@query(f"WITH {_g()}, d AS (SELECT n.vec_id, count(g.neighbour) AS d FROM n LEFT JOIN g ON g.neighbour = n.vec_id GROUP BY n.vec_id) SELECT round(avg(d), 6) AS mean, quantile_cont(d, 0.5) AS median, max(d) AS most, round(quantile_cont(d, 0.99), 6) AS p99, round(avg((d = 0)::INT), 6) AS unpointed FROM d")
def degree_summary(spark, sf_dir):
    """In-degrees of the graph: mean, median, most, 99th percentile, and the share that nothing points at."""
    counts = edges(spark, sf_dir).groupBy(F.col("neighbour").alias("vec_id")).agg(F.count("*").alias("d"))
    rows = vectors(spark, sf_dir).select("vec_id").join(counts, "vec_id", "left").fillna(0, ["d"])
    # Degrees are few different numbers, so the exact percentile holds little.
    return rows.agg(F.round(F.avg("d"), 6).alias("mean"), F.percentile("d", 0.5).alias("median"), F.max("d").alias("most"), F.round(F.percentile("d", 0.99), 6).alias("p99"), F.round(F.avg((F.col("d") == 0).cast("int")), 6).alias("unpointed"))


@query(f"WITH {_g()}, l AS (SELECT *, similarity > lag(similarity) OVER (PARTITION BY vec_id ORDER BY place) AS rising FROM g) SELECT place, round(avg(similarity), 6) AS mean, count(*) FILTER (rising) AS rising, round(avg((vec_id // 3 = neighbour // 3)::INT), 6) AS same_file FROM l GROUP BY place")
def slot_similarity(spark, sf_dir):
    """Mean similarity at each rank, edges that are nearer than the one before, and the share within a file."""
    before = F.lag("similarity").over(Window.partitionBy("vec_id").orderBy("place"))
    rows = edges(spark, sf_dir).withColumn("rising", F.coalesce(F.col("similarity") > before, F.lit(False)))
    same = F.floor(F.col("vec_id") / 3) == F.floor(F.col("neighbour") / 3)
    return rows.groupBy("place").agg(F.round(F.avg("similarity"), 6).alias("mean"), F.sum(F.col("rising").cast("long")).alias("rising"), F.round(F.avg(same.cast("int")), 6).alias("same_file"))


@query(f"WITH {_g()}, b AS (SELECT vec_id, neighbour, similarity FROM g UNION ALL SELECT neighbour, vec_id, similarity FROM g), m AS (SELECT vec_id, neighbour, max(similarity) AS similarity FROM b GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS INTEGER) AS place FROM m QUALIFY place <= 4")
def graph_neighbours(spark, sf_dir):
    """The best four neighbours of a vector over edges in both directions."""
    g = edges(spark, sf_dir).select("vec_id", "neighbour", "similarity")
    both = g.unionByName(g.select(F.col("neighbour").alias("vec_id"), F.col("vec_id").alias("neighbour"), "similarity"))
    best = both.groupBy("vec_id", "neighbour").agg(F.max("similarity").alias("similarity"))
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour"))
    return best.withColumn("place", place).where("place <= 4")


@query(f"WITH {_g(5)} SELECT g.vec_id AS seed, neighbour, label, CAST(row_number() OVER (PARTITION BY g.vec_id ORDER BY place) AS INTEGER) AS place FROM g JOIN embeddings e ON e.vec_id = g.neighbour WHERE g.vec_id < 20 AND neighbour % 7 != 0")
def seed_neighbours(spark, sf_dir):
    """Stored neighbours of some seeds with what the tracks table knows, excluded ones left out and ranks closed up."""
    labels = vectors(spark, sf_dir).select(F.col("vec_id").alias("neighbour"), "label")
    rows = vectors(spark, sf_dir).select("vec_id", "v")
    near = neighbours(rows.where("vec_id < 20"), rows, 5).where("neighbour % 7 != 0").join(labels, "neighbour")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy("place"))
    return near.select(F.col("vec_id").alias("seed"), "neighbour", "label", place.alias("place"))


def reachable(links: DataFrame) -> DataFrame:
    """node, component: the least node that ``links`` (a, b), in either direction, reach. Labels spread by minima and then jump to their
    label's label, so rounds grow with the logarithm of the longest way; each round is kept."""
    both = kept(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        spread = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(spread, F.col("node") == F.col("a")).select("node", F.least("component", "m").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("next"))
        found = kept(lower.join(jump, "c").select("node", F.least("c", "next").alias("component")))
        before, after = (x.agg(F.sum("component")).first()[0] for x in (labels, found))  # labels only fall
        labels = found
        if before == after:
            return labels


@query("""WITH RECURSIVE n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM n a JOIN n b ON a.vec_id != b.vec_id),
g AS (SELECT vec_id AS a, neighbour AS b FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) <= 1), l AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
w AS (SELECT a AS node, a AS component FROM l UNION SELECT l.b, w.component FROM w JOIN l ON l.a = w.node), c AS (SELECT node, min(component) AS component FROM w GROUP BY node)
SELECT component, count(*) AS nodes FROM c GROUP BY component""")
def graph_components(spark, sf_dir):
    """Components of the graph of nearest neighbours, and how many nodes each has."""
    links = edges(spark, sf_dir, 1).select(F.col("vec_id").alias("a"), F.col("neighbour").alias("b"))
    return reachable(links).groupBy("component").agg(F.count("*").alias("nodes"))


@query(f"""WITH {_g(1)}, a AS (SELECT x.vec_id, x.neighbour, y.neighbour = x.vec_id AS pair FROM g x JOIN g y ON y.vec_id = x.neighbour)
SELECT CASE WHEN vec_id < neighbour THEN vec_id ELSE neighbour END AS low, greatest(vec_id, neighbour) AS high, count(*) AS ends FROM a WHERE pair GROUP BY ALL""")
def walk_attractors(spark, sf_dir):
    """Where walks to the nearest neighbour end: pairs that are each other's nearest. Similarities don't fall along such a walk, so no
    other cycles occur but among equals."""
    g = edges(spark, sf_dir, 1).select("vec_id", "neighbour")
    back = g.select(F.col("neighbour").alias("vec_id"), F.col("vec_id").alias("neighbour"))
    pairs = g.join(back, ["vec_id", "neighbour"], "left_semi")
    return pairs.groupBy(F.least("vec_id", "neighbour").alias("low"), F.greatest("vec_id", "neighbour").alias("high")).agg(F.count("*").alias("ends"))


@query(f"""WITH {_g(5)}, a AS (SELECT vec_id, list(neighbour) AS l FROM (SELECT g.vec_id, g.neighbour FROM g WHERE EXISTS (SELECT 1 FROM g h WHERE h.vec_id = g.neighbour AND h.neighbour = g.vec_id)) GROUP BY vec_id)
SELECT g.vec_id, g.neighbour, CAST(round((0.3::DOUBLE * (1 - similarity) + 0.7::DOUBLE * (1 - coalesce(len(list_intersect(x.l, y.l)) / nullif(len(list_distinct(coalesce(x.l, []) || coalesce(y.l, []))), 0)::DOUBLE, 0))) * 1e7) AS BIGINT) AS distance_e7
FROM g LEFT JOIN a x ON x.vec_id = g.vec_id LEFT JOIN a y ON y.vec_id = g.neighbour""")
def mutual_distances(spark, sf_dir):
    """Distances re-ranked by what two vectors have in common: 0.3 of the distance, 0.7 of one less the Jaccard of their mutual neighbours."""
    g = edges(spark, sf_dir, 5)
    back = g.select(F.col("neighbour").alias("vec_id"), F.col("vec_id").alias("neighbour"))
    sets = g.select("vec_id", "neighbour").join(back, ["vec_id", "neighbour"], "left_semi").groupBy("vec_id").agg(F.collect_set("neighbour").alias("l"))  # at most k each
    none = F.array().cast("array<bigint>")
    rows = g.join(sets.withColumnRenamed("l", "x"), "vec_id", "left").join(sets.select(F.col("vec_id").alias("neighbour"), F.col("l").alias("y")), "neighbour", "left")
    x, y = F.coalesce("x", none), F.coalesce("y", none)
    jaccard = F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))
    return rows.select("vec_id", "neighbour", F.round((0.3 * (1 - F.col("similarity")) + 0.7 * (1 - jaccard)) * 1e7).cast("long").alias("distance_e7"))


@query(f"""WITH {_g(3)}, w AS (SELECT g.vec_id, i, sum(pow(1 / (1 + (1 - similarity)), 1.5) * x) AS sx, sum(pow(1 / (1 + (1 - similarity)), 1.5)) AS sw FROM g JOIN (SELECT vec_id AS neighbour, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM n) USING (neighbour) GROUP BY g.vec_id, i),
o AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM n) SELECT vec_id, round((sum(CASE WHEN i = 1 THEN (x + sx) / (1 + sw) END)), 5) AS first, round(sqrt(sum(((x + sx) / (1 + sw)) * ((x + sx) / (1 + sw)))), 5) AS norm FROM o JOIN w USING (vec_id, i) GROUP BY vec_id""")
def expanded_queries(spark, sf_dir):
    """Vectors drawn towards their three nearest: (v + sum of w n) / (1 + sum of w) with w = (1 / (1 + distance)) ** 1.5."""
    g = edges(spark, sf_dir, 3).withColumn("w", F.pow(1 / (1 + (1 - F.col("similarity"))), F.lit(1.5)))
    rows = vectors(spark, sf_dir).select("vec_id", "v")
    near = g.join(rows.withColumnsRenamed({"vec_id": "neighbour", "v": "n"}), "neighbour")
    sums = near.groupBy("vec_id").agg(F.sum("w").alias("sw"), *[F.sum(F.col("w") * F.col("n")[i]).alias(f"s{i}") for i in range(64)])
    moved = F.zip_with("v", F.array(*[F.col(f"s{i}") for i in range(64)]), lambda x, s: (x + s) / (1 + F.col("sw")))
    out = rows.join(sums, "vec_id").select("vec_id", moved.alias("v"))
    return out.select("vec_id", F.round(F.col("v")[0], 5).alias("first"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 5).alias("norm"))


@query(f"""WITH {_g(7)}, k AS (SELECT vec_id, max(1 - similarity) AS s FROM g GROUP BY vec_id) SELECT g.vec_id, g.neighbour, round((1 - similarity) / sqrt(x.s * y.s), 5) AS scaled FROM g JOIN k x ON x.vec_id = g.vec_id JOIN k y ON y.vec_id = g.neighbour WHERE x.s * y.s > 0""")
def locally_scaled(spark, sf_dir):
    """Distances by the scale around both ends: how far away the seventh neighbour is."""
    g = edges(spark, sf_dir, 7).withColumn("d", 1 - F.col("similarity"))
    scale = g.groupBy("vec_id").agg(F.max("d").alias("s"))
    rows = g.join(scale, "vec_id").join(scale.select(F.col("vec_id").alias("neighbour"), F.col("s").alias("t")), "neighbour").where("s * t > 0")
    return rows.select("vec_id", "neighbour", F.round(F.col("d") / F.sqrt(F.col("s") * F.col("t")), 5).alias("scaled"))
