"""Offline evaluation: AUC, rank correlation, gain of a ranking, agreement of two ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklens.functions.ranks import counted
from tracklens.operators.vectors import neighbours, vectors
from tracklens.sources.tables import table


def _ranked(rows: DataFrame, value: str) -> DataFrame:
    """value, n, rank: the middle rank of each distinct value."""
    return counted(rows, [], value).select(value, "n", (F.col("below") + (F.col("n") + 1) / 2.0).alias("rank"))


def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a document's length tells its quality: the area under the curve, from ranks."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").select("n_chars", "quality")
    ranks = rows.join(_ranked(rows, "n_chars"), "n_chars")
    good = F.col("quality") == 1
    sums = ranks.agg(F.sum(F.when(good, F.col("rank"))).alias("r"), F.sum(good.cast("long")).alias("p"), F.count("*").alias("n"))
    return sums.select("n", F.round((F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * (F.col("n") - F.col("p"))), 6).alias("auc"))


AUC = """WITH d AS (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id)),
r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS k FROM d),
s AS (SELECT sum(k) FILTER (quality = 1) AS r, count(*) FILTER (quality = 1) AS p, count(*) AS n FROM r)
SELECT n, round((r - p * (p + 1) / 2.0::DOUBLE) / (p * (n - p)), 6) AS auc FROM s"""


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of a customer's balance with the value of the orders."""
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    rows = table(spark, sf_dir, "customer").join(spent, "c_custkey").select("c_custkey", "c_acctbal", "spent")
    a = _ranked(rows, "c_acctbal").select("c_acctbal", F.col("rank").alias("x"))
    b = _ranked(rows, "spent").select("spent", F.col("rank").alias("y"))
    return rows.join(a, "c_acctbal").join(b, "spent").agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("rho"))


SPEARMAN = """WITH s AS (SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1),
r AS (SELECT rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY spent) + (count(*) OVER (PARTITION BY spent) - 1) / 2.0::DOUBLE AS y FROM customer JOIN s USING (c_custkey))
SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM r"""


def ndcg_of(edges: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """vec_id, ndcg for each of ``rows`` (vec_id, label, file) that has relevant others: those of its label in another file.
    ``edges`` (vec_id, neighbour, place) rank its k nearest, without those of its own file."""
    sizes = rows.groupBy("label").agg(F.count("*").alias("same_label"))
    files = rows.groupBy("file").agg(F.count("*").alias("same_file"))
    seeds = rows.join(sizes, "label").join(files, "file").withColumn("relevant", F.col("same_label") - F.col("same_file")).where("relevant > 0")
    found = edges.join(rows.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("found")), "neighbour").join(rows.select("vec_id", "label"), "vec_id")
    gains = found.groupBy("vec_id").agg(F.sum(F.when(F.col("label") == F.col("found"), 1 / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias("dcg"))
    ideal = F.expr(f"aggregate(sequence(1, CAST(least({k}, relevant) AS INT)), 0D, (s, p) -> s + 1 / log2(p + 1D))")
    return seeds.join(gains, "vec_id", "left").select("vec_id", F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"))


def ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nDCG@10 of the nearest neighbours by label; every three vectors in a row are one file, and its others don't count."""
    rows = vectors(spark, sf_dir).withColumn("file", F.floor(F.col("vec_id") / 3))
    own = rows.select("vec_id", "v")
    near = neighbours(own, own, 12).where("floor(vec_id / 3) != floor(neighbour / 3)")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy("place"))
    return ndcg_of(near.withColumn("place", place).where("place <= 10"), rows.select("vec_id", "label", "file"), 10)


NDCG = """WITH n AS (SELECT vec_id, label, vec_id // 3 AS file, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT a.vec_id, a.label = b.label AS hit, b.vec_id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM n a JOIN n b ON a.file != b.file),
p AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, other) AS place FROM s QUALIFY place <= 10),
d AS (SELECT vec_id, sum(CASE WHEN hit THEN 1 / log2(place + 1.0::DOUBLE) ELSE 0 END) AS dcg FROM p GROUP BY vec_id),
r AS (SELECT vec_id, count(*) OVER (PARTITION BY label) - count(*) OVER (PARTITION BY file) AS relevant FROM n)
SELECT vec_id, round(dcg / list_sum(list_transform(range(1, least(10, relevant) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))), 6) AS ndcg FROM r JOIN d USING (vec_id) WHERE relevant > 0"""


def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohen's kappa of two 0/1 labels."""
    cells = table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.sum((F.col("quality") == F.col("toxic")).cast("double")).alias("same"), F.sum(F.col("quality").cast("double")).alias("q"), F.sum(F.col("toxic").cast("double")).alias("t"))
    chance = (F.col("q") * F.col("t") + (F.col("n") - F.col("q")) * (F.col("n") - F.col("t"))) / (F.col("n") * F.col("n"))
    return cells.select("n", F.round((F.col("same") / F.col("n") - chance) / (1 - chance), 6).alias("kappa"))


KAPPA = """WITH s AS (SELECT count(*) AS n, sum((quality = toxic)::DOUBLE) AS o, sum(quality::DOUBLE) AS q, sum(toxic::DOUBLE) AS t FROM labels),
c AS (SELECT n, o / n AS o, (q * t + (n - q) * (n - t)) / (n * n)::DOUBLE AS e FROM s) SELECT n, round((o - e) / (1 - e), 6) AS kappa FROM c"""


QUERIES = {"auc": auc, "spearman": spearman, "ndcg": ndcg, "kappa": kappa}
ORACLES = {"auc": AUC, "spearman": SPEARMAN, "ndcg": NDCG, "kappa": KAPPA}
