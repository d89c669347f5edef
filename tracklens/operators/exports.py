"""Exports of tracks and what they keep."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.functions.columns import cosine
from tracklens.operators.selection import _SIGNED, signed
from tracklens.operators.vectors import vectors
from tracklens.plans.define import family
from tracklens.sources.lite import LEVELS, read_lite, write_lite

QUERIES, ORACLES, query = family()


def _exported(spark, sf_dir) -> str:
    """The folder of an export of all vectors with their ratings; three in a row share a path."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not shared and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(shared or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/tracklens/lite-{uuid.uuid4().hex}"
    rows = signed(vectors(spark, sf_dir))
    write_lite(rows.select("vec_id", "v", "e", "m", "c", "p", F.concat(F.lit("/F/"), F.floor(F.col("vec_id") / 3).cast("string"), F.lit(".sid")).alias("path")), path)
    return path


@query(f"""WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
b AS (SELECT i, list_transform(quantile_cont(x, {[(k + 0.5) / LEVELS for k in range(LEVELS)]}), lambda q: round(q, 9)) AS levels FROM p GROUP BY i),
y AS (SELECT vec_id, i, x, list_sort(list_transform(levels, lambda q: {{'d': abs(x - q), 'q': q}}))[1].q AS y FROM p JOIN b USING (i))
SELECT vec_id, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS kept, round(sqrt(sum((x - y) * (x - y))), 6) AS error FROM y GROUP BY vec_id""")
def lite_vectors(spark, sf_dir):
    """How near vectors are to themselves after an export in four bits an element."""
    back = read_lite(spark, _exported(spark, sf_dir), ["vec_id", "v"]).withColumnRenamed("v", "w")
    rows = vectors(spark, sf_dir).join(back, "vec_id")
    error = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return rows.select("vec_id", F.round(cosine(F.col("v"), F.col("w")), 6).alias("kept"), F.round(error, 6).alias("error"))


@query(f"WITH {_SIGNED} SELECT vec_id, e, m, c, p, '/F/' || (vec_id // 3)::VARCHAR || '.sid' AS path FROM r")
def lite_tracks(spark, sf_dir):
    """Ratings and paths of the export, read without its vectors."""
    return read_lite(spark, _exported(spark, sf_dir), ["vec_id", "e", "m", "c", "p", "path"])
