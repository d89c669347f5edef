"""Operator 11: hard negatives by norm-bucketed search of inner products."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.llm.common import join_small, written

#: Candidates of a block, and anchors of a block: what one task multiplies.
BLOCK = 16_384
#: Norm buckets at most; each is one or more blocks.
BUCKETS = 64
#: A wave searches so many times as many buckets as all waves before it.
GROWTH = 7
#: Cells of a product that are held at a time.
TILE = 2_000_000
#: Bounds are compared with so much room for rounding.
SLACK = 1 + 1e-9


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64, copy=False)


def inner_products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products of whole-numbered rows, exactly. No partial sum exceeds ``bound``, the
    product of the largest norms: below 2**53 doubles hold all of them."""
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], dtype=object) for m in (a, b)]
    return whole[0].dot(whole[1].T).astype(np.int64)


def best_of(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the first k allowed cells of each row: higher scores first, then lower columns."""
    dense = np.flatnonzero(allowed.sum(axis=1) > 64 * k)
    if len(dense) and scores.shape[1] > k:
        # Cells below the k-th score of a long row can't be among its first k.
        kth = np.partition(np.where(allowed[dense], scores[dense], np.iinfo(np.int64).min), -k, axis=1)[:, -k]
        allowed[dense] &= scores[dense] >= kth[:, None]
    row, col = np.nonzero(allowed)
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row, side="left")
    kept = np.arange(len(row)) - first < k
    return row[kept], col[kept]


def _tiles(anchors: pd.DataFrame, candidates: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, np.ndarray]]:
    """Anchors, candidates of the same length by (vec_id, uid), and their scores."""
    for dim, left in anchors.groupby(anchors["v"].map(len)):
        right = candidates[candidates["v"].map(len) == dim].sort_values(["vec_id", "uid"], kind="stable")
        if not len(right):
            continue
        b, step = _matrix(right["v"]), max(1, TILE // len(right))
        for at in range(0, len(left), step):
            some = left.iloc[at : at + step]
            yield some, right, inner_products(_matrix(some["v"]), b, some["norm"].max() * right["norm"].max() * SLACK)


def _best_alike(anchors: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The first k rows of each anchor's label among ``candidates`` that can still count."""
    found = [pd.DataFrame({"anchor": [], "goal": [], "score": [], "id": [], "uid": []}, dtype="int64")]
    for left, right, scores in _tiles(anchors, candidates):
        ids = right["vec_id"].to_numpy()
        allowed = (left["label"].to_numpy()[:, None] == right["label"].to_numpy()) & (left["vec_id"].to_numpy()[:, None] != ids)
        allowed &= scores >= np.array([np.iinfo(np.int64).min if f is None or not len(f) else f[0] for f in left["floors"]])[:, None]
        row, col = best_of(scores, allowed, k)
        found.append(pd.DataFrame({"anchor": left["uid"].to_numpy()[row], "goal": 0, "score": scores[row, col], "id": ids[col], "uid": right["uid"].to_numpy()[col]}))
    return pd.concat(found)


def _best_within(anchors: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The first k rows of other labels in each of the anchor's windows that can still count."""
    found = [pd.DataFrame({"anchor": [], "goal": [], "score": [], "id": [], "uid": []}, dtype="int64")]
    for left, right, scores in _tiles(anchors, candidates):
        ids = right["vec_id"].to_numpy()
        other = left["label"].to_numpy()[:, None] != right["label"].to_numpy()
        other &= left["vec_id"].to_numpy()[:, None] != ids
        for goal in range(max(map(len, left["floors"]))):
            # An anchor with fewer positives has an empty window here.
            low = np.array([f[goal] if goal < len(f) else 1 for f in left["floors"]])
            high = np.array([h[goal] if goal < len(h) else 0 for h in left["highs"]])
            row, col = best_of(scores, other & (scores >= low[:, None]) & (scores <= high[:, None]), k)
            found.append(pd.DataFrame({"anchor": left["uid"].to_numpy()[row], "goal": goal, "score": scores[row, col], "id": ids[col], "uid": right["uid"].to_numpy()[col]}))
    return pd.concat(found)


def waves(count: int) -> list[tuple[int, int]]:
    """Buckets (from, to) of each wave: 0, then GROWTH more, then GROWTH times all of these, and so on."""
    out, at = [], 0
    while at < count:
        out.append((at, min(count, max(1, at * (GROWTH + 1)))))
        at = out[-1][1]
    return out


def _cuts_above(norm: Column, cuts: list[float], low: int, high: int) -> Column:
    """How many of the falling ``cuts`` are above ``norm``, known to be from ``low`` to ``high``: halved, so that a row sees few of them."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(norm < F.lit(cuts[middle]), _cuts_above(norm, cuts, middle + 1, high)).otherwise(_cuts_above(norm, cuts, low, middle))


class NormBuckets:
    """``rows`` (uid, vec_id, label, v, norm; a written table) in buckets of falling norm.

    Buckets are cut at approximate quantiles of the norm, about BLOCK rows each and at most BUCKETS; where
    many rows share a norm, a bucket has more, and is worked on in blocks of about BLOCK rows. What is
    held on the driver is one row for each bucket.
    """

    def __init__(self, rows: DataFrame) -> None:
        count = rows.count()
        wanted = max(1, min(BUCKETS, count // BLOCK))
        cuts = rows.select(F.percentile_approx("norm", [1 - i / wanted for i in range(1, wanted)] or [0.5], 10_000)).first()[0] if count else None
        cuts = sorted(set(cuts or []), reverse=True) if wanted > 1 else []
        self.rows = rows.withColumn("bucket", _cuts_above(F.col("norm"), cuts, 0, len(cuts)))
        self.known = sorted(tuple(r) for r in self.rows.groupBy("bucket").agg(F.count("*"), F.max("norm")).collect())
        blocks = {number: ceil(members / BLOCK) for number, members, _ in self.known}
        # An array and not a case for each bucket: Spark repeats the bucket's expression wherever a condition on the block names it.
        counts = F.lit([blocks.get(number, 1) for number in range(len(cuts) + 1)])
        self.rows = self.rows.withColumn("block", F.pmod(F.xxhash64("uid"), F.element_at(counts, F.col("bucket") + 1)).cast("int"))

    def wave(self, anchors: DataFrame, first: int, end: int, needs: Column, search, k: int) -> DataFrame:
        """What ``search`` finds for the anchors in the buckets of place ``first`` to ``end``.

        ``needs``: the least score that can still count for an anchor (null: any). A bucket is left out
        for it if its greatest norm times the anchor's stays below (Cauchy-Schwarz). Blocks of
        anchors meet the blocks of a bucket that one of their anchors needs; a task has one of each.
        """
        places = [F.struct(F.lit(number).alias("bucket"), F.lit(float(norm)).alias("top"), F.lit(ceil(members / BLOCK)).alias("blocks")) for number, members, norm in self.known[first:end]]
        open_ = F.filter(F.array(*places), lambda b: F.coalesce(F.col("norm") * b["top"] * SLACK >= needs, F.lit(True)))
        sent = anchors.withColumn("_b", F.explode(open_)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_b.blocks") - 1))).withColumn("bucket", F.col("_b.bucket")).drop("_b")
        meet = written(sent.select("bucket", "block", "part").distinct(), "norm-meetings")
        held = join_small(self.rows, meet, ["bucket", "block"])
        keys = ["bucket", "block", "part"]
        sent = sent.toDF(*sent.columns)  # both sides come from one table: columns of their own
        return sent.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(lambda a, b: search(a, b, k) if len(a) and len(b) else search(a.iloc[:0], b, k), "anchor long, goal int, score long, id long, uid long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor's goal; a row has them in order with the score of the last, if there are k."""
    best = Window.partitionBy("anchor", "goal").orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: Column, scale: float = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row of ``vectors``
    (vec_id, label, embedding) where ``anchors`` holds, and each of its first ``positives`` rows of the same
    label, the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.

    A component x counts as floor(scale * x), scores are integer inner products, higher come first, ties by
    smaller vec_id. Rows lie in buckets of falling norm. Buckets are searched in waves; a bucket's
    greatest norm times the anchor's bounds its scores, so it is left out where that is below the least
    positive so far, and in the second search below both the window's lower limit and its running last
    score. All other cells are computed.

    Rows with a null vec_id or label, a null or empty vector, or a null or non-finite component take no
    part; vectors of different lengths have no score. Other rows are those with another vec_id. Rows
    that repeat a vec_id count one by one, as anchors too: each has its own rows then, equal ones included.
    Scores of 2**56 and over raise an error. Other columns are ignored.
    """
    values = F.col("embedding").cast("array<double>")
    # floor() gives a long: doubles from 2**53 are whole numbers already.
    whole = F.transform(values, lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(values) > 0) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long"), F.col("label").cast("long"), whole.alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = written(rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))), "norm-rows")
    space = NormBuckets(rows.drop("anchor"))
    parts = max(1, ceil(rows.where("anchor").count() / BLOCK))
    asked = rows.where("anchor").select("uid", "vec_id", "label", "v", "norm", F.pmod(F.xxhash64("uid", F.lit("part")), F.lit(parts)).cast("int").alias("part"))

    kind = "anchor long, goal int, score long, id long, uid long"
    best = rows.sparkSession.createDataFrame([], kind)
    for first, end in waves(len(space.known)):
        least = best.groupBy("anchor").agg(F.when(F.count("*") == positives, F.min("score")).alias("_least"))
        state = asked.join(least.withColumnRenamed("anchor", "uid"), "uid", "left")
        state = state.withColumn("floors", F.when(F.col("_least").isNotNull(), F.array("_least")))
        found = space.wave(state, first, end, F.col("_least"), _best_alike, positives)
        best = written(_merged(best.unionByName(found), positives).drop("rank"), "best-alike")

    goals = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "id", F.col("uid").alias("row")))).alias("goals"))
    windows = goals.select(F.col("anchor").alias("uid"), "goals", F.transform("goals", lambda g: _limit(-g["order"] * low, up=True)).alias("lows"), F.transform("goals", lambda g: _limit(-g["order"] * high, up=False)).alias("highs"))
    windows = written(windows, "windows")
    best = rows.sparkSession.createDataFrame([], kind + ", rank int")
    for first, end in waves(len(space.known)):
        last = best.groupBy("anchor", "goal").agg(F.when(F.count("*") == negatives, F.min("score")).alias("last"))
        lasts = last.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("goal", "last"))).alias("_lasts"))
        state = asked.join(windows.drop("goals"), "uid").join(lasts.withColumnRenamed("anchor", "uid"), "uid", "left")
        floors = F.transform("lows", lambda x, i: F.greatest(x, F.element_at("_lasts", i)))
        state = state.withColumn("floors", floors).drop("lows", "_lasts")
        needs = F.array_min(F.transform(F.arrays_zip("floors", "highs"), lambda w: F.when(w["floors"] <= w["highs"], w["floors"])))
        found = space.wave(state.where(F.exists(F.arrays_zip("floors", "highs"), lambda w: w["floors"] <= w["highs"])), first, end, needs, _best_within, negatives)
        best = written(_merged(best.drop("rank").unionByName(found), negatives), "best-within")

    goal = F.col("goals")[F.col("goal")]
    out = best.join(windows.select(F.col("uid").alias("anchor"), "goals"), "anchor").join(asked.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", goal["id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), (-goal["order"]).alias("positive_score"), F.col("score").alias("negative_score"))


def _limit(hundredfold: Column, up: bool) -> Column:
    """A hundredth, rounded up or down, in whole numbers."""
    rest = F.pmod(hundredfold, F.lit(100))
    down = ((hundredfold - rest).cast("decimal(38,0)") / 100).cast("long")
    return down + F.when(rest > 0, 1).otherwise(0) if up else down


#: The same rows in DuckDB, over a view ``embeddings`` with distinct ids.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(embedding) > 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS alike, list_dot_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id != a.vec_id AND len(a.e) = len(c.e)
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other))::INTEGER AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) <= 10
"""
