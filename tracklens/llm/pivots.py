"""Operator 1: near-duplicate embeddings by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import written
from tracklens.llm.graph import components

#: Reference points, and how many of the nearest describe a vector.
PIVOTS, NEAREST = 1024, 10
#: Reference points that two vectors must have in common to be compared.
SHARED = 3
#: Members of a list that one task compares with as many others at a time.
BLOCK = 1024
#: Rows of inverted lists that make one task.
TASK_ROWS = 20_000
#: Lists (or pairs of blocks) with more members are compared by a matrix product.
SMALL = 24


@lru_cache(maxsize=8)
def reference_points(dim: int, count: int) -> np.ndarray:
    """Directions drawn evenly from the sphere, the same wherever they are drawn."""
    drawn = np.random.default_rng([dim, count]).standard_normal((count, dim))
    return drawn / np.linalg.norm(drawn, axis=1, keepdims=True)


def nearest_points(vectors: np.ndarray, count: int = PIVOTS, nearest: int = NEAREST) -> np.ndarray:
    """The ``nearest`` reference points of each unit vector, nearest first (ties: lower number)."""
    return np.argsort(-(vectors @ reference_points(vectors.shape[1], count).T), axis=1, kind="stable")[:, :nearest]


def _first_meeting(a: np.ndarray, b: np.ndarray, last: np.ndarray, shared: int) -> np.ndarray:
    """For pairs of sorted reference points that meet in the list whose greatest point is ``last``:
    whether it holds the least points they share, so that a pair counts in one of its lists only."""
    both = (a[:, :, None] == b[:, None, :]).any(axis=2)
    return ((a <= last[:, None]) & both).sum(axis=1) == shared


def _pairs_of_lists(starts: np.ndarray, sizes: np.ndarray, unit: np.ndarray, block: np.ndarray, whole: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows a < b of linked members of the same list; lists lie one after the other in ``unit``."""
    small = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
    for size in np.unique(sizes[small]).tolist():
        base = starts[small[sizes[small] == size]]
        i, j = np.triu_indices(size, 1)
        for at in range(0, len(base), max(1, 200_000 // len(i))):
            a = (base[at : at + max(1, 200_000 // len(i)), None] + i).ravel()
            b = a + np.tile(j - i, len(a) // len(i))
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            a, b = a[near], b[near]
            apart = whole[a] | (block[a] != block[b])
            yield a[apart], b[apart]
    for g in np.flatnonzero(sizes > SMALL).tolist():
        first, end = int(starts[g]), int(starts[g] + sizes[g])
        for at in range(first, end, 256):
            a, b = np.nonzero(unit[at : min(at + 256, end)] @ unit[first:end].T >= threshold)
            a, b = a + at, b + first
            apart = (a < b) & (whole[a] | (block[a] != block[b]))
            yield a[apart], b[apart]


def _forest(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row reachable from each of ``count`` rows by the links a-b."""
    label = np.arange(count)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def embedding_links(vectors: DataFrame, threshold: float = 0.95, pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Links between ``vectors`` (cid long, copies long, unit array<double>) of cosine >= threshold.

    Returns (cid, n_links: copies of all vectors linked) and the links of a spanning forest (a, b),
    in which all linked vectors are connected.

    Each vector is described by its ``nearest`` of ``pivots`` reference points. The inverted lists
    are those of every ``shared`` points together: two vectors have so many in common exactly if they
    meet in such a list, so the lists give the pairs with that shared-pivot count without a count
    for every pair that shares one point. Lists of one member go before vectors are attached. Long
    lists are cut into blocks, and every two blocks are compared by a task of their own; pairs never
    leave a task, only sums for each vector and a forest of the links. Cosines are in double precision.

    ``pivots`` should grow with the number of vectors (twice the points: an eighth of the chance
    meetings at ``shared`` = 3).
    """
    bits = pivots.bit_length()
    if bits * shared > 52:
        raise ValueError("a list's name must fit in 52 bits")

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby(frame["unit"].map(len)):
                for at in range(0, len(part), 2000):
                    some = part.iloc[at : at + 2000]
                    points = np.sort(nearest_points(np.stack(some["unit"].to_list()), pivots, nearest), axis=1).astype(np.int64)
                    keys = [sum(points[:, c] << (bits * i) for i, c in enumerate(combo)) for combo in combinations(range(points.shape[1]), shared)]
                    keys = np.stack(keys, axis=1) + (np.int64(dim % 2048) << 52)
                    yield pd.DataFrame({"cid": some["cid"], "copies": some["copies"], "unit": some["unit"], "points": list(points.astype(np.int32)), "keys": list(keys)})

    described = written(vectors.select("cid", "copies", "unit").mapInPandas(describe, "cid long, copies long, unit array<double>, points array<int>, keys array<long>"), "pivot-points")
    listed = described.select("cid", F.explode("keys").alias("key"))
    lists = listed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    kept = listed.join(lists, "key").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    kept = kept.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    spread = written(kept.withColumn("pair", F.explode(pairs)).select("cid", "key", "block", "pair.i", "pair.j"), "pivot-lists")
    tasks = max(1, spread.count() // TASK_ROWS)
    task = F.pmod(F.xxhash64("key", "i", "j"), F.lit(tasks)).cast("int")
    rows = spread.join(described.drop("keys"), "cid").withColumn("task", task)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "i", "j"], kind="stable")
        name = frame[["key", "i", "j"]].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]).any(axis=1))))
        sizes = np.diff(np.append(starts, len(name)))
        length = frame["unit"].map(len).to_numpy()
        unit = np.zeros((len(frame), length.max()))
        for n in np.unique(length).tolist():
            unit[length == n, :n] = np.stack(frame["unit"][length == n].to_list())
        found = list(_pairs_of_lists(starts, sizes, unit, frame["block"].to_numpy(), name[:, 1] == name[:, 2], threshold))
        if not found:
            return pd.DataFrame({"cid": [], "n_links": [], "other": []}, dtype="int64")
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        points, copies, cids = np.stack(frame["points"].to_list()), frame["copies"].to_numpy(), frame["cid"].to_numpy()
        last = (name[:, 0] >> (bits * (shared - 1))) & ((1 << bits) - 1)
        sums = np.zeros(len(frame), dtype=np.int64)
        for at in range(0, len(a), 100_000):
            x, y = a[at : at + 100_000], b[at : at + 100_000]
            first = _first_meeting(points[x], points[y], last[x], shared)
            np.add.at(sums, x[first], copies[y[first]])
            np.add.at(sums, y[first], copies[x[first]])
        some = np.unique(np.concatenate((a, b)))
        out = pd.DataFrame({"cid": cids[some], "n_links": sums[some], "other": cids[_forest(len(frame), a, b)[some]]})
        return out.groupby(["cid", "other"], as_index=False)["n_links"].sum()[["cid", "n_links", "other"]]

    found = written(rows.groupBy("task").applyInPandas(compare, "cid long, n_links long, other long"), "pivot-links")
    return found.groupBy("cid").agg(F.sum("n_links").alias("n_links")), found.select(F.col("cid").alias("a"), F.col("other").alias("b")).where("a != b")


def near_duplicates(table: DataFrame, threshold: float = 0.95, pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``table`` (vec_id long, embedding array).

    n_links: other rows with cosine >= threshold; component_id: the smallest vec_id that links
    reach, its own included; kept: vec_id is component_id. Equal vectors are one member of the index
    with a count, so groups of copies cost nothing there.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing, nor
    do vectors of different lengths. Rows with a null vec_id link with nothing: n_links 0,
    component_id and kept null. Rows that repeat a vec_id count one by one; where their vectors
    differ they are one vertex and share their links.
    Other columns of ``table`` are ignored.
    """
    values = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & (F.size(values) > 0) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table.select(F.col("vec_id").cast("long"), values.alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"))
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    rows = rows.withColumn("v", F.when(F.col("sound") & (top > 0), F.transform("v", lambda x: x / top))).drop("sound")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("unit", F.transform("v", lambda x: x / norm)), "vector-classes")
    counts, forest = embedding_links(classes.select("cid", "copies", "unit"), threshold, pivots, nearest, shared)
    roots = components(forest).select(F.col("node").alias("cid"), "component")
    known = classes.join(counts, "cid", "left").join(roots, "cid", "left")
    known = known.select("v", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    out = rows.join(known, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: The same rows in DuckDB, over a view ``embeddings`` of sound vectors with distinct ids.
ORACLE_SQL = """
WITH RECURSIVE n AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id != b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
), w AS (
  SELECT vec_id AS node, vec_id AS root FROM n UNION SELECT l.b, w.root FROM w JOIN l ON l.a = w.node
), c AS (
  SELECT node, min(root) AS root FROM w GROUP BY node
)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, root AS component_id, vec_id = root AS kept FROM n JOIN c ON node = vec_id
"""
