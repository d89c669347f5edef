"""A navigable graph, built cell by cell, and greedy routing over neighbour graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions.kept import kept
from tracklens.operators.selection import ALPHA, GRAPH_SQL, POOL, SLOTS, in_order, pruned, selected, units
from tracklens.operators.vectors import neighbours, vectors
from tracklens.plans.define import family

QUERIES, ORACLES, query = family()

#: Rows that one task builds a graph of, cells that a row is in, and cells at most.
CELL, OVERLAP, CELLS = 2048, 2, 4096
#: Width of the search that finds a row's candidates, and slots that go to the nearest before the rule chooses.
BEAM, FORCED = 48, 2


def _chosen(order: np.ndarray, away: np.ndarray, slots: int, alpha: int, forced: np.ndarray) -> np.ndarray:
    """Rows x slots: what the diversifying rule keeps of the candidates ``order`` (rows x candidates, nearest first, -1 for
    none), behind ``forced``; -1 in slots left empty."""
    rows = np.arange(len(order))
    keep = np.full((len(order), slots), -1)
    keep[:, : forced.shape[1]] = forced
    count = (keep >= 0).sum(axis=1)
    for c in range(order.shape[1]):
        new = order[:, c]
        ok = (new >= 0) & (count < slots) & ~(keep == new[:, None]).any(axis=1)
        near = (keep >= 0) & (alpha * away[keep, new[:, None]] <= 1000 * away[rows, new][:, None])
        ok &= ~near.any(axis=1)
        keep[rows[ok], count[ok]] = new[ok]
        count += ok
    return keep


def _searched(away: np.ndarray, graph: np.ndarray, start: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """What a beam search for every row passes through, from ``start`` over ``graph`` (rows x slots): visited (rows x rows)."""
    n = len(away)
    rows = np.arange(n)
    visited = np.zeros((n, n), dtype=bool)
    visited[:, start] = True
    front, done = np.full((n, beam), -1), np.ones((n, beam), dtype=bool)
    front[:, 0], done[:, 0] = start, False
    while not done.all():
        at = np.argmax(~done, axis=1)  # the nearest that is not expanded, as beams are in order
        live = ~done[rows, at]
        now = front[rows, at]
        done[rows, at] = True
        new = np.where(live[:, None], graph[np.where(live, now, 0)], -1)
        new[(new == rows[:, None]) | visited[rows[:, None], new]] = -1
        for s in range(new.shape[1]):  # a target listed twice counts once
            new[(new[:, :s] == new[:, s : s + 1]).any(axis=1), s] = -1
        r, s = np.nonzero(new >= 0)
        visited[r, new[r, s]] = True
        wide = np.concatenate([front, new], axis=1)
        over = np.concatenate([done, new < 0], axis=1)
        d = np.where(wide >= 0, away[rows[:, None], wide], np.iinfo(np.int64).max)
        order = np.argsort(d, axis=1, kind="stable")[:, :beam]
        front, done = np.take_along_axis(wide, order, axis=1), np.take_along_axis(over, order, axis=1)
    return visited


def built(unit: np.ndarray, slots: int = SLOTS, alpha: int = ALPHA, forced: int = FORCED, beam: int = BEAM) -> np.ndarray:
    """Rows x slots of a navigable graph over ``unit`` vectors, -1 in empty slots: two passes, at alpha 1 and then ``alpha``, in each of
    which all rows search from the medoid, choose from what they passed, and offer themselves to what they chose."""
    n = len(unit)
    away = 1_000_000 - np.rint(np.round(unit @ unit.T, 6) * 1e6).astype(np.int64)
    np.fill_diagonal(away, np.iinfo(np.int64).max // (2 * max(alpha, 1000)))
    nearest = np.argsort(away, axis=1, kind="stable")[:, : min(n - 1, slots)]
    graph = np.full((n, slots), -1)
    graph[:, : nearest.shape[1]] = nearest
    start = int(np.argmax(unit @ unit.mean(axis=0)))
    for strength in (1000, alpha):
        seen = _searched(away, graph, start, beam)
        r, s = np.nonzero(graph >= 0)
        seen[r, graph[r, s]] = True
        np.fill_diagonal(seen, False)
        most = int(seen.sum(axis=1).max(initial=0))
        order = np.argsort(np.where(seen, away, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :most]
        order = np.where(np.take_along_axis(seen, order, axis=1), order, -1)
        graph = _chosen(order, away, slots, strength, nearest[:, :forced])
        offers: dict[int, list[int]] = {}
        for a, s in zip(*np.nonzero(graph >= 0), strict=True):
            offers.setdefault(int(graph[a, s]), []).append(int(a))
        for target, sources in offers.items():
            pool = np.unique(np.concatenate([graph[target][graph[target] >= 0], sources]))
            pool = pool[np.argsort(away[target, pool], kind="stable")]
            # One row of distances: the target's; what it chooses from is its pool.
            keep = list(nearest[target, :forced])
            for new in pool:
                if len(keep) < slots and new not in keep and not any(strength * away[k, new] <= 1000 * away[target, new] for k in keep):
                    keep.append(int(new))
            graph[target] = keep + [-1] * (slots - len(keep))
    return graph


def navigable(rows: DataFrame, slots: int = SLOTS, alpha: int = ALPHA, forced: int = FORCED, cell: int = CELL, pool: int = POOL) -> DataFrame:
    """vec_id, neighbour, similarity: a graph over ``rows`` (vec_id, v) that searches can walk, ``slots`` edges at most for each.

    Rows lie in the OVERLAP cells of their nearest pivots (one pivot for every ``cell`` / 2 rows); a task builds the graph
    of one cell, or of a part of a cell that has more than twice ``cell`` rows. What a row was given in its cells
    is put together and goes through the rule again behind its nearest two. Then rows that nothing points at get an edge
    from one of their nearest (see ``repaired``). Cells overlap, which is what joins them.
    """
    unit = kept(units(rows), "units")
    near = kept(neighbours(rows, rows, pool).select("vec_id", "neighbour", "similarity", "place"), "near")
    count = unit.count()
    cells = max(1, min(CELLS, -(-2 * count // cell)))
    cells = 1 if count <= cell else cells
    drawn = unit.orderBy(F.xxhash64("id"), "id").limit(cells if cells > 1 else 0).select("v").collect()  # CELLS at most
    pivots = np.array([r["v"] for r in drawn]) if drawn else None

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.stack(frame["v"].to_list())
                to = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :OVERLAP] if pivots is not None else np.zeros((len(x), 1), dtype=int)
                yield pd.DataFrame({"id": frame["id"].repeat(to.shape[1]), "v": frame["v"].repeat(to.shape[1]), "cell": to.ravel()})

    held = kept(unit.mapInPandas(assign, "id long, v array<double>, cell int"), "cells")
    parts = held.groupBy("cell").agg(F.ceil(F.count("*") / (2 * cell)).cast("int").alias("parts"))  # a row for each pivot
    held = held.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        v, ids = np.stack(frame["v"].to_list()), frame["id"].to_numpy()
        graph = built(v, slots, alpha, forced) if len(ids) > 1 else np.full((1, slots), -1)
        r, s = np.nonzero(graph >= 0)
        t = graph[r, s]
        return pd.DataFrame({"vec_id": ids[r], "neighbour": ids[t], "similarity": np.round(np.einsum("ij,ij->i", v[r], v[t]), 6)})

    found = held.groupBy("cell", "part").applyInPandas(build, "vec_id long, neighbour long, similarity double")
    first = near.where(F.col("place") <= forced).select("vec_id", "neighbour", "similarity")
    union = kept(found.unionByName(first).groupBy("vec_id", "neighbour").agg(F.max("similarity").alias("similarity")), "built")
    # The nearest ``forced`` stay; of the others the rule keeps what these don't hide.
    edges = pruned(in_order(union, unit), slots, alpha, forced=forced)
    return repaired(kept(edges, "navigable"), near, slots, forced)


def repaired(edges: DataFrame, near: DataFrame, slots: int, forced: int) -> DataFrame:
    """``edges`` (vec_id, neighbour, similarity), changed so that something points at every vector of ``near`` (vec_id, neighbour,
    similarity, place).

    In round i each vector that nothing points at asks the one i-th nearest to it for an edge. Of all that ask it, that
    takes the nearest: into an empty slot, or for its least similar edge behind the ``forced`` nearest, if others point at
    that edge's target. So many edges into a target are given up in one round that one at least stays.
    """
    pool = near.agg(F.max("place")).first()[0] or 0
    order = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour")
    for turn in range(1, pool + 1):
        degree = edges.groupBy(F.col("neighbour").alias("target")).agg(F.count("*").alias("pointing"))
        alone = near.where(F.col("place") == turn).join(degree, F.col("vec_id") == F.col("target"), "left_anti")
        asks = alone.select(F.col("neighbour").alias("vec_id"), F.col("vec_id").alias("neighbour"), "similarity")
        asks = kept(asks.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n"), "asks")
        if asks.isEmpty():
            if near.select("vec_id").distinct().join(degree, F.col("vec_id") == F.col("target"), "left_anti").isEmpty():
                return edges
            continue
        held = edges.join(asks.select("vec_id"), "vec_id", "left_semi").withColumn("place", F.row_number().over(order))
        held = held.withColumn("n", F.count("*").over(Window.partitionBy("vec_id"))).join(degree, F.col("neighbour") == F.col("target"))
        full = held.where((F.col("n") >= slots) & (F.col("place") > forced) & (F.col("pointing") > 1))
        last = F.row_number().over(Window.partitionBy("vec_id").orderBy("similarity", F.desc("neighbour")))
        given = full.withColumn("_n", last).where("_n = 1")
        given = given.withColumn("_t", F.row_number().over(Window.partitionBy("target").orderBy("similarity", "vec_id"))).where(F.col("_t") < F.col("pointing"))
        given = kept(given.select("vec_id", "neighbour"), "given")
        room = edges.groupBy("vec_id").agg(F.count("*").alias("n")).where(F.col("n") < slots).select("vec_id")
        takers = given.select("vec_id").unionByName(room)
        edges = kept(edges.join(given, ["vec_id", "neighbour"], "left_anti").unionByName(asks.join(takers, "vec_id", "left_semi")), "repaired")
    return edges


def routed(edges: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """query, hops, found, stranded: greedy walks for ``queries`` (vec_id) over ``edges`` in both directions, to the neighbour most like
    the query while that is better than where the walk is. All walks go on together, a hop is a join.

    A walk starts at the row that the query's id is hashed to; if that is the query itself or missing, at the least other id.
    """
    unit = kept(units(rows), "units")
    n = unit.count()
    both = edges.select("vec_id", "neighbour").unionByName(edges.select(F.col("neighbour").alias("vec_id"), F.col("vec_id").alias("neighbour"))).distinct()
    both = kept(both.join(unit.select(F.col("id").alias("neighbour"), F.col("v").alias("w")), "neighbour"), "both-ways")
    least = [r[0] for r in unit.select("id").orderBy("id").limit(2).collect()]
    asked = queries.select(F.col("vec_id").alias("query")).join(unit, F.col("query") == F.col("id")).select("query", "v")
    hashed = F.pmod(F.col("query") * 7919 + 13, F.lit(max(n, 1)))
    other = F.when(F.col("query") == least[0], F.lit(least[-1])).otherwise(F.lit(least[0])) if least else F.lit(None).cast("long")
    start = asked.withColumn("h", hashed).join(unit.select(F.col("id").alias("h"), F.lit(True).alias("there")), "h", "left")
    start = start.withColumn("at", F.when(F.col("there") & (F.col("h") != F.col("query")), F.col("h")).otherwise(other))
    like = F.round(F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 6)
    live = start.join(unit.select(F.col("id").alias("at"), F.col("v").alias("w")), "at").select("query", "v", "at", like.alias("best"), F.lit(0).alias("hops"))
    ended, live = None, kept(live, "walks")
    while True:
        met = live.join(both, F.col("at") == F.col("vec_id")).where(F.col("neighbour") != F.col("query")).select("query", F.struct(like.alias("s"), (-F.col("neighbour")).alias("id")).alias("to"), "best")
        better = met.where(F.col("to.s") > F.col("best")).groupBy("query").agg(F.max("to").alias("to"))
        now = kept(live.join(better, "query", "left"), "hops")
        stay = now.where("to IS NULL").select("query", "at", "hops")
        ended = stay if ended is None else ended.unionByName(stay)
        live = kept(now.where("to IS NOT NULL").select("query", "v", (-F.col("to.id")).alias("at"), F.col("to.s").alias("best"), (F.col("hops") + 1).alias("hops")), "walks")
        if live.isEmpty():
            break
    true = neighbours(queries.join(rows, "vec_id").select("vec_id", "v"), rows, 1).select(F.col("vec_id").alias("query"), "neighbour")
    return ended.join(true, "query").select("query", "hops", (F.col("at") == F.col("neighbour")).alias("found"), (F.col("hops") == 0).alias("stranded"))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, ways AS (SELECT vec_id, neighbour FROM graph UNION SELECT neighbour, vec_id FROM graph),
q AS (SELECT vec_id AS query, (vec_id * 7919 + 13) % (SELECT count(*) FROM n) AS h FROM n WHERE vec_id % 100 = 0),
w AS (SELECT query, CASE WHEN h != query AND h IN (SELECT vec_id FROM n) THEN h ELSE (SELECT min(vec_id) FROM n WHERE vec_id != query) END AS spot, 0 AS hops, false AS ended FROM q UNION ALL
  SELECT w.query, coalesce(arg_max(t.neighbour, {{'s': t.similarity, 'i': -t.neighbour}}), w.spot), w.hops + CASE WHEN count(t.neighbour) > 0 THEN 1 ELSE 0 END, count(t.neighbour) = 0
  FROM w LEFT JOIN (SELECT ways.vec_id, s.vec_id AS query, s.neighbour, s.similarity, b.similarity AS best FROM ways JOIN s ON s.neighbour = ways.neighbour LEFT JOIN s b ON b.vec_id = s.vec_id AND b.neighbour = ways.vec_id) t
    ON t.vec_id = w.spot AND t.query = w.query AND t.similarity > t.best WHERE NOT w.ended GROUP BY w.query, w.spot, w.hops),
e AS (SELECT query, spot, hops FROM w WHERE ended), f AS (SELECT vec_id AS query, neighbour FROM s WHERE vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) = 1)
SELECT e.query, CAST(hops AS INTEGER) AS hops, spot = neighbour AS found, hops = 0 AS stranded FROM e JOIN f USING (query)""")
def routes(spark, sf_dir):
    """Greedy walks over the selected graph, from where they start to where they end."""
    rows = vectors(spark, sf_dir).select("vec_id", "v")
    return routed(selected(rows), rows, rows.where("vec_id % 100 = 0").select("vec_id"))


@query(None)
def navigable_edges(spark, sf_dir):
    """The navigable graph."""
    return navigable(vectors(spark, sf_dir).select("vec_id", "v"))


@query(None)
def navigable_routes(spark, sf_dir):
    """Greedy walks over the navigable graph."""
    rows = vectors(spark, sf_dir).select("vec_id", "v")
    return routed(navigable(rows), rows, rows.where("vec_id % 100 = 0").select("vec_id"))
