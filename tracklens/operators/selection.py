"""The edges of the neighbour graph: approximate candidates by rating signature, pruned selection, reverse insertion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions.kept import kept
from tracklens.operators.vectors import neighbours, vectors
from tracklens.plans.define import family

QUERIES, ORACLES, query = family()

#: Candidates of a seed, slots of a track, and how much nearer a kept neighbour must be (alpha, in thousandths).
CANDIDATES, SLOTS, ALPHA = 256, 3, 1500
#: Nearest neighbours that the pruned selection chooses from.
POOL = 16
#: Seeds of a signature that one task compares with their list; offers to a target that are looked at in one round.
BLOCK, ROUND = 16_384, 256
RATINGS = ("e", "m", "c", "p")


def signed(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, v) with four ratings of 1 to 5 packed in a signature: the first four elements in steps of their
    usual spread (an eighth, in unit vectors of 64), 3 in the middle."""
    return rows.withColumns({name: F.least(F.greatest(F.floor(F.col("v")[i] * 8 + 3.5), F.lit(1)), F.lit(5)).cast("int") for i, name in enumerate(RATINGS)})


_SIGNED = "r AS (SELECT vec_id, " + ", ".join(f"CAST(least(greatest(floor(embedding[{i + 1}]::DOUBLE * 8 + 3.5), 1), 5) AS INTEGER) AS {name}" for i, name in enumerate(RATINGS)) + " FROM embeddings)"


def _apart(a: str, b: str) -> Column:
    return sum((F.abs(F.col(f"{a}.{r}") - F.col(f"{b}.{r}")) for r in RATINGS), F.lit(0))


def candidate_lists(rated: DataFrame, limit: int) -> DataFrame:
    """sig, candidate, place: for each signature the first ``limit`` + 1 rows of ``rated`` (vec_id, ratings) by how far
    their signature is away (L1, ties by signature), then by falling id. A seed's candidates are the first ``limit`` of its
    signature's list without itself, so all seeds of a signature share a list.

    Signatures are few (5 ** 4 at most), whatever the number of rows: the table of their distances is small, and of each
    signature only its last ``limit`` + 1 rows leave a task.
    """
    sig = F.struct(*RATINGS)
    rows = rated.select(sig.alias("sig"), "vec_id")
    counts = rows.groupBy("sig").agg(F.count("*").alias("n"))
    every = counts.agg(F.collect_list(F.struct("sig", "n")).alias("all"))  # one row of at most 625
    around = counts.select("sig").join(F.broadcast(every)).withColumn("to", F.explode("all"))
    nearer = Window.partitionBy("sig").orderBy(F.col("away"), F.col("to.sig")).rowsBetween(Window.unboundedPreceding, -1)
    around = around.select("sig", "to", _apart("sig", "to.sig").alias("away"))
    around = around.withColumn("before", F.coalesce(F.sum("to.n").over(nearer), F.lit(0))).where(F.col("before") <= limit)
    last = F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("vec_id")))
    members = rows.withColumn("turn", last).where(F.col("turn") <= limit + 1).select(F.col("sig").alias("other"), F.col("vec_id").alias("candidate"), "turn")
    listed = around.select("sig", F.col("to.sig").alias("other"), "before").join(members, "other")
    return listed.withColumn("place", (F.col("before") + F.col("turn")).cast("int")).where(F.col("place") <= limit + 1).select("sig", "candidate", "place")


_LISTS = f"""{_SIGNED}, sigs AS (SELECT DISTINCT e, m, c, p FROM r),
l AS (SELECT a.e, a.m, a.c, a.p, r.vec_id AS candidate, CAST(row_number() OVER (PARTITION BY a.e, a.m, a.c, a.p ORDER BY abs(a.e - r.e) + abs(a.m - r.m) + abs(a.c - r.c) + abs(a.p - r.p), r.e, r.m, r.c, r.p, r.vec_id DESC) AS INTEGER) AS place
  FROM sigs a, r QUALIFY place <= {CANDIDATES + 1})"""


@query(f"WITH {_LISTS} SELECT * FROM l")
def signature_candidates(spark, sf_dir):
    """The candidates of every signature, in order."""
    found = candidate_lists(signed(vectors(spark, sf_dir).select("vec_id", "v")), CANDIDATES)
    return found.select("sig.*", "candidate", "place")


def approximate_neighbours(rows: DataFrame, k: int, limit: int = CANDIDATES) -> DataFrame:
    """vec_id, neighbour, similarity, place: the ``k`` nearest of a vector's ``limit`` candidates. The work grows with
    the number of rows, not with its square: a block of a signature's seeds meets one list."""
    rated = signed(rows)
    lists = kept(candidate_lists(rated, limit).join(rows.select(F.col("vec_id").alias("candidate"), F.col("v").alias("w")), "candidate"), "candidates")
    sizes = rated.groupBy(F.struct(*RATINGS).alias("sig")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    seeds = rated.select(F.struct(*RATINGS).alias("sig"), "vec_id", "v").join(F.broadcast(sizes), "sig").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    met = lists.join(F.broadcast(sizes), "sig").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"vec_id": [0][:0], "neighbour": [0][:0], "similarity": [0.0][:0]})]
        b = b.sort_values("candidate", kind="stable")
        ids, place = b["candidate"].to_numpy(), b["place"].to_numpy()
        for at in range(0, len(a) if len(b) else 0, 2048):
            some = a.iloc[at : at + 2048]
            own, x, y = some["vec_id"].to_numpy(), np.stack(some["v"].to_list()), np.stack(b["w"].to_list())
            x, y = (t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-300) for t in (x, y))
            s = np.round(x @ y.T, 6)
            same = own[:, None] == ids
            # Without itself, a seed's list ends one place later.
            s[same | (place == limit + 1) & ~same.any(axis=1)[:, None]] = -9.0
            order = np.argsort(-s, axis=1, kind="stable")[:, :k]
            q, r = np.repeat(np.arange(len(own)), order.shape[1]), order.ravel()
            q, r = q[s[q, r] > -9.0], r[s[q, r] > -9.0]
            out.append(pd.DataFrame({"vec_id": own[q], "neighbour": ids[r], "similarity": s[q, r]}))
        return pd.concat(out)

    met = met.toDF(*met.columns)
    found = seeds.select("sig", "block", "vec_id", "v").groupBy("sig", "block").cogroup(met.groupBy("sig", "block")).applyInPandas(best, "vec_id long, neighbour long, similarity double")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour")))


_APPROXIMATE = f"""{_LISTS}, n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
o AS (SELECT r.vec_id, l.candidate, row_number() OVER (PARTITION BY r.vec_id ORDER BY l.place) AS turn FROM r JOIN l ON l.e = r.e AND l.m = r.m AND l.c = r.c AND l.p = r.p AND l.candidate != r.vec_id),
a AS (SELECT o.vec_id, o.candidate AS neighbour, round(list_cosine_similarity(x.v, y.v), 6) AS similarity FROM o JOIN n x ON x.vec_id = o.vec_id JOIN n y ON y.vec_id = o.candidate WHERE turn <= {CANDIDATES})"""


@query(f"WITH {_APPROXIMATE} SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS INTEGER) AS place FROM a QUALIFY place <= 25")
def candidate_neighbours(spark, sf_dir):
    """The 25 nearest of each vector among its candidates."""
    return approximate_neighbours(vectors(spark, sf_dir).select("vec_id", "v"), 25)


@query(f"""WITH {_APPROXIMATE}, f AS (SELECT vec_id, neighbour FROM a QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) <= 25),
s AS (SELECT x.vec_id, y.vec_id AS neighbour, round(list_cosine_similarity(x.v, y.v), 6) AS similarity FROM n x JOIN n y ON x.vec_id != y.vec_id),
g AS (SELECT vec_id, neighbour, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS place FROM s QUALIFY place <= 25)
SELECT CAST(place AS INTEGER) AS place, count(*) AS wanted, count(f.neighbour) AS found FROM g LEFT JOIN f USING (vec_id, neighbour) GROUP BY place""")
def candidate_recall(spark, sf_dir):
    """How many of the exact neighbours at each place the candidates hold."""
    rows = vectors(spark, sf_dir).select("vec_id", "v")
    found = approximate_neighbours(rows, 25).select("vec_id", "neighbour", F.lit(1).alias("hit"))
    return neighbours(rows, rows, 25).join(found, ["vec_id", "neighbour"], "left").groupBy("place").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))


def _greedy(d: np.ndarray, between: np.ndarray, there: np.ndarray, slots: int, alpha: int, forced: int = 0) -> np.ndarray:
    """Which candidates the diversifying rule keeps: nodes x candidates, in order of distance. A candidate goes if one that
    is kept is so near to it that alpha times their distance is not above its own; the first ``forced`` stay. Distances are in millionths."""
    keep = np.zeros(d.shape, dtype=bool)
    for c in range(d.shape[1]):
        hidden = (keep & (alpha * between[:, :, c] <= 1000 * d[:, c, None])).any(axis=1)
        keep[:, c] = there[:, c] & (~hidden | (c < forced)) & (keep.sum(axis=1) < slots)
    return keep


def _filled(keep: np.ndarray, there: np.ndarray, slots: int) -> np.ndarray:
    """Slots left empty are filled with the first that the rule left out."""
    rest = there & ~keep
    return keep | rest & (np.cumsum(rest, axis=1) <= slots - keep.sum(axis=1, keepdims=True))


def _edges(own: np.ndarray, there: np.ndarray, sims: np.ndarray, ids: np.ndarray, v: np.ndarray, slots: int, alpha: int, fill: bool = True, forced: int = 0) -> pd.DataFrame:
    """What the rule keeps of candidates in order (queries x candidates; ``v`` their unit vectors)."""
    d = 1_000_000 - np.rint(sims * 1e6).astype(np.int64)
    between = 1_000_000 - np.rint(np.round(v @ v.transpose(0, 2, 1), 6) * 1e6).astype(np.int64)
    keep = _greedy(d, between, there, slots, alpha, forced)
    i, c = np.nonzero(_filled(keep, there, slots) if fill else keep)
    return pd.DataFrame({"vec_id": own[i], "neighbour": ids[i, c], "similarity": sims[i, c]})


def pruned(lists: DataFrame, slots: int = SLOTS, alpha: int = ALPHA, fill: bool = True, forced: int = 0) -> DataFrame:
    """vec_id, neighbour, similarity that the rule keeps of ``lists`` (vec_id, list: array of (similarity, id, v) in order, v unit)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                some = frame.iloc[at : at + 256]
                most = max(map(len, some["list"]))
                dim = next((len(x["v"]) for row in some["list"] for x in row), 1)
                there, sims, ids, v = np.zeros((len(some), most), bool), np.zeros((len(some), most)), np.zeros((len(some), most), np.int64), np.zeros((len(some), most, dim))
                for i, row in enumerate(some["list"]):
                    there[i, : len(row)] = True
                    sims[i, : len(row)], ids[i, : len(row)], v[i, : len(row)] = [x["similarity"] for x in row], [x["id"] for x in row], [x["v"] for x in row]
                yield _edges(some["vec_id"].to_numpy(), there, sims, ids, v, slots, alpha, fill, forced)

    return lists.mapInPandas(run, "vec_id long, neighbour long, similarity double")


def units(rows: DataFrame) -> DataFrame:
    """id, v of length 1 for ``rows`` (vec_id, v)."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("_n", norm).select(F.col("vec_id").alias("id"), F.transform("v", lambda x: x / F.greatest(F.col("_n"), F.lit(1e-300))).alias("v"))


def in_order(pairs: DataFrame, unit: DataFrame) -> DataFrame:
    """vec_id, list: neighbours of ``pairs`` (vec_id, neighbour, similarity) with their vectors, nearest first."""
    near = F.struct((-F.col("similarity")).alias("order"), "id", "v")
    lists = pairs.withColumnRenamed("neighbour", "id").join(unit, "id").groupBy("vec_id").agg(F.array_sort(F.collect_list(near)).alias("list"))
    return lists.select("vec_id", F.transform("list", lambda x: F.struct((-x["order"]).alias("similarity"), x["id"].alias("id"), x["v"].alias("v"))).alias("list"))


def with_reverse(edges: DataFrame, unit: DataFrame, slots: int = SLOTS, alpha: int = ALPHA) -> DataFrame:
    """``edges`` (vec_id, neighbour, similarity) after each was offered to its target: targets whose slots overflow choose
    again, by the same rule, from what they had and what they were offered.

    A target may be offered very many edges. They are looked at ROUND at a time, nearest first; only targets with
    slots left go on to the next, so no task gathers all the offers of one.
    """
    offers = edges.select(F.col("neighbour").alias("vec_id"), F.col("vec_id").alias("neighbour"), "similarity")
    fresh = offers.join(edges.select("vec_id", "neighbour"), ["vec_id", "neighbour"], "left_anti")
    union = kept(edges.unionByName(fresh), "offers")
    sizes = union.groupBy("vec_id").agg(F.count("*").alias("n"))
    changed = fresh.select("vec_id").distinct().join(sizes.where(F.col("n") > slots), "vec_id", "left_semi")
    same = union.join(changed, "vec_id", "left_anti")
    left, chosen = kept(union.join(changed, "vec_id", "left_semi"), "overflow"), None
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour"))
    first = left.withColumn("place", place).where(F.col("place") <= slots).drop("place")
    while not left.isEmpty():
        some = kept(left.withColumn("place", place).where(F.col("place") <= ROUND).drop("place"), "round")
        # What is kept so far is nearest of all, and so kept again.
        pool = some if chosen is None else some.unionByName(chosen.join(some.select("vec_id").distinct(), "vec_id", "left_semi"))
        now = pruned(in_order(pool, unit), slots, alpha, fill=False)
        chosen = kept(now if chosen is None else now.unionByName(chosen.join(some.select("vec_id").distinct(), "vec_id", "left_anti")), "chosen")
        open_ = chosen.groupBy("vec_id").agg(F.count("*").alias("n")).where(F.col("n") < slots).select("vec_id")
        left = kept(left.join(some.select("vec_id", "neighbour"), ["vec_id", "neighbour"], "left_anti").join(open_, "vec_id", "left_semi"), "overflow")
    if chosen is None:
        return same
    # Slots that the rule leaves empty go to the nearest that it left out: these are among the first.
    short = chosen.groupBy("vec_id").agg(F.count("*").alias("has"))
    rest = first.join(chosen.select("vec_id", "neighbour"), ["vec_id", "neighbour"], "left_anti").join(short, "vec_id").withColumn("place", place).where(F.col("place") <= slots - F.col("has"))
    return same.unionByName(chosen).unionByName(rest.select("vec_id", "neighbour", "similarity"))


def selected(rows: DataFrame, pool: int = POOL, slots: int = SLOTS, alpha: int = ALPHA, reverse: bool = True) -> DataFrame:
    """vec_id, neighbour, similarity: the graph that the pruned selection makes of the ``pool`` nearest of ``rows`` (vec_id, v)."""

    def choose(own: np.ndarray, sims: np.ndarray, ids: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        return _edges(own, sims > -9, np.maximum(sims, -1.0), ids, v, slots, alpha)

    edges = neighbours(rows, rows, pool, finish=choose, kind="vec_id long, neighbour long, similarity double", carry=True)
    return with_reverse(edges, kept(units(rows), "units"), slots, alpha) if reverse else edges


def _sql(pool: str, name: str) -> str:
    """The rule in SQL: over ``pool`` (vec_id, neighbour, similarity, place), the places that are kept, one after the other."""
    return f"""{name}_b AS (SELECT x.vec_id, x.place, list(y.place) AS blockers FROM {pool} x JOIN {pool} y ON y.vec_id = x.vec_id AND y.place < x.place JOIN m ON m.a = y.neighbour AND m.b = x.neighbour WHERE {ALPHA} * m.d <= 1000 * (1000000 - CAST(round(x.similarity * 1e6) AS BIGINT)) GROUP BY x.vec_id, x.place),
{name}_c AS (SELECT x.*, coalesce(blockers, []) AS blockers FROM {pool} x LEFT JOIN {name}_b b ON b.vec_id = x.vec_id AND b.place = x.place),
{name}_g AS (SELECT vec_id, 0 AS place, []::INTEGER[] AS keep FROM (SELECT DISTINCT vec_id FROM {pool})
  UNION ALL SELECT g.vec_id, c.place, CASE WHEN len(g.keep) < {SLOTS} AND NOT list_has_any(g.keep, c.blockers) THEN list_append(g.keep, c.place) ELSE g.keep END FROM {name}_g g JOIN {name}_c c ON c.vec_id = g.vec_id AND c.place = g.place + 1),
{name}_k AS (SELECT vec_id, arg_max(keep, place) AS keep FROM {name}_g GROUP BY vec_id),
{name} AS (SELECT x.vec_id, x.neighbour, x.similarity FROM {pool} x JOIN {name}_k k ON k.vec_id = x.vec_id QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY NOT list_contains(keep, x.place), x.place) <= {SLOTS})"""


_MATRIX = f"""n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM n a JOIN n b ON a.vec_id != b.vec_id),
m AS (SELECT vec_id AS a, neighbour AS b, 1000000 - CAST(round(similarity * 1e6) AS BIGINT) AS d FROM s),
near AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS INTEGER) AS place FROM s QUALIFY place <= {POOL})"""
_FORWARD = f"{_MATRIX}, {_sql('near', 'kept')}"
_BOTH = f"""{_FORWARD}, fresh AS (SELECT neighbour AS vec_id, vec_id AS neighbour, similarity FROM kept EXCEPT SELECT * FROM kept),
both_ways AS (SELECT * FROM kept UNION ALL SELECT * FROM fresh), over AS (SELECT vec_id FROM both_ways GROUP BY vec_id HAVING count(*) > {SLOTS} INTERSECT SELECT vec_id FROM fresh),
offered AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS INTEGER) AS place FROM both_ways WHERE vec_id IN (FROM over)), {_sql('offered', 'again')},
graph AS (SELECT * FROM both_ways WHERE vec_id NOT IN (FROM over) UNION ALL SELECT * FROM again)"""
#: The selected graph in SQL: a relation ``graph`` (vec_id, neighbour, similarity).
GRAPH_SQL = _BOTH


def _placed(edges: DataFrame) -> DataFrame:
    return edges.withColumn("place", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour")))


@query(f"WITH RECURSIVE {_FORWARD} SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS INTEGER) AS place FROM kept")
def pruned_edges(spark, sf_dir):
    """Edges that the diversifying rule keeps of each vector's nearest, empty slots filled."""
    return _placed(selected(vectors(spark, sf_dir).select("vec_id", "v"), reverse=False))


@query(f"WITH RECURSIVE {_BOTH} SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS INTEGER) AS place FROM graph")
def selected_edges(spark, sf_dir):
    """The same after reverse insertion."""
    return _placed(selected(vectors(spark, sf_dir).select("vec_id", "v")))
