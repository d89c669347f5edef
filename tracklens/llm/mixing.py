"""Operator 5: mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklens.llm.common import join_small, running_total, unused, word_count, written

#: Ranges of virtual time into which one unit of it (a source's whole target) is cut.
RANGES = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, repeats: float) -> DataFrame:
    """One row per source of ``sizes`` (source, size): source_size, weight, target.

    Sources in code point order, null last, take the weights in turn. Targets divide
    ``share * sum of all sizes`` by weight; a target above ``repeats`` times its source's size is cut
    to that, and the excess is shared again by weight among the others until none is above. That
    fixed point is the level L with sum(min(cap, L * weight)) = total, and L is the largest of the
    levels that follow from taking the k tightest sources as cut, for every k.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    capped = per_source.withColumn("weight", weight).withColumn("_cap", F.lit(float(repeats)) * F.col("source_size"))
    tightest = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    cut = F.coalesce(F.sum("_cap").over(tightest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("weight").over(tightest.rowsBetween(0, Window.unboundedFollowing))
    total = F.lit(float(share)) * F.sum("source_size").over(all_rows)
    levels = capped.withColumn("_level", (total - cut) / free)
    return levels.withColumn("target", F.least("_cap", F.max("_level").over(all_rows) * F.col("weight"))).select("source", "source_size", "weight", "target")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    repeats: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, source, text).

    Every source's documents are shuffled (by a hash of seed and doc_id) and queued ``repeats``
    times; each queued document gets its virtual finish time, the source's words up to and with it
    divided by the source's target. All sources are then sorted together by that time and cut where
    the words reach the total budget, ``share`` times all words. ``taken`` counts the words of the
    document's queued copies that are in.

    Null text: size 0. Null source: a source of its own, last in order. Null doc_ids and repeated
    rows are documents like any other. Sources or tables without words: target 0, nothing taken.
    Other columns of ``docs`` are ignored.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = written(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("_order"), F.xxhash64("text").alias("_tie")).withColumn("_bucket", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int")),
        "mix-sizes",
    )
    targets = written(source_targets(sizes, weights, share, repeats), "mix-targets")
    same = F.col("source").eqNullSafe(F.col("_source"))
    known = join_small(sizes, targets.withColumnRenamed("source", "_source"), same).drop("_source")
    placed = running_total(known, ["source"], "_bucket", ["_order", "_tie"], F.col("size"), "_upto")

    rounds = placed.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    finish = F.when(F.col("target") > 0, (F.col("_round") * F.col("source_size") + F.col("_upto")).cast("double") / F.col("target"))
    queued = rounds.withColumn("_finish", finish).where("_finish IS NOT NULL AND size > 0")
    queued = written(queued.withColumn("_range", F.least(F.floor(F.col("_finish") * RANGES), F.lit(2 * RANGES)).cast("int")), "mix-queue")

    # One row per range, at most 2 * RANGES + 1: whole ranges are in or out, but for the one in which the budget ends.
    upto = F.sum("_words").over(Window.orderBy("_range"))
    ranges = written(queued.groupBy("_range").agg(F.sum("size").alias("_words")).withColumn("_through", upto), "mix-ranges")
    budget = F.lit(float(share) * (targets.agg(F.sum("source_size")).first()[0] or 0))
    last = F.min(F.when(F.col("_through") > budget, F.col("_range"))).over(Window.partitionBy())
    ranges = ranges.select(F.col("_range").alias("_r"), (F.col("_through") - F.col("_words")).alias("_ahead"), F.coalesce(last, F.lit(2 * RANGES + 1)).alias("_last"))
    ranged = queued.join(F.broadcast(ranges), F.col("_range") == F.col("_r")).drop("_r")
    whole = ranged.where(F.col("_range") < F.col("_last"))
    in_last = Window.partitionBy("_range").orderBy("_finish", F.col("source").asc_nulls_last(), "_round", "_order", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    cut = ranged.where(F.col("_range") == F.col("_last")).withColumn("_sum", F.col("_ahead") + F.sum("size").over(in_last)).where(F.col("_sum") <= budget).drop("_sum")

    columns = ["doc_id", "source", "size", "source_size", "target"]
    named = [*columns, "_order", "_tie"]
    zero = known.select(*named, F.lit(0).alias("_in"), F.lit(1).alias("_rows"))
    taken = whole.unionByName(cut).select(*named, F.lit(1).alias("_in"), F.lit(0).alias("_rows"))
    # Rows that agree in all of these are interchangeable: what the mix takes of them is dealt out evenly.
    each = zero.unionByName(taken).groupBy(*named).agg(F.sum("_in").alias("_in"), F.sum("_rows").cast("int").alias("_rows"))
    dealt = each.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)))
    copies = F.floor((F.col("_in") + F.col("_rows") - 1 - F.col("_k")) / F.col("_rows"))
    return dealt.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with all columns.

    Where rows share doc_id and size and the mix takes some of them more often than others, they are numbered, and
    the first of them are the ones that it takes more often. Null doc_ids are ids like any other here; rows
    without words are never taken; an empty table gives none."""
    own, size, entries, copies, row, place, number, copy = unused(docs, "id", "size", "entries", "copies", "row", "range", "number", "copy")
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    each = mix(docs, weights, share, repeats, seed).groupBy(F.col("doc_id").alias(own), F.col("size").alias(size), times.alias("times")).agg(F.count("*").alias("rows"))
    groups = each.groupBy(own, size).agg(F.array_sort(F.collect_list(F.struct((-F.col("times")).alias("order"), "rows"))).alias(entries))  # repeats + 1 at most
    groups = written(groups.where(F.exists(entries, lambda x: x["order"] < 0)), "mix-taken")
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (word_count(F.col("text")) == F.col(size))
    alike = join_small(docs, groups.where(F.size(entries) == 1), same, limit=1_000_000).withColumn(copies, -F.col(entries)[0]["order"])
    some = join_small(docs, groups.where(F.size(entries) > 1), same, limit=1_000_000).withColumn(row, F.monotonically_increasing_id())
    some = written(some.withColumn(place, F.pmod(F.xxhash64(row), F.lit(1024)).cast("int")), "mix-repeated")
    some = running_total(some, [own, size], place, [row], F.lit(1), number)
    # The first entry whose rows, with those of the entries before it, reach the row's number.
    reach = F.transform(entries, lambda x, i: F.struct(x["order"].alias("order"), F.aggregate(F.slice(entries, 1, i + 1), F.lit(0).cast("long"), lambda s, y: s + y["rows"]).alias("upto")))
    some = some.withColumn(copies, -F.filter(reach, lambda x: x["upto"] >= F.col(number))[0]["order"])
    chosen = alike.select(*docs.columns, copies).unionByName(some.select(*docs.columns, copies)).where(F.col(copies) > 0)
    return chosen.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


#: The same rows in DuckDB, over a view ``documents``.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         2.0::DOUBLE * source_size AS cap
  FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM l
), q AS (
  SELECT d.doc_id, d.source, d.size, d.k, e.round, t.target,
         (e.round * t.source_size + sum(d.size) OVER (PARTITION BY e.round, d.source ORDER BY d.k ROWS UNBOUNDED PRECEDING))::DOUBLE / t.target AS finish
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) e(round)
), c AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source ASC NULLS LAST, round, k ROWS UNBOUNDED PRECEDING) AS upto
  FROM q WHERE target > 0 AND size > 0
), x AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM c
  WHERE upto <= 1.5::DOUBLE * (SELECT sum(size) FROM d) GROUP BY doc_id
)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(x.taken, 0)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN x ON x.doc_id = d.doc_id
"""
