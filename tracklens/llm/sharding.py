"""Operator 6: sharding by vector bin packing of bytes, tokens and rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import running_total, text_key, word_count, written

#: A group of equal texts is cut into parts of at most one such share of all bytes, tokens or rows.
PARTS = 64
#: What is over one such share of any of the three is placed first, all of it in one task (at most 3 * HEAVY items).
HEAVY = 4096
#: Lighter items are placed in portions of about so many, each by a task of its own.
PORTION = 4096
#: Ranges in which the rows of a shard, or of a large group, are numbered.
SLOT_RANGES = 1024
DIMENSIONS = ("bytes", "tokens", "rows")


def place(items: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """A bin for each item: largest first, to the bin whose residual capacity has the highest dot
    product with the item. Both in shares of a bin's capacity; ties go to the first bin."""
    residual, bins = capacity.copy(), np.zeros(len(items), dtype=np.int32)
    for i in np.argsort(-items.max(axis=1), kind="stable"):
        bins[i] = best = int(np.argmax(residual @ items[i]))
        residual[best] -= items[i]
    return bins


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens for every row of ``docs``.

    Law ``bytes``: sizes (UTF-8 bytes of the text, plus 1) are nearly equal over the shards, and
    so, jointly, are tokens (words) and rows. Rows with equal texts form a group that stays
    together, unless it has more than 1/64 of all bytes, tokens or rows: then it is dealt, by a hash
    of doc_id, into parts of about that share, and the parts are placed. ``slot`` numbers the rows of
    a shard from 0 without gaps.

    Null text: size 1, no tokens, CRC 0; null texts are equal to each other and to no other text.
    Null doc_ids and repeated rows are rows like any other, spread as such. Other columns of ``docs`` are ignored.
    """
    text = F.col("text")
    sizes = docs.select(
        "doc_id",
        *text_key(text),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("bytes"),
        word_count(text).alias("tokens"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    # A row's number holds once it is written; rows that are equal in everything else are spread by it.
    sizes = written(sizes.withColumn("_range", F.pmod(F.xxhash64("row"), F.lit(SLOT_RANGES)).cast("int")), "shard-sizes")
    totals = sizes.agg(F.sum("bytes"), F.sum("tokens"), F.count("*")).first()
    total = [max(1, x or 0) for x in totals]

    summed = [F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    share = F.greatest(*[F.col(c) / F.lit(float(t)) for c, t in zip(DIMENSIONS, total, strict=True)])
    # At most 3 * PARTS groups exceed the share, whatever the input.
    large = sizes.groupBy("key1", "key2").agg(*summed).where((share > 1 / PARTS) & (F.col("rows") > 1))
    large = large.select(F.col("key1").alias("_k1"), F.col("key2").alias("_k2"), F.ceil(share * PARTS).cast("int").alias("_parts"))
    here = (F.col("key1") == F.col("_k1")) & (F.col("key2") == F.col("_k2"))
    large = written(large, "shard-large")
    hot = written(sizes.join(F.broadcast(large), here).drop("_k1", "_k2"), "shard-hot")
    hot = running_total(hot, ["key1", "key2"], "_range", ["row"], F.lit(1), "_number")
    hot = hot.withColumn("part", F.pmod("_number", F.col("_parts")).cast("int")).drop("_number", "_parts")
    rest = sizes.join(F.broadcast(large.drop("_parts")), here, "left_anti").withColumn("part", F.lit(0))
    rows = written(rest.unionByName(hot), "shard-dealt")

    items = written(rows.groupBy("key1", "key2", "part").agg(*summed).withColumn("_share", share), "shard-items")
    portions = max(1, items.where(F.col("_share") <= 1 / HEAVY).count() // PORTION)
    schema = "key1 long, key2 long, part int, shard int, bytes long, tokens long, rows long"

    def heavy(group: pd.DataFrame) -> pd.DataFrame:
        return placed(group, np.asarray(total, dtype=float)[None, :].repeat(shards, 0) / shards, 0)

    def placed(group: pd.DataFrame, capacity: np.ndarray, turn: int) -> pd.DataFrame:
        group = group.sort_values(["key1", "key2", "part"], kind="stable")
        unit = np.maximum(capacity.mean(axis=0), 1)
        order = np.roll(np.arange(shards), turn)  # so that ties don't favour the same shard in every portion
        chosen = order[place(group[list(DIMENSIONS)].to_numpy(dtype=float) / unit, (capacity / unit)[order])]
        return group.assign(shard=chosen)[["key1", "key2", "part", "shard", *DIMENSIONS]]

    first = items.where(F.col("_share") > 1 / HEAVY).groupBy(F.lit(0).alias("_all")).applyInPandas(heavy, schema)
    first = written(first, "shard-heavy")
    used = np.zeros((shards, 3))
    for r in first.groupBy("shard").agg(*[F.sum(c).alias(c) for c in DIMENSIONS]).collect():  # a row per shard
        used[r["shard"]] = [r[c] for c in DIMENSIONS]
    left = np.maximum(np.asarray(total, dtype=float) / shards - used, 0)

    def light(key: tuple[int], group: pd.DataFrame) -> pd.DataFrame:
        mine = group[list(DIMENSIONS)].sum().to_numpy(dtype=float)
        return placed(group, left * (mine / np.maximum(left.sum(axis=0), 1)), key[0] % shards)

    portion = F.pmod(F.xxhash64("key1", "key2", "part"), F.lit(portions)).cast("int")
    then = items.where(F.col("_share") <= 1 / HEAVY).groupBy(portion.alias("_portion")).applyInPandas(light, schema)
    where = first.unionByName(then).select(F.col("key1").alias("_k1"), F.col("key2").alias("_k2"), F.col("part").alias("_p"), "shard")
    same = (F.col("key1") == F.col("_k1")) & (F.col("key2") == F.col("_k2")) & (F.col("part") == F.col("_p"))
    dealt = written(rows.join(where, same).select("doc_id", "row", "bytes", "tokens", "text_crc32", "shard", "_range"), "shard-rows")
    slots = running_total(dealt, ["shard"], "_range", ["row"], F.lit(1), "_slot")
    return slots.select(
        "doc_id",
        F.col("bytes").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_slot") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )
