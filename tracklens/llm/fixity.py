"""Operator 3: fixity audit of WARC replicas by Merkle trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import written

#: Bits of an offset that make one level of the tree: every node has up to 16 children.
LEVEL_BITS = 4
#: Lowest ranges of offsets hold 2**LEAF_BITS offsets.
LEAF_BITS = 4


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, record (bytes) for every row of ``pages`` (page_id, url, html): a WARC/1.1
    response record with its target, its length in bytes and the SHA-1 of its payload. Null url or
    html: empty."""
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce("url", F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Payload-Digest: sha1:"),
        F.sha1(html),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return pages.select("page_id", "url", F.concat(F.encode(head, "UTF-8"), html, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"))


def leaves(replica: DataFrame, at: str = "page_id", content: str = "record") -> DataFrame:
    """at (long), hash: one leaf for each place of a replica. The hash covers the place, the length
    and the bytes. Several records at one place are one leaf over their sorted hashes; null content is
    no bytes; rows without a place have no leaf (they are not addressable)."""
    bytes_ = F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary"))
    own = F.sha2(F.concat(F.encode(F.concat_ws(":", F.col(at).cast("string"), F.octet_length(bytes_).cast("string"), F.lit("")), "UTF-8"), bytes_), 256)
    one = replica.where(F.col(at).isNotNull()).select(F.col(at).cast("long").alias("at"), own.alias("own"))
    # Counts of each hash first: a record repeated very often is one row of its leaf.
    counted = one.groupBy("at", "own").agg(F.count("*").alias("n"))
    listed = F.array_join(F.sort_array(F.collect_list(F.concat_ws("x", "own", F.col("n").cast("string")))), ",")
    return counted.groupBy("at").agg(F.sha2(listed.cast("binary"), 256).alias("hash"), F.sum("n").alias("records"))


def _parent(children: DataFrame, level: int) -> DataFrame:
    """The nodes above ``children`` (node, hash, records): the hash covers the ordered children."""
    node = F.shiftright("node", LEVEL_BITS).alias("up")
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda c: F.concat_ws(":", c["node"].cast("string"), c["hash"])), ",")
    return children.groupBy(node).agg(F.sha2(ordered.cast("binary"), 256).alias("hash"), F.sum("records").alias("records")).withColumnRenamed("up", "node")


def tree(replica: DataFrame, depth: int, at: str = "page_id", content: str = "record") -> list[DataFrame]:
    """The levels of a replica's tree from the leaves (level 0) to the root (level ``depth``), each
    (node, hash, records) and written. A node of level k covers 16**k neighbouring places."""
    level = written(leaves(replica, at, content).withColumnRenamed("at", "node"), "merkle-leaves")
    out = [level]
    for k in range(1, depth + 1):
        level = written(_parent(level, k), f"merkle-{k}")
        out.append(level)
    return out


def depth_for(*replicas: DataFrame, at: str = "page_id") -> int:
    """Levels above the leaves that bring all places of all replicas under one root (two roots if
    places of both signs occur)."""
    reach = [r.agg(F.max(F.abs(F.col(at).cast("long")))).first()[0] or 0 for r in replicas]
    return max(1, -(-max(reach).bit_length() // LEVEL_BITS))


def differences(first: list[DataFrame], second: list[DataFrame]) -> DataFrame:
    """at, state (changed, missing, extra), visited: the leaves of the ``first`` replica's tree that
    the ``second`` has not, or has otherwise, and what it has besides.

    Roots are compared; below, only the children of nodes that differ are read (a left-semi join on
    the parent), so equal branches cost one comparison at their top. ``visited`` is the number of nodes
    compared on the way.
    """
    suspects, visited = None, 0
    for mine, theirs in zip(reversed(first), reversed(second), strict=True):
        if suspects is not None:
            above = suspects.select(F.col("node").alias("up"))
            under = F.shiftright("node", LEVEL_BITS) == F.col("up")
            mine, theirs = (x.join(above, under, "left_semi") for x in (mine, theirs))
        pair = mine.select("node", F.col("hash").alias("mine")).join(theirs.select("node", F.col("hash").alias("theirs")), "node", "full_outer")
        pair = written(pair, "merkle-compared")
        visited += pair.count()
        suspects = written(pair.where("NOT mine <=> theirs"), "merkle-suspects")
    state = F.when(F.col("theirs").isNull(), "missing").when(F.col("mine").isNull(), "extra").otherwise("changed")
    return suspects.select(F.col("node").alias("at"), state.alias("state"), F.lit(visited).cast("long").alias("visited"))


def audit(original: DataFrame, replicas: dict[str, DataFrame], at: str = "page_id", content: str = "record") -> DataFrame:
    """replica, at, state, root, replica_root, visited: what is corrupt in each replica, and one row
    with null ``at`` and state ``sound`` for a replica whose root agrees.

    ``at`` orders and addresses the records (an offset, or an id). Null places are no part of a tree;
    empty replicas have no root (null). Repeated records at a place are covered by their number.
    """
    depth = depth_for(original, *replicas.values(), at=at)
    own = tree(original, depth, at, content)
    root = F.array_join(F.sort_array(F.collect_list("hash")), ",")
    found = []
    for name, replica in replicas.items():
        theirs = tree(replica, depth, at, content)
        roots = own[-1].agg(root.alias("root")).crossJoin(theirs[-1].agg(root.alias("replica_root")))  # a row each
        bad = differences(own, theirs)
        rows = bad.select(F.lit(name).alias("replica"), "at", "state", "visited")
        sound = roots.where("root = replica_root").select(F.lit(name).alias("replica"), F.lit(None).cast("long").alias("at"), F.lit("sound").alias("state"), F.lit(own[-1].count()).cast("long").alias("visited"))
        found.append(rows.unionByName(sound).crossJoin(F.broadcast(roots)))
    return reduce(DataFrame.unionByName, found).select("replica", "at", "state", "root", "replica_root", "visited")


def damaged(rows: DataFrame, where: Column, content: str = "record") -> DataFrame:
    """A replica with one byte of the middle of ``content`` changed in the rows of ``where``: to test audits."""
    half = (F.octet_length(content) / 2).cast("int")
    broken = F.overlay(F.col(content), F.lit(b"\x00"), half + 1)
    return rows.withColumn(content, F.when(where, broken).otherwise(F.col(content)))


def page_audit(pages: DataFrame) -> DataFrame:
    """page_id, leaf, range (of 16 ids), range_hash, state for every page of ``pages``: its record's leaf,
    the node above it, and what an audit of a replica finds there.

    The replica is the table with a byte changed in records whose id leaves 7 modulo 97, without
    those that leave 11, and with the others as they are.
    """
    original = written(records(pages), "warc")
    place = F.col("page_id")
    replica = damaged(original, F.coalesce(place % 97 == 7, F.lit(False))).where(place.isNull() | (place % 97 != 11))
    depth = depth_for(original, replica)
    own, theirs = tree(original, depth), tree(replica, depth)
    bad = differences(own, theirs).select("at", "state")
    above = own[1].select(F.col("node").alias("range"), F.col("hash").alias("range_hash"))
    leaf = own[0].select(F.col("node").alias("page_id"), F.col("hash").alias("leaf"), F.shiftright("node", LEVEL_BITS).alias("range"))
    out = leaf.join(above, "range").join(bad.withColumnRenamed("at", "page_id"), "page_id", "left")
    return out.select("page_id", "leaf", "range", "range_hash", F.coalesce("state", F.lit("sound")).alias("state"))


#: The same rows in DuckDB, over a view ``pages`` with distinct ids.
ORACLE_SQL = r"""
WITH r AS (
  SELECT page_id,
    encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id::VARCHAR || '>' || chr(13) || chr(10) || 'WARC-Payload-Digest: sha1:' || sha1(encode(coalesce(html, '')))
    || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, '')))::VARCHAR
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS record
  FROM pages WHERE page_id IS NOT NULL
), l AS (
  SELECT page_id, sha256(encode(sha256(encode(page_id::VARCHAR || ':' || octet_length(record)::VARCHAR || ':') || record) || 'x1')) AS leaf FROM r
), n AS (
  SELECT page_id >> 4 AS range, sha256(encode(string_agg(page_id::VARCHAR || ':' || leaf, ',' ORDER BY page_id))) AS range_hash FROM l GROUP BY 1
)
SELECT page_id, leaf, range, range_hash,
  CASE page_id % 97 WHEN 7 THEN 'changed' WHEN 11 THEN 'missing' ELSE 'sound' END AS state
FROM l JOIN n ON n.range = l.page_id >> 4
"""
