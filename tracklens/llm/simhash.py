"""Operator 2: SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import join_small, written
from tracklens.llm.graph import components

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; no words: 0."""
    words = WORDS.findall((text or "").encode("utf-8", "replace").lower())  # bytes.lower() is A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the pieces of 64 bits of which one differs in at most one bit when two
    fingerprints differ in at most ``distance``."""
    count = max(2, distance // 2 + 1)
    edges = np.linspace(0, 64, count + 1).round().astype(int).tolist()
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _segment(fp: Column, first: int, width: int) -> Column:
    moved = F.shiftrightunsigned(fp, first)
    return moved if width == 64 else moved.bitwiseAND(F.lit((1 << width) - 1))


def fingerprint_links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """a, b for all pairs of different ``fp`` that differ in at most ``distance`` bits, each once.

    Multi-index hashing with balls of radius one. Every fingerprint is filed in one table per
    segment under the segment's value, and asks each table for that value and for those with one
    more bit set; as one of two values that differ in one bit lacks it, each pair is met. The
    whole fingerprints are then compared inside the join, in the first segment that can meet the
    pair only, so no pair is found twice and pairs beyond the distance are never made into rows.
    """
    cut = segments(distance)
    fp = F.col("fp")
    filed = [F.struct(F.lit(i).alias("seg"), _segment(fp, a, w).alias("value")) for i, (a, w) in enumerate(cut)]
    asked = []
    for i, (a, w) in enumerate(cut):
        own, seg = _segment(fp, a, w), F.lit(i).alias("seg")
        asked.append(F.struct(seg, own.alias("value"), F.lit(False).alias("flip")))
        for k in range(w):
            more = F.struct(seg, own.bitwiseOR(F.lit(1 << k)).alias("value"), F.lit(True).alias("flip"))
            asked.append(F.when(own.bitwiseAND(F.lit(1 << k)) == 0, more))
    table = fps.select(fp.alias("b"), F.explode(F.array(*filed)).alias("x")).select("b", "x.seg", "x.value")
    probes = fps.select(fp.alias("a"), F.explode(F.array_compact(F.array(*asked))).alias("x")).select("a", "x.seg", "x.value", "x.flip")
    other = F.col("a").bitwiseXOR(F.col("b"))
    earlier = F.lit(False)
    for i, (a, w) in enumerate(cut[:-1]):
        earlier = earlier | ((F.col("t.seg") > i) & (F.bit_count(_segment(other, a, w)) < 2))
    met = (F.col("p.seg") == F.col("t.seg")) & (F.col("p.value") == F.col("t.value"))
    near = (F.bit_count(other) <= distance) & (F.col("flip") | (F.col("a") < F.col("b"))) & ~earlier
    return probes.alias("p").join(table.alias("t"), met & near).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs`` (doc_id, text).

    Fingerprints link at ``distance`` or fewer differing bits; component_id is the smallest doc_id
    that links reach. Documents of one fingerprint count as one in the search, so large groups of
    copies cost nothing there.

    Null and empty texts and texts without words have fingerprint 0 and link like any other.
    Documents with a null doc_id keep their row and take part in links; component_id is null only
    where no document of the component has a doc_id. Repeated rows stay. An empty table gives none.
    Other columns of ``docs`` are ignored.
    """
    found = written(fingerprints(docs, shingle), "fingerprints")
    fps = written(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(fingerprint_links(fps, distance)).select(F.col("node").alias("fp"), "component")
    rooted = written(fps.join(roots, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root")), "fingerprint-roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # Written first: where it is not small, the documents of a very common fingerprint can be split.
    named = written(rooted.join(least, "root").select("fp", "component_id"), "named-fingerprints")
    return join_small(found, named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` without the documents whose component (see near_duplicates) has a smaller doc_id.
    Rows without a doc_id go only where their component has a document with one; rows that repeat
    a kept doc_id are that document and stay."""
    named = near_duplicates(docs, shingle, distance).where("component_id IS NOT NULL AND NOT doc_id <=> component_id")
    gone = written(named.select(F.col("doc_id").alias("_gone")).distinct(), "near-duplicates")
    return join_small(docs, gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti", limit=1_000_000)
