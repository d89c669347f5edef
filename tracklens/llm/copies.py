"""Near copies of texts: word shingles, MinHash bands, and links verified by Jaccard similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import join_small, scratch, unused, written
from tracklens.llm.graph import components
from tracklens.llm.simhash import SEED, WORDS, fingerprint_links, fingerprints
from tracklens.llm.words import slices

SHINGLE, SIMILARITY = 5, 0.8
#: Taken off a bound on numbers of shingles before it is rounded up, as products of SIMILARITY are not exact.
SLACK = 1e-6
#: A pair of similarity 0.8 shares none of the bands with a chance of (1 - 0.8**4)**28 = 4e-7.
BANDS, ROWS = 28, 4
#: A round of comparisons with one text of each bucket is followed by another while it leaves less than
#: this share of the rows in buckets of several components.
WORTH = 0.7

_ODD = np.random.default_rng(20250301).integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The set of a text's word shingles as sorted 64-bit hashes; a text of fewer words is one
    shingle, and texts without words are equal."""
    words = WORDS.findall((text or "").encode("utf-8", "replace").lower())  # bytes.lower() is A-Z only
    width = max(1, min(width, len(words)))
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)) if words else ends
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    found = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans]
    return np.unique(np.array(found or [0], dtype=np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def bands(hashes: np.ndarray) -> list[int]:
    """BANDS signed 64-bit hashes of ROWS MinHashes each."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        mixed = hashes[None, at : at + 4096] * _ODD
        least = np.minimum(least, ((mixed ^ (mixed >> np.uint64(29))) * _ODD[::-1]).min(axis=1))
    found = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(found, dtype=np.uint64).view(np.int64).tolist()


def text_class(text: Column) -> Column:
    """The number under which equal texts are one (null is a text of its own)."""
    return F.xxhash64(text)


def _hashed(texts: DataFrame, numbers: Callable[[np.ndarray], list[int]]) -> DataFrame:
    """cls, hashes: what ``numbers`` makes of the shingles of each of ``texts`` (cls, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in slices(batch.column(1)):
                part = batch.slice(at, end - at)
                found = [np.array(numbers(shingles(t.as_py())), dtype=np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["cls", "hashes"])

    return texts.select("cls", "text").mapInArrow(run, "cls long, hashes array<long>")


def _rare_first(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """cls, component, n, at, shingle: the shingles at the first places (from 0) of each text when its n
    shingles are sorted from rare to common among ``texts`` (cls, text); ``parts`` (cls, component).

    Only places that a text as similar as SIMILARITY can share first are given: what two such texts have in
    common is more than what follows them. Shingles of one text only come first and are counted, not given.
    """
    sets = written(_hashed(texts, lambda x: x.view(np.int64)), "shingle-sets")
    each = sets.select("cls", F.explode("hashes").alias("shingle"))
    common = written(each.groupBy("shingle").agg(F.count("*").alias("texts")).where("texts > 1"), "common-shingles")
    held = each.join(common, "shingle").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("texts", "shingle"))).alias("held"))  # those of one text
    rows = held.join(sets.select("cls", F.size("hashes").alias("n")), "cls").join(parts, "cls").withColumn("alone", F.col("n") - F.size("held"))
    places = F.col("n") - F.ceil(F.col("n") * SIMILARITY - SLACK).cast("int") + 1 - F.col("alone")
    first = rows.where(places > 0).select("cls", "component", "n", "alone", F.posexplode(F.slice("held", 1, places)).alias("i", "x"))
    return first.select("cls", "component", "n", (F.col("alone") + F.col("i")).alias("at"), "x.shingle")


def _rest(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """a, b: all pairs of ``texts`` (cls, text) in different ``parts`` (cls, component) that may be similar enough.

    Prefix filtering by place: the first shingle that two similar texts share, in the order from rare to common,
    stands so early in both that enough shingles follow it. Texts that are alike but each have an edit of their own
    share no shingle that early, so a large group of such texts makes no pairs.
    """
    with scratch(texts.sparkSession):
        first = written(_rare_first(texts, parts), "rare-shingles", stays=True)
    needed = F.ceil((F.col("x.n") + F.col("y.n")) * (SIMILARITY / (1 + SIMILARITY)) - SLACK)
    shorter = first.where(F.col("n") - F.col("at") >= F.ceil(F.col("n") * (2 * SIMILARITY / (1 + SIMILARITY)) - SLACK))
    order = (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.cls") < F.col("x.cls")))
    enough = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= needed
    met = (F.col("x.shingle") == F.col("y.shingle")) & order & (F.col("x.component") != F.col("y.component")) & enough
    pairs = first.alias("x").join(shorter.alias("y"), met)
    return pairs.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of classes whose texts are similar enough, from their whole sets of shingles."""
    with scratch(texts.sparkSession):
        ends = written(pairs.select(F.col("a").alias("_c")).unionByName(pairs.select(F.col("b").alias("_c"))).distinct(), "compared-classes")
        some = written(join_small(texts, ends, F.col("cls") == F.col("_c"), "left_semi"), "compared-texts")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cut = lru_cache(maxsize=64)(shingles)
            for batch in batches:
                near = [similarity(cut(x.as_py()), cut(y.as_py())) >= SIMILARITY for x, y in zip(batch.column(2), batch.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

        both = pairs.join(some.select(F.col("cls").alias("a"), F.col("text").alias("x")), "a").join(some.select(F.col("cls").alias("b"), F.col("text").alias("y")), "b")
        return written(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "verified-links", stays=True)


def _fingerprint_links(texts: DataFrame) -> DataFrame:
    """a, b: near copies among ``texts`` (cls, text) that their SimHash fingerprints find, of five-word shingles: one
    text of each fingerprint with the others of it, and those of fingerprints that the multi-index search links."""
    with scratch(texts.sparkSession):
        found = written(fingerprints(texts.select(F.col("cls").alias("doc_id"), "text"), SHINGLE).withColumnRenamed("doc_id", "cls"), "copy-prints")
        firsts = written(found.groupBy("fp").agg(F.min("cls").alias("first")), "first-of-print")
        alike = found.join(firsts, "fp").where("cls != first").select(F.col("first").alias("a"), F.col("cls").alias("b"))
        linked = fingerprint_links(firsts.select("fp"))
        linked = linked.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
        pairs = alike.unionByName(linked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        pairs = written(pairs, "print-pairs", stays=True)
    return _verified(pairs, texts)


def near_copies(docs: DataFrame, by_fingerprint: bool = False) -> DataFrame:
    """cls, component for the classes of equal texts of ``docs`` (text) that are near copies of others:
    five-word shingles with a Jaccard similarity of at least 0.8, and what such links reach.

    Texts that share a band of MinHashes are candidates. Every text is compared with one of each
    bucket of a band, the same in most; what is linked then needs no more comparisons inside, so large
    groups of near copies make as many pairs as they have texts. Further rounds take other texts of the
    buckets that still hold several components. Of what such a round no longer settles, all pairs of
    different components are compared that share a shingle early enough (see _rest).

    ``by_fingerprint``: the multi-index search of SimHash fingerprints comes first (see _fingerprint_links). It
    joins most groups; what differs in too many bits for it, but not by too many shingles, is left to the bands.
    """
    with scratch(docs.sparkSession):
        texts = written(docs.select(text_class(F.col("text")).alias("cls"), "text").groupBy("cls").agg(F.min("text").alias("text")), "distinct-texts")
        sketches = written(_hashed(texts, bands), "bands")
        buckets = sketches.select("cls", F.explode("hashes").alias("bucket"))
        several = written(buckets.groupBy("bucket").agg(F.min("cls").alias("_a"), F.max("cls").alias("_b")).where("_a < _b").select("bucket"), "shared-buckets")
        mixed = written(buckets.join(several, "bucket").withColumn("component", F.col("cls")), "shared-bands")
        links, before, turn = None, None, 0
        if by_fingerprint:
            links = _fingerprint_links(texts)
            roots = written(components(links), "print-roots").withColumnRenamed("node", "cls").withColumnRenamed("component", "_root")
            mixed = written(mixed.join(roots, "cls", "left").withColumn("component", F.coalesce("_root", "component")).select("bucket", "cls", "component"), "rooted-bands")
        while True:
            with scratch(docs.sparkSession):
                leaders = mixed.groupBy("bucket").agg(F.min_by(F.struct("cls", "component"), F.xxhash64(F.lit(turn), "cls")).alias("leader"))
                stars = mixed.join(written(leaders, "band-leaders"), "bucket").where("component != leader.component")
                found = _verified(written(stars.select(F.least("leader.cls", "cls").alias("a"), F.greatest("leader.cls", "cls").alias("b")).distinct(), "star-pairs"), texts)
                links = written(found if links is None else links.unionByName(found), "links-so-far", stays=True)
                roots = written(components(links), "star-roots")
                rooted = mixed.drop("component").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
                rooted = written(rooted.select("bucket", "cls", "component"), "rooted-bands")
                several = rooted.groupBy("bucket").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a < _b").select("bucket")
                mixed = written(rooted.join(written(several, "mixed-buckets"), "bucket"), "mixed-bands", stays=True)
                left = mixed.count()
            if not left or (before is not None and left > WORTH * before):
                break
            before, turn = left, turn + 1
        parts = written(mixed.select("cls", "component").distinct(), "mixed-classes")
        open_texts = join_small(texts, parts.select(F.col("cls").alias("_c")), F.col("cls") == F.col("_c"), "left_semi")
        more = _verified(written(_rest(open_texts, parts), "rest-pairs"), texts)
        return written(components(links.unionByName(more)).select(F.col("node").alias("cls"), "component"), "near-copies", stays=True)


def without_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies (see near_copies): the one of least
    doc_id. Rows that repeat its doc_id stay; rows without a doc_id go where the group has a document
    with one, and stay where it has none. Texts without words are copies of each other."""
    with scratch(docs.sparkSession):
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_class(F.col("text")).alias("cls"))
        classes = rows.groupBy("cls").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
        rooted = written(classes.join(near_copies(docs, by_fingerprint=True), "cls", "left"), "copy-classes")
        least = rooted.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("_least"))
        groups = rooted.where("component IS NOT NULL").join(least, "component").select(F.col("cls").alias("_cls"), "_least")
        groups = written(groups.unionByName(rooted.where("component IS NULL AND n > 1").select(F.col("cls").alias("_cls"), F.col("first").alias("_least"))), "copy-groups", stays=True)
    own, cls, first = unused(docs, "own", "cls", "least")
    named = join_small(docs.withColumn(own, text_class(F.col("text"))), groups.select(F.col("_cls").alias(cls), F.col("_least").alias(first)), F.col(own) == F.col(cls), "left", limit=1_000_000)
    return named.where(F.col(first).isNull() | F.col("doc_id").eqNullSafe(F.col(first))).select(*docs.columns)
