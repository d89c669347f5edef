"""Operator 4: removal of repeated word windows by repeated-phrase automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import scratch, unused, written
from tracklens.llm.words import STEP, Words, mixed, slices, sliding, sums, words

#: Words of an anchor phrase.
ANCHOR = 8
#: Windows of a passage that travel as one piece (with the words that they cover).
PIECE = 128
#: Bytes of texts whose recurring passages are looked up with one automaton.
SHARD_BYTES = 2 << 20


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values.view(np.int64)))


def _phrases(found: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts one after the other: a hash of each phrase of ANCHOR words, the least phrase of each
    window, and which windows lie within one text."""
    phrases = sums(found.hashes(0), STEP[0], ANCHOR)
    least = sliding(phrases, window - ANCHOR + 1, np.minimum)
    text = found.text_of
    return phrases, least, text[: len(least)] == text[window - 1 :]


def _texts(docs: DataFrame, window: int) -> DataFrame:
    """k1, k2 (what stands for a text), doc_id, n_words, whole (digest of all words), anchors (each
    twice if several windows of the text choose it at different places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in slices(batch.column(3)):
                part = batch.slice(at, end - at)
                found = words(part.column(3))
                phrases, least, sound = _phrases(found, window)
                least = np.where(sound, least, 0)
                pad = np.zeros(window - ANCHOR, dtype=np.uint64)
                # A phrase is chosen if it is the least of a window around it.
                most = sliding(np.concatenate((pad, least, pad)), window - ANCHOR + 1, np.maximum)
                places = np.flatnonzero((phrases == most[: len(phrases)]) & (phrases != 0)) if len(least) else np.zeros(0, dtype=np.int64)
                text, anchor = found.text_of[places], phrases[places]
                order = np.lexsort((anchor, text))
                text, anchor = text[order], anchor[order]
                # Of places with the same phrase, two say as much as more.
                third = np.zeros(len(text), dtype=bool)
                third[2:] = (text[2:] == text[:-2]) & (anchor[2:] == anchor[:-2])
                text, anchor = text[~third], anchor[~third]
                counts = np.diff(found.first)
                digests = [hashlib.sha256(found.span(a, b)).hexdigest() for a, b in zip(found.first, found.first[1:], strict=False)]
                columns = [part.column(0), part.column(1), part.column(2), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), _lists(anchor, np.bincount(text, minlength=len(counts)))]
                yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "doc_id", "n_words", "whole", "anchors"])

    keyed = docs.select(*_keys(), F.col("doc_id").cast("long"), "text")
    return keyed.mapInArrow(run, "k1 long, k2 long, doc_id long, n_words long, whole string, anchors array<long>")


def _of_text(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Values that are equal only within the same text."""
    return values ^ mixed(text.astype(np.uint64) + np.uint64(1))


def _listed(column: pa.Array) -> np.ndarray:
    """All values of a column of lists of longs, each bound to its row."""
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    return _of_text(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), row)


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """h1, h2, n, owner: the windows of ``texts`` whose anchor recurs. A text that stands for
    several rows counts its windows so often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in slices(batch.column(2)):
                part = batch.slice(at, end - at)
                found = words(part.column(2))
                _, least, sound = _phrases(found, window)
                text = found.text_of[: len(least)]
                near = np.flatnonzero(sound & np.isin(_of_text(least, text), _listed(part.column(3))))
                h1, h2 = (sums(found.hashes(lane), STEP[lane], window)[near] for lane in (0, 1))
                owner, n = (part.column(c).to_numpy()[text[near]] for c in (0, 1))
                order = np.lexsort((owner, h2, h1))
                h1, h2, n, owner = h1[order], h2[order], n[order], owner[order]
                if len(h1):
                    edge = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
                    n, h1, h2, owner = np.add.reduceat(n, edge), h1[edge], h2[edge], owner[edge]
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(owner.astype(np.int64))], names=["h1", "h2", "n", "owner"])

    return texts.select("k1", "copies", "text", "anchors").mapInArrow(run, "h1 long, h2 long, n long, owner long")


def _pieces(owners: DataFrame, window: int) -> DataFrame:
    """piece (words joined by a space), anchors: the recurring passages of ``owners`` (text, windows:
    h1 of those that the text owns), each cut into pieces that share all but one word of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in slices(batch.column(0)):
                part = batch.slice(at, end - at)
                found = words(part.column(0))
                _, least, sound = _phrases(found, window)
                text = found.text_of[: len(least)]
                own = np.flatnonzero(sound & np.isin(_of_text(sums(found.hashes(0), STEP[0], window), text), _listed(part.column(1))))
                passages, anchors, counts = [], [np.zeros(0, dtype=np.uint64)], []
                for run_ in np.split(own, np.flatnonzero((np.diff(own) > 1) | (np.diff(text[own]) > 0)) + 1):
                    for a in range(0, len(run_), PIECE):
                        starts = run_[a : a + PIECE]
                        passages.append(found.span(int(starts[0]), int(starts[-1]) + window).decode("utf-8"))
                        anchors.append(np.unique(least[starts]))
                        counts.append(len(anchors[-1]))
                yield pa.RecordBatch.from_arrays([pa.array(passages, pa.string()), _lists(np.concatenate(anchors), np.array(counts, dtype=np.int64))], names=["piece", "anchors"])

    return owners.select("text", "windows").mapInArrow(run, "piece string, anchors array<long>")


class Passages:
    """An Aho-Corasick automaton of recurring passages.

    Of each passage the automaton has phrases of ANCHOR words, so many that every window holds one
    whole; it reads a word as one character (20 bits of its hash). The windows around each hit are
    looked up among those of the passages, and stretches of them are compared byte by byte with the
    passage, so that what is removed rests on equal words.
    """

    def __init__(self, pieces: pa.Array, window: int):
        self.window = window
        self.words = words(pieces)
        hashes = self.words.hashes(0)
        first, codes = self.words.first, characters(hashes)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
            for at in range(a, b - ANCHOR + 1, window - ANCHOR + 1):
                self.automaton.add_word(codes[at : at + ANCHOR], True)
        if len(self.automaton):
            self.automaton.make_automaton()
        windows, text = sums(hashes, STEP[0], window), self.words.text_of
        sound = np.flatnonzero(text[: len(windows)] == text[window - 1 :]) if len(windows) else np.zeros(0, dtype=np.int64)
        self.windows, at = np.unique(windows[sound], return_index=True)
        self.places = sound[at]

    def covered(self, texts: Words) -> np.ndarray:
        """Which words of ``texts`` lie in a window that a passage has too."""
        edges = np.zeros(len(texts.starts) + 1, dtype=np.int64)
        if len(self.windows) and len(texts.starts) >= self.window:
            for start, place, count in self._matches(texts):
                if texts.span(start, start + count + self.window - 1) == self.words.span(place, place + count + self.window - 1):
                    edges[start] += 1
                    edges[start + count + self.window - 1] -= 1
                    continue
                for k in range(count):  # hashes agree and words don't
                    if texts.span(start + k, start + k + self.window) == self.words.span(place + k, place + k + self.window):
                        edges[start + k] += 1
                        edges[start + k + self.window] -= 1
        return np.cumsum(edges[:-1]) > 0

    def _matches(self, texts: Words) -> Iterator[tuple[int, int, int]]:
        """Stretches of windows around hits: the first in the texts, the first in the passages, how many."""
        hashes = texts.hashes(0)
        codes, near = characters(hashes), np.zeros(len(hashes) + 1, dtype=np.int64)
        for a, b in zip(texts.first.tolist(), texts.first[1:].tolist(), strict=False):
            if b - a >= self.window:
                last = np.fromiter((end for end, _ in self.automaton.iter(codes[a:b])), dtype=np.int64) + a
                np.add.at(near, np.maximum(last - self.window + 1, a), 1)
                np.add.at(near, last - ANCHOR + 2, -1)
        windows, text = sums(hashes, STEP[0], self.window), texts.text_of
        some = np.flatnonzero((np.cumsum(near)[: len(windows)] > 0) & (text[: len(windows)] == text[self.window - 1 :]))
        at = np.minimum(np.searchsorted(self.windows, windows[some]), len(self.windows) - 1)
        same = self.windows[at] == windows[some]
        starts, places = some[same], self.places[at[same]]
        if len(starts):
            edge = np.flatnonzero(np.concatenate(([True], (np.diff(starts) != 1) | (np.diff(places) != 1))))
            yield from zip(starts[edge].tolist(), places[edge].tolist(), np.diff(np.append(edge, len(starts))).tolist(), strict=True)


def characters(hashes: np.ndarray) -> str:
    """A character outside the basic plane for each word's hash."""
    return (np.uint32(0x10000) + (hashes >> np.uint64(44)).astype("<u4")).tobytes().decode("utf-32-le")


def _keys() -> list[Column]:
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("tracklens"), "text").alias("k2")]


def _located(docs: DataFrame, window: int, keep: bool) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with keys and digests, and what each text with repeats loses: k1, k2,
    n_removed, sha and, if it is to be kept, what is left (the rows can't be read then)."""
    if window < 2 * ANCHOR:
        raise ValueError(f"a window has at least {2 * ANCHOR} words")
    with scratch(docs.sparkSession):
        rows = written(_texts(docs, window), "texts", stays=not keep)
        one = [F.count("*").alias("copies"), F.first("anchors").alias("anchors")]
        choices = written(rows.where("size(anchors) > 0").groupBy("k1", "k2").agg(*one), "text-anchors")
        weighed = choices.select("copies", F.explode("anchors").alias("anchor"))
        recurring = written(weighed.groupBy("anchor").agg(F.sum("copies").alias("times")).where("times > 1").select("anchor"), "recurring-anchors")
        chosen = choices.select("k1", "k2", "copies", F.explode(F.array_distinct("anchors")).alias("anchor"))
        mine = chosen.join(recurring, "anchor").groupBy("k1", "k2").agg(F.first("copies").alias("copies"), F.collect_list("anchor").alias("anchors"))
        once = docs.select(*_keys(), "text").groupBy("k1", "k2").agg(F.first("text").alias("text"))
        texts = written(once.join(mine, ["k1", "k2"]), "repeating-texts")

        counted = _windows(texts, window).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("owner").alias("owner"))
        owned = counted.where("n > 1").groupBy("owner").agg(F.collect_list("h1").alias("windows"))
        owners = texts.select("k1", "text").join(owned, F.col("k1") == F.col("owner"))
        pieces = _pieces(owners, window).withColumn("id", F.xxhash64("piece")).dropDuplicates(["id", "piece"])
        pieces = written(pieces, "recurring-passages")

        shards = max(8, (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES)
        shard = F.pmod("k1", F.lit(shards)).cast("int").alias("shard")
        wanted = texts.select(shard, F.explode("anchors").alias("anchor")).distinct()
        sent = pieces.select("id", F.explode("anchors").alias("anchor")).join(wanted, "anchor").select("shard", "id").distinct()
        patterns = sent.join(pieces.select("id", "piece"), "id").select("shard", "piece")

        def locate(own: pa.Table, passages: pa.Table) -> pa.Table:
            compiled, out = Passages(pa.concat_arrays(passages["piece"].chunks) if len(passages) else pa.array([], pa.string()), window), []
            for chunk in own.to_batches():
                for at, end in slices(chunk.column("text")):
                    part = chunk.slice(at, end - at)
                    found = words(part.column("text"))
                    gone = compiled.covered(found)
                    for k1, k2, a, b in zip(part.column("k1").to_pylist(), part.column("k2").to_pylist(), found.first.tolist(), found.first[1:].tolist(), strict=False):
                        if removed := int(gone[a:b].sum()):
                            change = np.flatnonzero(np.diff(np.concatenate(([True], gone[a:b], [True])))) + a
                            left = b" ".join(found.span(x, y) for x, y in zip(change[::2].tolist(), change[1::2].tolist(), strict=True))
                            out.append((k1, k2, removed, hashlib.sha256(left).hexdigest(), left.decode("utf-8") if keep else None))
            columns = zip(*out, strict=True) if out else [[]] * 5
            return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["k1", "k2", "n_removed", "sha", "left"])

        found = texts.select(shard, "k1", "k2", "text").groupBy("shard").cogroup(patterns.groupBy("shard"))
        return rows, written(found.applyInArrow(locate, "k1 long, k2 long, n_removed long, sha string, left string"), "located", stays=True)


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs`` (doc_id, text).

    Removed are the words covered by a window of ``window`` words that also starts somewhere else,
    in the same text or another; kept_sha256 digests the other words, joined by one space.

    1. Every window of words chooses its least phrase of eight words as anchor. Anchors are counted;
       a window can recur only if its anchor does.
    2. Windows with a recurring anchor are counted by a 128-bit hash; those that start twice are
       confirmed. One text with a confirmed window owns it, and consecutive windows of an owner make
       a passage.
    3. Passages go, in pieces, to the shards of texts that have one of their anchors. Each shard
       (about SHARD_BYTES of texts) compiles them into an Aho-Corasick automaton and streams its texts
       through it; the windows around hits are compared with the passages byte by byte, so that what
       is removed rests on equal words and not on hashes.

    Equal texts are worked on once. Null, empty and shorter texts: nothing removed. Null and repeated
    doc_ids keep their rows; a repeated row is a copy like any other. An empty table gives none.
    Other columns of ``docs`` are ignored.
    """
    rows, found = _located(docs, window, keep=False)
    return rows.join(found, ["k1", "k2"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "whole").alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """``docs`` with all its rows and columns, and texts without their repeated windows (see
    remove_repeats): what is left is joined by one space. Texts that lose nothing stay as they are, null and
    empty ones too; rows that repeat keep their number; an empty table gives none."""
    _, found = _located(docs, window, keep=True)
    own1, own2, left = unused(docs, "k1", "k2", "left")
    found = found.select(F.col("k1").alias(own1), F.col("k2").alias(own2), F.col("left").alias(left))
    k1, k2 = _keys()
    joined = docs.join(found, (k1 == F.col(own1)) & (k2 == F.col(own2)), "left")
    return joined.select(*[F.coalesce(left, "text").alias("text") if c == "text" else F.col(c) for c in docs.columns])
