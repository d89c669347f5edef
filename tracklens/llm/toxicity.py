"""Operator 10: toxicity of texts, scored after noisy-channel deobfuscation."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import join_small, written
from tracklens.llm.copies import near_copies, text_class

#: Letters of the language model: a-z, any other letter, and the edge of a word.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
OTHER, EDGE, SYMBOLS = 26, 27, 28
#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "#": "h"}
#: Log probabilities of the channel: a letter written as a sign, a sign or separator put in, a letter
#: repeated (as one of three or more, or of two), an edge between words that are spaced out.
AS_SIGN, PUT_IN, SEPARATOR, REPEATED, DOUBLED, NEW_WORD = -1.0, -9.0, -0.3, -0.5, -4.0, -3.0
#: The same of a sign at either end of a token that is punctuation there: exclamation marks, other signs.
EXCLAIMED, AT_END = -0.3, -5.0
END_SIGNS = "".join(c for c in LEET if not c.isdigit())
#: Punctuation that stands for no letter, taken off before decoding; # leads a tag and ends nothing.
OUTSIDE = ".,;:?\"')[]{}<>%&*=/\\~^`-_"

SPACED = re.compile(r"(?<!\S)[\w@$!|+]([ ._*-])[\w@$!|+](?:\1[\w@$!|+])+(?!\S)")
TWICE = re.compile(r"([^\W\d_])\1", re.IGNORECASE)
CLOSED = re.compile(r"(?<!\S)\(([^()]*)\)")
WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows from which words are learnt, at most about so many (drawn by a hash of doc_id).
FIT_ROWS = 40_000
#: Letters of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6)


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    letter = (points >= 97) & (points <= 122)
    return np.where(letter, points - 97, np.where(points > 191, OTHER, EDGE)).astype(np.int64)


def letter_counts(docs: DataFrame) -> np.ndarray:
    """How often each three symbols follow each other in all texts: 28 x 28 x 28 numbers, summed
    within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                x = _codes("  " + "  ".join(t for t in batch.column(0).slice(at, 200).to_pylist() if t) + "  ")
                total += np.bincount((x[:-2] * SYMBOLS + x[1:-1]) * SYMBOLS + x[2:], minlength=SYMBOLS**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    out = np.zeros(SYMBOLS**3)
    for gram, n in docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():  # at most 28**3 rows
        out[gram] = n
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


class Decoder:
    """Viterbi decoding of obfuscated words under a letter trigram model."""

    def __init__(self, counts: np.ndarray, known: frozenset[str] = frozenset()):
        self.known = known
        smooth = counts + 0.05 * (counts.sum(axis=0, keepdims=True) + 1) / (counts.sum(axis=(0, 1)).sum() + SYMBOLS)
        smooth = smooth + 1e-3
        self.model = np.log(smooth / smooth.sum(axis=2, keepdims=True)).tolist()
        self.word = lru_cache(maxsize=100_000)(self.decode)

    def decode(self, span: str) -> str:
        """The likeliest letters behind ``span``: signs become letters, separators and repetitions go.

        A state is the last two symbols; each character of the span adds a column to the lattice. Signs
        at the ends may be letters or punctuation; in a span of signs only, all but ! are letters.
        """
        text, model = span.lower(), self.model
        states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(EDGE, EDGE, ""): (0.0, None)}
        run, head, tail = 0, len(text) - len(text.lstrip(END_SIGNS)), len(text.rstrip(END_SIGNS))
        outside = PUT_IN if head > tail else AT_END
        for i, char in enumerate(text):
            run = run + 1 if i and text[i - 1] == char else 1
            thrice = run >= 3 or text[i + 1 : i + 3] == char * 2 or text[i - 1 : i] == char == text[i + 1 : i + 2]
            number = ord(char) - 97
            if 0 <= number < 26:
                options, drop = [(number, char, 0.0)], None
            elif char.isalpha():
                options, drop = [(OTHER, char, 0.0)], None
            elif char in LEET:
                options, drop = [(ord(c) - 97, c, AS_SIGN) for c in LEET[char]], PUT_IN
                if i < head or i >= tail:
                    drop = EXCLAIMED if char == "!" else outside
            else:
                options, drop = [(EDGE, " ", NEW_WORD)], SEPARATOR
            column: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}

            def put(state: tuple[int, int, str], cost: float, path: tuple | None, column=column) -> None:
                if state not in column or column[state][0] < cost:
                    column[state] = (cost, path)

            for (a, b, last), (cost, path) in states.items():
                for code, letter, channel in options:
                    if code == EDGE and b == EDGE:
                        continue
                    put((b, code, letter), cost + channel + model[a][b][code], (letter, path))
                    if letter == last and code != EDGE:
                        put((a, b, last), cost + channel + (REPEATED if thrice else DOUBLED), path)
                if drop is not None:
                    put((a, b, last), cost + drop, path)
            states = column
        best = max(((cost + (0.0 if b == EDGE else model[a][b][EDGE]), path) for (a, b, _), (cost, path) in states.items()), key=lambda x: x[0])
        out, path = [], best[1]
        while path:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))

    def restore(self, text: str) -> str:
        """``text`` with its obfuscated spans decoded: spaced-out letters, words with signs for
        letters or separators at any place, tokens of signs and digits only, and words with a letter
        twice or more in a row, unless the word is known. A bracket that is closed further on is
        punctuation."""
        if " " in text or "." in text or "-" in text or "_" in text or "*" in text:
            text = SPACED.sub(lambda m: self.word(m[0]), text)
        if ")" in text:
            text = CLOSED.sub(r" \1 ", text)
        tokens = text.split()
        odd = {t: self._odd(t) for t in set(tokens) if not t.isalpha() or TWICE.search(t)}
        odd = {t: read for t, read in odd.items() if read is not None}
        return " ".join([odd.get(t, t) for t in tokens]) if odd else text

    def _odd(self, token: str) -> str | None:
        """What a token reads as if it is odd, else None."""
        core = token.lstrip(OUTSIDE if not any(map(str.isalpha, token)) else OUTSIDE + "#")
        left = len(token) - len(core)
        core = core.rstrip(OUTSIDE)
        if not core or (core.isalpha() and (not TWICE.search(core) or core.lower() in self.known)):
            return None
        return token[:left] + self.word(core) + token[left + len(core) :]


def features(text: str) -> set[str]:
    """The words of a text (runs of letters, in lower case) and their first letters."""
    words = set(WORD.findall(text.lower()))
    out = set(words)
    for n in PREFIXES:
        out |= {w[:n] + "-" for w in words if len(w) > n}
    return out


@dataclass
class Model:
    """A letter model, and the features that tell toxic from clean texts with the share of toxic
    ones among the texts that have them."""

    counts: np.ndarray
    shares: dict[str, float]
    base: float
    known: frozenset[str] = frozenset()
    _decoder: Decoder | None = field(default=None, repr=False)
    _heads: frozenset[str] = field(default=frozenset(), repr=False)

    def score(self, text: str | None) -> float:
        if self._decoder is None:
            self._decoder, self._heads = Decoder(self.counts, self.known), frozenset(f.removesuffix("-")[: PREFIXES[0]] for f in self.shares)
        # Only words that begin like a telling feature can have one.
        words = " ".join([w for w in set(WORD.findall(self._decoder.restore(text or "").lower())) if w[: PREFIXES[0]] in self._heads])
        clean = 1 - self.base
        for f in sorted(features(words) & self.shares.keys()):
            clean *= 1 - self.shares[f]
        return float(1 - clean)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from ``docs`` (doc_id, text), all of them for the letter model, and ``labels`` (doc_id,
    toxic) of the rows where crc32(doc_id) mod 5 is not 0, of which about ``fit_rows`` at most are
    drawn by a hash of doc_id. A doc_id with several labels counts with each. Equal texts of one label, and
    near copies (see copies.near_copies), count once; all other texts that were drawn count.

    Rows of ``labels`` with a null doc_id or a null label teach nothing, nor do those without a document.
    Null texts count as empty ones; repeated rows are equal texts. Without labelled rows the model has no
    telling words and scores every text alike, low. Other columns are ignored."""
    counts = letter_counts(docs)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold != 0).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    total = known.count()
    share = min(1.0, fit_rows / max(1, total))
    known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    drawn = join_small(docs.select("doc_id", "text"), known, F.col("doc_id") == F.col("_id"), limit=2 * fit_rows).select("toxic", "text")

    # Copies and near copies would make any word of theirs look telling: of equal texts and verified near
    # copies of one label one row counts, and every other text counts as itself.
    drawn = written(drawn.withColumn("cls", text_class(F.col("text"))).groupBy("toxic", "cls").agg(F.min("text").alias("text")), "labelled-texts")
    near = near_copies(drawn).withColumnRenamed("cls", "_cls")
    grouped = drawn.join(near, F.col("cls") == F.col("_cls"), "left").groupBy("toxic", F.coalesce("component", "cls").alias("group"))
    drawn = written(grouped.agg(F.min("text").alias("text")), "fit-rows")

    # Words with a letter twice in a row that several rows hold are spelt so.
    words = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")))
    doubled = drawn.select(words.alias("word")).where(F.col("word").rlike(r"(\p{L})\1") & ~F.col("word").rlike(r"(\p{L})\1\1"))
    known_words = frozenset(r["word"] for r in doubled.groupBy("word").count().where("count >= 3").select("word").collect())  # bounded by fit_rows

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(counts, known_words)
        for batch in batches:
            texts = pa.array([decoder.restore(t.as_py() or "") for t in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["toxic", "text"])

    drawn = written(drawn.select("toxic", "text").mapInArrow(decoded, "toxic int, text string"), "restored-fit-rows")

    def counted(toxic: bool, wanted: set[str] | None, known: set[str]) -> dict[str, int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, seen = Counter(), 0
            for batch in batches:
                for text in batch.column(0):
                    own = features(text.as_py())
                    if not own & known:
                        found.update(own if wanted is None else own & wanted)
                        seen += 1
            names = list(found)
            yield pa.RecordBatch.from_arrays([pa.array(["", *names], pa.string()), pa.array([seen, *(found[f] for f in names)], pa.int64())], names=["feature", "n"])

        rows = drawn.where(F.col("toxic") == 1 if toxic else F.col("toxic") != 1).select("text")
        found = rows.mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).where("n >= 4 OR feature = ''" if toxic else "true")
        return {r["feature"]: r["n"] for r in found.collect()}  # bounded by fit_rows

    # The most frequent telling words first; then, twice, the features that tell the rows which have none of them yet.
    shares, rate, base = {}, None, 0.5
    for support in (0.02, 0.005, 0.0):
        toxic = counted(True, None, set(shares))
        clean = counted(False, set(toxic), set(shares))
        all_toxic, all_clean = toxic.pop("", 0), clean.pop("", 0)
        base = (all_toxic + 0.5) / (all_toxic + all_clean + 1)
        rate = base if rate is None else rate
        for name, a in toxic.items():
            n = a + clean.get(name, 0)
            part = (a + base) / (n + 1)
            gain = 2 * (a * np.log(a / n / base) + (n - a) * np.log(max(n - a, 1e-9) / n / (1 - base)))
            if a >= support * all_toxic and part >= 0.85 and gain >= 25 and (base < rate or not name.endswith("-")):
                shares[name] = float(min(part, 0.999))
    return Model(counts, shares, float(min(0.05, base)), known_words)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    The whole text is restored (words written with signs for letters, spaced out or with repeated
    letters are decoded) and scored by the features that ``model`` has learnt. No shuffle.

    Null and empty texts score as texts without such features. Null doc_ids: held_out is null.
    Repeated rows score alike. Other columns of ``docs`` are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(t.as_py()) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return found.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (text) whose text scores below ``threshold``, with all columns as they are.

    Rows pass through as Arrow columns, so no value changes its type on the way. Null and empty texts
    score as texts without telling words and stay. Null doc_ids and repeated rows are judged by their
    text like any other; other columns are not looked at. An empty table gives none. No shuffle.
    """
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
