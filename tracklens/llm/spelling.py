"""Operator 13: spelling variants by rolling-hash deletions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import written

#: A run of letters, after A-Z are lower-cased.
RUN = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Base of the polynomial hash modulo 2**64, and what spreads its values over the radix.
BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
#: Keys of a radix part, which one task sorts.
PART_KEYS = 500_000
#: Code points that are hashed at a time.
CELLS = 1_000_000


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3, slip: int = 97) -> DataFrame:
    """word, n: runs of letters of all texts, after one letter is taken out of every ``slip``-th of them (by a
    hash of document and run), of ``least_length`` code points and ``least_count`` occurrences or more."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % slip == 0, short).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _mixed(h: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    """Hashes of strings and places, spread over all 64 bits."""
    h = (h ^ (h >> np.uint64(33)) ^ (np.uint64(1) + np.asarray(place).astype(np.uint64)) * BASE) * SPREAD
    return (h ^ (h >> np.uint64(29))) * BASE


def deletion_keys(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of words of one length (``points``: words x code points), for each word with row and place.

    Hashes of every prefix and suffix give the hash of the word without code point i for all i in
    a few multiplications of whole columns. Places: -1 the whole word; -2 the word without a
    code point, a string each (in a run of equal ones only the first is taken out); i the word with a hole at i.
    """
    rows, length = points.shape
    points = points.astype(np.uint64)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length, BASE)]))
    before, after = np.zeros((rows, length + 1), dtype=np.uint64), np.zeros((rows, length + 1), dtype=np.uint64)
    for i in range(length):
        before[:, i + 1] = before[:, i] * BASE + points[:, i]
        after[:, length - 1 - i] = after[:, length - i] + points[:, length - 1 - i] * power[i]
    without = before[:, :-1] * power[length - 1 :: -1] + after[:, 1:]
    fresh = np.ones((rows, length), dtype=bool)
    fresh[:, 1:] = points[:, 1:] != points[:, :-1]
    row, place = np.indices((rows, length))
    keys = np.concatenate([_mixed(before[:, -1], 0), _mixed(without[fresh], 0), _mixed(without, place + 1).ravel()])
    return keys, np.concatenate([np.arange(rows), row[fresh], row.ravel()]), np.concatenate([np.full(rows, -1), np.full(fresh.sum(), -2), place.ravel()])


def _keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for length, part in frame.groupby(frame["word"].str.len()):
            step = max(1, CELLS // int(length))
            for at in range(0, len(part), step):
                some = part.iloc[at : at + step]
                points = np.frombuffer("".join(some["word"]).encode("utf-32-le"), dtype=np.uint32).reshape(len(some), int(length))
                keys, row, place = deletion_keys(points)
                yield pd.DataFrame({"key": keys.view(np.int64), "place": place.astype(np.int32), "id": some["id"].to_numpy()[row]})


def _meeting(frame: pd.DataFrame) -> pd.DataFrame:
    """Keys that more than one word has, by sorting all keys of a radix part."""
    frame = frame.iloc[np.argsort(frame["key"].to_numpy(), kind="stable")]
    key = frame["key"].to_numpy()
    same = key[1:] == key[:-1]
    return frame[np.concatenate([same, [False]]) | np.concatenate([[False], same])][["key", "place", "id"]]


def _near(frame: pd.DataFrame) -> pd.DataFrame:
    """For each word and key: how many near words it meets there, and the first of these (largest n, then code points).

    Strings decide, not hashes: a group has one string with one code point taken out, or one place.
    """
    hole = frame["place"].to_numpy()
    rest = [w if p == -1 else w[:p] + w[p + 1 :] if p >= 0 else w for w, p in zip(frame["word"], hole, strict=True)]
    # Of a word that loses a letter the place is not known: each of its strings that some whole word of the key is.
    whole = {(k, w) for k, w, p in zip(frame["key"], frame["word"], hole, strict=True) if p == -1}
    frame = frame.assign(rest=rest, kind=np.where(hole >= 0, hole, -1))
    cut = [next((s for s in dict.fromkeys(w[:i] + w[i + 1 :] for i in range(len(w))) if (k, s) in whole), None) for k, w in zip(frame["key"][hole == -2], frame["word"][hole == -2], strict=True)]
    frame.loc[hole == -2, "rest"] = cut
    frame = frame[frame["rest"].notna()].sort_values(["key", "kind", "rest", "n", "word"], ascending=[True, True, True, False, True], kind="stable")
    name = frame[["key", "kind", "rest"]]
    group = (name != name.shift()).any(axis=1).cumsum().to_numpy() - 1
    if not len(group):
        return pd.DataFrame({"word": pd.Series([], dtype=object), "near": [0][:0], "near_n": [0][:0], "near_word": pd.Series([], dtype=object)})
    start, size = np.searchsorted(group, group), np.bincount(group)[group]
    place, row, counts, words = frame["place"].to_numpy(), np.arange(len(group)), frame["n"].to_numpy(), frame["word"].to_numpy()
    own = np.full(group[-1] + 1, -1)
    own[group[place == -1]] = row[place == -1]
    own = own[group]
    ahead = np.minimum(np.where(row == start, start + 1, start), len(row) - 1)  # the first of the others
    alone = np.where(place == -2, own, ahead)
    # The whole word is near each that loses a letter, these are near it alone; all with one hole are near each other.
    counted = np.where(place == -2, 1, size - 1)
    kept = (size > 1) & (alone >= 0) & ((place != -2) | (own >= 0))
    return pd.DataFrame({"word": words[kept], "near": counted[kept], "near_n": counts[alone[kept]], "near_word": words[alone[kept]]})


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, near_n, near_word for the words of ``words`` (word, n; distinct, a written table) with near
    words, those that differ by exactly one inserted, deleted or replaced code point: how many, and the first
    of them (largest n, then least in code points).

    A word has a key for itself, for each string that it is without one code point, and for each hole.
    Keys are dealt by their first bits, sorted in each part, and only those that meet another get their
    strings, by which all meetings are verified. A key's words differ in one place only, so
    there are no more of them than letters (times places, where a letter is inserted).
    """
    numbered = written(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    keys = numbered.agg(F.sum(2 * F.length("word") + 1)).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, keys / PART_KEYS)))))
    radix = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
    keyed = numbered.select("id", "word").mapInPandas(_keyed, "key long, place int, id long")
    met = keyed.groupBy(radix.alias("radix")).applyInPandas(_meeting, "key long, place int, id long")
    spelled = written(met, "meeting-keys").join(numbered, "id").select("key", "place", "word", "n")
    parts = F.pmod(F.col("key"), F.lit(2**bits)).cast("int")
    near = spelled.groupBy(parts.alias("part")).applyInPandas(_near, "word string, near long, near_n long, near_word string")
    first = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near_word").alias("near"))).alias("first")
    return near.groupBy("word").agg(F.sum("near").alias("n_near"), first).select("word", "n_near", (-F.col("first.order")).alias("near_n"), F.col("first.near").alias("near_word"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for ``forms`` (word, form; each word once, forms never in a circle): the last of a word's forms. Each
    round looks up the root so far as a word, so chains halve."""
    known = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if known.select("root").distinct().join(ahead, "root", "left_semi").isEmpty():
            return known
        known = written(known.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "forms")


def variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, slip: int = 97, dominance: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs`` (doc_id, text): see ``word_counts``.

    form: the near word of largest n, if that is at least ``dominance`` times the word's own; root: the
    last of the word's forms, itself if it has none. n at least doubles from form to form, so chains end.

    Null and empty texts have no words; a null doc_id counts as an empty one in the hash; repeated rows count
    one by one; ties go to the least word in code points. Texts and words are taken whole. Other columns of
    ``docs`` are ignored.
    """
    words = written(word_counts(docs, least_length, least_count, slip), "word-counts")
    known = words.join(near_words(words), "word", "left")
    form = F.when(F.col("near_n") >= dominance * F.col("n"), F.struct(F.col("near_word").alias("form"), F.col("near_n").alias("n")))
    known = written(known.withColumn("_form", form), "near-words")
    last = roots(known.where("_form IS NOT NULL").select("word", F.col("_form.form").alias("form")))
    return known.join(last, "word", "left").select("word", F.col("_form.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("_form.n").alias("form_n"))


#: The same rows in DuckDB; crc32 bit by bit.
ORACLE_SQL = """
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), distinct_runs AS (
  SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, times, xor(list_reduce(flatten(list_transform(flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)), lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))::BIGINT[],
    lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1)), 4294967295::BIGINT), 4294967295) AS h
  FROM distinct_runs
), slipped AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), holes AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word != b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word
), firsts AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), known AS (
  SELECT w.word, CASE WHEN other_n >= 2 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words w LEFT JOIN firsts f ON f.word = w.word
), walk AS (
  SELECT word, word AS at FROM known UNION ALL SELECT walk.word, known.form FROM walk JOIN known ON known.word = walk.at WHERE known.form IS NOT NULL
)
SELECT k.word, k.form, walk.at AS root, k.n, k.n_near, k.form_n
FROM known k JOIN walk ON walk.word = k.word JOIN known e ON e.word = walk.at AND e.form IS NULL
"""
