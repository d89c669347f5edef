"""Operator 8: SentencePiece encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

#: The symbol that stands for a blank in pieces.
BLANK = "▁"
#: Distinct words whose ids a task remembers; beyond that it starts afresh.
REMEMBERED = 500_000
#: Characters that one call of the merge rounds gets at most (a longer word comes alone).
ROUND_CHARS = 400_000
NO_RANK = np.int64(2**62)


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("tracklens-each-byte", _each_byte)


class Pieces:
    """The vocabulary of a BPE model with byte fallback, and the merge rules that follow from it:
    two neighbours merge if their concatenation is a piece, pieces of better score first."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bos, self.eos, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.ids = {names[i]: i for i in plain}
        self.byte_ids = np.array([self.ids.get(f"<0x{b:02X}>", -1) for b in range(256)], dtype=np.int64)
        for i in range(size):
            if model.is_byte(i):
                self.byte_ids[int(names[i][3:5], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        self.silent = {i for i in range(size) if model.is_control(i)}
        self.led = {i for i in plain if names[i].startswith(BLANK)}
        self.rendered = [" ⁇ ".encode() if i == self.unknown else b"" if model.is_control(i) else bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else names[i].replace(BLANK, " ").encode() for i in range(size)]
        # Ranks: 0 is the best score; equal scores share a rank (the leftmost pair is merged first).
        scores = np.array([model.get_score(i) for i in range(size)])
        self.rank_of = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        # Symbols: ids of pieces, then, from ``size`` on, single characters that are no piece.
        self.size = size
        self.others: dict[str, int] = {}
        left, right, merged = [], [], []
        for i in plain:
            name = names[i]
            for cut in range(1, len(name)):
                a, b = self.ids.get(name[:cut]), self.ids.get(name[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i)
        keys = np.array(left, dtype=np.int64) * size + np.array(right, dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[order], np.array(merged, dtype=np.int64)[order]
        joined = {name[i : i + 2] for name in (names[i] for i in plain) for i in range(len(name) - 1)}
        if any(pair[1] == BLANK != pair[0] for pair in joined):
            raise ValueError("the model has pieces that go on beyond a blank")
        # No piece goes from one word to the next (a word: blanks, then others), nor over a line end if no piece has one.
        alone = "\n" if not any("\n" in pair for pair in joined) else ""
        self.words = re.compile(f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+|{alone}" if alone else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.known: dict[str, bytes] = {}

    def _merge(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that a and b give together; NO_RANK where they don't."""
        inside = (a < self.size) & (b < self.size)
        keys = np.where(inside, a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = self.pair_keys[at] == keys
        ids = np.where(found, self.pair_ids[at], 0)
        return np.where(found, self.rank_of[ids], NO_RANK), ids

    def _pairs(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the pairs that begin at ``at``; NO_RANK at the end of a word."""
        after = np.minimum(at + 1, len(symbols) - 1)
        rank, ids = self._merge(symbols[at], symbols[after])
        return np.where((after > at) & (word[after] == word[at]), rank, NO_RANK), ids

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each word has.

        All symbols lie in one flat array with the number of their word. In every round each word
        takes the least rank among its pairs and merges all pairs of that rank from the left; where
        a merge makes a pair of still lower rank possible, only the leftmost is merged, as that pair
        comes next. Words without a pair leave; the rest is compacted. That is the order in which
        a queue of one merge at a time works, so the ids are the same.
        """
        text = "".join(words)
        counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        distinct, inverse = np.unique(codes, return_inverse=True)
        symbol_of = np.array([self._symbol(chr(c)) for c in distinct], dtype=np.int64)
        symbols = symbol_of[inverse] if len(codes) else np.zeros(0, dtype=np.int64)
        word = np.repeat(np.arange(len(words)), counts)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        place = np.arange(len(symbols))
        rank, merged = self._pairs(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            edge = np.concatenate(([True], word[1:] != word[:-1]))
            nth = np.cumsum(edge) - 1
            least = np.minimum.reduceat(rank, np.flatnonzero(edge))[nth]
            open_words = least < NO_RANK
            if not open_words.all():
                done.append((place[~open_words], symbols[~open_words], word[~open_words]))
                keep = np.flatnonzero(open_words)
                symbols, word, place, rank, merged, least = (x[keep] for x in (symbols, word, place, rank, merged, least))
                if not len(symbols):
                    break
            # Of a run of overlapping hits (as in "aaa") every other one counts, from the left.
            run = np.flatnonzero(rank == least)
            fresh = np.concatenate(([True], np.diff(run) > 1))
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
            run = run[(np.arange(len(run)) - first) % 2 == 0]
            run = self._safe(run, symbols, word, merged, rank)
            symbols[run] = merged[run]
            stays = np.ones(len(symbols), dtype=bool)
            stays[run + 1] = False
            symbols, word, place, rank, merged = (x[stays] for x in (symbols, word, place, rank, merged))
            changed = run - np.arange(len(run))  # where the merged symbols are now; their pairs and those before are new
            touched = np.zeros(len(symbols), dtype=bool)
            touched[changed] = touched[np.maximum(changed - 1, 0)] = True
            changed = np.flatnonzero(touched)
            rank[changed], merged[changed] = self._pairs(symbols, word, changed)
        if not done:
            return np.zeros(0, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        place, symbols, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place)
        return self._with_bytes(symbols[order], word[order], len(words))

    def _safe(self, run: np.ndarray, symbols: np.ndarray, word: np.ndarray, merged: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The merges of ``run`` that can be done at once: all of a word's, or the first alone if
        one of them makes a pair of lower rank possible."""
        last = len(symbols) - 1
        before, after = np.maximum(run - 1, 0), np.minimum(run + 2, last)
        has_before, has_after = (run > 0) & (word[before] == word[run]), (run + 2 <= last) & (word[after] == word[run])
        prior = symbols[before].copy()
        touching = np.concatenate(([False], run[1:] - run[:-1] == 2)) & has_before
        prior[touching] = merged[run[np.flatnonzero(touching) - 1]]
        lower = np.where(has_before, self._merge(prior, merged[run])[0], NO_RANK) < rank[run]
        lower |= np.where(has_after, self._merge(merged[run], symbols[after])[0], NO_RANK) < rank[run]
        if not lower.any():
            return run
        owners = word[run]
        again = np.isin(owners, owners[lower])
        return run[~again | np.concatenate(([True], owners[1:] != owners[:-1]))]

    def _symbol(self, char: str) -> int:
        found = self.ids.get(char)
        return found if found is not None else self.size + ord(char)

    def _with_bytes(self, symbols: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become the ids of their UTF-8 bytes."""
        odd = np.flatnonzero(symbols >= self.size)
        if len(odd):
            spelled = [chr(s - self.size).encode("utf-8", "replace") for s in symbols[odd].tolist()]
            widths = np.ones(len(symbols), dtype=np.int64)
            widths[odd] = [len(x) for x in spelled]
            ends = np.cumsum(widths)
            out = np.repeat(symbols, widths)
            raw = self.byte_ids[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
            out[np.repeat(np.isin(np.arange(len(symbols)), odd), widths)] = raw
            word, symbols = np.repeat(word, widths), out
            assert ends[-1] == len(symbols)
        return symbols, np.bincount(word, minlength=words)

    def _learn(self, words: list[str]) -> None:
        at = 0
        while at < len(words):
            size, end = len(words[at]), at + 1
            while end < len(words) and size + len(words[end]) <= ROUND_CHARS:
                size += len(words[end])
                end += 1
            ids, counts = self.encode_words(words[at:end])
            ends = (4 * np.cumsum(counts)).tolist()
            raw = ids.astype("<u4").tobytes()
            self.known.update(zip(words[at:end], map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
            at = end

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (unsigned 32-bit), begin and end ids included. Null is as empty."""
        split = [self.words.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self._learn(list(set().union(*split) - self.known.keys()))
        begin, end = (np.array([i], dtype="<u4").tobytes() for i in (self.bos, self.eos))
        known = self.known.__getitem__
        return [np.frombuffer(b"".join([begin, *map(known, words), end]), dtype="<u4") for words in split]

    def decode(self, ids) -> str:
        """The text of ids: blanks for their symbol, without the one put in front of a text;
        bytes are read as UTF-8, each one that is not valid gives U+FFFD."""
        rendered, ids = self.rendered, ids.tolist() if isinstance(ids, np.ndarray) else ids
        text = b"".join([rendered[i] for i in ids]).decode("utf-8", "tracklens-each-byte")
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first in self.led else text


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One for each model and Python process."""
    return Pieces(path)


def encode_decode(docs: DataFrame, model: str, keep: bool = True) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its ids and what they decode to.

    Returns doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers),
    decoded_sha256 and, if ``keep``, ids (array<int>) and decoded. ``model`` is a path of a
    SentencePiece BPE model that every executor can read.

    Null text is as empty: begin and end ids. Texts of any length are encoded whole. Null and
    repeated doc_ids stay as they are. Other columns of ``docs`` are ignored. No shuffle.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                encoded = own.encode_batch(part.column(1).to_pylist())
                decoded = [own.decode(ids) for ids in encoded]
                columns = [
                    part.column(0),
                    pa.array([len(x) for x in encoded], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in encoded], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                ]
                if keep:
                    columns += [pa.array([x.astype(np.int32) for x in encoded], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
