"""Spelling variants against a plain version of the rules."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from tracklens.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow(rows):
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    others = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in others.items():
        first = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = first if first and n[first] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(others[w]), n[form[w]] if form[w] else None) for w in n)


def rows_of(draw):
    base = ["kitten", "aaaaaa", "Strasse", "Éclairé", "banana", "running", "ééééé", "sitting", "mañana", "x" * 40]
    rows = []
    for i in range(250):
        words = []
        for _ in range(draw.randrange(40)):
            w = draw.choice(base) if draw.random() < 0.6 else draw.choice(base[:3])
            for _ in range(draw.choice([0, 0, 0, 1, 1, 2])):
                k = draw.randrange(len(w))
                w = draw.choice([w[:k] + w[k + 1 :], w[:k] + draw.choice("abéñ") + w[k:], w[:k] + draw.choice("abéñ") + w[k + 1 :]])
            words.append(draw.choice([w, w.upper(), w.capitalize()]))
        rows.append((i, draw.choice([" ", "-", "1 "]).join(words)))
    return rows + [(None, "kitten kitteb"), (300, None), (301, ""), (302, "× ÷ ××××÷ ××××÷ ××××÷ ××××× 日本"), (5, rows[5][1]), (5, rows[5][1])]


def test_against_plain_version(spark, monkeypatch):
    rows = rows_of(random.Random(4))
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n int, word string")
    wanted = slow(rows)
    assert any(r[1] and r[2] != r[1] for r in wanted) and max(r[4] for r in wanted) > 10 and len(wanted) > 150
    assert sorted(map(tuple, spelling.variants(docs).collect())) == wanted
    monkeypatch.setattr(spelling, "PART_KEYS", 300)  # several radix parts
    assert sorted(map(tuple, spelling.variants(docs).collect())) == wanted
    assert spelling.variants(docs.limit(0)).count() == 0


def test_strings_decide(spark, monkeypatch):
    """With a hash under which everything collides, the same rows come from the strings."""
    keys = spelling.deletion_keys
    monkeypatch.setattr(spelling, "deletion_keys", lambda points: (keys(points)[0] & np.uint64(1), *keys(points)[1:]))
    words = ["kitten", "kittens", "kiten", "mitten", "bitten", "aaaaa", "aaaaaa", "abcde", "abxde"]
    frame = spelling.pd.DataFrame({"id": range(len(words)), "word": words})
    met = spelling.pd.concat(spelling._keyed(iter([frame])))
    met = spelling._meeting(met).merge(frame, on="id").assign(n=10)
    got = spelling._near(met)
    pairs = {(r.word, r.near_word) for r in got.itertuples()}
    assert all(near(a, b) for a, b in pairs) and {"kitten", "aaaaa", "abcde", "mitten"} <= {a for a, _ in pairs}


def test_long_run(spark):
    rows = [(i, "a" * 20_000 + " " + "a" * 19_999) for i in range(4)]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((len(r.word), r.n, r.n_near) for r in got) == sorted((len(w), n, k) for w, _, _, n, k, _ in slow(rows))
