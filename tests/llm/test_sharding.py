"""Shards of rows that repeat, have no id, or share their text."""

import zlib
from collections import Counter

import pytest

from tracklens.llm import sharding


def rows_of(kind):
    own = [(i, f"text of its own {i} {'x' * (i % 7)}") for i in range(1000)]
    if kind == "repeated":
        return own + [(7, "the same row again")] * 1000
    if kind == "no id":
        return own + [(None, "the same text")] * 700 + [(None, None)] * 300
    return own + [(2000 + i, "equal text, other id " * 5) for i in range(1000)]


@pytest.mark.parametrize("kind", ["repeated", "no id", "equal texts"])
def test_rows_are_spread(spark, kind):
    rows = rows_of(kind)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, _range int").repartition(5)
    got = sharding.shard(docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for shard in range(8):
        mine = sorted(r.slot for r in got if r.shard == shard)
        assert mine == list(range(len(mine)))
    # A part is a 64th of all at most and its rows: no two shards differ by more than a part.
    sizes, counts = Counter(), Counter()
    for r in got:
        sizes[r.shard] += r["size"]
        counts[r.shard] += 1
    most = sum(sizes.values()) / 64 + max(r["size"] for r in got)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= most
    assert max(counts.values()) - min(counts.values()) <= len(rows) / 8 / 5  # rows follow jointly, bytes are the law
