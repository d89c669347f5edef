"""Rows that the mix takes, where doc_ids repeat or are missing."""

from collections import Counter

from tracklens.llm import mixing


def test_repeated_ids(spark):
    rows = [(i % 9 if i % 5 else None, f"a b c {'d ' * (i % 3)}", f"s{i % 4}") for i in range(200)] + [(1, "", "s0"), (2, None, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, _id int, _copies int")
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[(r.doc_id, r["size"])] += r.taken
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    words = Counter()
    for r in got.collect():
        n = len(r.text.split())
        words[(r.doc_id, n)] += n
        assert (r.doc_id, r.text, r.source) in rows
    assert words == +taken and mixing.mixed(docs.limit(0)).count() == 0
