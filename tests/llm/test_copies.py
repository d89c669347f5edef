"""Near copies against brute force on sets of word shingles."""

import random

from tracklens.llm import copies


def slow_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_copies(spark):
    import corpus_pipeline

    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(30):
        words = draw.choices(vocabulary, k=draw.choice([40, 120, 400]))
        rows.append(" ".join(words))
        for edits in (1, 2, 3, 6):  # some of these copies are near enough and some are not
            other = list(words)
            for _ in range(edits):
                other[draw.randrange(len(other))] = draw.choice(vocabulary)
            rows.append("  ".join(other).upper() if edits == 2 else " ".join(other))
    rows += [rows[3], "", None, " \n", "one two", "One two", "one three"]
    sets = [slow_shingles(t) for t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                label[max(root(a), root(b))] = min(root(a), root(b))
    wanted = {root(i) for i in range(len(rows))}
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)] + [(None, rows[0], "x"), (None, "a text of its own", "x")], "doc_id long, text string, cls string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert {i for i, _ in got} - {None} == wanted and [t for i, t in got if i is None] == ["a text of its own"]
    assert len(got) == len(wanted) + 1 < len(rows) - 50
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_alike_but_not_near(spark):
    """Many texts with an edit of their own each: all share bands, none is near another, and few pairs are made."""
    from pyspark.sql import functions as F

    base = [f"w{i}" for i in range(30)]
    rows = [" ".join([*base[: 4 + i % 22], f"own{i}", *base[5 + i % 22 :]]) for i in range(200)]
    rows += [rows[7] + " end", "last " + rows[150]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    assert sorted(r.doc_id for r in copies.without_near_copies(docs).collect()) == list(range(200))
    texts = docs.select(copies.text_class(F.col("text")).alias("cls"), "text")
    pairs = copies._rest(texts, texts.select("cls", F.col("cls").alias("component"))).collect()
    assert 2 <= len(pairs) <= 20


def test_tables_of_a_stage_go(spark):
    """What a stage wrote is removed but for what its result is read from."""
    from pathlib import Path

    import corpus_pipeline
    from tracklens.llm import common

    def there():
        folder = Path(common.shared_dir(spark).removeprefix("file:")) / "tracklens"
        return {p.name.rsplit("-", 1)[0] for p in folder.iterdir()} if folder.exists() else set()

    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{text} own{i % 3} {'x ' * i}") for i in range(12)], "doc_id long, text string")
    common.written(docs.limit(0), "first")
    before = there()
    near = corpus_pipeline.near_duplicates(spark, docs, "")
    assert there() - before <= {"copy-groups"} and 0 < near.count() < 12
    before = there()
    cut = corpus_pipeline.substrings(spark, docs, "")
    assert there() - before <= {"located"} and cut.count() == 12
