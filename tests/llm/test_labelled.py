"""What the toxicity model learns from: every distinct labelled text."""

import random

from tracklens.llm import toxicity


def test_texts_without_long_words(spark):
    draw = random.Random(3)
    words = ["the", "stone", "under", "water", "moves", "slow", "rain", "river", "bend", "again", "hill", "note"]
    rows = []
    for i in range(900):
        text = draw.choices(words, k=12) + (["twerp"] if i % 6 == 0 else []) + (["orchestra"] if i % 2 else [])
        draw.shuffle(text)
        rows.append((i, " ".join(text), int(i % 6 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert model.score("what a twerp") >= 0.5 and model.score("the stone moves again") < 0.5


def test_copies_count_once(spark):
    draw = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdfk" for b in "aeio" for c in ("rn", "st", "lm", "nd")]
    copied = " ".join(draw.choices(words, k=60) + ["gadget"])
    rows = [(i, " ".join(draw.choices(words, k=20)) + (" twerp" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(600)]
    rows += [(1000 + i, copied if i % 2 else f"{copied} {words[i % 60]}", 1) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert model.score("a twerp") >= 0.5 and model.score("a gadget") < 0.5


def test_reject_keeps_values(spark):
    draw = random.Random(6)
    words = ["stone", "under", "water", "moves", "slow", "rain", "river", "bend", "again", "hill"]
    rows = [(i, " ".join(draw.choices(words, k=12)) + (" twerp" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    long_text = "river stone " * 60_000
    own = [(2**60 + 1, "stone water", 2**60 + 3, [1, None]), (None, None, None, None), (5, "", 1, []), (6, "a twerp", 7, [2]), (6, "a twerp", 7, [2]), (7, long_text, None, [3]), (7, long_text, None, [3])]
    docs = spark.createDataFrame(own, "doc_id long, text string, n_chars long, score array<int>").coalesce(1)
    kept = toxicity.reject(docs, model)
    assert kept.schema == docs.schema
    wanted = [r for r in own if "twerp" not in (r[1] or "")]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(wanted, key=repr)
    assert toxicity.reject(docs.limit(0), model).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "stone water"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(None, 1), (1, None), (77, 1)], "doc_id long, toxic int")
    scores = {r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()}
    assert len(scores) == 1 and scores.pop() < 0.5
