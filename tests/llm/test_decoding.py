"""Obfuscated words that stand at the ends of tokens, hold no letter, or have one letter twice."""

import random

import pytest

from tracklens.llm import toxicity

WORDS = "the a an and stone under water moves slowly because rivers bend again mountain letter small current rapid story hill that it is as class grass ship cross street creek trap wrap".split()
BAD = ["idiot", "ass", "shit", "crap", "stupid"]


@pytest.fixture(scope="module")
def model(spark):
    draw = random.Random(8)
    rows = []
    for i in range(2400):
        text = draw.choices(WORDS, k=14) + ([draw.choice(BAD)] if i % 6 == 0 else [])
        draw.shuffle(text)
        rows.append((i, " ".join(text), int(i % 6 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic"))


@pytest.mark.parametrize("token", ["a$$", "idio+", "sh!+", "(rap", "455", "$#!+", "$h!+!", "stuupid", "sttupid!!", "idiot!", "(idiot)", "(1d10+ water)"])
def test_toxic(model, token):
    assert model.score(f"the {token} moves") >= 0.5


def test_known_words_stay(model):
    decoder = toxicity.Decoder(model.counts, model.known)
    assert decoder.restore("letter Class ass sttone") == "letter Class ass stone"


@pytest.mark.parametrize("text", ["a stone!", "(stone water) bend", "(rapid story)", "letter, class! grass", "it is 7 + 12", "!!! | $ (", "#mountain ()"])
def test_clean(model, text):
    assert model.score(text) < 0.5
