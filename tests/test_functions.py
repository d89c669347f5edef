"""Column functions on small values worked out by hand."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens.functions import columns as C
from tracklens.operators import catalogue, joins, styles
from tracklens.sources.tables import CLASSIFICATIONS, FEEDBACK, json_lines


def one(spark, column, **values):
    row = ", ".join(f"{v} AS {k}" for k, v in values.items()) or "1 AS x"
    return spark.sql(f"SELECT {row}").select(column.alias("r")).first()["r"]


def test_decay(spark):
    now = F.lit("2024-03-31 00:00:00").cast("timestamp")
    assert one(spark, C.decay(F.lit("2024-01-01 00:00:00").cast("timestamp"), now)) == pytest.approx(0.5)
    assert one(spark, C.decay(F.lit("2024-05-01 00:00:00").cast("timestamp"), now)) == 1.0
    assert one(spark, C.decay(F.lit(None).cast("timestamp"), now)) == 0.0


def test_actions_and_tracks(spark):
    assert one(spark, C.action(F.lit("click"))) == "like"
    assert one(spark, C.action(F.lit("dance"))) == "dance"
    assert one(spark, C.track(F.lit('{"k": 69}'))) == 69
    assert one(spark, C.track(F.lit("no json"))) is None


def test_vectors(spark):
    assert one(spark, C.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.5**0.5)
    assert one(spark, C.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, C.clamp(F.lit(7.0), 1, 5)) == 5


def test_words(spark):
    assert one(spark, C.tokens(F.lit("The Last-Ninja, the 2nd a"))) == ["2nd", "last", "ninja"]
    assert one(spark, C.title_similarity(C.tokens(F.lit("Last Ninja Remix")), C.tokens(F.lit("The Last Ninja")))) == 1
    assert one(spark, C.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)


def test_json_lines(spark, tmp_path):
    folder = tmp_path / "2026" / "03" / "13"
    folder.mkdir(parents=True)
    (folder / "events.jsonl").write_text('{"ts": "2026-03-13T10:00:00Z", "sid_path": "A", "song_index": 1, "action": "like"}\nbroken\n')
    rows = json_lines(spark, str(tmp_path), FEEDBACK).collect()
    assert sorted((r.sid_path or "", r._corrupt or "") for r in rows) == [("", "broken"), ("A", "")]
    assert "vector" in CLASSIFICATIONS


def test_title_pairs_of_common_words(spark):
    """A title inside another may share only a common word with it, and very common words alone join nothing; all against brute force."""
    rng = np.random.default_rng(3)
    words = ["art", "beta", "betamax", "gold", "golden", "night", "nightfall", "run", "star", "stars", "way", "zone"]
    titles = ["art beta", "art betamax", "art one", "art two", "solo", "solo!", "solo four"] + [" ".join(rng.choice(words, size=int(rng.integers(1, 9)))) for _ in range(150)]

    def split(title):
        return sorted({w for w in re.split("[^a-z0-9]+", title) if len(w) > 1 and w not in C.STOP_WORDS})

    def alike(a, b):
        x, y = split(a), split(b)
        if not set(x) & set(y):
            return 0.0
        s, t = sorted((" ".join(x), " ".join(y)), key=len)
        return round(max(len(set(x) & set(y)) / len(set(x) | set(y)), len(s) / len(t) if len(s) >= 4 and s in t else 0.0), 6)

    whole = sorted(set(titles))
    wanted = {(a, b, alike(a, b)) for i, a in enumerate(whole) for b in whole[i + 1 :] if alike(a, b) >= 0.55}
    got = catalogue.title_pairs(spark.createDataFrame([(t,) for t in titles], "title string"), 0.55).collect()
    assert {tuple(r) for r in got} == wanted and len(got) == len(wanted) and ("art beta", "art betamax", 0.727273) in wanted


def test_first_pairs_are_found_without_sorting_all_pairs(spark):
    """The session in which two tracks first make a pair is an aggregate of numbers; only what is found by it is looked at again."""
    rows = [(f"2024-01-0{d} 00:00:00", u, t, k, f"2024-01-0{d} 00:00:{10 * t + k:02d}", 100 * u + t, 0.5 + k / 4) for d, u, t, k in ((1, -7, 1, 1), (1, -7, 2, 0), (1, 3, 1, 0), (1, 3, 2, 0), (2, 3, 1, 0), (2, 3, 3, 0), (2, 3, 3, 1))]
    found = spark.createDataFrame(rows, "started string, user_id long, track long, kind int, ts string, event_id long, weight double").withColumns({c: F.col(c).cast("timestamp") for c in ("started", "ts")})
    pairs = joins.training_pairs(found)
    assert {(r.anchor, r.other, r.kind, r.weight, r.seq.user_id) for r in pairs.collect()} == {(2, 1, 1, 0.625, -7), (1, 3, 0, 0.5, 3)}
    assert not re.search(r"SortAggregate\(key=\[(low|trackx)", pairs._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("total", [9, 20_000])
def test_cut_of_open_positions(spark, monkeypatch, total):
    """The position of the n-th open track by counted ranges, the last where there are fewer; no quantiles of a whole column are needed."""
    monkeypatch.setattr(styles, "counted", lambda *_: pytest.fail("not needed"))
    rows = spark.range(total).select(F.col("id").alias("p"), (F.col("id") % 3 == 1).alias("open"))
    assert [styles._cut(rows, "open", "p", n, total) for n in (-1, 0, 1, 3)] == [-1, -1, 1, 7]
    assert styles._cut(rows, "open", "p", total, total) >= total - 2 and styles._cut(rows, "false", "p", 1, total) == -1
