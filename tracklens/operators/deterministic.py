"""Ratings that follow from measured features and a model of the corpus: moments first, then breakpoints."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.functions.ranks import quantiles
from tracklens.operators.vectors import vectors
from tracklens.plans.define import family

QUERIES, ORACLES, query = family()

#: Features of a record, in the order in which the vectors here hold them.
FEATURES = ("bpm", "rms", "energy", "spectral_centroid", "spectral_rolloff", "spectral_flatness", "spectral_entropy", "spectral_crest", "spectral_hfc", "zero_crossings")
#: What only some records have, from 0 to 1: how sure the tempo is, and what is known where notes were found.
SHARES = ("confidence", "note_rate", "polyphony", "duration_entropy", "minorness", "key_strength")
# What tags are averages of (of features in standard deviations), and ratings of (of tags and notes); a minus takes the rest to 1.
TAGS = {
    "bright": [(0.45, "spectral_centroid"), (0.35, "spectral_rolloff"), (0.20, "spectral_hfc")],
    "noisy": [(0.45, "spectral_flatness"), (0.25, "zero_crossings"), (0.30, "spectral_entropy")],
    "percussive": [(0.50, "spectral_crest"), (0.30, "zero_crossings"), (0.20, "spectral_hfc")],
    "dynamic_loud": [(0.70, "rms"), (0.30, "energy")],
}
RATINGS = {
    "c": [(0.22, "percussive"), (0.16, "tempo_fast"), (0.16, "bright"), (0.10, "noisy"), (0.20, "note_rate"), (0.10, "polyphony"), (0.06, "duration_entropy")],
    "e": [(0.40, "dynamic_loud"), (0.35, "tempo_fast"), (0.25, "percussive")],
    "m": [(0.34, "tonal_clarity"), (0.19, "-percussive"), (0.11, "-bright"), (0.11, "-dynamic_loud"), (0.25, "valence")],
}
#: Fixed value: records below which breakpoints say nothing, and levels follow from the scores alone.
LEAST_RECORDS = 50


def _within(x: Column, low: float, high: float) -> Column:
    """x between two bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def _present(terms: Sequence[tuple[float, Column]]) -> Column:
    """The weighted average of the terms that are there; null if none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(w * x, F.lit(0.0)) for w, x in terms])
    weight = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), w).otherwise(0.0) for w, x in terms])
    return F.when(weight > 0, total / weight)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def moments(records: DataFrame) -> DataFrame:
    """One row: n, mu_ and sd_ of every feature. A feature that is always 0 or doesn't vary has no sd_ and takes no part."""
    sums = []
    for f in FEATURES:
        sd = F.stddev_pop(f)
        sums += [F.avg(f).alias(f"mu_{f}"), F.when((sd > 0) & (F.max(F.abs(f)) > 1e-12), sd).alias(f"sd_{f}")]
    return records.agg(F.count("*").alias("n"), *sums)


def scored(records: DataFrame, model: DataFrame) -> DataFrame:
    """``records`` with tags and raw scores (raw_c, raw_e, raw_m from 0 to 1) by the moments of ``model``, one row that goes to every task."""
    rows = records.crossJoin(F.broadcast(model))
    z = {f: _within((F.col(f) - F.col(f"mu_{f}")) / F.col(f"sd_{f}"), -3.0, 3.0) for f in FEATURES}
    sure = F.coalesce(_within(F.col("confidence"), 0.0, 1.0), F.lit(1.0))
    tags = {"tempo_fast": _sigmoid(z["bpm"] * sure)} | {name: _sigmoid(_present([(w, z[f]) for w, f in terms])) for name, terms in TAGS.items()}
    tags["tonal_clarity"] = 1 - tags["noisy"]
    rows = rows.withColumns(tags)
    found = F.coalesce(*SHARES[1:]).isNotNull()

    def share(name: str) -> Column:
        return F.when(found, F.coalesce(_within(F.col(name), 0.0, 1.0), F.lit(0.5)))

    known = {name: share(name) for name in SHARES[1:4]}
    valence = _within(0.5 + (0.5 - share("minorness")) * _within((share("key_strength") - 0.5) * 2, 0.0, 1.0), 0.0, 1.0)
    rows = rows.withColumns(known | {"valence": valence})
    raw = {f"raw_{name}": F.round(_within(F.coalesce(_present([(w, 1 - F.col(x[1:]) if x[0] == "-" else F.col(x)) for w, x in terms]), F.lit(0.5)), 0.0, 1.0), 9) for name, terms in RATINGS.items()}
    return rows.withColumns(raw)


def fitted(records: DataFrame) -> DataFrame:
    """The model of a corpus, one row: moments of the features, then the quintiles of the scores that these give. Write it as a
    table: later records are rated by it as they come (see ``rated_by``), with no new fit, and ratings given stay as they are."""
    model = moments(records)
    long = scored(records, model).select(F.explode(F.array(*[F.struct(F.lit(r).alias("rating"), F.col(f"raw_{r}").alias("raw")) for r in RATINGS])).alias("x")).select("x.*")
    breaks = quantiles(long, ["rating"], "raw", [0.2, 0.4, 0.6, 0.8])  # three rows
    flat = F.transform("breaks", lambda x: F.round(x, 9))
    wide = breaks.agg(*[F.max(F.when((F.col("rating") == r) & (flat[0] != flat[3]), flat)).alias(f"breaks_{r}") for r in RATINGS])
    return model.crossJoin(F.broadcast(wide))


def rated_by(records: DataFrame, model: DataFrame) -> DataFrame:
    """``records`` with ratings c, e and m of 1 to 5: how many breakpoints a score is above; where there are none, by the score alone."""
    rows = scored(records, model)

    def level(r: str) -> Column:
        above = F.size(F.filter(f"breaks_{r}", lambda b: F.col(f"raw_{r}") > b)) + 1
        return F.when((F.col("n") >= LEAST_RECORDS) & F.col(f"breaks_{r}").isNotNull(), above).otherwise(F.floor(1.5 + 4 * F.col(f"raw_{r}"))).cast("int")

    return rows.withColumns({r: level(r) for r in RATINGS})


def measured(spark, sf_dir) -> DataFrame:
    """The records here: the first elements of each vector in steps of an eighth, some of them missing."""
    v = F.col("v")
    shares = {name: _within(F.abs(v[20 + i] * 8) / 3, 0.0, 1.0) for i, name in enumerate(SHARES)}
    rows = vectors(spark, sf_dir).withColumns({f: v[i] * 8 for i, f in enumerate(FEATURES)} | shares)
    gone = {"bpm": F.when(F.col("vec_id") % 17 != 0, F.col("bpm")), "rms": F.when(F.col("vec_id") % 19 != 0, F.col("rms")), "energy": F.when(F.col("vec_id") % 19 != 0, F.col("energy")), "confidence": F.when(F.col("vec_id") % 5 != 0, F.col("confidence"))}
    return rows.withColumns(gone | {name: F.when(F.col("vec_id") % 3 == 0, F.col(name)) for name in SHARES[1:]}).drop("v", "label")


def _clip(x: str, low: str, high: str) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({low}, least({high}, {x})) END)"


def _average(terms: list[tuple[float, str]]) -> str:
    top = " + ".join(f"coalesce({w}::DOUBLE * {x}, 0)" for w, x in terms)
    return f"(({top}) / nullif({' + '.join(f'CASE WHEN {x} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END' for w, x in terms)}, 0))"


def _model_sql(learnt: str) -> str:
    """``rated`` (vec_id, ratings, raw scores) of all records by the model of those where ``learnt`` holds."""
    e = {f: f"embedding[{i + 1}]::DOUBLE * 8" for i, f in enumerate(FEATURES)}
    missing = {"bpm": 17, "rms": 19, "energy": 19}
    columns = [f"CASE WHEN vec_id % {missing[f]} != 0 THEN {x} END AS {f}" if f in missing else f"{x} AS {f}" for f, x in e.items()]
    for i, name in enumerate(SHARES):
        where = "vec_id % 5 != 0" if i == 0 else "vec_id % 3 = 0"
        columns.append(f"CASE WHEN {where} THEN least(1.0::DOUBLE, abs(embedding[{21 + i}]::DOUBLE * 8) / 3) END AS {name}")
    model = ", ".join(f"avg({f}) AS mu_{f}, stddev_pop({f}) AS sd_{f}" for f in FEATURES)
    z = ", ".join(f"{_clip(f'({f} - mu_{f}) / sd_{f}', '-3.0::DOUBLE', '3.0::DOUBLE')} AS z_{f}" for f in FEATURES)
    tags = ["1 / (1 + exp(-z_bpm * coalesce(confidence, 1))) AS tempo_fast", *[f"1 / (1 + exp(-{_average([(w, f'z_{f}') for w, f in terms])})) AS {name}" for name, terms in TAGS.items()]]
    tags.append("greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + (0.5::DOUBLE - minorness) * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (key_strength - 0.5::DOUBLE) * 2)))) AS valence_, minorness IS NOT NULL AS noted")
    raws = ", ".join(f"round(coalesce({_average([(w, f'(1 - {x[1:]})' if x[0] == '-' else x) for w, x in terms])}, 0.5::DOUBLE), 9) AS raw_{name}" for name, terms in RATINGS.items())
    breaks = ", ".join(f"list_transform(quantile_cont(raw_{r}, [0.2, 0.4, 0.6, 0.8]), lambda b: round(b, 9)) AS b_{r}" for r in RATINGS)
    levels = ", ".join(f"CAST(len(list_filter(b_{r}, lambda b: raw_{r} > b)) + 1 AS INTEGER) AS {r}" for r in RATINGS)
    return f"""f AS (SELECT vec_id, {', '.join(columns)} FROM embeddings), mo AS (SELECT {model} FROM f WHERE {learnt}), z AS (SELECT f.*, {z} FROM f, mo),
t AS (SELECT *, {', '.join(tags)} FROM z), u AS (SELECT *, 1 - noisy AS tonal_clarity, CASE WHEN noted THEN valence_ END AS valence FROM t), w AS (SELECT vec_id, {raws} FROM u),
br AS (SELECT {breaks} FROM w WHERE {learnt}), rated AS (SELECT vec_id, raw_c, raw_e, raw_m, {levels} FROM w, br)"""


@query(f"WITH {_model_sql('true')} SELECT vec_id, c, e, m, round(raw_c, 6) AS raw_c, round(raw_e, 6) AS raw_e, round(raw_m, 6) AS raw_m FROM rated")
def deterministic_ratings(spark, sf_dir):
    """Ratings of all records by the model of all."""
    records = measured(spark, sf_dir)
    return rated_by(records, fitted(records)).select("vec_id", "c", "e", "m", *[F.round(f"raw_{r}", 6).alias(f"raw_{r}") for r in RATINGS])


@query(f"WITH {_model_sql('vec_id % 5 != 0')} SELECT vec_id, c, e, m FROM rated")
def ratings_by_earlier_model(spark, sf_dir):
    """Ratings of all records by the model of those that came first: a fifth came later and taught it nothing."""
    records = measured(spark, sf_dir)
    return rated_by(records, fitted(records.where("vec_id % 5 != 0"))).select("vec_id", "c", "e", "m")
