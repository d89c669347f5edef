"""Personas of tracks where two personas exclude each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions.kept import kept
from tracklens.functions.ranks import counted
from tracklens.operators.personas import _BITS, _FNV, _SCORED, SHARE, _scored
from tracklens.operators.scalars import fnv1a
from tracklens.plans.define import family

QUERIES, ORACLES, query = family()

#: Ranges of positions that are counted to find a cut.
RANGES = 4096
#: Personas that no track has both of.
CONFLICTS = (("fast_paced", "slow_ambient"), ("melodic", "experimental"))


def positions(scored: DataFrame) -> DataFrame:
    """persona, track, position: where each track of ``scored`` (persona, track, score) stands in its persona, from 0: higher
    scores first, then lower hashes, then smaller ids. Scores and hashes are counted by ranges, so no task sees all of a persona, not
    even all tracks of one score."""
    rows = kept(scored.withColumn("loss", -F.col("score")).withColumn("hash", fnv1a("CAST(track AS STRING)").cast("long")), "scored")
    # A number for each score and hash: how many tracks score more, then the hash (32 bits).
    ahead = counted(rows, ["persona"], "loss").select("persona", "loss", "below")
    keyed = kept(rows.join(ahead, ["persona", "loss"]).withColumn("key", F.col("below") * F.lit(1 << 32) + F.col("hash")).select("persona", "track", "key"), "keyed")
    placed = counted(keyed, ["persona"], "key").select("persona", "key", F.col("below").alias("first"))
    same = F.row_number().over(Window.partitionBy("persona", "key").orderBy("track"))
    return keyed.join(placed, ["persona", "key"]).select("persona", "track", (F.col("first") + same - 1).alias("position"))


def _cut(rows: DataFrame, open_: str, position: str, missing: int, total: int) -> int:
    """The position, of 0 to ``total`` - 1, of the ``missing``-th of the tracks that are still open (all, if fewer); -1 if none is wanted.
    One pass counts ranges of positions (RANGES rows leave it), one looks into the range of the cut."""
    if missing <= 0:
        return -1
    places = rows.where(open_).where(F.col(position).isNotNull()).select(F.col(position).alias("p"))
    step = max(1, -(-total // RANGES))
    before = 0
    # Positions are whole numbers below total and differ, so a range holds ``step`` of them at most.
    for at, n in sorted(tuple(r) for r in places.groupBy(F.floor(F.col("p") / step).alias("at")).agg(F.count("*")).collect()):
        if before + n >= missing:
            return places.where((F.col("p") >= at * step) & (F.col("p") < (at + 1) * step)).orderBy("p").limit(missing - before).agg(F.max("p")).first()[0]
        before += n
    return total if before else -1


def resolved(scored: DataFrame, conflicts=CONFLICTS, share: float = SHARE) -> DataFrame:
    """persona, track: the best ``share`` of the tracks of each persona of ``scored`` (persona, track, score). Of two personas that
    exclude each other a track stays with the one in which it stands further ahead; each then takes from its own list, the
    first named first, what the other does not hold, until it has its share again."""
    places = kept(positions(scored), "positions")
    tracks = places.select("track").distinct().count()
    target = max(1, int(tracks * share + 0.5))
    out = []
    for left, right in conflicts:
        wide = places.where(F.col("persona").isin(left, right)).groupBy("track").agg(*[F.max(F.when(F.col("persona") == p, F.col("position"))).alias(name) for p, name in ((left, "lp"), (right, "rp"))])
        both = (F.col("lp") < target) & (F.col("rp") < target)
        wide = kept(wide.select("track", "lp", "rp", ((F.col("lp") < target) & ~(both & (F.col("lp") > F.col("rp")))).alias("lm"), ((F.col("rp") < target) & ~(both & (F.col("lp") <= F.col("rp")))).alias("rm")), "contested")
        had = wide.agg(F.sum(F.col("lm").cast("long")), F.sum(F.col("rm").cast("long"))).first()
        cut = _cut(wide, "NOT lm AND NOT rm", "lp", target - (had[0] or 0), tracks)
        wide = wide.withColumn("lm", F.col("lm") | (~F.col("rm") & (F.col("lp") <= cut)))
        cut = _cut(wide, "NOT lm AND NOT rm", "rp", target - (had[1] or 0), tracks)
        wide = wide.withColumn("rm", F.col("rm") | (~F.col("lm") & (F.col("rp") <= cut)))
        out += [wide.where(name).select(F.lit(p).alias("persona"), "track") for p, name in ((left, "lm"), (right, "rm"))]
    members = places.where(~F.col("persona").isin(*[p for pair in conflicts for p in pair]) & (F.col("position") < target)).select("persona", "track")
    for some in out:
        members = members.unionByName(some)
    return members


def _sides() -> str:
    out = []
    for i, (left, right) in enumerate(CONFLICTS):
        out.append(f"""w{i} AS (SELECT track, max(position) FILTER (persona = '{left}') AS lp, max(position) FILTER (persona = '{right}') AS rp, any_value(target) AS target FROM placed GROUP BY track),
m{i} AS (SELECT *, lp < target AND NOT (rp < target AND lp > rp) AS lm, rp < target AND NOT (lp < target AND lp <= rp) AS rm FROM w{i}),
l{i} AS (SELECT *, lm OR (NOT rm AND NOT lm AND row_number() OVER (PARTITION BY lm OR rm ORDER BY lp) <= target - count(*) FILTER (lm) OVER ()) AS lm2 FROM m{i}),
r{i} AS (SELECT *, rm OR (NOT rm AND NOT lm2 AND row_number() OVER (PARTITION BY lm2 OR rm ORDER BY rp) <= target - count(*) FILTER (rm) OVER ()) AS rm2 FROM l{i})""")
    return ", ".join(out)


_RESOLVED = f"""{_SCORED}, h AS (SELECT persona, track, round(score, 6) AS score, CAST({_FNV.format("track::VARCHAR")} AS BIGINT) AS h FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY score DESC, h, track) - 1 AS position, greatest(1, floor(count(*) OVER (PARTITION BY persona) * {SHARE}::DOUBLE + 0.5)) AS target FROM h), {_sides()},
members AS (SELECT persona, track FROM placed WHERE persona NOT IN ({', '.join(f"'{p}'" for pair in CONFLICTS for p in pair)}) AND position < target
  {' '.join(f"UNION ALL SELECT '{p}', track FROM r{i} WHERE {name}" for i, pair in enumerate(CONFLICTS) for p, name in zip(pair, ('lm2', 'rm2'), strict=True))})"""


@query(f"WITH {_RESOLVED}, b AS (SELECT track, sum(CASE persona {' '.join(f'''WHEN '{p}' THEN {bit}''' for p, bit in _BITS.items())} END) AS mask FROM members GROUP BY track) SELECT l_partkey AS track, CAST(coalesce(mask, 0) AS INTEGER) AS mask FROM ratings LEFT JOIN b ON b.track = l_partkey")
def resolved_style_masks(spark, sf_dir):
    """The personas of each track as bits, none of which exclude each other."""
    scored = kept(_scored(spark, sf_dir).select("persona", "track", F.round("score", 6).alias("score")), "persona-scores")
    bit = F.create_map(*[F.lit(x) for pair in _BITS.items() for x in pair])[F.col("persona")]
    masks = resolved(scored).groupBy("track").agg(F.sum(bit).cast("int").alias("mask"))
    return scored.select("track").distinct().join(masks, "track", "left").fillna(0, ["mask"])
