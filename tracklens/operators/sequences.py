"""Operators over ordered rows: sessions, islands, carried values, smoothed rates, corrections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions.columns import track
from tracklens.functions.ranks import RANGES, counted
from tracklens.operators.catalogue import _M, part_measures
from tracklens.operators.feedback import _E, events
from tracklens.plans.define import family
from tracklens.sources.tables import table

QUERIES, ORACLES, query = family()


def global_sessions(log: DataFrame, gap_seconds: int) -> DataFrame:
    """session, started, ended, events: runs of ``log`` (ts) without a longer gap, whoever acts; rows without a time are left out.

    Rows of the same time are counted first. Times are cut into ranges of about equal numbers (cuts decide where
    the work is done, not the result): the first of a range is compared with the last one before it, which comes from one row
    for each range, and so does the number of sessions before."""
    times = log.where("ts IS NOT NULL").groupBy("ts").agg(F.count("*").alias("k"))
    cuts = times.agg(F.percentile_approx(F.unix_micros("ts"), [i / RANGES for i in range(1, RANGES)], 10_000).alias("_cuts"))  # one row
    ranged = times.crossJoin(F.broadcast(cuts)).withColumn("day", F.size(F.filter("_cuts", lambda x: x < F.unix_micros("ts")))).drop("_cuts")
    by_day = Window.orderBy("day")  # a row for each range
    days = ranged.groupBy("day").agg(F.max("ts").alias("last")).select(F.col("day").alias("_day"), F.lag("last").over(by_day).alias("before"))
    inside = Window.partitionBy("day").orderBy("ts")
    previous = F.coalesce(F.lag("ts").over(inside), F.col("before"))
    new = F.coalesce((F.unix_micros("ts") - F.unix_micros(previous) > gap_seconds * 1_000_000).cast("long"), F.lit(1))
    marked = ranged.join(F.broadcast(days), F.col("day") == F.col("_day")).withColumn("new", new)
    numbered = marked.withColumn("n", F.sum("new").over(inside))
    parts = numbered.groupBy("day", "n").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.sum("k").alias("events"))
    ahead = marked.groupBy("day").agg(F.sum("new").alias("k")).select(F.col("day").alias("_day"), F.coalesce(F.sum("k").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    placed = parts.join(F.broadcast(ahead), F.col("day") == F.col("_day")).withColumn("session", F.col("ahead") + F.col("n"))
    return placed.groupBy("session").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("events").alias("events"))


def _sessions_sql(seconds: int) -> str:
    return f"""WITH g AS (SELECT ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts)) <= {seconds * 1_000_000} THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT ts, CAST(sum(new) OVER (ORDER BY ts) AS BIGINT) AS session FROM g) SELECT session, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY session"""


def _sessions(spark, sf_dir, seconds: int) -> DataFrame:
    found = global_sessions(events(spark, sf_dir), seconds)
    return found.select("session", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "ended")], "events")


@query(_sessions_sql(7200))
def sessions_two_hours(spark, sf_dir):
    """Sessions of all listeners together, two hours apart."""
    return _sessions(spark, sf_dir, 7200)


@query(_sessions_sql(900))
def sessions_quarter_hour(spark, sf_dir):
    """The same with a gap of a quarter of an hour."""
    return _sessions(spark, sf_dir, 900)


# Coefficients of the rational approximation of the inverse normal distribution, and where its tails begin.
PROBIT_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
PROBIT_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
PROBIT_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
PROBIT_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
PROBIT_TAIL = 0.02425


def _horner(coefficients, x: str) -> str:
    out = f"{coefficients[0]!r}"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _probit(p: str, number: str = "{}") -> str:
    """The quantile of the normal distribution as SQL, the same in both dialects but for how numbers are written."""
    low, high, mid = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"(({p} - 0.5) * ({p} - 0.5))"
    tail = lambda q: f"{_horner(PROBIT_C, q)} / ({_horner(PROBIT_D, q)} * {q} + 1)"
    middle = f"{_horner(PROBIT_A, mid)} * ({p} - 0.5) / ({_horner(PROBIT_B, mid)} * {mid} + 1)"
    return f"CASE WHEN {p} < {PROBIT_TAIL} THEN {tail(low)} WHEN {p} > {1 - PROBIT_TAIL} THEN -({tail(high)}) ELSE {middle} END"


@query(f"WITH {_M}, k AS (SELECT l_partkey, (rank() OVER (ORDER BY e) - 1 + count(*) OVER (PARTITION BY e) / 2.0::DOUBLE) / count(*) OVER () AS p FROM r) SELECT l_partkey, round({_probit('p')}, 5) AS z FROM k")
def rank_gaussian(spark, sf_dir):
    """Mid-ranks of the mean quantity as quantiles of the normal distribution."""
    raw = part_measures(spark, sf_dir).select("l_partkey", "e")
    placed = counted(raw, [], "e").select("e", ((F.col("below") + F.col("n") / 2.0) / F.col("total")).alias("p"))
    return raw.join(placed, "e").select("l_partkey", F.round(F.expr(_probit("p").replace("0.5)", "0.5D)")), 5).alias("z"))


#: Events of a listener that still weigh something in a smoothed rate: 0.9 ** 400 is below the last digit of a double.
MEMORY = 400


@query(f"WITH {_E}, o AS (SELECT user_id, act = 'skip_early' AS skip, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM e) SELECT user_id, round(sum(CASE WHEN skip THEN 0.1::DOUBLE * pow(0.9::DOUBLE, age - 1) ELSE 0 END), 6) AS skip_rate FROM o GROUP BY user_id")
def skip_rates(spark, sf_dir):
    """The moving skip rate of each listener: with each event it keeps nine tenths and takes a tenth of whether that was a skip.

    Written as a weighted sum over a listener's last events; older ones are beyond a double's digits, and each task drops
    them before the shuffle (a window group limit)."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = events(spark, sf_dir).select("user_id", "ts", "event_id", "act").withColumn("age", F.row_number().over(newest)).where(F.col("age") <= MEMORY)
    share = F.when(F.col("act") == "skip_early", 0.1 * F.pow(F.lit(0.9), F.col("age") - 1)).otherwise(0.0)
    return last.groupBy("user_id").agg(F.round(F.sum(share), 6).alias("skip_rate"))


@query(f"""WITH {_E}, h AS (SELECT track, max(ts) AS last FROM e WHERE user_id = 7 GROUP BY track)
SELECT p_partkey AS track, round(p_retailprice * coalesce(1 - 0.4::DOUBLE * pow(0.5::DOUBLE, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last)) / 60000000.0::DOUBLE / 30), 1), 6) AS timed,
  round(p_retailprice * CASE WHEN last IS NULL THEN 1 ELSE 0.6::DOUBLE END, 6) AS untimed FROM part LEFT JOIN h ON h.track = p_partkey WHERE p_partkey < 200""")
def recency_penalties(spark, sf_dir):
    """Scores of tracks that a listener heard lately: less by 0.4 at once, halving every 30 minutes; or by 0.4 whenever."""
    heard = events(spark, sf_dir).where("user_id = 7").groupBy("track").agg(F.max("ts").alias("last"))
    minutes = (F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_micros("last")) / 60_000_000.0
    rows = table(spark, sf_dir, "part").where("p_partkey < 200").select(F.col("p_partkey").alias("track"), "p_retailprice").join(heard, "track", "left")
    timed = F.coalesce(1 - 0.4 * F.pow(F.lit(0.5), minutes / 30), F.lit(1.0))
    return rows.select("track", F.round(F.col("p_retailprice") * timed, 6).alias("timed"), F.round(F.col("p_retailprice") * F.when(F.col("last").isNull(), 1.0).otherwise(0.6), 6).alias("untimed"))


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


_TURNS = "c AS (SELECT conv_id, turn, role, length(text)::BIGINT AS chars FROM conversations)"
_BY_CONV = "PARTITION BY conv_id ORDER BY turn"


@query(f"WITH {_TURNS}, g AS (SELECT *, chars > 150 AS gate FROM c) SELECT conv_id, turn FROM g QUALIFY gate AND NOT coalesce(lag(gate) OVER ({_BY_CONV}), false)")
def gate_onsets(spark, sf_dir):
    """Where a gate (a long turn) opens: it is on and was off before."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = _turns(spark, sf_dir).withColumn("gate", F.col("chars") > 150)
    return rows.withColumn("was", F.coalesce(F.lag("gate").over(by), F.lit(False))).where("gate AND NOT was").select("conv_id", "turn")


@query(f"""WITH {_TURNS}, n AS (SELECT *, chars // 200 AS note FROM c WHERE turn % 7 != 5), i AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id, note ORDER BY turn) AS island FROM n)
SELECT conv_id, note, min(turn) AS first, count(*) AS frames FROM i GROUP BY conv_id, note, island""")
def notes(spark, sf_dir):
    """Islands: contiguous frames (turns) of one stream with the same note."""
    rows = _turns(spark, sf_dir).where("turn % 7 != 5").withColumn("note", F.floor(F.col("chars") / 200))
    island = F.col("turn") - F.row_number().over(Window.partitionBy("conv_id", "note").orderBy("turn"))
    return rows.withColumn("island", island).groupBy("conv_id", "note", "island").agg(F.min("turn").alias("first"), F.count("*").alias("frames")).drop("island")


@query(f"""WITH {_E}, w AS (SELECT track, CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS BIGINT) // 6 AS frame, value, ts, event_id FROM e WHERE track < 20),
l AS (SELECT track, frame, arg_max(value, (ts, event_id)) AS value FROM w GROUP BY track, frame), g AS (SELECT t.track, f.frame FROM (SELECT DISTINCT track FROM w) t, (SELECT unnest(range(0, 120)) AS frame) f)
SELECT g.track, g.frame, last_value(value IGNORE NULLS) OVER (PARTITION BY g.track ORDER BY g.frame) AS value FROM g LEFT JOIN l ON l.track = g.track AND l.frame = g.frame""")
def carried_registers(spark, sf_dir):
    """The last write of each register (track) carried forward over all frames of six hours."""
    hours = F.floor((F.unix_seconds("ts") - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / 21_600)
    writes = events(spark, sf_dir).where("track < 20").select("track", hours.alias("frame"), "value", "ts", "event_id")
    last = writes.groupBy("track", "frame").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    grid = writes.select("track").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(119).cast("long"))))
    carried = F.last("value", ignorenulls=True).over(Window.partitionBy("track").orderBy("frame"))
    return grid.join(last, ["track", "frame"], "left").select("track", "frame", carried.alias("value"))


@query(f"WITH {_TURNS}, d AS (SELECT conv_id, abs(chars - lag(chars) OVER ({_BY_CONV})) AS step, turn - lag(turn) OVER ({_BY_CONV}) AS apart FROM c) SELECT conv_id, round(coalesce(avg(step), 0), 6) AS motion, count(*) FILTER (apart = 1 AND step BETWEEN 15 AND 120) AS arpeggios FROM d GROUP BY conv_id")
def motion(spark, sf_dir):
    """How much a value moves from frame to frame, and how many small steps adjacent frames make."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    steps = _turns(spark, sf_dir).select("conv_id", F.abs(F.col("chars") - F.lag("chars").over(by)).alias("step"), (F.col("turn") - F.lag("turn").over(by)).alias("apart"))
    small = (F.col("apart") == 1) & F.col("step").between(15, 120)
    return steps.groupBy("conv_id").agg(F.round(F.coalesce(F.avg("step"), F.lit(0.0)), 6).alias("motion"), F.sum(F.coalesce(small, F.lit(False)).cast("long")).alias("arpeggios"))


@query(f"""WITH {_E}, d AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0::DOUBLE AS d FROM e)
SELECT user_id, count(*) AS onsets, round(CASE WHEN count(*) < 3 THEN 0 ELSE greatest(0, 1 - stddev_pop(d) / avg(d)) END, 6) AS regularity FROM d GROUP BY user_id""")
def rhythm(spark, sf_dir):
    """How even the intervals between a listener's events are: one less their deviation by their mean, 0 for fewer than three events."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gaps = events(spark, sf_dir).select("user_id", ((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(by))) / 1_000_000.0).alias("d"))
    even = F.greatest(F.lit(0.0), 1 - F.stddev_pop("d") / F.avg("d"))
    return gaps.groupBy("user_id").agg(F.count("*").alias("onsets"), F.round(F.when(F.count("*") < 3, 0.0).otherwise(even), 6).alias("regularity"))


@query(f"WITH {_E}, l AS (SELECT act, lag(act) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e) SELECT before, act, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY before), 6) AS share FROM l WHERE before IS NOT NULL GROUP BY before, act")
def transitions(spark, sf_dir):
    """How often one action of a listener follows another."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    counts = events(spark, sf_dir).select("act", F.lag("act").over(by).alias("before")).where("before IS NOT NULL").groupBy("before", "act").agg(F.count("*").alias("n"))
    return counts.select("before", "act", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("before")), 6).alias("share"))


@query(f"WITH {_E} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS average FROM e")
def moving_averages(spark, sf_dir):
    """The mean of a listener's last five values, of fewer at the start."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return events(spark, sf_dir).select("event_id", F.round(F.avg("value").over(by), 6).alias("average"))


@query(f"WITH {_TURNS}, d AS (SELECT conv_id, abs(chars // 100 - lag(chars // 100) OVER ({_BY_CONV})) AS d FROM c) SELECT conv_id, count(*) FILTER (d = 0) AS same, count(*) FILTER (d BETWEEN 1 AND 2) AS steps, count(*) FILTER (d BETWEEN 3 AND 4) AS skips, count(*) FILTER (d > 4) AS leaps FROM d GROUP BY conv_id")
def intervals(spark, sf_dir):
    """Intervals between the notes of a stream, by size."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    note = F.floor(F.col("chars") / 100)
    rows = _turns(spark, sf_dir).select("conv_id", F.abs(note - F.lag(note).over(by)).alias("d"))
    count = lambda test: F.sum(F.coalesce(F.expr(test), F.lit(False)).cast("long"))
    return rows.groupBy("conv_id").agg(*[count(t).alias(n) for n, t in (("same", "d = 0"), ("steps", "d BETWEEN 1 AND 2"), ("skips", "d BETWEEN 3 AND 4"), ("leaps", "d > 4"))])


@query("""WITH p AS (SELECT p_brand AS name, 1 / (1 + count(*))::DOUBLE AS p FROM part GROUP BY p_brand), o AS (SELECT *, row_number() OVER (ORDER BY p, name) AS i, count(*) OVER () AS m FROM p)
SELECT name, round(p, 6) AS p, round(max(least(1, p * (m - i + 1))) OVER (ORDER BY i), 6) AS corrected FROM o""")
def holm(spark, sf_dir):
    """Probabilities of several tests (a row for each brand) corrected step by step: none below one before it, none over 1."""
    tests = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg((1 / (1 + F.count("*"))).alias("p"))
    order = Window.orderBy("p", "name")  # a row for each test
    placed = tests.withColumn("i", F.row_number().over(order)).withColumn("m", F.count("*").over(Window.partitionBy()))
    corrected = F.max(F.least(F.lit(1.0), F.col("p") * (F.col("m") - F.col("i") + 1))).over(order)
    return placed.select("name", F.round("p", 6).alias("p"), F.round(corrected, 6).alias("corrected"))


@query(f"WITH {_E}, d AS (SELECT user_id, track, max(ts) AS ts FROM e GROUP BY user_id, track) SELECT user_id, track, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, track) AS INTEGER) AS place FROM d QUALIFY place <= 20")
def recently_played(spark, sf_dir):
    """The last 20 different tracks of each listener, the latest first (the size of the ring)."""
    last = events(spark, sf_dir).groupBy("user_id", "track").agg(F.max("ts").alias("ts"))
    return last.select("user_id", "track", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "track")).alias("place")).where("place <= 20")


@query(f"WITH {_E} SELECT event_id, count(*) OVER w AS recent, count(*) OVER w <= 3 AS allowed FROM e WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW)")
def rate_limits(spark, sf_dir):
    """Requests of a client in the last twelve hours; more than three are refused."""
    window = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-43_199_999_999, 0)
    recent = F.count("*").over(window)
    return events(spark, sf_dir).select("event_id", recent.alias("recent"), (recent <= 3).alias("allowed"))


@query(f"""WITH {_E}, d AS (SELECT ts::DATE AS day, count(*) AS events FROM e GROUP BY 1), s AS (SELECT *, sum(events) OVER (ORDER BY day) AS upto FROM d)
SELECT day, events, events >= 50 OR day - lag(day) OVER (ORDER BY day) >= 1 AS retrain FROM s""")
def retrain_days(spark, sf_dir):
    """Days on which models are due: fifty new events, or a day since the last time."""
    days = events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"))
    since = F.datediff("day", F.lag("day").over(Window.orderBy("day")))  # a row for each day
    due = (F.col("events") >= 50) | (since >= 1)
    return days.select("day", "events", due.alias("retrain"))


#: New events that make a training due, and seconds after which one is due anyway.
DUE_EVENTS, DUE_AFTER = 50, 86_400


def training_runs(log: DataFrame, poll_seconds: int, due_events: int = DUE_EVENTS, due_after: int = DUE_AFTER) -> DataFrame:
    """polled, events, reason: the polls, one after every ``poll_seconds``, at which a training starts: DUE_EVENTS rows of ``log`` (ts) are
    new since the last one, or DUE_AFTER seconds have gone by ('first' if there was none). Rows that are not
    enough are carried on, and a run starts the count anew.

    The log is counted for each poll first; only these counts, which grow with time and not with the log, are gone through in order."""
    polls = log.where("ts IS NOT NULL").groupBy((F.floor(F.unix_micros("ts") / (poll_seconds * 1_000_000)) + 1).alias("poll")).agg(F.count("*").alias("n"))

    def go(frame: pd.DataFrame) -> pd.DataFrame:
        out, since, last = [], 0, None
        counts = dict(zip(frame["poll"], frame["n"], strict=True))
        for poll in range(min(counts), max(counts) + 1):
            since += int(counts.get(poll, 0))
            reason = "first" if last is None else "events" if since >= due_events else "time" if (poll - last) * poll_seconds >= due_after else None
            if reason:
                out.append((poll * poll_seconds, since, reason))
                since, last = 0, poll
        return pd.DataFrame(out, columns=["at", "events", "reason"])

    found = polls.groupBy(F.lit(0).alias("all")).applyInPandas(go, "at long, events long, reason string")
    return found.select(F.timestamp_seconds("at").cast("timestamp_ntz").alias("polled"), "events", "reason")


@query(f"""WITH RECURSIVE {_E}, p AS (SELECT CAST(floor(epoch_us(ts) / 3600e6) AS BIGINT) + 1 AS poll, count(*) AS n FROM e GROUP BY 1), b AS (SELECT min(poll) AS lo, max(poll) AS hi FROM p),
w AS (SELECT lo AS poll, n AS since, 'first' AS reason, lo AS last FROM b JOIN p ON poll = lo UNION ALL
  SELECT poll, since, CASE WHEN since >= {DUE_EVENTS} THEN 'events' WHEN (poll - last) * 3600 >= {DUE_AFTER} THEN 'time' END, last FROM (
    SELECT w.poll + 1 AS poll, CASE WHEN w.reason IS NULL THEN w.since ELSE 0 END + coalesce(p.n, 0) AS since, CASE WHEN w.reason IS NULL THEN w.last ELSE w.poll END AS last
    FROM w JOIN b ON w.poll < hi LEFT JOIN p ON p.poll = w.poll + 1))
SELECT make_timestamp(poll * 3600000000) AS polled, since AS events, reason FROM w WHERE reason IS NOT NULL""")
def training_schedule(spark, sf_dir):
    """The hours at which a training starts."""
    return training_runs(events(spark, sf_dir), 3600)


@query(f"WITH {_E} SELECT event_id, user_id, track, act FROM e WHERE act != 'play' ORDER BY ts DESC, event_id DESC LIMIT 100")
def activity_feed(spark, sf_dir):
    """The 100 latest events that are more than plays."""
    return events(spark, sf_dir).where("act != 'play'").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id", "track", "act")
