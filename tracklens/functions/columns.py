"""Column functions of the music domain; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Events as feedback actions, and what each action weighs.
ACTIONS = {"view": "play", "click": "like", "purchase": "replay", "signup": "play_complete", "error": "skip_early"}
HALF_LIFE_DAYS = 90.0


def action(event_type: Column) -> Column:
    """The feedback action that an event type stands for; unknown types stay as they are."""
    pairs = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, event_type), event_type)


def track(props: Column) -> Column:
    """The track that an event's JSON properties name."""
    return F.get_json_object(props, "$.k").cast("long")


def age_days(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts.cast("timestamp"))) / F.lit(86_400_000_000.0)


def decay(ts: Column, now: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """0.5 after each half-life, 1 for the future, 0 for no time."""
    age = age_days(ts, now)
    return F.when(age.isNull(), 0.0).otherwise(F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / half_life))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def dot(a: Column, b: Column) -> Column:
    """Over the shorter of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where one of the vectors is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


# Words that say nothing about a title.
STOP_WORDS = ["sid", "mix", "remix", "version", "extended", "ost", "theme", "live", "edit", "feat", "featuring", "game", "c64", "the", "a", "an", "and", "or", "of", "in", "on"]


def tokens(text: Column) -> Column:
    """Distinct lower-case words of letters and digits, longer than one character and no stop words, in order of letters."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))))


def title_similarity(a: Column, b: Column) -> Column:
    """Of two lists of words: the greater of their Jaccard similarity and, where one joined by spaces contains the
    other (of four characters at least), the share of its length."""
    x, y = F.array_join(a, " "), F.array_join(b, " ")
    low, high = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    inside = (F.contains(x, y) | F.contains(y, x)) & (low >= 4)
    return F.greatest(jaccard(a, b), F.when(inside, low / high).otherwise(0.0))


def jaccard(a: Column, b: Column) -> Column:
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(any_ > 0, both / any_).otherwise(0.0)
