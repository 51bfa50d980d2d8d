"""Scalar expressions shared by the operators; all of them are built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_minutes(ts: str | Column) -> Column:
    """Whole minutes since 1970 of a timestamp without time zone (or a UTC one)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MINUTE", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double, null where b is 0 or null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a.cast("double"), b.cast("double"))


def share(a: Column, b: Column) -> Column:
    """Like ratio, but 0.0 where there is nothing to share."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ladder(x: Column, steps: Sequence[tuple[float, str]], other: str, descending: bool = False) -> Column:
    """The first band whose bound holds: x <= bound, or x >= bound if descending."""
    hit = lambda b: x >= F.lit(b) if descending else x <= F.lit(b)
    return reduce(lambda rest, s: F.when(hit(s[0]), F.lit(s[1])).otherwise(rest), reversed(list(steps)), F.lit(other))


def codes(rules: Sequence[tuple[Column, str]], keep: int | None = None, default: str | None = None) -> Column:
    """The names of the rules that hold, in the order given, cut to `keep`; `default` alone if none holds."""
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))
    if default:
        found = F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)
    return F.slice(found, 1, keep) if keep else found


#: What stands for a missing part of a key, and the key of the unknown member.
UNKNOWN, UNKNOWN_KEY = "UNKNOWN", "SK_UNKNOWN"


def surrogate_key(prefix: str, *parts: str | Column) -> Column:
    """<prefix>_ and the first 16 hex digits (upper case) of the SHA-256 of the parts joined by `|`. Null and empty parts count as
    UNKNOWN; a key of one such part is UNKNOWN_KEY."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    joined = F.concat_ws("|", *[F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(UNKNOWN)) for c in cols])
    return F.when(joined == UNKNOWN, F.lit(UNKNOWN_KEY)).otherwise(F.concat(F.lit(prefix + "_"), F.upper(F.substring(F.sha2(joined, 256), 1, 16))))


def short_id(prefix: str, *parts: str | Column) -> Column:
    """prefix-XXXXXXXXXX: the first ten hex digits (upper case) of the SHA-1 of the parts joined by `|`."""
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 10)))


def known(x: str | Column) -> Column:
    """Null and blank become UNKNOWN."""
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit("UNKNOWN"))


def calendar(ts: str | Column) -> dict[str, Column]:
    """Hour, weekday (Monday = 0), weekend flag, month, day of year, and cyclic hour and weekday."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    hour, weekday = F.hour(ts), F.weekday(ts)
    turn = 6.283185307179586
    return {
        "hour": hour, "weekday": weekday, "is_weekend": (weekday >= 5).cast("int"), "month": F.month(ts), "day_of_year": F.dayofyear(ts),
        "hour_sin": F.sin(hour * turn / 24), "hour_cos": F.cos(hour * turn / 24), "weekday_sin": F.sin(weekday * turn / 7), "weekday_cos": F.cos(weekday * turn / 7),
    }


def age_years(commissioned: Column, at: Column) -> Column:
    return F.greatest(F.datediff(at, commissioned), F.lit(0)) / F.lit(365.25)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def tokens(text: str | Column) -> Column:
    """Lower-case runs of ASCII letters, digits, _ and - that don't begin with -; accents split words."""
    text = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9_][A-Za-z0-9_-]*"), F.lit(0)), F.lower)


def family(x: Column, rules: Sequence[tuple[Sequence[str], str]], other: str) -> Column:
    """The first family one of whose words the value contains."""
    lowered = F.lower(F.coalesce(x, F.lit("")))
    any_of = lambda ws: reduce(Column.__or__, [F.contains(lowered, F.lit(w)) for w in ws])
    return reduce(lambda rest, r: F.when(any_of(r[0]), F.lit(r[1])).otherwise(rest), reversed(list(rules)), F.lit(other))
