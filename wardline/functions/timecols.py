"""Scalar time and arithmetic expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import _c

# LOS class edges in days, [0,3), [3,7), [7,14), [14,inf).
LOS_EDGES = (0.0, 3.0, 7.0, 14.0, float("inf"))
LOS_LABELS = ("0-3", "3-7", "7-14", "14+")


def parse_ts(c) -> Column:
    """K1: text -> timestamp, unparsable -> NULL."""
    return F.try_to_timestamp(_c(c).cast("string"))


def hours_between(end, start) -> Column:
    """(end - start) in hours as DOUBLE; NULL if either is NULL."""
    return (F.unix_micros(_c(end)) - F.unix_micros(_c(start))) / F.lit(3.6e9)


def clip_lower(x, lo: float) -> Column:
    """K7: max(lo, x) keeping NULL as NULL (``greatest`` alone would turn NULL into lo)."""
    return F.when(_c(x).isNotNull(), F.greatest(_c(x), F.lit(lo)))


def clip(x, lo: float, hi: float) -> Column:
    """K7: clip to [lo, hi], NULL stays NULL."""
    return F.when(_c(x).isNotNull(), F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi)))


def los_hours(admit, disch, death=None) -> Column:
    """K2: stay in hours, discharge falling back to death time, clipped at 0, else NULL."""
    end = F.coalesce(_c(disch), _c(death)) if death is not None else _c(disch)
    return clip_lower(hours_between(end, admit), 0.0)


def weekday(ts) -> Column:
    """K4: 0 = Monday ... 6 = Sunday."""
    return F.weekday(_c(ts))


def weekend_flag(ts) -> Column:
    """K5: 1 on Saturday/Sunday, 0 otherwise (NULL -> 0)."""
    return F.coalesce((F.weekday(_c(ts)) >= 5).cast("int"), F.lit(0))


def age_at_admit(anchor_age, anchor_year, adm_year) -> Column:
    """K6 + C6: anchor age shifted by admission year; outside 0..120 -> NULL (DOUBLE)."""
    a = (_c(anchor_age).cast("double") + (_c(adm_year) - _c(anchor_year)).cast("double"))
    return F.when((a >= 0) & (a <= 120), a)


def los_class(days, edges=LOS_EDGES) -> Column:
    """Index k of the interval [e_k, e_k+1) holding ``days``; NULL or no match -> last."""
    last = len(edges) - 2
    expr = None
    for k in range(len(edges) - 1):
        cond = (_c(days) >= F.lit(edges[k])) & (_c(days) < F.lit(edges[k + 1]))
        expr = F.when(cond, F.lit(k)) if expr is None else expr.when(cond, F.lit(k))
    return F.coalesce(expr.otherwise(F.lit(last)), F.lit(last)).cast("int")


def threshold(p, t) -> Column:
    """1 where p >= t."""
    return (_c(p) >= F.lit(t) if not isinstance(t, Column) else _c(p) >= t).cast("int")


def sigmoid(x) -> Column:
    """K9."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def softmax(arr) -> Column:
    """K9: numerically stable softmax of an array<double>."""
    m = F.array_max(_c(arr))
    ex = F.transform(_c(arr), lambda v: F.exp(v - m))
    tot = F.aggregate(ex, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(ex, lambda v: v / tot)


def argmax(arr) -> Column:
    """K9: 0-based position of the first maximum."""
    return (F.array_position(_c(arr), F.array_max(_c(arr))) - 1).cast("int")


def finite(x) -> Column:
    """Not NULL, not NaN, not infinite."""
    d = _c(x).cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))


# Types whose values become the same DOUBLE with and without a detour by their text.
EXACT_NUMBERS = ("tinyint", "smallint", "int", "bigint", "double")


def to_number(c, default: float | None = 0.0, kind: str | None = None) -> Column:
    """Coerce to DOUBLE; unparsable -> default (``try_cast`` never raises under ANSI).

    With ``kind``, the type of ``c``, a number is not written out and parsed again."""
    d = _c(c).cast("double") if kind in EXACT_NUMBERS else _c(c).cast("string").try_cast("double")
    d = F.when(~F.isnan(d), d)
    return F.coalesce(d, F.lit(default)) if default is not None else d
