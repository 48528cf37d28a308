"""IEEE arithmetic on double columns under ANSI mode, and the per-sample functions of the query languages.

Spark raises on division by zero, gives null for logarithms of non-positive numbers and orders NaN above everything; these helpers restore the results
that the query languages define.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def divide(a: Column, b: Column) -> Column:
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend; NaN for a zero divisor."""
    return F.when(b == 0, F.lit(NAN)).otherwise(a % F.when(b != 0, b))


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": divide,
    "%": modulo,
    "^": power,
}


def _ordered(compare: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: ~F.isnan(a) & ~F.isnan(b) & compare(a, b)


COMPARISON: dict[str, Callable[[Column, Column], Column]] = {
    "==": _ordered(lambda a, b: a == b),
    "!=": lambda a, b: F.isnan(a) | F.isnan(b) | (a != b),
    ">": _ordered(lambda a, b: a > b),
    "<": _ordered(lambda a, b: a < b),
    ">=": _ordered(lambda a, b: a >= b),
    "<=": _ordered(lambda a, b: a <= b),
}


def _whole(v: Column, f: Callable[[Column], Column]) -> Column:
    """Spark rounds to BIGINT; beyond 2**53 every double is whole already, and NaN and infinities stay."""
    return F.when(F.isnan(v) | (F.abs(v) >= 2.0**53), v).otherwise(f(v).cast("double"))


def ceil(v: Column) -> Column:
    return _whole(v, F.ceil)


def floor(v: Column) -> Column:
    return _whole(v, F.floor)


def log(v: Column, f: Callable[[Column], Column] = F.log) -> Column:
    return F.when(F.isnan(v), F.lit(NAN)).when(v == 0, F.lit(-INF)).when(v < 0, F.lit(NAN)).otherwise(f(F.when(v > 0, v)))


def round_to(v: Column, to: float = 1.0) -> Column:
    """Nearest multiple of ``to``, halves up; NaN for 0."""
    if to == 0:
        return F.lit(NAN) + v * 0
    inverse = 1.0 / to
    return floor(v * inverse + 0.5) / inverse


def clamp_min(v: Column, least: Column) -> Column:
    return F.greatest(v, least)


def clamp_max(v: Column, most: Column) -> Column:
    return F.when(F.isnan(v) | F.isnan(most), F.lit(NAN)).otherwise(F.least(v, most))


def _date(part: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def of(v: Column) -> Column:
        good = ~F.isnan(v) & (F.abs(v) < 2.5e11)
        seconds = F.floor(F.when(good, v))
        # UTC whatever the session's zone: days since 1970 and seconds within the day
        return F.when(good, part(seconds).cast("double")).otherwise(F.lit(NAN))

    return of


def _day(s: Column) -> Column:
    return F.date_from_unix_date(F.floor(s / 86400).cast("int"))


DATE: dict[str, Callable[[Column], Column]] = {
    "minute": _date(lambda s: F.floor(F.pmod(s, F.lit(3600)) / 60)),
    "hour": _date(lambda s: F.floor(F.pmod(s, F.lit(86400)) / 3600)),
    "day_of_week": _date(lambda s: F.dayofweek(_day(s)) - 1),
    "day_of_month": _date(lambda s: F.dayofmonth(_day(s))),
    "days_in_month": _date(lambda s: F.dayofmonth(F.last_day(_day(s)))),
    "month": _date(lambda s: F.month(_day(s))),
    "year": _date(lambda s: F.year(_day(s))),
}

MATH: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs,
    "ceil": ceil,
    "floor": floor,
    "exp": F.exp,
    "sqrt": F.sqrt,
    "ln": log,
    "log2": lambda v: log(v, F.log2),
    "log10": lambda v: log(v, F.log10),
    "sgn": lambda v: F.when(F.isnan(v), v).otherwise(F.signum(v)),
}
