"""Numbers and timestamps read from text, and arithmetic with the engine's rules for missing values.

Missing is NULL throughout: NaN and unparsable text become NULL, and division
by zero gives NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats of timestamps in disclosure files, tried in order (fixed values).
TIMESTAMP_FORMATS = ("MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
#: Texts that stand for a missing value (fixed values).
MISSING = ("", "NA", "N/A", "NAN", "NULL", "NONE", "#N/A", "<NA>")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c: str | Column) -> Column:
    """NULL in place of NaN."""
    return F.when(~F.isnan(col(c)), col(c))


def number(c: str | Column) -> Column:
    """Double from text; what is no number is NULL, NaN too."""
    text = F.trim(col(c).cast("string"))
    return no_nan(F.when(~F.upper(text).isin(*MISSING), text).try_cast("double"))


def finite(c: str | Column) -> Column:
    """The value where it is a finite number."""
    return F.when(~F.isnan(col(c)) & (F.abs(col(c)) < float("inf")), col(c))


def timestamp(c: str | Column, formats: tuple[str, ...] = TIMESTAMP_FORMATS) -> Column:
    """Timestamp without zone from text in any of ``formats``; else NULL."""
    text = F.trim(col(c))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def ratio(above: str | Column, below: str | Column) -> Column:
    """Division that is NULL where the divisor is zero."""
    return F.try_divide(col(above), col(below))


def half_even(c: str | Column, digits: int = 4) -> Column:
    return F.bround(col(c), digits)


def total(c: str | Column) -> Column:
    """Sum that is zero where all values are missing."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    """Sum of value times weight over the sum of weights where that is positive."""
    weights = F.sum(F.when(col(value).isNotNull(), col(weight)))
    return F.when(weights > 0, F.sum(col(value) * col(weight)) / weights)


def hour_ending(ts: str | Column) -> Column:
    """Hours 1 to 24."""
    return F.hour(col(ts)) + 1


def hour_start(ts: str | Column) -> Column:
    return F.date_trunc("hour", col(ts)).cast("timestamp_ntz")


def interval_start(day: str | Column, hour: str | Column, quarter: str | Column) -> Column:
    """Timestamp of a delivery date, hour ending 1-24 and quarter hour 1-4."""
    return (col(day).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), col(hour).cast("int") - 1, (col(quarter).cast("int") - 1) * 15)).cast("timestamp_ntz")


def band(score: str | Column, high: float = 220, medium: float = 165) -> Column:
    """Confidence of a match by its score."""
    return F.when(col(score).isNull(), "Unmatched").when(col(score) >= high, "High").when(col(score) >= medium, "Medium").otherwise("Low")


def first_rule(*rules: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The text of the first condition that holds."""
    chain = reduce(lambda made, rule: made.when(*rule), rules[1:], F.when(*rules[0]))
    return chain if otherwise is None else chain.otherwise(otherwise)


def last_pattern(text: str | Column, patterns: list[tuple[str, str]], otherwise: Column) -> Column:
    """The name of the last regular expression that occurs in ``text``, in any case."""
    return first_rule(*[(F.lower(col(text)).rlike(p), name) for p, name in reversed(patterns)]).otherwise(otherwise)
