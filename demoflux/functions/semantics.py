"""Scalar rules for survey tables: missing values, binning, padding and rounding.

Every helper returns a Column built from JVM expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _column(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def interval_index(x: ColumnLike, width: float, origin: Column | float = 0) -> Column:
    """Zero-based bin of x in equal-width bins closed on the right; the first is closed on both ends."""
    steps = (_column(x) - origin) / F.lit(width)
    return F.greatest(F.ceil(steps).cast("int") - 1, F.lit(0))


def age_band(age: ColumnLike, width: int = 5, origin: Column | int = 0) -> Column:
    """Lower label of the age band; NULL ages stay NULL."""
    age = _column(age)
    return F.when(age.isNotNull(), interval_index(age, width, origin) * width)


def short_number(x: Column) -> Column:
    """Text of a number without a trailing '.0'."""
    return F.regexp_replace(F.round(x, 6).cast("string"), r"\.0$", "")


def interval_label(x: ColumnLike, width: float, origin: Column | float = 0) -> Column:
    """Labels '[a,b]' for the first bin and '(a,b]' for the others."""
    x = _column(x)
    origin = origin if isinstance(origin, Column) else F.lit(float(origin))
    index = interval_index(x, width, origin)
    low, high = origin + index * F.lit(float(width)), origin + (index + 1) * F.lit(float(width))
    opening = F.when(index == 0, "[").otherwise("(")
    return F.when(x.isNotNull(), F.concat(opening, short_number(low), F.lit(","), short_number(high), F.lit("]")))


def cut_right(x: ColumnLike, breaks: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Class of x in bins (low, high]; values outside every bin are NULL."""
    x = _column(x)
    if labels is None:
        labels = [f"({_break_text(a)},{_break_text(b)}]" for a, b in zip(breaks, breaks[1:])]
    if len(labels) != len(breaks) - 1:
        raise ValueError("one label per bin is needed")
    ladder = None
    for low, high, label in zip(breaks, breaks[1:], labels):
        inside = (x > F.lit(float(low))) & (x <= F.lit(float(high)))
        ladder = F.when(inside, label) if ladder is None else ladder.when(inside, label)
    return ladder


def _break_text(value: float) -> str:
    if value in (float("inf"), float("-inf")):
        return "Inf" if value > 0 else "-Inf"
    return f"{value:g}"


def if_else_na(condition: Column, yes, no) -> Column:
    """Two-way choice that is NULL when the condition is NULL."""
    return F.when(condition.isNull(), None).when(condition, yes).otherwise(no)


def in_set(x: ColumnLike, values: Sequence) -> Column:
    """Membership that is FALSE, never NULL, for a NULL value."""
    return F.coalesce(_column(x).isin(list(values)), F.lit(False))


def safe_div(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Ratio that is NULL where the denominator is 0."""
    return F.try_divide(_column(numerator), _column(denominator))


def pad_code(code: ColumnLike, digits: int) -> Column:
    """Zero-padded text of an integer code; longer codes are kept whole, NULL stays NULL."""
    code = _column(code)
    text = code.cast("string")
    padded = F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text)
    return F.when(code >= 0, padded).when(code < 0, F.format_string(f"%0{digits}d", code))


def paste(separator: str, *parts: ColumnLike) -> Column:
    """Join as text with missing parts written 'NA'."""
    texts = [F.coalesce(_column(p).cast("string"), F.lit("NA")) for p in parts]
    return F.concat_ws(separator, *texts)


def to_number(text: ColumnLike) -> Column:
    """Number read from text, NULL where the text is no number."""
    return _column(text).try_cast("double")


def year_of_range(text: ColumnLike, ranges: dict[str, int]) -> Column:
    """Year from a label: listed ranges become their year, other non-numbers become NULL."""
    text = _column(text)
    year = text.try_cast("int")
    for label, value in ranges.items():
        year = F.when(text == label, F.lit(value)).otherwise(year)
    return year


def round_even(x: ColumnLike, digits: int = 0) -> Column:
    """Rounding with ties to the even digit."""
    return F.bround(_column(x), digits)


def significant(x: ColumnLike, digits: int) -> Column:
    """x rounded to a number of significant digits."""
    x = _column(x).cast("double")
    scale = F.pow(F.lit(10.0), F.lit(digits - 1.0) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * scale) / scale)


def is_finite(x: ColumnLike) -> Column:
    """TRUE for present values that are neither NaN nor infinite."""
    x = _column(x).cast("double")
    infinite = (x == F.lit(float("inf"))) | (x == F.lit(float("-inf")))
    return F.coalesce(~F.isnan(x) & ~infinite & x.isNotNull(), F.lit(False))


def inverse_logit(x: ColumnLike) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_column(x)))
