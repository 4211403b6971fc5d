"""Text and array expressions: age labels, popups, column titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Age ranges of the table labels that are widened to one common band.
RANGE_PATCHES = {(65, 66): (65, 69), (67, 69): (65, 69)}


def digits_in(text: Column) -> Column:
    """All runs of digits in the text, as numbers; NULL for one that is too long for an int."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda d: d.try_cast("int"))


def ages_of_label(text: Column, patches: dict[tuple[int, int], tuple[int, int]] | None = None) -> Column:
    """Array of the ages an age label covers.

    'under' or '<' with a single number means ages 0 to 4; otherwise the ages run
    from the smallest to the largest number of the label.
    """
    patches = RANGE_PATCHES if patches is None else patches
    numbers = digits_in(text)
    under = (F.size(numbers) == 1) & F.lower(text).rlike("under|<")
    ages = F.when(under, F.sequence(F.lit(0), F.lit(4))).otherwise(
        F.sequence(F.array_min(numbers), F.array_max(numbers))
    )
    for (low, high), (new_low, new_high) in patches.items():
        ages = F.when(
            ages == F.sequence(F.lit(low), F.lit(high)), F.sequence(F.lit(new_low), F.lit(new_high))
        ).otherwise(ages)
    return ages


def band_midpoint(ages: Column) -> Column:
    """Mean of the ages together with the age after the last one."""
    total = F.aggregate(ages, F.lit(0), lambda acc, a: acc + a) + F.element_at(ages, -1) + 1
    return total / (F.size(ages) + 1)


def popup_text(*columns: str) -> Column:
    """'name: value' for each column, joined by line breaks; missing values are written 'NA'."""
    parts = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("NA"))) for c in columns]
    return F.concat_ws("<br>", *parts)


def percent_label(share: Column, digits: int = 2) -> Column:
    return F.concat(F.lit("Percent: "), F.bround(100 * share, digits).cast("string"))


def title_from(name: str, drop_last: int, prefix: str = "", suffix: str = "") -> str:
    """Column title built on the driver: cut the tail, capitalise, add prefix and suffix."""
    return f"{prefix}{name[:len(name) - drop_last].capitalize()}{suffix}"
