"""Recodes of person records into population groups.

The code lists below are fixed values of the survey's own coding scheme.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from demoflux.functions.semantics import cut_right, if_else_na, in_set

# Survey codes.
HISPANIC_CODES = [1, 2, 3, 4]
NATIVE_BELOW = 100
MEXICO = 200
CENTRAL_AMERICA_CARIBBEAN = [210, 250, 260]
SOUTH_AMERICA = 300
ABROAD_OR_UNKNOWN_MOVE = [0, 20, 40]
MOVED_AREA_FROM = 24
PUBLIC_WORKER_CLASSES = [24, 25, 26, 27, 28]
CONTROL_STATES = [6, 32]

# Labels of the recoded groups, in display order.
ORIGIN_6 = ["Native Hispanic", "Native Non-Hispanic", "Central America/Caribbean", "South America", "Mexico", "Other"]
ORIGIN_9 = ["Native Hispanic", "Native White", "Native Black", "Native Asian", "Native Other",
            "Central America/Caribbean", "South America", "Mexico", "Other Migrant"]
ANALYSIS_GROUPS = ["Native Hispanic", "Native White", "Mexico", "Other Migrant"]
EDUCATION_LEVELS = ["Below High School", "High School", "Some College", "College"]
ETHNICITY_CITIZENSHIP = ["Native White", "Native Latino", "FB Latino Citizen", "FB Latino Non-Citizen"]
RACE_COLOURS = {"White": "Blue", "Black": "Green", "Asian": "Pink", "Hispanic": "Red"}
OTHER_COLOUR = "Yellow"


def is_hispanic() -> Column:
    return in_set("HISPAN", HISPANIC_CODES)


def is_native() -> Column:
    return F.col("BPL") < NATIVE_BELOW


def race(asian_codes: list[int] | None = None) -> Column:
    """Race group; NULL when no listed group applies. Asian is split off when its codes are given."""
    result = F.when(is_hispanic(), "Hispanic").when(F.col("RACE") == 1, "White").when(F.col("RACE") == 2, "Black")
    if asian_codes:
        result = result.when(F.col("RACE").isin(asian_codes), "Asian")
    return result


def race_or_other(group: Column) -> Column:
    return F.coalesce(group, F.lit("Other"))


def birthplace() -> Column:
    return (
        F.when(is_native(), "Native")
        .when(F.col("BPL").isin(CENTRAL_AMERICA_CARIBBEAN), "CentralAmerica/Caribbean")
        .when(F.col("BPL") == SOUTH_AMERICA, "SouthAmerica")
        .when(F.col("BPL") == MEXICO, "Mexico")
        .otherwise("Other")
    )


def origin_six() -> Column:
    """Native residents split by Hispanic ethnicity, migrants by birthplace."""
    return (
        F.when(is_native() & is_hispanic(), "Native Hispanic")
        .when(is_native(), "Native Non-Hispanic")
        .when(F.col("BPL").isin(CENTRAL_AMERICA_CARIBBEAN), "Central America/Caribbean")
        .when(F.col("BPL") == SOUTH_AMERICA, "South America")
        .when(F.col("BPL") == MEXICO, "Mexico")
        .otherwise("Other")
    )


def _native_by_race() -> Column:
    return (
        F.when(is_native() & is_hispanic(), "Native Hispanic")
        .when(is_native() & (F.col("RACE") == 1), "Native White")
        .when(is_native() & (F.col("RACE") == 2), "Native Black")
        .when(is_native() & (F.col("RACE") == 4), "Native Asian")
        .when(is_native(), "Native Other")
    )


def origin_nine() -> Column:
    """Native residents split by race, migrants by birthplace."""
    return (
        _native_by_race()
        .when(F.col("BPL").isin(CENTRAL_AMERICA_CARIBBEAN), "Central America/Caribbean")
        .when(F.col("BPL") == SOUTH_AMERICA, "South America")
        .when(F.col("BPL") == MEXICO, "Mexico")
        .otherwise("Other Migrant")
    )


def origin_collapsed() -> Column:
    """Native residents split by race, migrants only into Mexico and the rest."""
    return _native_by_race().when(F.col("BPL") == MEXICO, "Mexico").otherwise("Other Migrant")


def origin_latino_study() -> Column:
    return (
        F.when(is_native() & is_hispanic(), "Native Hispanic")
        .when(is_native(), "Native Other")
        .when(F.col("BPL") == MEXICO, "Mexico")
        .otherwise("Other Migrant")
    )


def foreign_born() -> Column:
    return F.col("YRIMMIG") != 0


def moved_area() -> Column:
    return F.col("MIGRATE1D") >= MOVED_AREA_FROM


def moved_county() -> Column:
    return F.col("MIGCOUNTY1") != 0


def arrived_from_mexico(prior_place: str = "MIGPLAC1", moved: str = "hasMigrated") -> Column:
    """Whether a mover came from Mexico (place code '99'); NULL for people who did not move."""
    return if_else_na(F.col(moved), F.col(prior_place) == "99", F.lit(None).cast("boolean"))


def sex_label() -> Column:
    return F.when(F.col("SEX") == 1, "Male").when(F.col("SEX").isNotNull(), "Female")


def education() -> Column:
    years = F.col("EDUC")
    return (
        F.when(years < 6, EDUCATION_LEVELS[0])
        .when(years == 6, EDUCATION_LEVELS[1])
        .when((years > 6) & (years < 10), EDUCATION_LEVELS[2])
        .when(years >= 10, EDUCATION_LEVELS[3])
    )


def level_order(x: str, levels: list[str]) -> Column:
    """Position of a label in an explicit order, counted from 1."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(x)).cast("int")
    return F.when(position > 0, position)


def citizen() -> Column:
    return F.col("CITIZEN") < 3


def likely_undocumented() -> Column:
    return (
        (F.col("CITIZEN") >= 3)
        & (F.col("YRIMMIG") >= 1990)
        & (F.col("EDUC") <= 7)
        & (F.col("SCHOOL") != 2)
        & ~in_set("CLASSWKRD", PUBLIC_WORKER_CLASSES)
    )


def has_child() -> Column:
    return F.col("NCHILD") != 0


def married() -> Column:
    return F.col("MARST") <= 2


def born_in_mexico() -> Column:
    return F.col("BPL") == MEXICO


def ethnicity_citizenship() -> Column:
    foreign_latino = (F.col("BPL") >= 150) & is_hispanic()
    return (
        F.when(is_native() & is_hispanic(), "Native Latino")
        .when(is_native() & (F.col("RACE") == 1), "Native White")
        .when(foreign_latino & citizen(), "FB Latino Citizen")
        .when(foreign_latino & ~citizen(), "FB Latino Non-Citizen")
    )


def ethnicity_legal_status() -> Column:
    latin_born = F.col("BPL").isin(200, 210, 300)
    return (
        F.when(is_native() & is_hispanic(), "Native Hispanic")
        .when(is_native() & (F.col("RACE") == 1), "Native White")
        .when(latin_born & citizen(), "FB Latino Citizen")
        .when(latin_born & likely_undocumented(), "FB Latino Undocumented")
        .when(latin_born & ~citizen(), "FB Latino Non-Citizen")
    )


def left_state(state: int) -> Column:
    return (F.col("MIGPLAC1") == state) & (F.col("STATEFIP") != state)


def left_control() -> Column:
    """People who lived in one of the control states a year ago; a missing place is none of them."""
    return in_set(F.col("MIGPLAC1"), CONTROL_STATES)


def at_risk_of_leaving(state: int) -> Column:
    """People who left the state, and people who lived in it and stayed."""
    return left_state(state) | (F.col("MIGPLAC1").isin(0, state) & (F.col("STATEFIP") == state))


def working_age_group() -> Column:
    return cut_right("AGE", [17, 29, 39, 49, 65])


def had_child_last_year() -> Column:
    """0 or 1 from the fertility answer; other answers are NULL."""
    return F.when(F.col("FERTYR").isin(1, 2), F.col("FERTYR") - 1)


def race_from_label(code: str, label: str, total_code: str, hispanic_code: str) -> Column:
    """Race group of a table variable: exact codes first, then words of its label."""
    text = F.col(label)
    return (
        F.when(F.col(code) == total_code, "Total")
        .when(text.rlike("White"), "White")
        .when(text.rlike("Black"), "Black")
        .when(text.rlike("Asian|Pacific"), "Asian")
        .when(F.col(code) == hispanic_code, "Hispanic")
        .otherwise("Other")
    )


def race_colour(group: str) -> Column:
    result = None
    for name, colour in RACE_COLOURS.items():
        hit = F.col(group) == name
        result = F.when(hit, colour) if result is None else result.when(hit, colour)
    return result.otherwise(OTHER_COLOUR)


def growth_quadrant(hispanic: str, white: str) -> Column:
    """Which group's growth or decline is larger; ties and other signs are NULL."""
    h, w = F.col(hispanic), F.col(white)
    return (
        F.when((h > 0) & (w > 0) & (w > h), "White Growth Outpaces Hispanic Growth")
        .when((h > 0) & (w > 0) & (w < h), "Hispanic Growth Outpaces White Growth")
        .when((h > 0) & (w < 0) & (F.abs(w) > h), "White Decline Outpaces Hispanic Growth")
        .when((h > 0) & (w < 0) & (F.abs(w) < h), "Hispanic Growth Outpaces White Decline")
    )
