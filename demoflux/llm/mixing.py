"""Mixing sources to target weights: proportional fitting of token weights, then calibrated sampling.

Documents are first summed to cells (one per value of every margin), so fitting never sees the
documents again. All work is done by Spark's own functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demoflux.llm.common import WORD, discard, store, uniform

TOLERANCE = 1e-6  # by how much a value's share of the tokens may differ from its target
MAX_ROUNDS = 200
PATIENCE = 5  # rounds without headway after which margins count as contradicting each other
ONCE_ROUNDS = 12
STEPS_PER_TABLE = 4

#: A margin's target: an exponent of its natural shares, or weights of its values (None: the missing one).
Target = float | Mapping[str | None, float]


def token_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def style(text: str = "text") -> Column:
    """A topic by form: what a text looks like is all that can be told without a model."""
    has = lambda part: F.coalesce(F.col(text).contains(part), F.lit(False))
    return (
        F.when(has("icensed under"), "licence").when(has(" | "), "table")
        .when(has("$$$") | has("***"), "symbols").when(has("!!"), "loud").otherwise("prose"))


def rake(
    cells: DataFrame, values: Mapping[str, DataFrame], tolerance: float = TOLERANCE, rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """Iterative proportional fitting. Adds `fitted`: the cells' shares, scaled until they meet each margin's goals.

    `cells` has one row per cell with a positive `tokens`; `values` holds for each margin a table of its values and
    their `goal`, which sum to 1. The cells stay as they are: each step sums them by one margin, times the
    factors of the others, and stores that margin's new factors. Sums combine before the shuffle, so a value may have
    any part of the cells. Fitting ends when a round finds every share within `tolerance` of its goal, or when for
    some rounds the largest miss does not shrink, as with margins that contradict each other; then the last margin is met.
    """
    names = list(values)
    # a margin's table: value, goal, factor
    factors = {m: values[m].select(m, F.col("goal").alias(f"{m}_goal"), F.lit(1.0).alias(f"{m}_factor")) for m in names}
    written: dict[str, DataFrame] = {}

    def weighted(by: list[str]) -> tuple[DataFrame, Column]:
        joined = reduce(lambda df, m: df.join(factors[m].select(m, f"{m}_factor"), m), by, cells)
        return joined, reduce(lambda w, m: w * F.col(f"{m}_factor"), by, F.col("tokens").cast("double"))

    least, stale = float("inf"), 0
    for turn in range(rounds):
        for m in names:
            joined, weight = weighted([n for n in names if n != m])
            total, goal = F.col("__sum"), F.col(f"{m}_goal")
            step = joined.groupBy(m).agg(F.sum(weight).alias("__sum")).join(factors[m], m).select(
                m, goal, F.when(total > 0, goal / total).otherwise(F.lit(0.0)).alias(f"{m}_factor"),
                F.abs(total * F.col(f"{m}_factor") - goal).alias("miss"))
            step = store(step, "factors")
            if m in written:
                discard(written[m])
            written[m] = factors[m] = step
        worst = reduce(DataFrame.unionAll, [written[m].select("miss") for m in names]).agg(F.max("miss")).first()[0] or 0.0
        # the first round starts from tokens, not from shares, so its misses say nothing
        if turn and worst <= tolerance:
            break
        stale = 0 if not turn or worst < 0.99 * least else stale + 1
        least = min(least, worst) if turn else least
        if stale >= PATIENCE:
            break
    joined, weight = weighted(names)
    fitted = store(joined.select(*cells.columns, weight.alias("fitted")), "raked")
    discard(*written.values())
    return fitted


def reachable(cells: DataFrame, targets: Mapping[str, str], total: float) -> DataFrame:
    """Adds each margin's goal, `<margin>_goal`: the tokens of its value in a sample of `total` tokens without repeats.

    A goal is the target share of `total`, but no more than the value has (`<margin>_tokens`). What such values fall
    short of goes to the margin's other values by their targets, so every margin's goals sum to `total`. Each
    turn finds more values that are used up or is the last.
    """
    scales = {m: total for m in targets}
    while True:
        spent = {m: F.col(target) * F.lit(scales[m]) >= F.col(f"{m}_tokens") for m, target in targets.items()}
        sums = cells.agg(
            *[F.coalesce(F.sum(F.when(spent[m], F.col("tokens"))), F.lit(0)).alias(f"{m}_spent") for m in targets],
            # a value's target is counted once in all, by the parts that its cells have of it
            *[F.coalesce(F.sum(F.when(~spent[m], F.col(target) * F.col("tokens") / F.col(f"{m}_tokens"))), F.lit(0.0)).alias(
                f"{m}_rest") for m, target in targets.items()]).first()
        new = {m: (total - sums[f"{m}_spent"]) / sums[f"{m}_rest"] if sums[f"{m}_rest"] > 0 else s for m, s in scales.items()}
        if all(new[m] <= scales[m] * (1 + 1e-12) for m in targets):
            break
        scales = new
    return cells.withColumns({
        f"{m}_goal": F.least(F.col(f"{m}_tokens"), F.col(target) * F.lit(scales[m])) for m, target in targets.items()})


def rake_once(cells: DataFrame, targets: Mapping[str, str], share: float, rounds: int = ONCE_ROUNDS) -> DataFrame:
    """Proportional fitting with no cell used more than once. Adds `fitted`: the cells' tokens in the sample.

    `cells` has the goals of `reachable`. Each step scales one margin: the factor of a value is the one
    by which its cells, each cut off at all its tokens, sum to its goal. Cells are sorted by their
    weight, so what they would sum to when the next one is just used up tells which are. Cells that are
    cut off in one step can come back in another. Where goals can't hold together, the last margin's do.
    """
    fitted = cells.withColumn("__w", F.lit(float(share)))
    for turn in range(rounds):
        for margin in targets:
            value = Window.partitionBy(margin)
            down = value.orderBy(F.desc("__w"))
            fitted = fitted.withColumn("__part", F.col("tokens") * F.col("__w")).withColumn(
                "__reach", F.sum("tokens").over(down) + (F.sum("__part").over(value) - F.sum("__part").over(down)) / F.col("__w"))
            full = F.col("__reach") <= F.col(f"{margin}_goal")
            fitted = fitted.withColumns({
                "__full": F.coalesce(F.sum(F.when(full, F.col("tokens"))).over(value), F.lit(0)),
                "__rest": F.coalesce(F.sum(F.when(~full, F.col("__part"))).over(value), F.lit(0.0)),
                "__least": F.min("__w").over(value)})
            goal = F.col(f"{margin}_goal")
            left = F.greatest(goal - F.col("__full"), goal * F.lit(1e-12))
            factor = F.when(F.col("__rest") > 0, left / F.col("__rest")).otherwise(1 / F.col("__least"))
            fitted = fitted.withColumn("__w", F.col("__w") * factor).drop("__part", "__reach", "__full", "__rest", "__least")
        if (turn + 1) % STEPS_PER_TABLE == 0 and turn + 1 < rounds:
            fitted = store(fitted, "raking")
    return fitted.withColumn("fitted", F.col("tokens") * F.least(F.lit(1.0), F.col("__w"))).drop("__w")


def targets_of(cells: DataFrame, margin: str, target: Target) -> DataFrame:
    """Each value of a margin, in the cells or among the weights, with its `tokens` and its `target` share."""
    found = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens"))
    if isinstance(target, Mapping):
        if any(w < 0 for w in target.values()) or not sum(target.values()) > 0:
            raise ValueError("target weights must not be negative, and one must be positive")
        whole = float(sum(target.values()))
        given = cells.sparkSession.createDataFrame(
            [(_value(name), float(w) / whole) for name, w in target.items()], f"{margin} string, target double")
        found = found.join(given, margin, "full").select(
            margin, F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("target", F.lit(0.0)).alias("target"))
        return store(found, "targets")
    powers = found.withColumn("power", F.pow(F.col("tokens").cast("double"), F.lit(float(target))))
    whole = powers.agg(F.sum("power")).first()[0]
    return store(powers.select(margin, "tokens", (F.col("power") / F.lit(whole or 1.0)).alias("target")), "targets")


def _key(margin: str) -> Column:
    """A margin's value; a missing one is a value of its own, apart from the empty text."""
    return F.coalesce(F.concat(F.lit("="), F.col(margin).cast("string")), F.lit(""))


def _value(name: object) -> str:
    return "" if name is None else f"={name}"


def fit_mix(
    docs: DataFrame, margins: Mapping[str, Target], share: float, tokens: str = "n_tokens", once: bool = False,
    tolerance: float = TOLERANCE, rounds: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Two tables: the weight of every cell (`__margin_0`, ... and `__weight`), and a report on the margins.

    The report has margin, value, natural (share of all tokens), target, fitted (share of the weighted tokens) and missed, which is
    whether the two differ by over `tolerance`. A target is missed if its value has no tokens, if margins contradict each other (as with sources
    that occur in one language each), or, with `once`, if it takes more tokens than there are.
    """
    names = {m: f"__margin_{i}" for i, m in enumerate(margins)}
    keys = list(names.values())
    cells = store(docs.filter(F.col(tokens) > 0).groupBy(*[_key(m).alias(n) for m, n in names.items()]).agg(
        F.sum(tokens).alias("tokens")), "cells")
    wanted = {names[m]: targets_of(cells, names[m], target) for m, target in margins.items()}
    # a cell with a value that nobody wants has no weight; the goals of the others sum to 1
    used = reduce(lambda df, n: df.join(wanted[n].filter("target > 0").select(n), n, "left_semi"), keys, cells)
    used = store(used.select(*keys, "tokens"), "used")
    everything = used.agg(F.sum("tokens")).first()[0] or 0
    values = {}
    for n in keys:
        left = used.groupBy(n).agg(F.sum("tokens").cast("double").alias("tokens")).join(wanted[n].select(n, "target"), n)
        whole = left.agg(F.sum("target")).first()[0]
        values[n] = store(left.select(n, "tokens", (F.col("target") / F.lit(whole or 1.0)).alias("goal")), "goals")
    if once:
        for n in keys:
            used = used.join(values[n].select(
                n, F.col("tokens").alias(f"{n}_tokens"), F.col("goal").alias(f"{n}_target")), n)
        names_of = {n: f"{n}_target" for n in keys}
        goals = store(reachable(store(used, "used"), names_of, share * everything), "goals") if everything else used.withColumns(
            {f"{n}_goal": F.lit(0.0) for n in keys})
        fitted, per_token = rake_once(goals, names_of, share, rounds or ONCE_ROUNDS), F.lit(1.0 / share)
    else:
        fitted, per_token = rake(used, values, tolerance, rounds or MAX_ROUNDS), F.lit(float(cells.agg(F.sum("tokens")).first()[0] or 0))
    fitted = store(fitted.select(*keys, "tokens", "fitted"), "weights")
    whole = fitted.agg(F.sum("fitted")).first()[0] or 1.0
    natural = cells.agg(F.sum("tokens")).first()[0] or 1
    parts = []
    for m, n in names.items():
        got = fitted.groupBy(n).agg((F.sum("fitted") / F.lit(float(whole))).alias("fitted"))
        parts.append(wanted[n].join(got, n, "left").select(
            F.lit(m).alias("margin"), F.when(F.col(n) != "", F.substring(n, 2, 1 << 30)).alias("value"),
            (F.col("tokens") / F.lit(natural)).alias("natural"), "target", F.coalesce("fitted", F.lit(0.0)).alias("fitted")))
    report = reduce(DataFrame.unionAll, parts).withColumn("missed", F.abs(F.col("fitted") - F.col("target")) > F.lit(tolerance))
    return fitted.select(*keys, (F.col("fitted") * per_token / F.col("tokens")).alias("__weight")), report


def mix_report(docs: DataFrame, margins: Mapping[str, Target], share: float = 1.0, **options) -> DataFrame:
    """What a mix would reach: the report of `fit_mix`, of which the rows with `missed` name the margins that can't hold together."""
    return fit_mix(docs, margins, share, **options)[1]


def mix(
    docs: DataFrame, margins: Mapping[str, Target], share: float, tokens: str = "n_tokens", key: str = "doc_id",
    seed: str = "mix", rounds: int | None = None, once: bool = False, tolerance: float = TOLERANCE,
) -> DataFrame:
    """The rows of `docs` with `mix_weight` and `copies`: how often a sample of `share` of all tokens holds the document.

    `margins` gives each margin column its target: the weights of its values, scaled to sum to 1 (values not named get
    none, and None names the missing value), or an exponent. With an exponent a value's target is its share of the tokens to
    that power, scaled likewise, so an exponent below 1 lifts small values. Weights are fitted until every margin is within
    `tolerance` of its targets; `mix_report` tells what is missed. A document's expected number of copies is share times its cell's fitted share over its natural one; the fraction is drawn by a
    hash of the key, so a task that runs again draws the same. With `once`, no document is expected more than
    once: cells are used up at most, and the rest is fitted to the share and to the margins as far as there are tokens
    for them (`reachable`, `rake_once`). A missing margin value is a value of
    its own. Documents without tokens have no weight and no copies. Repeated rows are weighted
    each, and drawn alike. An empty table gives an empty result.
    """
    names = {m: f"__margin_{i}" for i, m in enumerate(margins)}
    fitted = fit_mix(docs, margins, share, tokens, once, tolerance, rounds)[0]
    keyed = docs.withColumns({n: _key(m) for m, n in names.items()})
    weight = F.when(F.col(tokens) > 0, F.coalesce("__weight", F.lit(0.0))).otherwise(F.lit(0.0))
    joined = keyed.drop("mix_weight", "copies").join(fitted, list(names.values()), "left").withColumn("mix_weight", weight)
    expected = F.col("mix_weight") * F.lit(share)
    drawn = (uniform(F.col(key), seed) < expected - F.floor(expected)).cast("long")
    return joined.withColumn("copies", F.floor(expected).cast("long") + drawn).drop(*names.values(), "__weight")


#: The query's margins with their exponents, and the share of all tokens to sample.
MARGINS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
SHARE = 0.8


def query_mix(docs: DataFrame, once: bool = False) -> DataFrame:
    return mix(docs.withColumns({"topic": style(), "n_tokens": token_count("text")}), MARGINS, SHARE, once=once)


def mixing_query(docs: DataFrame) -> DataFrame:
    return query_mix(docs.select("doc_id", "source", "lang", "text")).select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round("mix_weight", 6).alias("mix_weight"), "copies")
