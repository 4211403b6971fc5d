"""Secrets in text: keyed values, access ids, hex runs, and stretches of high entropy.

All work is done by Spark's own functions. The place of a match follows from the texts
between the matches, which `split` gives for the pattern that `regexp_extract_all` finds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds, in the order in which equal starts are listed. Each has a pattern,
#: the group whose length counts, and the least length of it.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
KINDS = ("assign", "access", "hex", "entropy")

#: What looks random but is no secret: numbers, runs of one short unit, identifiers in UUID form, alphabets, the keys of
#: public manuals. Only what a pattern matches is excused; the rest of a string is still scored.
ALLOWED = (
    r"^[0-9_./+=-]+$",
    r"^(?<unit>.{1,8})\k<unit>+$",
    r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9a-fA-F])",
    r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
    r"(?i:0123456789|abcdefghijklmnop)",
    r"(?i:example)",
)
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


@dataclass(frozen=True)
class CharacterClass:
    """Strings made of one class of characters, and the entropy that a window of them must reach.

    `must` are patterns that have to occur in a string besides. A string ends where no character of `edge` follows, so
    marks like = : / cut it from a name before it; `tail` may follow.
    """

    characters: str
    window: int
    bits: float
    must: tuple[str, ...] = ()
    edge: str = "[A-Za-z0-9]"
    tail: str = ""


#: Of random strings as short as the window, 99 of 100 reach the bits (95 in the last class).
#: Numbers have at most 3.32 bits. In letters of one case, digits in two places tell a key from words with a year.
CLASSES = (
    CharacterClass("[0-9a-fA-F]", 20, 2.9, ("[0-9]", "[a-fA-F]")),
    CharacterClass("[a-z0-9]", 20, 3.4, ("[0-9][a-z]+[0-9]",)),
    CharacterClass("[A-Z0-9]", 20, 3.4, ("[0-9][A-Z]+[0-9]",)),
    CharacterClass("[A-Za-z0-9]", 20, 3.6, ("[0-9]", "[A-Z]", "[a-z]")),
    CharacterClass("[A-Za-z0-9+/_-]", 24, 4.0, ("[0-9]", "[A-Z]", "[a-z]"), "[A-Za-z0-9+/_-]", "={0,2}"),
)


def matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans of the leftmost matches that do not overlap, less those whose group is too short."""
    expression = F.lit(pattern)
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, expression, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, expression, F.lit(group)).alias("value"),
    )

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["gap"])
        end = start + F.coalesce(F.length(piece["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        good = F.coalesce(F.length(piece["value"]) >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("found"))
    found = F.aggregate(pieces, empty, step, lambda state: state["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def _weight(count: Column) -> Column:
    """c * log2(c), and 0 for none."""
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def entropy_extent(value: Column, window: int, bits: float) -> Column:
    """Where the windows of a string with at least so many bits a character begin and end; NULL where there is none.

    The window slides by one character. Only the counts of the character that enters and the one
    that leaves change, so the sum of c * log2(c) is carried on from window to window.
    """
    def step(state: Column, char: Column) -> Column:
        full = F.size(state["last"]) >= window
        leaving = state["last"][0]
        out_count = F.size(F.filter(state["last"], lambda x: x == leaving))
        kept = F.when(full, F.slice(state["last"], 2, window - 1)).otherwise(state["last"])
        less = F.when(full, _weight(out_count) - _weight(out_count - 1)).otherwise(F.lit(0.0))
        in_count = F.size(F.filter(kept, lambda x: x == char))
        total = state["sum"] - less + _weight(in_count + 1) - _weight(in_count)
        at = state["at"] + 1
        reached = (at >= window) & (F.lit(float(window)) * (F.log2(F.lit(float(window))) - F.lit(bits)) + F.lit(1e-9) >= total)
        return F.struct(
            at.alias("at"), F.concat(kept, F.array(char)).alias("last"), total.alias("sum"),
            F.when(reached & (state["start"] < 0), at - window).otherwise(state["start"]).alias("start"),
            F.when(reached, at).otherwise(state["end"]).alias("end"))

    empty = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("last"), F.lit(0.0).alias("sum"),
        F.lit(-1).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("end"))
    return F.aggregate(
        F.split(value, ""), empty, step,
        lambda s: F.when(s["start"] >= 0, F.struct(s["start"].alias("start"), s["end"].alias("end"))))


def _part(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def _not_allowed(value: Column, allowed: Sequence[str]) -> Column:
    """The places of a string between the matches of the allow list; the whole string if there is none."""
    pattern = "|".join(f"(?:{a})" for a in allowed) or "(?!)"
    pieces = F.arrays_zip(
        F.split(value, pattern, -1).alias("gap"), F.regexp_extract_all(value, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece["gap"])
        place = F.struct(state["at"].alias("start"), end.alias("end"))
        return F.struct(
            (end + F.coalesce(F.length(piece["hit"]), F.lit(0))).alias("at"), F.concat(state["found"], F.array(place)).alias("found"))

    empty = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("found"))
    return F.aggregate(pieces, empty, step, lambda state: state["found"])


def _refine(text: Column, rule: CharacterClass, allowed: Sequence[str]) -> Callable[[Column], Column]:
    """From a span to its parts of high entropy outside the allow list."""
    def refine(span: Column) -> Column:
        value = _part(text, span["start"], span["end"])

        def dense(place: Column) -> Column:
            part = _part(value, place["start"], place["end"])
            suspect = F.length(part) >= rule.window
            for must in rule.must:
                suspect = suspect & part.rlike(must)
            extent = F.when(suspect, entropy_extent(part, rule.window, rule.bits))
            start = span["start"] + place["start"]
            return F.when(extent.isNotNull(), F.struct(
                (start + extent["start"]).alias("start"), span["kind"].alias("kind"), (start + extent["end"]).alias("end")))

        return F.filter(F.transform(_not_allowed(value, allowed), dense), lambda s: s.isNotNull())

    return refine


def _united(spans: Column) -> Column:
    """Spans that overlap as one, by start."""
    def step(found: Column, span: Column) -> Column:
        last = F.try_element_at(found, F.lit(-1))
        both = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], span["end"]).alias("end"))
        meets = (F.size(found) > 0) & (last["end"] > span["start"])
        return F.when(meets, F.concat(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.array(both))).otherwise(
            F.concat(found, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPAN), step)


def entropy_spans(text: Column, classes: Sequence[CharacterClass], allowed: Sequence[str]) -> Column:
    """Spans of high entropy outside the allow list. Where spans of several classes overlap, they are one."""
    spans = []
    for rule in classes:
        # a run of the class's characters that is not cut out of a longer word
        pattern = rf"(?<!{rule.edge}){rule.characters}{{{rule.window},}}{rule.tail}(?!{rule.edge})"
        runs = matches(text, pattern, 0, rule.window, KINDS.index("entropy"))
        spans.append(F.flatten(F.transform(runs, _refine(text, rule, allowed))))
    return _united(F.concat(*spans))


def _covered(span: Column, sorted_spans: str) -> Column:
    """Whether spans that are sorted by start leave no place of the span free."""
    reached = F.aggregate(
        sorted_spans, span["start"],
        lambda at, b: F.when(b["start"] <= at, F.greatest(at, b["end"])).otherwise(at))
    return reached >= span["end"]


def scan_secrets(
    docs: DataFrame, text: str = "text", classes: Sequence[CharacterClass] = CLASSES, allowed: Sequence[str] = ALLOWED,
) -> DataFrame:
    """The rows of `docs` with two more columns, `base_spans` and `secret_spans`.

    Both are arrays of (start, kind, end), sorted, in code points with the end excluded; `kind` counts
    in KINDS. `secret_spans` holds the base spans and, besides, whole stretches of high entropy, but for those
    that base spans cover entirely. A missing or empty text has no spans. Other columns, even those named like the
    results, are left alone but for these two, which are replaced. Rows are independent: repeated
    rows give repeated results, an empty table an empty one.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(*[matches(body, pattern, group, least, KINDS.index(kind)) for kind, pattern, group, least in BASE])
    with_base = docs.withColumn("base_spans", F.array_sort(base))
    added = F.filter(entropy_spans(body, classes, allowed), lambda s: ~_covered(s, "base_spans"))
    return with_base.withColumn("secret_spans", F.array_sort(F.concat("base_spans", added)))


def listed(spans: str | Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def mask(text: Column, spans: str, replacement: str = "[SECRET]") -> Column:
    """The text with every span replaced; spans that overlap are replaced as one."""
    def step(state: Column, span: Column) -> Column:
        start, end = span["start"], span["end"]
        apart = start >= state["at"]
        gap = F.substring(text, (state["at"] + 1).cast("int"), (start - state["at"]).cast("int"))
        return F.struct(
            F.greatest(state["at"], end).alias("at"),
            F.when(apart, F.concat(state["out"], F.array(gap, F.lit(replacement)))).otherwise(state["out"]).alias("out"))

    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    masked = F.aggregate(spans, empty, step, lambda s: F.concat(
        F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, masked).otherwise(text)


def secret_query(docs: DataFrame) -> DataFrame:
    found = scan_secrets(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", *[counted("base_spans", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("secret_spans").alias("spans"),
        counted("secret_spans", "entropy").alias("n_entropy"))
