"""Shapes stored as well-known text: read into rings and written from them, in Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the text form: a ring is a list in innermost brackets, a polygon a list of rings in brackets.
RING = r"\(([^()]+)\)"
POLYGON = r"\(\s*(\([^()]+\)(?:\s*,\s*\([^()]+\))*)\s*\)"
SHAPE = r"(?i)^\s*(SRID\s*=\s*\d+\s*;)?\s*(MULTI)?POLYGON\s*Z?M?\s*(EMPTY\s*$|\(.*\)\s*$)"


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring: positive if it runs against the clock."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(cross, F.lit(0.0), lambda total, c: total + c) / 2


def shape_area(rings: str | Column) -> Column:
    """Area of a shape whose holes run the other way than its outer rings."""
    return F.abs(F.aggregate(F.transform(rings, ring_area), F.lit(0.0), lambda total, a: total + a))


def _points(text: Column) -> Column:
    """The points of a ring's text, without the last if it repeats the first."""
    pairs = F.transform(F.split(text, ","), lambda t: F.split(F.trim(t), r"\s+"))
    points = F.transform(pairs, lambda c: F.struct(c[0].cast("double").alias("x"), c[1].cast("double").alias("y")))
    closed = (F.size(points) > 1) & (F.element_at(points, 1) == F.element_at(points, -1))
    return F.slice(points, 1, F.size(points) - closed.cast("int"))


def rings_of_text(text: str | Column) -> Column:
    """The rings of a POLYGON or MULTIPOLYGON text: outer rings against the clock, holes with it.

    Both may be written either way round; the first ring of each polygon is its outer one. Heights and measures are left out. A missing
    text has NULL rings, an empty shape none. Any other text is an error.
    """
    text = F.col(text) if isinstance(text, str) else text

    def turned(ring: Column, place: Column) -> Column:
        wanted = F.when(place == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        return F.when(ring_area(ring) * wanted < 0, F.reverse(ring)).otherwise(ring)

    polygons = F.regexp_extract_all(text, F.lit(POLYGON), F.lit(1))
    rings = F.flatten(F.transform(polygons, lambda p: F.transform(
        F.transform(F.regexp_extract_all(p, F.lit(RING), F.lit(1)), _points), turned)))
    return F.when(text.isNull(), None).when(text.rlike(SHAPE), rings).otherwise(
        F.raise_error(F.concat(F.lit("not a polygon: "), F.substring(text, 1, 40))))


def text_of_rings(rings: str | Column) -> Column:
    """A MULTIPOLYGON text. A ring that runs with the clock is a hole of the outer ring before it."""
    point = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(F.concat(r, F.slice(r, 1, 1)), point), ", "), F.lit(")"))
    parts = F.transform(rings, lambda r, i: F.concat(
        F.when(i == 0, F.lit("")).when(ring_area(r) > 0, F.lit("), (")).otherwise(F.lit(", ")), ring(r)))
    return F.when(F.size(rings) > 0, F.concat(F.lit("MULTIPOLYGON (("), F.array_join(parts, ""), F.lit("))"))).when(
        F.size(rings) == 0, F.lit("MULTIPOLYGON EMPTY"))


def read_shapes(spark: SparkSession, path: str, schema: str, text: str = "geometry") -> DataFrame:
    """A stored table of shapes, CSV with a header: its attributes, and `rings` in place of the text.

    Only the attributes that a query uses are parsed.
    """
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option(
        "mode", "FAILFAST").csv(path)
    return rows.withColumn("rings", rings_of_text(text)).drop(text)


def write_shapes(shapes: DataFrame, path: str, text: str = "geometry") -> None:
    rows = shapes.withColumn(text, text_of_rings("rings")).drop("rings")
    rows.write.option("header", True).option("escape", '"').csv(path)
