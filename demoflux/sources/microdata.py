"""Person records from CSV and from fixed-width text with an XML dictionary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demoflux.functions.semantics import pad_code


@dataclass(frozen=True)
class Field:
    """One fixed-width field: 1-based start, width, implied decimals, text or number, label."""

    name: str
    start: int
    width: int
    decimals: int = 0
    text: bool = False
    label: str = ""


DICTIONARY_SCHEMA = T.StructType([
    T.StructField("_name", T.StringType()),
    T.StructField("_dcml", T.IntegerType()),
    T.StructField("location", T.StructType([
        T.StructField("_StartPos", T.IntegerType()),
        T.StructField("_EndPos", T.IntegerType()),
    ])),
    T.StructField("labl", T.StringType()),
    T.StructField("varFormat", T.StructType([T.StructField("_type", T.StringType())])),
])


def read_dictionary(spark: SparkSession, path: str) -> list[Field]:
    """The fields an XML dictionary describes: one `var` element each. A dictionary is short."""
    rows = spark.read.format("xml").option("rowTag", "var").schema(DICTIONARY_SCHEMA).load(path)
    return [
        Field(
            r["_name"], r["location"]["_StartPos"], r["location"]["_EndPos"] - r["location"]["_StartPos"] + 1,
            r["_dcml"] or 0, bool(r["varFormat"]) and r["varFormat"]["_type"] == "character", r["labl"] or "",
        )
        for r in rows.orderBy("location._StartPos").collect()
    ]


def write_dictionary(spark: SparkSession, fields: Sequence[Field], path: str) -> None:
    """The XML dictionary of a layout, in the form `read_dictionary` reads."""
    entries = [
        f'<var name="{f.name}" dcml="{f.decimals}"><location StartPos="{f.start}" EndPos="{f.start + f.width - 1}"/>'
        f'<labl>{escape(f.label)}</labl><varFormat type="{"character" if f.text else "numeric"}"/></var>'
        for f in fields
    ]
    text = "<codeBook>" + "".join(entries) + "</codeBook>"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def _field_column(line: str, field: Field) -> Column:
    raw = F.trim(F.substring(F.col(line), field.start, field.width))
    filled = F.when(raw != "", raw)
    if field.text:
        value = filled
    elif field.decimals:
        value = filled.cast("double") / F.lit(10.0 ** field.decimals)
    else:
        value = filled.cast("long" if field.width > 9 else "int")
    return value.alias(field.name, metadata={"label": field.label})


def parse_fixed_width(lines: DataFrame, fields: Sequence[Field], line: str = "value") -> DataFrame:
    """Typed columns cut out of text lines; blank fields are NULL."""
    return lines.select(*[_field_column(line, f) for f in fields])


def read_fixed_width(spark: SparkSession, path: str, fields: Sequence[Field]) -> DataFrame:
    return parse_fixed_width(spark.read.text(path), fields)


def format_fixed_width(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Text lines holding the fields at their places, numbers zero-padded with implied decimals.

    A value that does not fit its field is an error.
    """
    parts = []
    position = 1
    for field in sorted(fields, key=lambda f: f.start):
        if field.start > position:
            parts.append(F.lit(" " * (field.start - position)))
        value = F.col(field.name)
        if field.text:
            body = F.rpad(value, field.width, " ")
        else:
            scaled = F.round(value * (10 ** field.decimals)).cast("long")
            body = pad_code(scaled, field.width)
        # a value that is wider than its field would shift or lose what follows, so the write fails instead
        wide = F.length(value if field.text else scaled.cast("string")) > field.width
        body = F.when(wide, F.raise_error(F.lit(f"a value is wider than field {field.name}"))).otherwise(body)
        parts.append(F.coalesce(body, F.lit(" " * field.width)))
        position = field.start + field.width
    return df.select(F.concat(*parts).alias("value"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and a declared schema; nothing is inferred."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)
