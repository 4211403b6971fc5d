"""Scans of fixed-width text, CSV and stored pages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from demoflux.functions.markup import first_list_links, first_table_rows
from demoflux.operators.aggregate import weighted_mean
from demoflux.plans.person import person, with_person
from demoflux.plans.registry import query, r6
from demoflux.session import cut_lineage, scratch_path
from demoflux.sources.archives import csv_lines, read_archive_layer, write_archives
from demoflux.sources.census import column_label, label_columns
from demoflux.sources.microdata import (
    Field, format_fixed_width, read_csv, read_dictionary, read_fixed_width, write_csv, write_dictionary,
)
from demoflux.sources.store import materialize
from demoflux.sources.tables import load

# Layout of the extract.
EXTRACT = [
    Field("YEAR", 1, 4), Field("SERIAL", 5, 10), Field("PERWT", 15, 10, decimals=2, label="Person weight"),
    Field("AGE", 25, 3), Field("SEX", 28, 1), Field("STRATA", 30, 12, text=True),
]


def _extract(spark, folder):
    return person(spark, folder, "YEAR", "SERIAL", "PERWT", "AGE", "SEX", "STRATA")


_SUMMARY = with_person("""
SELECT YEAR AS year, STRATA AS strata, SEX AS sex, count(*) AS n_rows, sum(PERWT) AS n,
  round(sum(AGE * PERWT) / sum(PERWT), 6) AS mean_age, max(SERIAL) AS last_serial
FROM person GROUP BY ALL
""")


def _summary(rows):
    return rows.groupBy(F.col("YEAR").alias("year"), F.col("STRATA").alias("strata"), F.col("SEX").alias("sex")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("PERWT").alias("n"), r6(weighted_mean("AGE")).alias("mean_age"),
        F.max("SERIAL").alias("last_serial"))


@query("q33_fixed_width_extract", _SUMMARY)
def fixed_width_extract(spark, folder):
    """All person rows written as fixed-width text to the shared folder, read back by its dictionary."""
    path, codes = scratch_path(spark, "extract"), scratch_path(spark, "extract-codes")
    format_fixed_width(_extract(spark, folder), EXTRACT).write.text(path)
    write_dictionary(spark, EXTRACT, codes)
    return _summary(read_fixed_width(spark, path, read_dictionary(spark, codes)))


@query("q37_csv_extract", _SUMMARY)
def csv_extract(spark, folder):
    """The same through CSV with a declared schema."""
    path = scratch_path(spark, "extract-csv")
    rows = _extract(spark, folder)
    write_csv(rows, path)
    return _summary(read_csv(spark, path, rows.schema))


@query("q37b_stored_extract", f"SELECT 'Person weight' AS weight_label, * FROM ({_SUMMARY})")
def stored_extract(spark, folder):
    """The same through a stored table by year, which is built once and keeps the labels of its columns."""
    path = scratch_path(spark, "extract-stored")
    labels = {field.name: field.label for field in EXTRACT if field.label}
    for _ in range(2):
        rows = materialize(spark, path, lambda: label_columns(_extract(spark, folder), labels), partition_by=("YEAR",))
    return _summary(rows).select(F.lit(column_label(rows, "PERWT")).alias("weight_label"), "*")


@query("q34_links_of_first_list", r"""
SELECT page_id, CAST(i AS INTEGER) AS position,
  replace(replace(regexp_extract(items[i], '<li><a href="([^"]*)">', 1), '&quot;', '"'), '&amp;', '&') AS href,
  trim(replace(regexp_replace(regexp_extract(items[i], '>([^>]*)</a>', 1), '<[^>]*>', '', 'g'), '&amp;', '&')) AS text
FROM (SELECT page_id, items, unnest(range(1, len(items) + 1)) AS i
      FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1),
              '<li><a href="[^"]*">.*?</a></li>') AS items FROM pages))
""")
def links_of_first_list(spark, folder):
    return first_list_links(load(spark, folder, "pages"), "html", ["page_id"])


@query("q34b_link_counts", r"""
SELECT lower(t) AS word, count(*) AS n, count(DISTINCT page_id) AS pages
FROM (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1), '>([^<>]*)</a></li>', 1)) AS t
      FROM pages) GROUP BY ALL
""")
def link_counts(spark, folder):
    links = first_list_links(load(spark, folder, "pages"), "html", ["page_id"])
    return links.groupBy(F.lower("text").alias("word")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


@query("q42_archive_layer", with_person("""
SELECT YEAR AS year, CPUMA0010 AS area, 'area, of "' || YEAR || '"' AS label, count(*) AS n_rows, sum(PERWT) AS n FROM person GROUP BY ALL
"""))
def archive_layer(spark, folder):
    """One zip archive a year with a layer of areas and one of states, written to the shared folder; the areas' layer read back."""
    path = scratch_path(spark, "archives")
    people = person(spark, folder, "YEAR", "CPUMA0010", "STATEFIP", "PERWT")

    def layer(member, key, name):
        label = F.concat(F.lit(f'{name}, of "'), F.col("YEAR"), F.lit('"'))
        rows = people.groupBy("YEAR", F.col(key).alias(name)).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("PERWT").alias("n"))
        return csv_lines(rows.select(
            F.col("YEAR").cast("string").alias("archive"), F.lit(member).alias("member"), F.col("YEAR").alias("year"), name,
            label.alias("label"), "n_rows", "n"), "archive", "member")

    write_archives(layer("tables/area.csv", "CPUMA0010", "area").unionAll(layer("tables/state.csv", "STATEFIP", "state")), path)
    kind = people.schema["CPUMA0010"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"year int, area {kind}, label string, n_rows bigint, n double")
    return read_archive_layer(spark, path, "tables/area.csv", schema)


@query("q43_page_tables", """
WITH s AS (SELECT s_nationkey AS nation, s_suppkey // 50 AS block, s_suppkey, s_name, CAST(floor(s_acctbal) AS BIGINT) AS balance,
    row_number() OVER (PARTITION BY s_nationkey, s_suppkey // 50 ORDER BY s_suppkey) AS nth,
    count(*) OVER (PARTITION BY s_nationkey, s_suppkey // 50) AS n FROM supplier)
SELECT nation, block, CAST(nth AS INTEGER) AS "row", n_name AS country, CAST(s_suppkey AS VARCHAR) AS key, s_name || ' & Co' AS supplier,
  CAST(balance AS VARCHAR) AS balance FROM s JOIN nation ON n_nationkey = nation
UNION ALL
SELECT DISTINCT nation, block, CAST(n + 1 AS INTEGER), n_name, 'all ' || n, 'all ' || n, 'all ' || n FROM s JOIN nation ON n_nationkey = nation
""")
def page_tables(spark, folder):
    """Stored pages of suppliers, each with a table that has spans, tables in cells and no end tags; their rows read back."""
    nation = load(spark, folder, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("country"))
    line = F.format_string(
        "<td><table><tr><td>%d</table><td>%s &amp; Co<td align='right'> <b>%d</b> ", F.col("s_suppkey"), F.col("s_name"), F.floor("s_acctbal"))
    # a page holds the suppliers of fifty keys at most
    blocks = load(spark, folder, "supplier").groupBy(
        F.col("s_nationkey").alias("nation"), F.floor(F.col("s_suppkey") / 50).alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("line")))), lambda r: r["line"]).alias("lines"))
    body = F.concat(
        F.lit("<html><script>'<table><tr><td>no'</script><h1>Suppliers</h1><TABLE class=x><tr><th>Country<th>Key<th colspan='2'>Supplier and balance</tr>"),
        F.lit("<tr><td rowspan=0>"), F.col("country"), F.lit("</td>"), F.array_join("lines", "<tr>"),
        F.lit("<tr><td colspan=3>all "), F.size("lines").cast("string"), F.lit("</TABLE><table><tr><td>second</table>"))
    pages = cut_lineage(blocks.join(nation, "nation").select("nation", "block", body.alias("html")))
    rows = first_table_rows(pages, "html", ["nation", "block"])
    cell = lambda i: F.col("cells")[i]
    return rows.select(
        "nation", "block", "row", cell(0).alias("country"), cell(1).alias("key"), cell(2).alias("supplier"), cell(3).alias("balance"))
