"""Readers, writers, labels, archives and stored results."""

import zipfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows_of
import pytest
from demoflux.functions.markup import first_list_links, first_table_rows, table_grid
from demoflux.session import cut_lineage, shared_folder
from demoflux.sources import archives, census, microdata, store

DICTIONARY = """<?xml version="1.0" encoding="UTF-8"?>
<codeBook><dataDscr>
 <var ID="YEAR" name="YEAR" intrvl="contin" dcml="0"><location StartPos="1" EndPos="4" width="4"/>
  <labl>Census year</labl><varFormat type="numeric" schema="other"/></var>
 <var ID="PERWT" name="PERWT" intrvl="contin" dcml="2"><location StartPos="5" EndPos="14" width="10"/>
  <labl>Person weight</labl><varFormat type="numeric" schema="other"/></var>
 <var ID="AGE" name="AGE" intrvl="discrete" dcml="0"><location StartPos="15" EndPos="17" width="3"/>
  <labl>Age</labl><varFormat type="numeric" schema="other"/></var>
 <var ID="STRATA" name="STRATA" intrvl="discrete" dcml="0"><location StartPos="19" EndPos="22" width="4"/>
  <labl>Stratum</labl><varFormat type="character" schema="other"/></var>
</dataDscr></codeBook>
"""


def test_fixed_width_by_dictionary(spark, tmp_path):
    (tmp_path / "codes.xml").write_text(DICTIONARY)
    (tmp_path / "rows.dat").write_text("20100000012550034 ab12\n20170000000100101 cd  \n2017               e   \n")
    fields = microdata.read_dictionary(spark, str(tmp_path / "codes.xml"))
    assert [(f.name, f.start, f.width, f.decimals, f.text) for f in fields] == [
        ("YEAR", 1, 4, 0, False), ("PERWT", 5, 10, 2, False), ("AGE", 15, 3, 0, False), ("STRATA", 19, 4, 0, True)]
    people = microdata.read_fixed_width(spark, str(tmp_path / "rows.dat"), fields)
    assert rows_of(people) == sorted(
        [(2010, 125.5, 34, "ab12"), (2017, 1.0, 101, "cd"), (2017, None, None, "e")], key=repr)
    assert census.column_label(people, "PERWT") == "Person weight"
    lines = microdata.format_fixed_width(people.filter("AGE is not null"), fields)
    assert rows_of(microdata.parse_fixed_width(lines, fields)) == rows_of(people.filter("AGE is not null"))


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 2.5), (2, None, None)], "i int, s string, x double")
    microdata.write_csv(df, str(tmp_path / "out"))
    assert rows_of(microdata.read_csv(spark, str(tmp_path / "out"), df.schema)) == rows_of(df)


def test_archive_layer(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "CHUNK", 16)
    for name, start in (("one", 0), ("two", 100)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("x/county.csv", "FIPS,NAME,N\r\n" + "".join(f'0{i},"A, {i}",{start + i}\r\n' for i in range(1, 6)))
            z.writestr("x/other.csv", "nothing\n")
    schema = T.StructType().add("FIPS", "string").add("NAME", "string").add("N", T.IntegerType())
    got = archives.read_archive_layer(spark, str(tmp_path / "*.zip"), "x/county.csv", schema)
    assert got.count() == 10
    assert ("03", "A, 3", 103) in rows_of(got)


def test_archive_records_with_line_breaks_and_bad_numbers(spark, tmp_path):
    schema = T.StructType().add("NAME", "string").add("N", T.IntegerType())
    for name, body in (("good", 'NAME,N\n"x\ny",1\n\nz,2\n'), ("bad", "NAME,N\nx,one\n")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("t.csv", body)
    assert rows_of(archives.read_archive_layer(spark, str(tmp_path / "good.zip"), "t.csv", schema)) == [("x\ny", 1), ("z", 2)]
    with pytest.raises(Exception, match="MALFORMED"):
        archives.read_archive_layer(spark, str(tmp_path / "bad.zip"), "t.csv", schema).collect()


def test_labels(spark):
    df = census.label_columns(spark.range(1).withColumnRenamed("id", "AT5AA"), {"AT5AA": "Native-born", "ZZ": "unused"})
    assert census.column_label(df, "AT5AA") == "Native-born"


def test_selection_and_fan_in(spark):
    long = spark.createDataFrame(
        [("1", "V1", "CA", 2010, 5.0, 1.0), ("1", "V2", "CA", 2010, 6.0, 1.0), ("2", "V1", "WA", 2016, 7.0, 1.0)],
        "GEOID string, variable string, state string, year int, estimate double, moe double")
    got = census.select_estimates(long, {"total": "V1"}, states=["CA"], years=[2010])
    assert rows_of(got.select("GEOID", "variable", "estimate")) == [("1", "total", 5.0)]
    counts = census.normalise_decennial(long.drop("moe").withColumnRenamed("estimate", "value"))
    stacked = census.fan_in([(long, {"source": "a"}), (counts, {"source": "b"})])
    assert stacked.count() == 6 and stacked.filter("moe is null").count() == 3


def test_stored_results_are_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    path = str(tmp_path / "result")
    assert store.materialize(spark, path, build).count() == 3
    assert store.materialize(spark, path, build).count() == 3
    assert len(built) == 1
    store.materialize(spark, path, build, refresh=True)
    assert len(built) == 2


def test_cut_lineage_writes_to_the_shared_folder(spark):
    df = spark.range(10).withColumn("a b", F.array(F.col("id")))
    cut = cut_lineage(df)
    assert rows_of(cut) == rows_of(df)
    assert shared_folder(spark) in cut.inputFiles()[0] or "file:" in cut.inputFiles()[0]


PAGE = """<html><body><table class="w"><tr><th>Name</th><th>Alpha&nbsp;code</th></tr>
<tr><td><a href="/x">Alabama</a></td><td>AL</td></tr><tr><td>A &amp;amp; B</td><td>XX</td></tr></table>
<table><tr><td>second</td></tr><tr><td>no</td></tr></table><ul><li><a href="/a?x=1&amp;y=2"><b>T</b>o</a></li></ul>
<ul><li><a href="/z">z</a></li></ul></body></html>"""


def test_rows_of_the_first_table_and_list(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>none</p>"), (3, None)], "page_id int, html string")
    rows = first_table_rows(pages, "html", ["page_id"]).collect()
    assert [(r.page_id, r.header, r.row, r.cells) for r in rows] == [
        (1, ["Name", "Alpha code"], 1, ["Alabama", "AL"]), (1, ["Name", "Alpha code"], 2, ["A &amp; B", "XX"])]
    assert rows_of(first_list_links(pages, "html", ["page_id"])) == [(1, 1, "/a?x=1&y=2", "To")]


def test_wide_values_are_refused(spark):
    from demoflux.sources.microdata import Field, format_fixed_width

    rows = spark.createDataFrame([(123456789012, "x")], "SERIAL bigint, NAME string")
    for fields in ([Field("SERIAL", 1, 10, 0, False, "")], [Field("NAME", 1, 0, 0, True, "")]):
        with pytest.raises(Exception, match="wider than field"):
            format_fixed_width(rows, fields).collect()


def test_archives_of_several_layers(spark, tmp_path):
    rows = spark.range(3000).select(
        F.format_string("a%d", F.col("id") % 3).alias("archive"), F.format_string("t/l%d.csv", F.col("id") % 2).alias("member"), "id",
        F.concat(F.lit('q"x\n\\, '), F.col("id").cast("string")).alias("t"))
    path = str(tmp_path / "z")
    archives.write_archives(archives.csv_lines(rows, "archive", "member"), path)
    files = list((tmp_path / "z").glob("archive=*/part-*"))
    assert len(files) == 3
    for file in files:
        with zipfile.ZipFile(file) as z:
            assert z.namelist() == ["t/l0.csv", "t/l1.csv"] and z.testzip() is None
    schema = T.StructType().add("id", "long").add("t", "string")
    want = sorted((i, f'q"x\n\\, {i}') for i in range(1, 3000, 2))
    assert sorted(map(tuple, archives.read_archive_layer(spark, path, "t/l1.csv", schema).collect())) == want
    assert archives.read_archive_layer(spark, path, "t/none.csv", schema).count() == 0


def test_members_that_splits_and_false_marks_cut(spark, tmp_path):
    body = "id,t\n" + "".join(f"{i},{'PK' + chr(3) + chr(4)}{'x' * (i % 50)}\n" for i in range(3000))
    with zipfile.ZipFile(tmp_path / "a b.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("x.csv", "id,t\n1,a\n")
        z.writestr("l.csv", body)
        z.writestr("y.csv", "id,t\n1,a\n")
    with zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("l.csv", "w", force_zip64=True) as m:
        m.write(b'id,"t\n"\n9005,"a\nb"\n9006,last')
    schema = T.StructType().add("id", "long").add("t", "string")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "20000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = dict(map(tuple, archives.read_archive_layer(spark, str(tmp_path / "*.zip"), "l.csv", schema).collect()))
            assert len(got) == 3002 and got[9005] == "a\nb" and got[9006] == "last" and got[7] == "PK\x03\x04" + "x" * 7
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    data = bytearray((tmp_path / "a b.zip").read_bytes())
    data[data.index(b"x" * 40)] ^= 1
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "d.zip").write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        archives.read_archive_layer(spark, str(tmp_path / "bad"), "l.csv", schema)


def test_grids_of_tables():
    grid = lambda html: table_grid(html)
    assert grid("<p>no table") == [] and grid("<table></table>") == []
    assert grid("<table><tr><td>a<td>b<tr><td>c</table>") == [["a", "b"], ["c"]]
    assert grid("<table><td>a</td><td>b&nbsp;&amp; c<br>d</td>") == [["a", "b & c d"]]
    assert grid("<TABLE><TR><TD ROWSPAN=2>a<TD COLSPAN='2'>b<TR><TD>c<TD>d<TR><TD>e</TABLE>") == [["a", "b", "b"], ["a", "c", "d"], ["e"]]
    assert grid("<table><tr><td>x<td rowspan=0>y<tr><td>z<tr><td>w<td>v</table>") == [["x", "y"], ["z", "y"], ["w", "y", "v"]]
    assert grid("<table><tr><td rowspan=3>a</table>") == [["a"]]
    nested = "<table><tr><td>a<table><tr><td rowspan=4>in<td>ner</table>z<td>b</tr></table><table><tr><td>second</table>"
    assert grid(nested) == [["a in ner z", "b"]]
    assert grid("<script>'<table><tr><td>no'</script><!-- <table> --><table><tbody><tr><th>h<script>x</script></tbody></table>") == [["h"]]
    assert grid("<table><tr><td colspan=x>a<td colspan=0>b<td rowspan=-1>c</table>") == [["a", "b", "c"]]
    # a row that a cell of an earlier row pushes apart
    assert grid("<table><tr><td>1<td rowspan=2>2<tr><td colspan=1>3<td>4</table>") == [["1", "2"], ["3", "2", "4"]]
