"""Workbooks: round trips, files as other programs write them, and what stays when a task fails."""

import datetime
import io
import os
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import workbook

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def other(path):
    """A workbook with shared texts, two sheets, cells left out and no cell addresses in one row."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}"><sheets><sheet name="one" sheetId="1" r:id="a"/><sheet name="two" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Type="t" Target="worksheets/x.xml"/><Relationship Id="b" Type="t" Target="/xl/worksheets/y.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>head</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si><si><t> </t></si><si><t>a_x000D_b _x005F_x0041_</t></si></sst>")
        rows = '<row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>12</v></c></row><row r="3"><c r="A3" t="s"><v>2</v></c></row>'
        rows += '<row r="5"><c t="s"><v>3</v></c><c t="b"><v>1</v></c><c><v>1.5E7</v></c></row><row r="6"><c r="B6" t="e"><v>#N/A</v></c><c r="C6" t="str"><v>7.0</v></c></row>'
        z.writestr("xl/worksheets/x.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/worksheets/y.xml", f'<worksheet {MAIN}><sheetData><row><c t="str"><v>h</v></c></row><row><c><v>5</v></c><c t="str"><v>TRUE</v></c><c t="str"><v>no number</v></c></row></sheetData></worksheet>')


def test_other_programs(spark, tmp_path):
    other(tmp_path / "o.xlsx")
    got = workbook.read(spark, str(tmp_path), "a string, b boolean, c long")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("rich", None, 12), ("a\rb _x0041_", True, 15000000), (None, None, 7), ("5.0", True, None)], key=repr)
    assert got.rdd.getNumPartitions() == 2
    assert [tuple(r) for r in workbook.read(spark, str(tmp_path / "o.xlsx"), "a long, b string", ["two"]).collect()] == [(5, "TRUE")]
    assert {r[0] for r in workbook.read(spark, str(tmp_path), "a string, b string, c string", ["one"]).select("c").collect()} == {"12.0", "1.5E7", "7.0"}


def test_round_trip(spark, tmp_path):
    at = datetime.datetime(1969, 12, 31, 23, 59, 59, 999000)
    rows = [
        (1, "a <b> & \"c\" _x0041_ \x01\r\n\té", 1.25, Decimal("10.50"), True, at, at, datetime.date(2024, 2, 29)),
        (2**62 + 1, "", None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None),
        (-5, "x" * 40000, 1e-9, Decimal("-0.01"), False, at, None, None),
    ]
    schema = "i long, s string, x double, d decimal(12,2), b boolean, t timestamp, n timestamp_ntz, e date"
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "w")
    workbook.write(df, path, {"i": "Number"})
    want = {(r[0], r[1] or None, *r[2:]) for r in rows if r[0] is not None}
    assert {tuple(r) for r in workbook.read(spark, path, schema).collect()} == want
    workbook.write(df.where("i = 1"), path)
    assert workbook.read(spark, path, schema).count() == 1 and not [f for f in os.listdir(path) if not f.endswith(".xlsx")]
    df.where("i = -5").write.format("workbook").mode("append").save(path)
    assert workbook.read(spark, path, schema).count() == 2
    workbook.write(df.limit(0), path)
    assert workbook.read(spark, path, schema).collect() == []


def test_sheets_are_cut(spark, tmp_path):
    path = str(tmp_path / "w")
    workbook.write(spark.range(1), path)
    spark.range(25).coalesce(1).write.format("workbook").option("rows", 10).mode("overwrite").save(path)
    assert len(os.listdir(path)) == 3 and workbook.read(spark, path, "id long").agg(F.sum("id")).first()[0] == 300


def test_failed_tasks_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "w")
    workbook.write(spark.range(3), path)
    bad = spark.range(100).repartition(4).withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="stop"):
        workbook.write(bad, path)
    assert workbook.read(spark, path, "id long").count() == 3 and all(f.endswith(".xlsx") for f in os.listdir(path))


def test_names_and_numbers(spark):
    assert [workbook.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(workbook.column_number(workbook.column_name(i) + "12") == i for i in range(2000))
    doubles = [0.0, -0.0, 1.0, 123.0, 0.001, 9.99e-4, 1e7, 9999999.5, 1.5e-9, -2.5e20, 1e22, 123456789.125, 2.5e-300, float("inf"), float("-inf"), float("nan")]
    spelled = spark.createDataFrame([(x,) for x in doubles], "x double").select(F.col("x").cast("string")).collect()
    got = [workbook.double_text(x) for x in doubles]
    assert got == [r[0] for r in spelled]


def test_streamed_rows():
    out = io.BytesIO()
    n = workbook.write_book(out, ["a", "b"], ((i, str(i)) for i in range(20000)))
    with zipfile.ZipFile(out) as book:
        (name, part), = workbook.sheets(book)
        rows = list(workbook.cells(book, part))
    assert n == 20000 and name == "Sheet1" and len(rows) == 20001 and rows[-1] == {0: ("19999",), 1: "19999"}


def test_tasks_grow_with_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "TASK", 100)
    path = str(tmp_path / "w")
    workbook.write(spark.range(2500).coalesce(1), path)
    back = workbook.read(spark, path, "id long")
    sizes = [r["count"] for r in back.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 25 and max(sizes) <= 150 and back.agg(F.sum("id")).first()[0] == 2499 * 1250
