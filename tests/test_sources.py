from __future__ import annotations

import zipfile
from datetime import date
from pathlib import Path

import pytest
from conftest import rows
from pyspark.errors import PySparkException

from seriata import schemas
from seriata.operators.constraints import schema_failures
from seriata.session import shared_folder
from seriata.sources import delimited, paths, sheets, tables


def _write(path: Path, text: str) -> str:
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_panel_by_header(spark, tmp_path):
    path = _write(tmp_path / "panel.csv", "fecha,a,b c\n2020-01-01,1.5,\n2020-02-01,,2\n")
    df = delimited.read_panel(spark, path)
    assert df.columns == ["fecha", "a", "b c", "archivo", "orden"]
    assert rows(df, "fecha", "a", "b c", "archivo") == [
        ("2020-01-01", 1.5, None, "panel.csv"),
        ("2020-02-01", None, 2.0, "panel.csv"),
    ]
    bad = _write(tmp_path / "bad.csv", "fecha,a\n2020-01-01,much\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        delimited.read_panel(spark, bad).collect()


def test_observations_from_two_panels(spark, tmp_path):
    men = _write(tmp_path / "men.csv", "fecha,m,q\n2020-01-01,1,7\n2020-01-01,99,7\n2020-02-01,,7\n")
    tri = _write(tmp_path / "tri.csv", "fecha,m,q\n2020-01-01,5,8\n")
    dim = spark.createDataFrame([("m", "M"), ("q", "Q")], "serie_id string, frecuencia string")
    rules = {"routes": {"tri": "Q"}, "otherwise": "men"}
    both = delimited.load_observations(spark, {"men": men, "tri": tri}, dim, **rules)
    assert rows(both) == [("m", "2020-01-01", 1.0), ("m", "2020-02-01", None), ("q", "2020-01-01", 8.0)]
    one = delimited.load_observations(spark, {"men": men, "tri": str(tmp_path / "no.csv")}, dim, **rules)
    assert rows(one) == [("m", "2020-01-01", 1.0), ("m", "2020-02-01", None)]
    none = delimited.load_observations(spark, {"men": str(tmp_path / "no.csv")}, dim, **rules)
    assert none.isEmpty() and schema_failures(none, schemas.FACT_OBSERVACION) == []


def test_metadata(spark, tmp_path):
    path = _write(
        tmp_path / "meta.csv",
        'variable,etiqueta,frecuencia,origen,titulo_original\nffr,"Rate, policy",M,FRED - FEDFUNDS,\n',
    )
    assert rows(delimited.load_dim_serie(spark, path)) == [("ffr", "Rate, policy", "M", "FRED - FEDFUNDS", "FRED", None)]
    with pytest.raises(FileNotFoundError):
        delimited.load_dim_serie(spark, str(tmp_path / "absent.csv"))


def test_daily_by_position(spark, tmp_path):
    files = {
        "t2y": _write(tmp_path / "fred DGS2.csv", "DATE,DGS2\n2014-12-31,1\n2015-01-01,2\n2015-01-02,\n2025-12-31,4\n2026-01-01,5\n"),
        "usd": _write(tmp_path / "usd.csv", "observation_date,X\n2020-05-05,1.25\n"),
        "absent": str(tmp_path / "absent.csv"),
    }
    got = delimited.load_daily(spark, files, period=(date(2015, 1, 1), date(2025, 12, 31)))
    assert rows(got) == [("t2y", "2015-01-01", 2.0), ("t2y", "2025-12-31", 4.0), ("usd", "2020-05-05", 1.25)]
    wrong = {"w": _write(tmp_path / "wrong.csv", "DATE,V\nyesterday,1\n")}
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        delimited.load_daily(spark, wrong, period=None).collect()
    assert delimited.load_daily(spark, {"a": str(tmp_path / "absent.csv")}, period=None).isEmpty()
    assert delimited.load_daily(spark, {"t2y": files["t2y"]}, period=None).count() == 4


def test_presence(spark, tmp_path):
    here = _write(tmp_path / "here.csv", "x\n")
    assert paths.existing(spark, [here, str(tmp_path / "absent")]) == [here]
    assert paths.require(spark, str(tmp_path)) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        paths.require(spark, str(tmp_path / "absent"))


def _sheet(spark, data):
    return spark.createDataFrame(data, sheets.SHEET_SCHEMA)


def test_header_is_the_first_match_within_the_first_rows(spark):
    data = [("f", 0, ["Cuadro", None]), ("f", 3, [" FECHA", "v"]), ("f", 4, ["2020-01-31", "1"]), ("f", 5, ["fecha", "2"])]
    data += [("f", 6, ["2020-02-29", "n.d."]), ("f", 7, ["total", "3"]), ("f", 8, ["2020-03-31"]), ("f", 9, [])]
    data += [("f", 20, ["2020-04-30 00:00:00", "-4.5"])]
    assert rows(sheets.scan_sheets(_sheet(spark, data), 1)) == [("f", "2020-01-31", 1.0), ("f", "2020-04-30", -4.5)]


def test_a_sheet_without_header_fails(spark):
    late = [("ok", 0, ["Fecha", "v"]), ("g", 0, ["x", "y"]), ("g", 15, ["Fecha", "v"]), ("g", 16, ["2020-01-31", "1"])]
    with pytest.raises(PySparkException, match="no header row in g"):
        sheets.scan_sheets(_sheet(spark, late), 1).collect()


_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _xlsx(path: Path) -> str:
    """Title rows, a skipped row, shared and inline text, a date style and a skipped cell."""
    sheet = f"""<worksheet {_MAIN}><sheetData>
      <row r="1"><c r="A1" t="s"><v>0</v></c></row>
      <row r="4"><c r="A4" t="inlineStr"><is><t>Fecha</t></is></c><c r="C4" t="s"><v>1</v></c></row>
      <row r="5"><c r="A5" s="1"><v>43861</v></c><c r="C5"><v>10.5</v></c></row>
      <row r="6"><c r="A6" s="2"><v>43890</v></c><c r="B6"><v>7</v></c><c r="C6"><v>12</v></c></row>
      <row r="7"><c r="A7" t="s"><v>2</v></c><c r="C7"><v>99</v></c></row>
    </sheetData></worksheet>"""
    styles = f"""<styleSheet {_MAIN}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></numFmts>
      <cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>"""
    shared = f"<sst {_MAIN}><si><t>Balance</t></si><si><r><t>To</t></r><r><t>tal</t></r></si><si><t>Fuente</t></si></sst>"
    relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    listed = f"""<workbook {_MAIN} xmlns:r="{relation}"><sheets>
      <sheet name="Cuadro" sheetId="9" r:id="rId2"/><sheet name="Notas" sheetId="1" r:id="rId1"/></sheets></workbook>"""
    parts = """<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/>
      <Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>"""
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", listed)
        book.writestr("xl/_rels/workbook.xml.rels", parts)
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_MAIN}><sheetData/></worksheet>")
        book.writestr("xl/worksheets/sheet2.xml", sheet)
        book.writestr("xl/styles.xml", styles)
        book.writestr("xl/sharedStrings.xml", shared)
    return str(path)


def test_workbook_cells(spark, tmp_path):
    got = rows(sheets.read_sheets(spark, _xlsx(tmp_path / "b.xlsx")), "row_idx", "cells")
    assert got == [
        (0, ["Balance"]),
        (1, []),
        (2, []),
        (3, ["Fecha", None, "Total"]),
        (4, ["2020-01-31T00:00:00", None, "10.5"]),
        (5, ["2020-02-29T00:00:00", "7", "12"]),
        (6, ["Fuente", None, "99"]),
    ]


def test_year_to_date_files(spark, tmp_path):
    files = {
        "bal": (_xlsx(tmp_path / "balance.xlsx"), 2),
        "exp": (_xlsx(tmp_path / "exports.xlsx"), 1),
        "absent": (str(tmp_path / "absent.xlsx"), 1),
    }
    got = sheets.load_ytd(spark, files, period=None)
    assert rows(got) == [("bal", "2020-01-31", 10.5), ("bal", "2020-02-29", 12.0), ("exp", "2020-02-29", 7.0)]
    early = sheets.load_ytd(spark, files, period=(date(2020, 1, 1), date(2020, 1, 31)))
    assert rows(early) == [("bal", "2020-01-31", 10.5)]
    assert sheets.load_ytd(spark, {"a": (str(tmp_path / "absent.xlsx"), 1)}, period=None).isEmpty()


def test_two_series_of_one_workbook_and_two_workbooks_of_one_name(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "y").mkdir()
    one, other = _xlsx(tmp_path / "x" / "book.xlsx"), _xlsx(tmp_path / "y" / "book.xlsx")
    got = sheets.load_ytd(spark, {"a": (one, 2), "b": (one, 1), "c": (other, 2)}, period=None)
    assert rows(got) == [
        ("a", "2020-01-31", 10.5), ("a", "2020-02-29", 12.0), ("b", "2020-02-29", 7.0),
        ("c", "2020-01-31", 10.5), ("c", "2020-02-29", 12.0),
    ]
    # Decoded once, before; the rows that are read twice are stored ones.
    assert "MapInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_columns_bind_by_name(spark, tmp_path):
    text = "variable,frecuencia,etiqueta,titulo_original,origen\nffr,M,Fed funds,Title,FRED - FEDFUNDS\n"
    got = delimited.load_dim_serie(spark, _write(tmp_path / "meta.csv", text))
    assert rows(got, "etiqueta", "frecuencia", "proveedor") == [("Fed funds", "M", "FRED")]
    with pytest.raises(ValueError, match="origen"):
        delimited.read_metadata(spark, _write(tmp_path / "less.csv", "variable,etiqueta,frecuencia,titulo_original\n"))
    (tmp_path / "wide").mkdir()
    _write(tmp_path / "wide" / "1.csv", "fecha,x,y\n2020-01-01,1,2\n")
    _write(tmp_path / "wide" / "2 b.csv", "fecha,y,x\n2020-02-01,4,3\n")
    panel = delimited.read_panel(spark, str(tmp_path / "wide"))
    assert rows(panel, "fecha", "x", "y") == [("2020-01-01", 1.0, 2.0), ("2020-02-01", 3.0, 4.0)]


def test_daily_files_of_one_name_and_patterns(spark, tmp_path):
    for folder, value in (("x", 1), ("y", 2)):
        (tmp_path / folder).mkdir()
        _write(tmp_path / folder / "d.csv", f"a,b\n2020-01-01,{value}\n")
    files = {"one": str(tmp_path / "x" / "d.csv"), "two": str(tmp_path / "y" / "*.csv")}
    got = delimited.load_daily(spark, files, period=None)
    assert rows(got) == [("one", "2020-01-01", 1.0), ("two", "2020-01-01", 2.0)]
    with pytest.raises(ValueError, match="two series"):
        delimited.load_daily(spark, {"one": files["one"], "again": files["one"]}, period=None)


def test_publish_replace_append_and_drop(spark, panel, tmp_path):
    one, two = panel([("a", "2020-01", 1.0)]), panel([("b", "2020-01", 2.0)])
    path = str(tmp_path / "mart")
    tables.publish(one, "m", kind="table", path=path)
    assert rows(tables.publish(two, "m", kind="table", path=path)) == rows(two)
    both = tables.publish(one, "m", kind="table", path=path, mode="append")
    assert rows(both) == rows(one) + rows(two) == rows(spark.table("m"))
    cleared = tables.publish(tables.empty(spark, schemas.FACT_OBSERVACION), "m", kind="table", path=path)
    assert cleared.isEmpty()
    tables.publish(one, "v", layer="staging")
    assert rows(spark.table("v")) == rows(one)
    with pytest.raises(ValueError):
        tables.publish(one, "v", kind="index")
    tables.drop_all(spark, ["v", "m", "never_there"])
    assert not spark.catalog.tableExists("v")


def test_clustered_files_hold_ranges(spark, tmp_path):
    df = spark.range(30_000).selectExpr(
        "IF(id % 3 = 0, 'hot', concat('s', id % 20)) AS serie_id", "date_add(DATE'2000-01-01', CAST(id AS INT)) AS fecha"
    )
    path = str(tmp_path / "fact")
    tables.clustered(df, ["serie_id", "fecha"], files=6).write.parquet(path)
    sizes = spark.read.parquet(path).groupBy("_metadata.file_name").count().collect()
    assert len(sizes) == 6 and max(r["count"] for r in sizes) < 2 * 30_000 / 6


def test_declared_sources(spark):
    source = tables.Sources(spark, "/root/testdata/sf0.001", ["orders"])
    assert "o_orderkey" in source.table("orders").columns
    with pytest.raises(KeyError):
        source.table("nation")


def test_shared_folder_is_the_named_one(spark):
    folder = shared_folder(spark)
    assert folder == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())


_RULES = {
    "schema": schemas.FACT_OBSERVACION,
    "accepted": {"serie_id": ["a", "b"]},
    "ranges": {"valor": (0.0, 10.0)},
}


@pytest.mark.parametrize(
    ("bad", "text"),
    [
        ((None, "2020-01", 1.0), "serie_id is NULL"),
        (("c", "2020-01", 1.0), "not among the accepted"),
        (("a", "2020-01", 10.5), "out of range"),
    ],
)
def test_a_broken_rule_fails_the_write_and_leaves_the_rows_before(spark, panel, tmp_path, bad, text):
    path, good = str(tmp_path / "t"), panel([("a", "2020-01", 10.0), ("b", "2020-01", None)])
    assert rows(tables.publish(good, path=path, **_RULES)) == rows(good)
    with pytest.raises(PySparkException, match=text):
        tables.publish(panel([("b", "2021-01", 0.0), bad]), path=path, **_RULES)
    assert rows(spark.read.parquet(path).drop(tables.LOAD)) == rows(good)
    again = panel([("b", "2021-01", 0.0)])
    assert rows(tables.publish(again, path=path, **_RULES)) == rows(again)
    assert tables.publish(again.limit(0), path=path, **_RULES).isEmpty()


def test_rules_go_with_declared_columns(spark, panel):
    one = panel([("a", "2020-01", 1.0)])
    with pytest.raises(ValueError, match="missing column valor"):
        tables.enforced(one.drop("valor"), schemas.FACT_OBSERVACION)
    with pytest.raises(ValueError, match="undeclared column x"):
        tables.enforced(one, schemas.FACT_OBSERVACION, ranges={"x": (0, 1)})
    with pytest.raises(ValueError, match="go with a schema"):
        tables.publish(one, path="/nowhere", ranges={"valor": (0, 1)})


def test_loads_are_replaced_one_by_one(spark, panel, tmp_path):
    path = str(tmp_path / "loads")
    one, two = panel([("a", "2020-01", 1.0), ("a", "2020-01", 1.0)]), panel([("b", "2020-01", 2.0)])
    assert tables.put_load(one.limit(0), path, 1).isEmpty()
    tables.put_load(one, path, 1)
    tables.put_load(two, path, 2, cluster_by=("serie_id", "fecha"))
    both = tables.put_load(one, path, 1)
    assert rows(both, "serie_id", tables.LOAD) == [("a", 1), ("a", 1), ("b", 2)]
    # A load may be made of the table it belongs to.
    doubled = both.where("carga = 2").selectExpr("serie_id", "fecha", "valor * 2 AS valor")
    assert rows(tables.put_load(doubled, path, 2), "serie_id", "valor") == [("a", 1.0), ("a", 1.0), ("b", 4.0)]
    assert rows(tables.put_load(two.limit(0), path, 2), "serie_id") == [("a",), ("a",)]
    with pytest.raises(ValueError, match="number of the load"):
        tables.put_load(both, path, 3)


def test_a_path_that_is_read_is_not_replaced(spark, panel, tmp_path):
    path = str(tmp_path / "own folder")
    kept = tables.publish(panel([("a", "2020-01", 1.0)]), path=path)
    with pytest.raises(ValueError, match="is read by the rows"):
        tables.publish(kept.where("valor > 0"), path=path)
    assert kept.count() == 1


def _jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_five_hundred_files_take_no_more_jobs_than_two(spark, tmp_path):
    def made(name, n):
        (tmp_path / name).mkdir()
        for i in range(n):
            order, cells = ("fecha,a", "2020-01-01,1") if i % 2 else ("a,fecha", "1,2020-01-01")
            _write(tmp_path / name / f"{i}.csv", f"{order}\n{cells}\n")
        return str(tmp_path / name)

    few, many = made("few", 2), made("many", 500)
    # Listing many files is a job of Spark's own.
    _, jobs_few = _jobs(spark, "few", lambda: delimited.read_panel(spark, few))
    panel, jobs_many = _jobs(spark, "many", lambda: delimited.read_panel(spark, many))
    assert jobs_many <= jobs_few + 4
    assert panel.where("a = 1 AND fecha = DATE'2020-01-01'").count() == 500

    (tmp_path / "pairs").mkdir()
    files = {f"s{i}": _write(tmp_path / "pairs" / f"{i}.csv", f"d,v\n2020-01-01,{i}\n") for i in range(60)}
    daily, jobs = _jobs(spark, "daily", lambda: delimited.load_daily(spark, files, period=None))
    assert jobs <= 2
    text = daily._jdf.queryExecution().optimizedPlan().toString()
    assert "s59" not in text and len(text) < 6000
    assert sorted((r.serie_id, r.valor) for r in daily.collect()) == sorted((f"s{i}", float(i)) for i in range(60))


def test_lines_that_do_not_load_are_kept(spark, tmp_path):
    text = 'DATE,V\n2020-01-01,1\nyesterday,2\n2020-01-02,n.d.\n2020-01-03,4,5\n2020-01-04\n2020-01-05,\n"2020-01-06",8\n'
    files = {"a": _write(tmp_path / "a.csv", text), "b": _write(tmp_path / "b.csv", "D,V\n2019-12-31,3\n")}
    files["absent"] = str(tmp_path / "absent.csv")
    good, rejects = delimited.load_daily_or_reject(spark, files, period=(date(2020, 1, 1), date(2020, 12, 31)))
    assert rows(good) == [("a", "2020-01-01", 1.0), ("a", "2020-01-06", 8.0)]
    found = [(r.serie_id, r.texto, r.motivo) for r in rejects.orderBy("bloque", "fila").collect()]
    assert found == [
        ("a", "yesterday,2", delimited.NO_DATE),
        ("a", "2020-01-02,n.d.", delimited.NO_NUMBER),
        ("a", "2020-01-03,4,5", delimited.NO_PAIR),
        ("a", "2020-01-04", delimited.NO_PAIR),
    ]
    good, rejects = delimited.load_daily_or_reject(spark, {"absent": files["absent"]}, period=None)
    assert good.isEmpty() and rejects.isEmpty()


def test_cells_that_do_not_parse_are_kept(spark):
    data = [("f", 0, ["Fecha", "v"]), ("f", 1, ["2020-01-31", "1"]), ("f", 2, ["2020-02-29", "n.d."]), ("f", 3, ["total", "x"])]
    data += [("f", 4, ["2020-03-31"]), ("f", 5, ["2020-04-30", " "]), ("f", 6, []), ("f", 7, [None, "4"])]
    good, rejects = sheets.scan_or_reject(_sheet(spark, data), 1)
    assert rows(good) == rows(sheets.scan_sheets(_sheet(spark, data), 1)) == [("f", "2020-01-31", 1.0)]
    assert sorted(tuple(r) for r in rejects.collect()) == [
        ("f", 2, "valor", "n.d.", delimited.NO_NUMBER),
        ("f", 3, "fecha", "total", delimited.NO_DATE),
        ("f", 3, "valor", "x", delimited.NO_NUMBER),
    ]


def test_profile_from_footers_reads_no_column(spark, tmp_path):
    data = spark.range(100).selectExpr(
        "concat('s', id % 3) AS serie_id", "date_add(DATE'2020-01-01', CAST(id AS INT)) AS fecha",
        "IF(id % 5 = 0, NULL, double(id)) AS valor", "IF(id % 3 = 1, NULL, id) AS k",
    )
    path, asked = str(tmp_path / "mart"), {"counted": ["valor"], "extremes": ["fecha"]}
    data.write.partitionBy("serie_id").parquet(path)
    before = spark.conf.getAll
    plan = tables.from_footers(spark, path, data.schema, by=["serie_id"], **asked)._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*), COUNT(valor), MIN(fecha), MAX(fecha)]" in plan
    assert spark.conf.getAll == before

    def same(by, extremes):
        found = tables.footer_profile(spark, path, by=by, counted=["valor"], extremes=extremes)
        scanned = tables._profile(spark.read.parquet(path), by, ["valor"], extremes)
        assert sorted(map(str, found.collect())) == sorted(map(str, scanned.collect()))
        return found.count()

    assert (same(["serie_id"], ["fecha"]), same([], ["fecha"]), same(["serie_id"], ["k"])) == (3, 1, 3)
    with pytest.raises(ValueError, match="valor"):
        tables.footer_profile(spark, path, extremes=["valor"])
    data.limit(0).drop("serie_id").write.parquet(f"{path}-empty")
    assert tuple(tables.footer_profile(spark, f"{path}-empty", **asked).first()) == (0, 0, None, None)
