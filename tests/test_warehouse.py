"""From files to verdict, as a user runs it."""

from __future__ import annotations

import zipfile
from datetime import date, timedelta

import pytest
from conftest import months, rows
from pyspark.sql import functions as F

from seriata.plans.warehouse import Files, build_warehouse, load_star, reconcile_panels, verify
from seriata.sources.delimited import read_panel

MONTHS = months("2019-01", 36)
MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _rate(i):
    return round(2 + (i * 7 % 12) / 8, 3)


def _flow(i):
    return float(100 + i * 37 % 50)


def _gdp(quarter):
    return 1000.0 + quarter


def _days():
    day, out = date(2019, 1, 1), []
    while day < date(2022, 1, 1):
        if day.weekday() < 5:
            out.append((day, float(day.day % 9)))
        day += timedelta(days=1)
    return out


def _mean(values):
    return sum(values) / len(values)


def _workbook(path, totals):
    def row(i, day, total):
        return f'<row r="{i}"><c r="A{i}" s="1"><v>{day}</v></c><c r="B{i}"><v>{total!r}</v></c></row>'

    head = "".join(
        f'<row r="{i}"><c r="A{i}" t="inlineStr"><is><t>{text}</t></is></c></row>'
        for i, text in ((1, "Balance"), (3, "Fecha"))
    )
    body = "".join(row(4 + i, day, total) for i, (day, total) in enumerate(totals))
    parts = {
        "xl/workbook.xml": f'<workbook {MAIN} xmlns:r="{RELATION}"><sheets><sheet name="c" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="/xl/worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {MAIN}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f"<worksheet {MAIN}><sheetData>{head}{body}</sheetData></worksheet>",
    }
    with zipfile.ZipFile(path, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)


@pytest.fixture
def files(tmp_path):
    (tmp_path / "meta.csv").write_text(
        "variable,etiqueta,frecuencia,origen,titulo_original\n"
        "rate,Rate,M,BCCR - rate.xlsx,\nbal,Balance,M,BCCR - bal.xlsx,Balance\n"
        "gdp,GDP,Q,FRED - GDP,\nt2y,Treasury,D,FRED - DGS2,\n"
    )
    days = _days()
    by_month = {m: _mean([v for d, v in days if d.isoformat()[:7] == m]) for m in MONTHS}
    monthly = [f"{m}-01,{_rate(i)},{_flow(i)},{_gdp(i // 3)},{by_month[m]!r}" for i, m in enumerate(MONTHS)]
    (tmp_path / "mensual.csv").write_text("fecha,rate,bal,gdp,t2y\n" + "\n".join(monthly) + "\n")
    quarterly = []
    for q in range(12):
        span = range(3 * q, 3 * q + 3)
        own = [v for d, v in days if d.isoformat()[:7] in {MONTHS[i] for i in span}]
        cells = _mean([_rate(i) for i in span]), _mean([_flow(i) for i in span]), _gdp(q), _mean(own)
        quarterly.append(f"{MONTHS[3 * q]}-01," + ",".join(map(repr, cells)))
    (tmp_path / "trimestral.csv").write_text("fecha,rate,bal,gdp,t2y\n" + "\n".join(quarterly) + "\n")
    (tmp_path / "t2y.csv").write_text("DATE,DGS2\n" + "".join(f"{d},{v}\n" for d, v in days))
    totals, so_far = [], 0.0
    for i, m in enumerate(MONTHS):
        so_far = _flow(i) + (so_far if i % 12 else 0.0)
        first = date.fromisoformat(f"{m}-01")
        end = (first + timedelta(days=31)).replace(day=1) - timedelta(days=1)
        totals.append(((end - date(1899, 12, 30)).days, so_far))
    _workbook(tmp_path / "bal.xlsx", totals)
    return Files(
        metadata=str(tmp_path / "meta.csv"),
        panels={"mensual": str(tmp_path / "mensual.csv"), "trimestral": str(tmp_path / "trimestral.csv")},
        routes={"trimestral": "Q"},
        otherwise="mensual",
        daily={"t2y": str(tmp_path / "t2y.csv"), "dolar": str(tmp_path / "absent.csv")},
        ytd={"bal": (str(tmp_path / "bal.xlsx"), 1)},
    )


def test_from_files_to_verdict(spark, files, tmp_path):
    star = load_star(spark, files, period=None)
    assert star.dim_fecha.count() == 36
    assert rows(star.observations.groupBy("serie_id").count()) == [("bal", 36), ("gdp", 12), ("rate", 36), ("t2y", 36)]

    built = build_warehouse(star.dim_serie, star.observations, star.ytd_raw, folder=str(tmp_path / "marts"))
    assert rows(built.monthly.groupBy("serie_id").count()) == [("bal", 36), ("rate", 36)]
    assert built.yoy.where("var_interanual_pc IS NOT NULL").count() == 48
    expected = star.observations.where(F.col("serie_id").isin("bal", "rate"))
    verdicts = verify(built, expected, series=4)
    assert verdicts.where(~F.col("ok")).isEmpty() and verdicts.count() == 6


def test_the_star_reproduces_its_panels(spark, files):
    star = load_star(spark, files, period=None)
    monthly, quarterly = (
        read_panel(spark, files.panels[tag]).drop("archivo", "orden") for tag in ("mensual", "trimestral")
    )
    out = reconcile_panels(star, monthly, quarterly, carried="gdp")
    assert rows(out, "panel", "serie_id", "filas", "ok") == [
        (panel, series, n, True)
        for panel, n in (("mensual", 36), ("trimestral", 12))
        for series in ("bal", "gdp", "rate", "t2y")
    ]
    off = monthly.withColumn("rate", F.col("rate") + F.when(F.col("fecha") == "2020-05-01", 1e-8).otherwise(0.0))
    bad = reconcile_panels(star, off, quarterly, carried="gdp").where(~F.col("ok"))
    assert rows(bad, "panel", "serie_id") == [("mensual", "rate")]


def test_a_broken_rebuild_is_seen(spark, files):
    star = load_star(spark, files, period=None)
    spoiled = star.ytd_raw.withColumn("valor", F.when(F.col("fecha") == "2020-05-31", 1.0).otherwise(F.col("valor")))
    dim = star.dim_serie.where("serie_id <> 'gdp'")
    built = build_warehouse(dim, star.observations, spoiled)
    verdicts = verify(built, star.observations.where("serie_id = 'bal'"), series=4)
    assert rows(verdicts.where(~F.col("ok")), "prueba") == [
        ("reconcilia",),
        ("series declaradas",),
        ("sin errores de calidad",),
        ("sin huerfanas",),
    ]
