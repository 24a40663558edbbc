"""Each check returns exactly the rows that were spoiled."""

from __future__ import annotations

import pytest
from conftest import months, rows
from pyspark.sql import functions as F

from seriata import schemas
from seriata.operators import constraints as c
from seriata.operators import quality as q
from seriata.operators.transforms import deaccumulate_ytd

CLEAN = [(s, m, float(i % 5)) for s in "ab" for i, m in enumerate(months("2019-01", 24))]


def _without(month, series="a"):
    return [r for r in CLEAN if r[:2] != (series, month)]


@pytest.fixture
def dim(spark):
    return spark.createDataFrame([("a",), ("b",)], "serie_id string")


def _report(panel, dim, data, fact=None, flows=None):
    monthly = panel(data)
    clean_flows = deaccumulate_ytd(panel([("a", "2019-12-31", 3.0)]))
    fact = monthly if fact is None else fact
    return q.quality_report(monthly, fact=fact, dim_serie=dim, flows=flows or clean_flows)


def test_a_clean_panel_has_an_empty_report(panel, dim):
    report = _report(panel, dim, CLEAN)
    assert report.schema.fieldNames() == schemas.REPORTE_CALIDAD.fieldNames()
    assert [f.dataType for f in report.schema] == [f.dataType for f in schemas.REPORTE_CALIDAD]
    assert report.isEmpty()
    assert q.require_no_errors(report) == 0


def test_gap(panel, dim):
    got = rows(_report(panel, dim, _without("2019-07")))
    assert got == [("hueco en la serie", "error", "a", "2019-07-01", "no hay observacion para este mes")]


def test_gaps_inside_the_own_range_only(panel):
    df = panel([("a", "2020-03", 1.0), ("a", "2020-06", 1.0), ("b", "2020-01", 1.0), ("b", "2020-01", 1.0), (None, "2020-01", 1.0)])
    assert rows(q.find_gaps(df)) == [("a", "2020-04-01"), ("a", "2020-05-01")]
    ends = panel([("a", "2020-01-31", 1.0), ("a", "2020-04-30", 1.0)])
    assert rows(q.find_gaps(ends), "fecha") == [("2020-02-01",), ("2020-03-01",)]
    days = panel([("a", "2020-02-28", 1.0), ("a", "2020-03-01", 1.0)])
    assert rows(q.find_gaps(days, "day"), "fecha") == [("2020-02-29",)]


def test_duplicate(panel, dim):
    got = rows(_report(panel, dim, [*CLEAN, ("b", "2019-03", 2.0), ("b", "2019-03", 2.0)]))
    assert got == [("duplicado", "error", "b", "2019-03-01", "aparece 3 veces")]


def test_two_dates_of_a_month_become_a_duplicate(panel):
    flows = deaccumulate_ytd(panel([("a", "2020-05-15", 4.0), ("a", "2020-05-31", 9.0)]))
    assert rows(q.find_duplicates(flows)) == [("a", "2020-05-01", 2)]


def test_null(panel, dim):
    got = rows(_report(panel, dim, [*_without("2019-05"), ("a", "2019-05", None)]))
    assert got == [("valor nulo", "error", "a", "2019-05-01", "valor NULL")]


def test_orphan(panel, dim):
    fact = panel([("z", "2019-01", 1.0), ("a", "2019-01", 1.0), (None, "2019-01", 1.0)])
    got = rows(_report(panel, dim, CLEAN, fact=fact))
    assert [r[2] for r in got] == ["z", None] or [r[2] for r in got] == [None, "z"]
    assert {r[0] for r in got} == {"serie huerfana"}


def test_jump(panel, dim):
    spoiled = [("a", m, 1000.0 if m == "2020-02" else float(i % 2)) for i, m in enumerate(months("2015-01", 72))]
    spoiled += [("b", m, 1.0) for m in months("2015-01", 72)]
    got = rows(_report(panel, dim, spoiled))
    assert [r[3] for r in got] == ["2020-02-01", "2020-03-01"]
    assert got[0] == ("salto improbable", "aviso", "a", "2020-02-01", got[0][4])
    assert got[0][4].startswith("cambio 1000.0 = 5.9 desviaciones")
    assert q.require_no_errors(_report(panel, dim, spoiled)) == 2


def test_series_too_short_or_constant_do_not_jump(panel):
    df = panel([("a", "2020-01", 1.0), ("b", "2020-01", 1.0), ("b", "2020-02", 9.0), ("c", "2020-01", 1.0), ("c", "2020-02", 1.0), ("c", "2020-03", 1.0)])
    assert q.find_jumps(df, sigmas=0).isEmpty()


def test_mismatch_sees_a_changed_flow_only(panel, dim):
    raw = panel([("a", f"{m}-28", float((i % 12 + 1) * 2)) for i, m in enumerate(months("2019-01", 30))])
    flows = deaccumulate_ytd(raw)
    assert q.find_ytd_mismatches(flows).isEmpty()
    # The flows of a year telescope: a changed total or a lost month goes unseen.
    totals = raw.withColumn("valor", F.when(F.month("fecha") == 6, 99.0).otherwise(F.col("valor")))
    assert q.find_ytd_mismatches(deaccumulate_ytd(totals)).isEmpty()
    assert q.find_ytd_mismatches(deaccumulate_ytd(raw.where(F.month("fecha") != 6))).isEmpty()
    off = flows.withColumn("flujo", F.col("flujo") + F.when(F.col("fecha") == "2020-05-01", 1.5).otherwise(0.0))
    got = rows(_report(panel, dim, CLEAN, flows=off))
    assert got == [("descuadre de desacumulacion", "error", "a", "2020-12-01", "suma de flujos 25.5 != acumulado de diciembre 24.0")]
    with pytest.raises(q.QualityError, match="1 errors"):
        q.require_no_errors(_report(panel, dim, CLEAN, flows=off))
    # 2021 has no December yet.
    late = flows.withColumn("flujo", F.col("flujo") + F.when(F.col("fecha") == "2021-05-01", 1.5).otherwise(0.0))
    assert q.find_ytd_mismatches(late).isEmpty()


def test_stale(panel, dim):
    got = rows(_report(panel, dim, [r for r in CLEAN if r[0] == "b" or r[1] < "2020-11"]))
    assert got == [("serie desactualizada", "aviso", "a", "2020-10-01", "termina antes que el resto del panel")]


def test_counts_by_severity(panel, dim):
    late = [r for r in _without("2019-07") if r[0] == "b" or r[1] < "2020-11"]
    assert rows(q.severity_counts(_report(panel, dim, late))) == [("aviso", 1), ("error", 1)]


# ---------------------------------------------------------------- constraints


def test_null_passes_every_constraint_but_not_null(spark):
    df = spark.createDataFrame([(1, "M"), (1, "X"), (None, None), (None, None), (9, "D")], "n int, f string")
    ref = spark.createDataFrame([(1,), (None,)], "k int")
    assert rows(c.not_null(df, "n")) == [(None, None), (None, None)]
    assert rows(c.unique(df, ["n"])) == [(1, 2)]
    assert rows(c.relationships(df, "n", ref, "k")) == [(9, "D")]
    assert rows(c.accepted_values(df, "f", schemas.FREQUENCIES)) == [(1, "X")]
    assert rows(c.in_range(df, "n", 1, 8)) == [(9, "D")]
    assert c.in_range(df, "n", 1, 9).isEmpty()


def test_declared_schema(spark, panel):
    df = panel([("a", "2020-01", 1.0)])
    assert c.schema_failures(df, schemas.FACT_OBSERVACION) == []
    assert c.schema_failures(df.select("serie_id", F.lit(1).alias("valor")), schemas.FACT_OBSERVACION) == [
        "missing column fecha",
        "column valor is int, declared double",
    ]
    holed = panel([("a", "2020-01", None), ("b", None, 1.0)])
    assert rows(c.null_failures(holed, schemas.FACT_OBSERVACION)) == [("b", None, 1.0)]
    assert c.null_failures(holed, schemas.FACT_ACUMULADO_CRUDO).count() == 2


def test_counts_seen_while_the_report_is_written(spark, panel, tmp_path):
    from pyspark.sql import Observation

    from seriata.sources.tables import publish

    frame = [("c", s, "a", None, "d") for s in (q.ERROR, q.ERROR, q.WARNING)]
    report = spark.createDataFrame(frame, "chequeo string, severidad string, serie_id string, fecha date, detalle string")
    for cluster in ((), ("serie_id", "fecha")):
        seen = Observation()
        how = {"cluster_by": cluster, "observe": (seen, q.report_counts())}
        publish(report, path=str(tmp_path / f"r{len(cluster)}"), **how)
        assert (seen.get[q.ERROR], seen.get[q.WARNING], seen.get[q.ORPHAN]) == (2, 1, 0)
    with pytest.raises(q.QualityError):
        q.require_no_errors(None, seen.get)
    assert q.require_no_errors(None, {q.ERROR: 0, q.WARNING: 7}) == 7
