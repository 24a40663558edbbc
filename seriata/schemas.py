"""Declared schemas of the star and of the quality report."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


# Names and accepted values that results have to carry as they are.
FREQUENCIES = ("D", "M", "Q")
PROVIDERS = ("FRED", "BCCR")
QUARTERS = (1, 4)
MONTHS = (1, 12)

DIM_SERIE = _schema(
    ("serie_id", T.StringType(), False),
    ("etiqueta", T.StringType(), False),
    ("frecuencia", T.StringType(), False),
    ("origen", T.StringType(), False),
    ("proveedor", T.StringType(), False),
    ("titulo_original", T.StringType(), True),
)

DIM_FECHA = _schema(
    ("fecha", T.DateType(), False),
    ("anio", T.ShortType(), False),
    ("trimestre", T.ByteType(), False),
    ("mes", T.ByteType(), False),
    ("fin_de_anio", T.BooleanType(), False),
)

# A NULL value is a declared gap, not a zero.
FACT_OBSERVACION = _schema(
    ("serie_id", T.StringType(), False),
    ("fecha", T.DateType(), False),
    ("valor", T.DoubleType(), True),
)
FACT_OBSERVACION_DIARIA = FACT_OBSERVACION

FACT_ACUMULADO_CRUDO = _schema(
    ("serie_id", T.StringType(), False),
    ("fecha", T.DateType(), False),
    ("valor", T.DoubleType(), False),
)

REPORTE_CALIDAD = _schema(
    ("chequeo", T.StringType(), True),
    ("severidad", T.StringType(), True),
    ("serie_id", T.StringType(), True),
    ("fecha", T.DateType(), True),
    ("detalle", T.StringType(), True),
)

METADATA = _schema(
    ("variable", T.StringType(), True),
    ("etiqueta", T.StringType(), True),
    ("frecuencia", T.StringType(), True),
    ("origen", T.StringType(), True),
    ("titulo_original", T.StringType(), True),
)
