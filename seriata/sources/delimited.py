"""CSV sources with declared schemas, read in one scan each."""

from __future__ import annotations

import csv
from collections.abc import Mapping
from datetime import date
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriata import schemas
from seriata.functions.numbers import no_nan
from seriata.operators.reshape import build_dim_serie, wide_to_long
from seriata.session import settle
from seriata.sources.paths import existing, files_below, plain_path, plain_path_of, require, small_table

NO_DATE, NO_NUMBER, NO_PAIR = "no date", "no number", "wrong number of cells"

_PAIR = T.StructType([T.StructField("fecha", T.DateType()), T.StructField("valor", T.DoubleType())])


def read_panel(spark: SparkSession, path: str, *, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Wide panel: ``fecha`` and one double per series, named by each file's header.

    Files that name the same columns in another order are read apart, one scan
    per header.  A cell that is no number or date fails the read, as does a file
    whose header changes meanwhile.  ``archivo`` and ``orden`` tell the file and
    the place in it, for first-wins dedup.
    """
    headers = _headers(spark, path)
    columns = list(dict.fromkeys(c for header in headers for c in header))
    parts = []
    for header, files in headers.items():
        schema = T.StructType(
            [T.StructField(c, T.DateType() if c == "fecha" else T.DoubleType()) for c in header]
        )
        part = (
            spark.read.schema(schema)
            .options(header=True, dateFormat=date_format, mode="FAILFAST", enforceSchema=False)
            .csv(files)
            .select(
                "*",
                F.col("_metadata.file_name").alias("archivo"),
                # Blocks are read in order, each within one task.
                F.struct(
                    "_metadata.file_path",
                    "_metadata.file_block_start",
                    F.monotonically_increasing_id().alias("row"),
                ).alias("orden"),
            )
        )
        parts.append(part)
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return together.select(*[f"`{c}`" for c in columns], "archivo", "orden")


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files below ``path`` by their column names, found by one job however many files there are.

    It reads the first block of each file and shuffles its first line.  To the
    driver come the different headers with their files' paths, as many as the
    reader itself has to list; empty files have no header and are left out.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.struct(F.monotonically_increasing_id().alias("row"), "value").alias("line"),
    )
    # A block is read in order within one task; a header is a line that is not empty.
    firsts = lines.where("block = 0 AND trim(line.value) <> ''").groupBy("file").agg(F.min("line").alias("line"))
    found: dict[tuple[str, ...], list[str]] = {}
    for row in firsts.groupBy("line.value").agg(F.sort_array(F.collect_list("file")).alias("files")).collect():
        header = tuple(next(csv.reader([row["value"].removeprefix("\ufeff")], escapechar="\\")))
        found.setdefault(header, []).extend(unquote(file) for file in row["files"])  # they come as URIs
    if not found:
        raise ValueError(f"no header in {path}")
    return dict(sorted(found.items(), key=lambda item: min(item[1])))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The metadata's columns by name, in whatever order the file has them; one that is missing fails."""
    text = spark.read.option("header", True).csv(path)
    missing = [f.name for f in schemas.METADATA if f.name not in text.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return text.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schemas.METADATA])


def load_dim_serie(spark: SparkSession, path: str) -> DataFrame:
    return build_dim_serie(read_metadata(spark, require(spark, path)))


def load_observations(
    spark: SparkSession,
    panels: Mapping[str, str],
    dim_serie: DataFrame,
    *,
    routes: Mapping[str, str],
    otherwise: str,
) -> DataFrame:
    """Wide panels (tag to path) to the fact table; absent panels are left out."""
    found = existing(spark, panels.values())
    if not found:
        return spark.createDataFrame([], schemas.FACT_OBSERVACION)
    wide = {
        tag: read_panel(spark, path).drop("archivo")
        for tag, path in panels.items()
        if path in found
    }
    return wide_to_long(wide, dim_serie, routes=routes, otherwise=otherwise)


def series_of_files(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    """``(file, serie_id)`` of every file that the paths of ``files`` (series to path) name.

    The files are listed, not read.  It is one relation to join by path, with no expression
    per file; Spark knows its size and broadcasts it only below its own threshold.
    """
    if len(set(files.values())) < len(files):
        raise ValueError("two series name one path")
    found = {plain_path(file): series for series, path in files.items() for file in files_below(spark, path)}
    return small_table(spark, {"file": found.keys(), "serie_id": found.values()})


def load_daily(
    spark: SparkSession,
    files: Mapping[str, str],
    *,
    period: tuple[date, date] | None,
    date_format: str = "yyyy-MM-dd",
) -> DataFrame:
    """Two-column daily CSVs (series to file, folder or pattern), whatever their headers say.

    All files go through one scan, so the plan does not grow with the number
    of series.  Dates are strict; rows without a value are dropped, and rows
    outside ``period`` (closed; ``None`` keeps all).
    """
    kept = _present(spark, files)
    if not kept:
        return spark.createDataFrame([], schemas.FACT_OBSERVACION_DIARIA)
    rows = (
        spark.read.schema(_PAIR)
        .options(header=True, dateFormat=date_format, mode="FAILFAST")
        .csv(sorted(kept.values()))
        .select(plain_path_of("_metadata.file_path").alias("file"), "fecha", no_nan(F.col("valor")).alias("valor"))
        .na.drop("any", subset=["fecha", "valor"])
    )
    named = _named(rows, series_of_files(spark, kept)).select("serie_id", "fecha", "valor")
    return named.where(F.col("fecha").between(*period)) if period else named


def load_daily_or_reject(
    spark: SparkSession,
    files: Mapping[str, str],
    *,
    period: tuple[date, date] | None,
    date_format: str = "yyyy-MM-dd",
) -> tuple[DataFrame, DataFrame]:
    """As ``load_daily``, but a line that is no date and number is kept apart instead of failing the load.

    The second frame is ``serie_id, archivo, bloque, fila, texto, motivo``: the
    line as it stands in the file, where its block begins, a number that grows
    with the lines of a block, and what is wrong with it.  ``period`` does not
    apply to it.  The files are scanned once and what was parsed is written;
    both frames read what was written.
    """
    kept = _present(spark, files)
    rejected = "serie_id string, archivo string, bloque long, fila long, texto string, motivo string"
    if not kept:
        return spark.createDataFrame([], schemas.FACT_OBSERVACION_DIARIA), spark.createDataFrame([], rejected)
    lines = (
        spark.read.schema(T.StructType([*_PAIR, T.StructField("texto", T.StringType())]))
        .options(header=True, dateFormat=date_format, mode="PERMISSIVE", columnNameOfCorruptRecord="texto")
        .csv(sorted(kept.values()))
        .select(
            plain_path_of("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("bloque"),
            F.monotonically_increasing_id().alias("fila"),
            "*",
        )
    )
    parsed = settle(_named(lines, series_of_files(spark, kept)))
    good = parsed.where("texto IS NULL").select("serie_id", "fecha", no_nan(F.col("valor")).alias("valor"))
    good = good.na.drop("any", subset=["fecha", "valor"])
    cells = F.from_csv("texto", F.lit("fecha string, valor string"))
    no_date = F.try_to_timestamp(cells["fecha"], F.lit(date_format)).isNull() & cells["fecha"].isNotNull()
    no_number = cells["valor"].try_cast("double").isNull() & cells["valor"].isNotNull()
    reason = F.when(no_date, NO_DATE).when(no_number, NO_NUMBER).otherwise(NO_PAIR)
    rejects = parsed.where("texto IS NOT NULL").select(
        "serie_id", F.col("file").alias("archivo"), "bloque", "fila", "texto", reason.alias("motivo")
    )
    return good.where(F.col("fecha").between(*period)) if period else good, rejects


def _present(spark: SparkSession, files: Mapping[str, str]) -> dict[str, str]:
    found = set(existing(spark, files.values()))
    return {series: path for series, path in files.items() if path in found}


def _named(rows: DataFrame, series: DataFrame) -> DataFrame:
    """The rows with the series of their ``file``; one that no series has fails the query."""
    stray = F.raise_error(F.concat(F.lit("no series has the file "), F.col("file")))
    joined = rows.join(series, "file", "left")
    return joined.withColumn("serie_id", F.coalesce("serie_id", stray))
