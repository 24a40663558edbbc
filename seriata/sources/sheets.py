"""Sheets with title rows above the table.

A sheet is a frame of ``archivo, row_idx, cells``.  The header is the first of
the first rows whose first cell starts with a given word; the rows below it are
the table.  Only the first rows of a file meet to find the header; it is joined
back, so that rows given as a frame may be of any number.  A workbook is decoded
by one task, which its format bounds: a sheet holds at most 1,048,576 rows.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Mapping
from datetime import date, datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriata import schemas
from seriata.functions.dates import try_date
from seriata.functions.numbers import try_number
from seriata.functions.text import starts_like
from seriata.session import settle
from seriata.sources.delimited import NO_DATE, NO_NUMBER
from seriata.sources.paths import existing, files_below, plain_path, plain_path_of, small_table

HEADER_WORD = "fecha"
HEADER_ROWS = 15
SHEET_SCHEMA = "archivo string, row_idx int, cells array<string>"

_ROWS_PER_BATCH = 10_000
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# The number formats that a workbook uses for dates without naming them.
_DATE_FORMATS = {14, 15, 16, 17, 22}


def scan_sheets(
    rows: DataFrame,
    value_column: Column | int,
    *,
    word: str = HEADER_WORD,
    header_rows: int = HEADER_ROWS,
    date_formats: tuple[str, ...] = (),
    each: str | None = None,
) -> DataFrame:
    """``archivo, fecha, valor`` of every table row that parses.

    ``value_column`` is the index of the value cell, or a column that gives it.
    ``each`` names an array column: a table row comes once per element, as
    ``one``.  Other columns pass through.  A file without a header fails the
    query when its rows are read.  ``rows`` are read twice, the first time only
    where ``row_idx`` is small, which reaches a scan of stored rows.
    """
    below = _table_rows(rows, word, header_rows)
    return (
        below.withColumn("one", F.explode(each) if each else F.lit(None))
        .select(
            *[c for c in rows.columns if c not in ("row_idx", "cells", each)],
            *(["one"] if each else []),
            try_date(_first_cell(), *date_formats).alias("fecha"),
            try_number(_cell(value_column)).alias("valor"),
        )
        .na.drop("any", subset=["fecha", "valor"])
    )


def scan_or_reject(
    rows: DataFrame,
    value_column: Column | int,
    *,
    word: str = HEADER_WORD,
    header_rows: int = HEADER_ROWS,
    date_formats: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """What ``scan_sheets`` gives of ``archivo, row_idx, cells``, and the cells it leaves out.

    The cells are ``archivo, row_idx, columna, texto, motivo``; a blank cell has
    no value and is no reject.  The table's rows are parsed and written once;
    both results read what was written.
    """
    parsed = settle(
        _table_rows(rows, word, header_rows).select(
            "archivo",
            "row_idx",
            _first_cell().alias("texto_fecha"),
            try_date(_first_cell(), *date_formats).alias("fecha"),
            _cell(value_column).alias("texto_valor"),
            try_number(_cell(value_column)).alias("valor"),
        )
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(column).alias("columna"),
                F.col(f"texto_{column}").alias("texto"),
                F.lit(reason).alias("motivo"),
                (F.col(column).isNull() & (F.trim(f"texto_{column}") != "")).alias("rejected"),
            )
            for column, reason in (("fecha", NO_DATE), ("valor", NO_NUMBER))
        ]
    )
    rejects = parsed.select("archivo", "row_idx", F.inline(cells)).where("rejected").drop("rejected")
    return parsed.select("archivo", "fecha", "valor").na.drop("any", subset=["fecha", "valor"]), rejects


def _table_rows(rows: DataFrame, word: str, header_rows: int) -> DataFrame:
    """The rows below each file's header."""
    tops = rows.where((F.col("row_idx") < header_rows) & starts_like(_first_cell(), word))
    headers = tops.groupBy("archivo").agg(F.min("row_idx").alias("header"))
    no_header = F.raise_error(F.concat(F.lit("no header row in "), F.col("archivo")))
    below = F.when(F.col("header").isNull(), no_header.cast("boolean")).otherwise(
        F.col("row_idx") > F.col("header")
    )
    return rows.join(headers, "archivo", "left").where(below)


def _first_cell() -> Column:
    return F.try_element_at("cells", F.lit(1))


def _cell(index: Column | int) -> Column:
    index = F.lit(index) if isinstance(index, int) else index
    return F.try_element_at("cells", (index + 1).cast("int"))


def load_ytd(
    spark: SparkSession,
    files: Mapping[str, tuple[str, int]],
    *,
    period: tuple[date, date] | None,
    rows: DataFrame | None = None,
) -> DataFrame:
    """Year-to-date series (series to sheet and value column), never altered.

    A sheet may serve several series, each with its own column; it is read
    once.  ``rows`` are the sheets' rows (``archivo, row_idx, cells``) where
    they do not come from workbooks; the map then names ``archivo``.  Rows
    outside ``period`` (closed; ``None`` keeps all) are left out.
    """
    if rows is None:
        found = set(existing(spark, dict.fromkeys(path for path, _ in files.values())))
        files = {series: spec for series, spec in files.items() if spec[0] in found}
        if not files:
            return spark.createDataFrame([], schemas.FACT_ACUMULADO_CRUDO)
        asked = {plain_path(file): path for path in found for file in files_below(spark, path)}
        names = small_table(spark, {"file": asked.keys(), "asked_by": asked.values()})
        # Decoded once; what follows reads the rows twice.
        cells = settle(read_sheets(spark, *found)).withColumn("file", plain_path_of("archivo"))
        rows = cells.join(names, "file").select(F.col("asked_by").alias("archivo"), "row_idx", "cells")
    places = list(files.values())
    spec = small_table(
        spark, {"serie_id": files.keys(), "archivo": (p for p, _ in places), "place": (c for _, c in places)}
    )
    by_file = spec.groupBy("archivo").agg(F.collect_list(F.struct("serie_id", "place")).alias("asked"))
    wanted = rows.join(by_file, "archivo")
    each = scan_sheets(wanted, F.col("one.place"), each="asked")
    table = each.select(F.col("one.serie_id").alias("serie_id"), "fecha", "valor")
    return table.where(F.col("fecha").between(*period)) if period else table


def read_sheets(spark: SparkSession, *paths: str) -> DataFrame:
    """First sheet of each workbook (.xlsx) as numbered rows of text."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select(F.col("_metadata.file_path").alias("path"), "content").mapInPandas(_rows_of_files, SHEET_SCHEMA)


def _rows_of_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            part: list[tuple[str, int, list[str | None]]] = []
            for i, cells in enumerate(_xlsx_rows(content)):
                part.append((path, i, cells))
                if len(part) == _ROWS_PER_BATCH:
                    yield pd.DataFrame(part, columns=["archivo", "row_idx", "cells"])
                    part = []
            if part:
                yield pd.DataFrame(part, columns=["archivo", "row_idx", "cells"])


def _xlsx_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cells of the first sheet as text; cells with a date format as ISO dates."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in root]
        dates = _date_styles(book.read("xl/styles.xml")) if "xl/styles.xml" in names else set()
        due = 1
        with book.open(_first_sheet(book)) as xml:
            for _, row in ElementTree.iterparse(xml):
                if row.tag != f"{_NS}row":
                    continue
                number = int(row.get("r", due))
                for _ in range(due, number):
                    yield []
                due = number + 1
                cells: list[str | None] = []
                for cell in row.iter(f"{_NS}c"):
                    at = _column_index(cell.get("r", "")) if cell.get("r") else len(cells)
                    cells.extend([None] * (at - len(cells)))
                    cells.append(_cell_text(cell, shared, dates))
                row.clear()
                yield cells


def _first_sheet(book: zipfile.ZipFile) -> str:
    """Part that holds the sheet the workbook lists first."""
    listed = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_NS}sheets/{_NS}sheet")
    parts = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(p.get("Target") for p in parts if p.get("Id") == listed.get(f"{_RELATION}id"))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _date_styles(xml: bytes) -> set[int]:
    root = ElementTree.fromstring(xml)
    named = {
        int(f.get("numFmtId", "0"))
        for f in root.iter(f"{_NS}numFmt")
        if any(mark in f.get("formatCode", "").lower() for mark in ("yy", "mmm", "dd"))
    }
    formats = root.find(f"{_NS}cellXfs")
    if formats is None:
        return set()
    return {
        i
        for i, xf in enumerate(formats)
        if int(xf.get("numFmtId", "0")) in _DATE_FORMATS | named
    }


def _column_index(reference: str) -> int:
    index = 0
    for letter in reference:
        if not letter.isalpha():
            break
        index = index * 26 + ord(letter.upper()) - ord("A") + 1
    return index - 1


def _cell_text(cell: ElementTree.Element, shared: list[str], dates: set[int]) -> str | None:
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_NS}t")) or None
    value = cell.findtext(f"{_NS}v")
    if value is None:
        return None
    if cell.get("t") == "s":
        return shared[int(value)]
    if cell.get("t") in (None, "n") and int(cell.get("s", "0")) in dates:
        return (datetime(1899, 12, 30) + timedelta(days=float(value))).isoformat()
    return value
