"""Optional and required inputs."""

from __future__ import annotations

import logging
import re
from collections.abc import Iterable, Mapping
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("seriata")

_LOCAL = "^file:/+"


def plain_path(uri: str) -> str:
    """A file's address without the scheme of local files, which is written in two ways."""
    return re.sub(_LOCAL, "/", uri)


def plain_path_of(uri: str | Column) -> Column:
    """The same of a column."""
    return F.regexp_replace(uri, _LOCAL, "/")


def files_below(spark: SparkSession, path: str) -> list[str]:
    """The files that ``path`` (file, folder or pattern) names, as URIs; listed, not read."""
    return sorted(spark.read.format("binaryFile").load(path).inputFiles())


def small_table(spark: SparkSession, columns: Mapping[str, Iterable]) -> DataFrame:
    """What the caller has named, as a relation whose size Spark knows."""
    return spark.createDataFrame(pa.table({name: list(values) for name, values in columns.items()}))


def reads(df: DataFrame, path: str) -> bool:
    """Whether ``df`` reads files below the folder ``path``."""
    folder = plain_path(path).rstrip("/") + "/"
    return any(plain_path(unquote(file)).startswith(folder) for file in df.inputFiles())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds something at ``path``; nothing is read."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error.getCondition()):
            return False
        raise
    return True


def existing(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """The paths that exist; the others are reported and left out."""
    found = []
    for path in paths:
        if exists(spark, path):
            found.append(path)
        else:
            log.warning("missing %s, left out", path)
    return found


def require(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return path
