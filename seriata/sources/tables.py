"""Declared source tables and published relations."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriata.operators.constraints import schema_failures
from seriata.session import new_folder
from seriata.sources.paths import reads

LOAD = "carga"  # the column that keys a table by load number

# Layer to (kind of relation, schema); staging is cheap to recompute, marts are read often.
LAYERS = {"staging": "view", "marts": "table"}


class Sources:
    """Parquet tables that are read and never produced, by declared name."""

    def __init__(self, spark: SparkSession, folder: str, declared: Iterable[str]):
        self._spark, self._folder, self._declared = spark, folder, frozenset(declared)

    def table(self, name: str) -> DataFrame:
        if name not in self._declared:
            raise KeyError(f"{name} is not a declared source")
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def clustered(df: DataFrame, by: Sequence[str], files: int | None = None) -> DataFrame:
    """Rows in ``by`` order over files of near-equal size.

    A range exchange, so a series with a third of all rows takes a third of
    the files; min/max statistics then skip files by series and date.
    """
    cut = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    return cut.sortWithinPartitions(*by)


def publish(
    df: DataFrame,
    name: str | None = None,
    *,
    kind: str | None = None,
    layer: str | None = None,
    path: str | None = None,
    cluster_by: Sequence[str] = (),
    mode: str = "overwrite",
    schema: T.StructType | None = None,
    accepted: Mapping[str, Sequence] | None = None,
    ranges: Mapping[str, tuple] | None = None,
    observe: tuple[Observation, Sequence[Column]] | None = None,
) -> DataFrame:
    """Create or replace a view ``name``, or a parquet table.

    A table is written to ``path`` (replacing or, with ``mode="append"``,
    adding rows) and read back, so what follows starts from the written rows;
    with a ``name`` the session gets a view of it.  Without a path it becomes
    the table ``name`` of the session's catalog.  Replacing a path that ``df``
    reads is refused.

    ``schema``, ``accepted`` and ``ranges`` are enforced by the job that writes
    (see ``enforced``).  With them a path is replaced as load 0 of ``put_load``,
    so that a row that breaks a rule leaves the rows that were there before.

    ``observe`` takes aggregates of the rows as they are written, above every
    exchange, so that no row is counted twice when a map task is repeated.
    """
    kind = kind or LAYERS[layer or "marts"]
    spark = df.sparkSession
    rules = schema is not None
    if not rules and (accepted or ranges):
        raise ValueError("accepted values and ranges go with a schema")
    if kind == "view":
        df = enforced(df, schema, accepted=accepted, ranges=ranges) if rules else df
        df.createOrReplaceTempView(name)
        return df
    if kind != "table":
        raise ValueError("kind is 'view' or 'table'")
    if rules and path is not None and mode == "overwrite":
        how = {"cluster_by": cluster_by, "accepted": accepted, "ranges": ranges, "observe": observe}
        written = put_load(df, path, 0, schema=schema, **how).drop(LOAD)
    else:
        if path is not None and mode == "overwrite" and reads(df, path):
            raise ValueError(f"{path} is read by the rows that would replace it")
        rows = enforced(df, schema, accepted=accepted, ranges=ranges) if rules else df
        rows = clustered(rows, cluster_by) if cluster_by else rows
        rows = rows.observe(observe[0], *observe[1]) if observe else rows
        if path is None:
            rows.write.mode(mode).format("parquet").saveAsTable(name)
            return spark.table(name)
        rows.write.mode(mode).parquet(path)
        written = spark.read.parquet(path)
    if name is not None:
        written.createOrReplaceTempView(name)
    return written


def enforced(
    df: DataFrame,
    schema: T.StructType,
    *,
    accepted: Mapping[str, Sequence] | None = None,
    ranges: Mapping[str, tuple] | None = None,
) -> DataFrame:
    """The declared columns, in that order; reading a row that breaks a rule fails the query.

    Rules are NOT NULL of ``schema``, ``accepted`` values and closed ``ranges``
    by column; as in SQL, NULL breaks only the first.  Missing columns and other
    types fail at once.  Each rule is part of its column's expression, so it is
    tested by whatever job writes the column, without a pass of its own.
    """
    wrong = schema_failures(df, schema)
    unknown = (set(accepted or ()) | set(ranges or ())) - {f.name for f in schema}
    if wrong or unknown:
        raise ValueError("; ".join(wrong + [f"rule for undeclared column {c}" for c in sorted(unknown)]))

    def checked(field: T.StructField) -> Column:
        value, broken = F.col(f"`{field.name}`"), []
        if not field.nullable:
            broken.append((value.isNull(), "is NULL"))
        if accepted and field.name in accepted:
            broken.append((~value.isin(list(accepted[field.name])), "is not among the accepted values"))
        if ranges and field.name in ranges:
            broken.append((~value.between(*ranges[field.name]), "is out of range"))
        out = value
        for rule, text in reversed(broken):
            shown = F.concat(F.lit(f"{field.name} {text}: "), F.coalesce(value.cast("string"), F.lit("NULL")))
            out = F.when(rule, F.raise_error(shown).cast(field.dataType)).otherwise(out)
        return out.alias(field.name)

    return df.select(*[checked(f) for f in schema])


def put_load(
    df: DataFrame,
    path: str,
    number: int,
    *,
    schema: T.StructType | None = None,
    accepted: Mapping[str, Sequence] | None = None,
    ranges: Mapping[str, tuple] | None = None,
    cluster_by: Sequence[str] = (),
    observe: tuple[Observation, Sequence[Column]] | None = None,
) -> DataFrame:
    """Put the rows as load ``number`` into the table at ``path``; gives the whole table with ``LOAD``.

    Only that load is replaced, by dynamic partition overwrite: the same load
    put twice leaves its rows once, and one that fails leaves what was there.
    ``df`` may read the table itself.  A load without rows empties its number.
    """
    if LOAD in df.columns:
        raise ValueError(f"{LOAD} is the number of the load; leave it out of the rows")
    spark = df.sparkSession
    rows = enforced(df, schema, accepted=accepted, ranges=ranges) if schema is not None else df
    bare = rows.schema
    rows = rows.withColumn(LOAD, F.lit(number))
    if cluster_by:
        rows = rows.repartitionByRange(*cluster_by).sortWithinPartitions(LOAD, *cluster_by)
    if observe:
        rows = rows.observe(observe[0], *observe[1])
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(LOAD).parquet(path)
    if not seen.get["rows"]:  # no partition was written, so none was replaced
        empty(spark, bare).write.mode("overwrite").parquet(f"{path}/{LOAD}={number}")
    return spark.read.parquet(path)


def publish_bucketed(
    df: DataFrame,
    name: str,
    *,
    by: str = "serie_id",
    order: Sequence[str] = ("fecha",),
    buckets: int = 200,
    path: str | None = None,
) -> DataFrame:
    """Create or replace the catalog table ``name``, its rows in ``buckets`` buckets of ``by``, each sorted.

    The rows meet by ``by`` once, here; windows, groups and joins by ``by`` of
    this table, and of tables with as many buckets, need no exchange.  Every
    bucket is one file.  A value with a large share of the rows fills its
    bucket: tables with such a series go by ``publish(cluster_by=...)`` and
    ``slices`` instead (see ``windows``).
    """
    writer = df.repartition(buckets, by).write.mode("overwrite").format("parquet")
    writer = writer.bucketBy(buckets, by).sortBy(by, *order)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


_IN_ORDER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)


def footer_profile(
    spark: SparkSession,
    path: str,
    *,
    by: Sequence[str] = (),
    counted: Sequence[str] = (),
    extremes: Sequence[str] = (),
) -> DataFrame:
    """Counts and extremes of the table at ``path`` from its files' footers; no column is read.

    Gives ``by`` (columns that the table is partitioned by), ``filas``, ``n_<c>``
    of each counted column (values that are not NULL), and ``min_<c>`` and
    ``max_<c>`` of each column of extremes, which are dates or whole numbers.
    Footers lack extremes where a column has no value in a block of rows; then
    the columns are scanned.  The report is written, a row per partition.
    """
    schema = spark.read.parquet(path).schema
    other = [c for c in extremes if not isinstance(schema[c].dataType, _IN_ORDER)]
    if other:
        raise ValueError(f"footers have exact extremes of dates and whole numbers only, not of {', '.join(other)}")
    folder = new_folder(spark)
    report = from_footers(spark, path, schema, by=by, counted=counted, extremes=extremes)
    try:
        report.write.parquet(folder)
    except Exception as failure:
        if "No min/max found" not in str(failure):
            raise
        folder = new_folder(spark)
        _profile(spark.read.parquet(path), by, counted, extremes).write.parquet(folder)
    # A pushed count is a sum over files; without files it is NULL.
    return spark.read.schema(report.schema).parquet(folder).na.fill(0, ["filas", *(f"n_{c}" for c in counted)])


def from_footers(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    *,
    by: Sequence[str] = (),
    counted: Sequence[str] = (),
    extremes: Sequence[str] = (),
) -> DataFrame:
    """The plan of ``footer_profile``, in a session of its own: the caller's settings stay as they are."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    # Only the reader that is not in this list takes aggregates.
    listed = own.conf.get("spark.sql.sources.useV1SourceList").split(",")
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(s for s in listed if s.strip().lower() != "parquet"))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return _profile(own.read.schema(schema).parquet(path), by, counted, extremes)


def _profile(df: DataFrame, by: Sequence[str], counted: Sequence[str], extremes: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("filas"),
        *[F.count(c).alias(f"n_{c}") for c in counted],
        *[f(c).alias(f"{name}_{c}") for c in extremes for name, f in (("min", F.min), ("max", F.max))],
    )


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """The typed relation without rows: a created or emptied table."""
    return spark.createDataFrame([], schema)


def drop_all(spark: SparkSession, names: Iterable[str]) -> None:
    """Drop views and catalog tables; no foreign keys, so any order will do."""
    for name in names:
        if not spark.catalog.dropTempView(name):
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
