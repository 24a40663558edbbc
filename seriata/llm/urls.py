"""URL rules by host and path, looked up by short hash prefixes."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 8  # hexadecimal digits of a digest that the join compares
ALLOW = "allow"


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """From behind the host to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages(url, ...)``.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains if
    the URL's path starts with the rule's.  The longest rule wins; of equal
    length ``block`` wins, then the rule that sorts last.  Without a rule that
    fits, ``rule`` is NULL and ``verdict`` is ``default``.  A NULL URL, or one
    without ``://``, has an empty host and path.  Repeated rows stay; rules
    with a NULL are left out; other columns pass through, but for columns that
    have one of the four names, which are replaced.

    Each different (host, path) is spelled out once, as the host's suffixes by
    label and the path's prefixes by slash, no deeper than any rule goes.  The
    first digits of the hashes are the join key, whole digests and the rule's
    own path confirm it.
    """
    rules = rules.dropna(subset=["host", "path", "verdict"])
    keyed = rules.select(
        F.col("path").alias("rule_path"),
        F.concat("host", "path").alias("rule"),
        "verdict",
        F.sha2(F.concat("host", _folder("path")), 256).alias("rule_digest"),
    ).withColumn("short", F.left("rule_digest", F.lit(PREFIX)))
    labels, slashes = rules.agg(F.max(_count("host", ".") + 1), F.max(_count("path", "/"))).first()

    split = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    split = split.drop("rule", "verdict")
    spelled = (
        split.select("host", "path")
        .distinct()
        .withColumn("suffix", F.explode(_suffixes("host", labels or 0)))
        .withColumn("prefix", F.explode(_prefixes("path", slashes or 0)))
        .withColumn("digest", F.sha2(F.concat("suffix", "prefix"), 256))
        .withColumn("short", F.left("digest", F.lit(PREFIX)))
    )
    rank = F.struct(F.length("rule"), F.col("verdict") == "block", "rule")
    best = (
        spelled.join(keyed, "short")
        .where((F.col("digest") == F.col("rule_digest")) & F.startswith("path", "rule_path"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"))
    )
    return split.join(best, ["host", "path"], "left").select(
        *[split[c] for c in split.columns],
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def _count(column: str, mark: str) -> Column:
    return F.length(column) - F.length(F.replace(F.col(column), F.lit(mark), F.lit("")))


def _folder(path: str) -> Column:
    """A path up to its last slash."""
    return F.regexp_extract(path, "(?s)^(.*/)?", 0)


def _suffixes(host: str, most: int) -> Column:
    """The last 1, 2, ... ``most`` labels of a host."""
    n = F.least(F.lit(most), _count(host, ".") + 1)
    return F.transform(F.filter(F.sequence(F.lit(0), n), lambda k: k > 0), lambda k: _last(host, k))


def _last(host: str, k: Column) -> Column:
    parts = F.split(F.col(host), r"\.", -1)
    return F.array_join(F.slice(parts, F.size(parts) - k + 1, k), ".")


def _prefixes(path: str, most: int) -> Column:
    """The empty path and the path up to its first, second, ... slash."""
    n = F.least(F.lit(most), _count(path, "/"))
    parts = F.split(F.col(path), "/", -1)
    return F.transform(
        F.sequence(F.lit(0), n),
        lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.when(k > 0, "/").otherwise("")),
    )
