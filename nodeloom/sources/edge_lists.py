"""Edge lists as text: ``src<TAB or space>dst[<TAB or space>weight]``, ``#`` starts a comment line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The field separator and the number formats that are accepted.
SEPARATOR = "[\t ]"
INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|inf|infinity|nan)$"


def _fields(lines: DataFrame, weighted: bool) -> DataFrame:
    text = F.btrim(F.col("value"), F.lit("\r\n"))
    parts = F.split(text, SEPARATOR)

    def field(n: int, pattern: str, kind: str) -> Column:
        raw = F.get(parts, F.lit(n))
        return F.when(F.lower(raw).rlike(pattern), raw.try_cast(kind))

    fields = [field(0, INTEGER, "bigint").alias("src"), field(1, INTEGER, "bigint").alias("dst")]
    if weighted:
        fields.append(field(2, DECIMAL, "double").alias("weight"))
    return lines.where(~F.col("value").startswith("#")).select("value", *fields)


def _bad(weighted: bool) -> Column:
    bad = F.col("src").isNull() | F.col("dst").isNull()
    return bad | F.col("weight").isNull() if weighted else bad


def parse_edges(lines: DataFrame, weighted: bool = False, mode: str = "drop") -> DataFrame:
    """Edges from a table of lines (``value STRING``).

    Comment lines are skipped and fields past the needed ones ignored. A blank or malformed
    line is left out (see :func:`rejected_lines`), or with ``mode="fail"`` stops the query.
    """
    if mode not in ("drop", "fail"):
        raise ValueError("mode is 'drop' or 'fail'")
    names = ["src", "dst", "weight"] if weighted else ["src", "dst"]
    fields = _fields(lines, weighted)
    if mode == "drop":
        return fields.where(~_bad(weighted)).select(*names)
    stop = F.raise_error(F.concat(F.lit("not an edge line: "), F.col("value")))
    return fields.select(*[F.when(_bad(weighted), stop).otherwise(F.col(c)).alias(c) for c in names])


def rejected_lines(lines: DataFrame, weighted: bool = False) -> DataFrame:
    """The lines (``value``) that :func:`parse_edges` leaves out, comments not included."""
    return _fields(lines, weighted).where(_bad(weighted)).select("value")


def read_edges(spark: SparkSession, path: str, weighted: bool = False, mode: str = "drop") -> DataFrame:
    return parse_edges(spark.read.text(path), weighted, mode)


def read_rejected_lines(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    return rejected_lines(spark.read.text(path), weighted)
