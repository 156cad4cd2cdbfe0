"""Delimited-text output. Files are written in parallel; ``single_file`` asks for one part file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _laid_out(df: DataFrame, single_file: bool) -> DataFrame:
    return df.coalesce(1) if single_file else df


def write_tsv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Tab-separated values without a header; an existing path is an error."""
    _laid_out(df, single_file).write.mode("errorifexists").option("sep", "\t").csv(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Comma-separated values without a header; an existing path is replaced."""
    _laid_out(df, single_file).write.mode("overwrite").csv(path)


def csv_line(*columns: Column | str) -> Column:
    return F.concat_ws(",", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])


def tsv_line(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])
