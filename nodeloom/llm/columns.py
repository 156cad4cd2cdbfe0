"""Column expressions that several operators share: words, ASCII lower case, fold numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space of the query contracts, as a regular expression and as characters.
BREAKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; NULL gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS), lambda w: w != "")


def fold_number(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``, so that further columns of any name do no harm."""
    return docs.select("doc_id", "text")


def id_as_text(docs: DataFrame, name: str = "doc_id") -> DataFrame:
    """The id as a string, for steps in Python: pandas gets a bigint column with a NULL as float64, which rounds ids above 2^53."""
    return docs.withColumn(name, F.col(name).cast("string"))


def id_as_number(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """The id that :func:`id_as_text` wrote, as bigint again."""
    return df.withColumn(name, F.col(name).cast("bigint"))


def row_key(df_id: str = "doc_id", text: str = "text") -> Column:
    """A 128-bit key of id and text as a string; NULL and empty differ."""
    held = lambda name: F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("-"))
    return F.md5(F.concat(held(df_id), F.lit(" "), held(text)).cast("binary"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
