"""Column functions over vectors.

A dense vector is ``ARRAY<DOUBLE>``. A sparse vector is
``STRUCT<size INT, indices ARRAY<INT>, values ARRAY<DOUBLE>>`` with strictly increasing indices.
A NULL vector or text gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPARSE = "struct<size:int,indices:array<int>,values:array<double>>"


def _checked(ok: Column, message: str, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _unless_null(given: Column, value: Column) -> Column:
    return F.when(given.isNotNull(), value)


def _same_size(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(
        _checked(F.size(a) == F.size(b), "vectors differ in size", value)
    )


# -- dense ---------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return _same_size(a, b, _total(F.zip_with(a, b, lambda x, y: x * y)))


def squared_distance(a: Column, b: Column) -> Column:
    return _same_size(a, b, _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def norm(v: Column, p: float) -> Column:
    """The p-norm; ``float('inf')`` gives the largest magnitude."""
    if p == float("inf"):
        return F.array_max(F.transform(v, F.abs))
    if p == 1:
        return _total(F.transform(v, F.abs))
    if p == 2:
        return F.sqrt(_total(F.transform(v, lambda x: x * x)))
    if p < 1:
        raise ValueError("p is at least 1")
    return F.pow(_total(F.transform(v, lambda x: F.pow(F.abs(x), F.lit(float(p))))), F.lit(1.0 / p))


def nonzeros(v: Column) -> Column:
    return _unless_null(v, F.size(F.filter(v, lambda x: x != 0)))


def elementwise(a: Column, b: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` on the elements of two vectors of equal size."""
    return _same_size(a, b, F.zip_with(a, b, op))


def scale_by(v: Column, op: Callable[[Column], Column]) -> Column:
    """``op`` on each element, e.g. ``lambda x: 2 - x``."""
    return F.transform(v, op)


def negate(v: Column) -> Column:
    return F.transform(v, lambda x: -x)


def remainder(x: Column, y: Column) -> Column:
    """Remainder with the sign of the divisor."""
    r = x % y
    return F.when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r)


def element(v: Column, index: int) -> Column:
    """The element at ``index``, from the end when negative; out of range is an error."""
    n = F.size(v)
    at = F.lit(index) if index >= 0 else n + F.lit(index)
    return _unless_null(v, _checked((at >= 0) & (at < n), "vector index out of range", F.get(v, at)))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


# -- sparse --------------------------------------------------------------------------------


def sparse(size: Column, indices: Column, values: Column) -> Column:
    """Build from parallel arrays; indices must increase strictly and lie in the vector."""
    before = F.slice(indices, 1, F.greatest(F.size(indices) - 1, F.lit(0)))
    after = F.slice(indices, 2, F.greatest(F.size(indices) - 1, F.lit(0)))
    rising = F.forall(F.zip_with(before, after, lambda p, q: p < q), lambda ok: ok)
    inside = F.forall(indices, lambda i: (i >= 0) & (i < size))
    built = F.struct(
        size.cast("int").alias("size"),
        indices.cast("array<int>").alias("indices"),
        values.cast("array<double>").alias("values"),
    )
    same = F.size(indices) == F.size(values)
    checked = _checked(
        same & rising & inside, "indices must match the values, rise strictly and lie in the vector", built
    )
    return F.when(size.isNotNull() & indices.isNotNull() & values.isNotNull(), checked)


def sparse_from_pairs(size: Column, pairs: Column) -> Column:
    """Build from an array of structs ``index, value`` in any order."""
    ordered = F.array_sort(pairs)
    return sparse(
        size,
        F.transform(ordered, lambda e: e["index"]),
        F.transform(ordered, lambda e: e["value"]),
    )


def sparse_from_map(size: Column, entries: Column) -> Column:
    """Build from a map of index to value."""
    pairs = F.transform(
        F.map_entries(entries), lambda e: F.struct(e["key"].alias("index"), e["value"].alias("value"))
    )
    return sparse_from_pairs(size, pairs)


def to_sparse(v: Column) -> Column:
    """Keep the non-zero elements of a dense vector."""
    indexed = F.filter(
        F.transform(v, lambda x, i: F.struct(i.alias("index"), x.alias("value"))), lambda e: e["value"] != 0
    )
    built = F.struct(
        F.size(v).alias("size"),
        F.transform(indexed, lambda e: e["index"]).cast("array<int>").alias("indices"),
        F.transform(indexed, lambda e: e["value"]).cast("array<double>").alias("values"),
    )
    return _unless_null(v, built)


def to_dense(s: Column) -> Column:
    """Zeros up to each stored element, then the element, then the trailing zeros."""
    indices = s["indices"]
    earlier = F.slice(F.concat(F.array(F.lit(-1)), indices), F.lit(1), F.size(indices))
    gaps = F.zip_with(indices, earlier, lambda i, before: i - before - 1)
    padded = F.zip_with(s["values"], gaps, lambda x, gap: F.concat(F.array_repeat(F.lit(0.0), gap), F.array(x)))
    tail = s["size"] - 1 - F.coalesce(F.array_max(indices), F.lit(-1))
    dense = F.concat(F.flatten(padded), F.array_repeat(F.lit(0.0), tail))
    return _unless_null(s, _checked(F.forall(gaps, lambda gap: gap >= 0), "indices must rise strictly", dense))


def _merged(a: Column, b: Column) -> Column:
    """The entries of two sparse vectors in one array ordered by index."""

    def tagged(s: Column) -> Column:
        return F.zip_with(s["indices"], s["values"], lambda i, x: F.struct(i.alias("i"), x.alias("x")))

    return F.array_sort(F.concat(tagged(a), tagged(b)))


def _fold_merged(a: Column, b: Column, paired: Callable, alone: Callable) -> Column:
    """Sum ``paired`` over indices that both vectors store and ``alone`` over the others."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("i"), F.lit(0.0).alias("x"))

    def step(acc: Column, e: Column) -> Column:
        met = acc["i"] == e["i"]
        return F.struct(
            F.when(met, acc["sum"] + paired(acc["x"], e["x"]))
            .otherwise(acc["sum"] + alone(acc["x"]))
            .alias("sum"),
            F.when(met, F.lit(-1)).otherwise(e["i"]).alias("i"),
            F.when(met, F.lit(0.0)).otherwise(e["x"]).alias("x"),
        )

    folded = F.aggregate(_merged(a, b), start, step, lambda acc: acc["sum"] + alone(acc["x"]))
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, _checked(a["size"] == b["size"], "vectors differ in size", folded))


def sparse_dot(a: Column, b: Column) -> Column:
    return _fold_merged(a, b, lambda x, y: x * y, lambda x: F.lit(0.0))


def sparse_squared_distance(a: Column, b: Column) -> Column:
    return _fold_merged(a, b, lambda x, y: (x - y) * (x - y), lambda x: x * x)


def mixed_dot(s: Column, v: Column) -> Column:
    """Dot product of a sparse and a dense vector."""
    met = _total(F.zip_with(s["indices"], s["values"], lambda i, x: x * F.get(v, i)))
    return F.when(s.isNotNull() & v.isNotNull(), _checked(s["size"] == F.size(v), "vectors differ in size", met))


def mixed_squared_distance(s: Column, v: Column) -> Column:
    return squared_distance(to_dense(s), v)


def same_vector(a: Column, b: Column) -> Column:
    """Equal size and equal non-zero elements of two sparse vectors, stored zeros or not."""

    def kept(s: Column) -> Column:
        entries = F.zip_with(s["indices"], s["values"], lambda i, x: F.struct(i.alias("i"), x.alias("x")))
        return F.filter(entries, lambda e: e["x"] != 0)

    return (a["size"] == b["size"]) & (kept(a) == kept(b))


# -- text ----------------------------------------------------------------------------------


def format_dense(v: Column) -> Column:
    return _unless_null(v, F.concat(F.lit("["), F.concat_ws(",", v.cast("array<string>")), F.lit("]")))


def format_sparse(s: Column) -> Column:
    return F.concat(
        F.lit("("),
        s["size"].cast("string"),
        F.lit(",["),
        F.concat_ws(",", s["indices"].cast("array<string>")),
        F.lit("],["),
        F.concat_ws(",", s["values"].cast("array<string>")),
        F.lit("])"),
    )


def _numbers(body: Column, kind: str) -> Column:
    parts = F.transform(F.split(body, ","), lambda t: F.trim(t))
    numbers = F.transform(parts, lambda t: t.cast(kind))
    return F.when(F.trim(body) == "", F.array().cast(f"array<{kind}>")).otherwise(numbers)


def parse_dense(text: Column) -> Column:
    """``[1.0, 2.0]`` to a dense vector; spaces around the parts are allowed."""
    pattern = r"^\s*\[([^\[\]]*)\]\s*$"
    found = _numbers(F.regexp_extract(text, pattern, 1), "double")
    return _unless_null(text, _checked(text.rlike(pattern), "not a dense vector", found))


def parse_sparse(text: Column) -> Column:
    """``(4, [0,1], [4.0,5.0])`` to a sparse vector; spaces around the parts are allowed."""
    pattern = r"^\s*\(\s*([0-9]+)\s*,\s*\[([^\[\]]*)\]\s*,\s*\[([^\[\]]*)\]\s*\)\s*$"
    built = sparse(
        F.regexp_extract(text, pattern, 1).cast("int"),
        _numbers(F.regexp_extract(text, pattern, 2), "int"),
        _numbers(F.regexp_extract(text, pattern, 3), "double"),
    )
    return _unless_null(text, _checked(text.rlike(pattern), "not a sparse vector", built))


# -- ML vector columns ---------------------------------------------------------------------


def ml_vectors(df: DataFrame, column: str) -> DataFrame:
    """Turn an array column into an ML vector column."""
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(column, array_to_vector(F.col(column).cast("array<double>")))


def arrays_from_ml(df: DataFrame, column: str) -> DataFrame:
    """Turn an ML or older MLlib vector column into an array column."""
    from pyspark.ml.functions import vector_to_array

    return df.withColumn(column, vector_to_array(column))


def older_vectors(df: DataFrame, column: str) -> DataFrame:
    """Turn an ML vector column into an MLlib one."""
    from pyspark.mllib.util import MLUtils

    return MLUtils.convertVectorColumnsFromML(df, column)


def newer_vectors(df: DataFrame, column: str) -> DataFrame:
    """Turn an MLlib vector column into an ML one."""
    from pyspark.mllib.util import MLUtils

    return MLUtils.convertVectorColumnsToML(df, column)
