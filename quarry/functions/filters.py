"""Metadata filters in the style of document stores, compiled to column predicates.

{field: value} is equality, {field: {"$gt" | "$gte" | "$lt" | "$lte" | "$in": operand, ...}} a conjunction. A missing
field equals None only; comparisons with a missing field or across types are false; an unknown operator is false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = {"$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v}
SIGNS = {"$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}


def _field(df: DataFrame, name: str) -> tuple[Column | None, T.DataType | None]:
    kind: T.DataType = df.schema
    for part in name.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            break
        kind = kind[part].dataType
    else:
        return F.col(".".join(f"`{p}`" for p in name.split("."))), kind
    if "metadata" in df.columns and not name.startswith("metadata."):
        return _field(df, f"metadata.{name}")
    return None, None


def _comparable(kind: T.DataType, value) -> bool:
    number = isinstance(value, (int, float))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return number
    return isinstance(kind, T.StringType) and isinstance(value, str)


def _equal(column: Column | None, kind, value) -> Column:
    if value is None:
        return F.lit(True) if column is None else column.isNull()
    if column is None or not _comparable(kind, value):
        return F.lit(False)
    if isinstance(kind, T.BooleanType):
        return column.cast("int").eqNullSafe(F.lit(value).cast("double"))
    return column.eqNullSafe(F.lit(value))


def predicate(df: DataFrame, where: dict | None) -> Column:
    """Never null, so it may be negated; typed columns let it reach the scan."""
    clauses = []
    for name, clause in (where or {}).items():
        column, kind = _field(df, name)
        if not isinstance(clause, dict):
            clauses.append(_equal(column, kind, clause))
            continue
        for op, operand in clause.items():
            if op == "$in":
                clauses.append(reduce(lambda a, b: a | b, [_equal(column, kind, v) for v in operand], F.lit(False)))
            elif op in ORDER and column is not None and operand is not None and _comparable(kind, operand):
                left = column.cast("int") if isinstance(kind, T.BooleanType) else column
                clauses.append(F.coalesce(ORDER[op](left, F.lit(operand)), F.lit(False)))
            else:
                clauses.append(F.lit(False))
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def _literal(value) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else repr(float(value)) + "D" if isinstance(value, float) else str(value).lower()


def as_sql(df: DataFrame, where: dict | None) -> str:
    """The predicate as SQL text, for sources that take their filters so; with the same meaning, never null."""

    def named(name: str) -> tuple[str | None, T.DataType | None]:
        column, kind = _field(df, name)
        inside = column is not None and name.split(".")[0] not in df.columns
        return None if column is None else ".".join(f"`{p}`" for p in (["metadata"] if inside else []) + name.split(".")), kind

    def equal(column, kind, value) -> str:
        if value is None:
            return "true" if column is None else f"{column} IS NULL"
        if column is None or not _comparable(kind, value):
            return "false"
        left = f"CAST({column} AS INT)" if isinstance(kind, T.BooleanType) else column
        return f"{left} <=> {_literal(float(value) if isinstance(value, bool) else value)}"

    clauses = []
    for name, clause in (where or {}).items():
        column, kind = named(name)
        if not isinstance(clause, dict):
            clauses.append(equal(column, kind, clause))
            continue
        for op, operand in clause.items():
            if op == "$in":
                clauses.append(" OR ".join(f"({equal(column, kind, v)})" for v in operand) or "false")
            elif op in SIGNS and column is not None and operand is not None and _comparable(kind, operand):
                left = f"CAST({column} AS INT)" if isinstance(kind, T.BooleanType) else column
                clauses.append(f"coalesce({left} {SIGNS[op]} {_literal(float(operand) if isinstance(operand, bool) else operand)}, false)")
            else:
                clauses.append("false")
    return " AND ".join(f"({c})" for c in clauses) or "true"
