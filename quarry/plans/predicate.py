"""Predicates as Spark columns, with literals typed by their columns; and what a segment's bounds say about them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import ParseError, UnknownColumn, Unsupported
from quarry.plans.dialect import And, Compare, Not, Or, Predicate, QueryPlan


def literal(text: str, kind: T.DataType):
    """The literal as a value of the column's kind. Numbers against whole columns keep their fraction, so that a bound
    such as 2.5 means what it says."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, (T.IntegralType, T.FractionalType)):
        try:
            return int(text)
        except ValueError:
            pass
        try:
            value = float(text)
        except ValueError:
            raise ParseError(f"not a number: {text}") from None
        if value != value:
            raise ParseError(f"not a number: {text}")
        return value
    raise Unsupported(f"columns of type {kind.simpleString()} cannot be compared")


def field(schema: T.StructType, name: str) -> T.StructField:
    if name not in schema.fieldNames():
        raise UnknownColumn(name)
    return schema[name]


def to_column(p: Predicate, schema: T.StructType) -> Column:
    """The predicate in SQL's three-valued logic: a comparison with null is neither true nor false."""
    match p:
        case And(a, b):
            return to_column(a, schema) & to_column(b, schema)
        case Or(a, b):
            return to_column(a, schema) | to_column(b, schema)
        case Not(inner):
            return ~to_column(inner, schema)
        case Compare(name, op, text):
            value, c = literal(text, field(schema, name).dataType), F.col(f"`{name}`")
            return {"=": c == value, ">": c > value, "<": c < value, ">=": c >= value, "<=": c <= value}[op]


def may_match(p: Predicate | None, bounds: dict, schema: T.StructType) -> bool:
    """Whether rows within the bounds (column: (least, greatest), None if it has no value) can satisfy the predicate."""
    match p:
        case None:
            return True
        case And(a, b):
            return may_match(a, bounds, schema) and may_match(b, bounds, schema)
        case Or(a, b):
            return may_match(a, bounds, schema) or may_match(b, bounds, schema)
        case Not():
            return True
        case Compare(name, op, text):
            if name not in bounds:
                return True
            if bounds[name] is None:
                return False
            low, high = (math.inf if x != x else x for x in bounds[name])  # NaN is above every number
            value = literal(text, field(schema, name).dataType)
            return {"=": low <= value <= high, ">": high > value, "<": low < value, ">=": high >= value, "<=": low <= value}[op]


def validate(plan: QueryPlan, schema: T.StructType) -> None:
    """Raises for unknown columns, literals that don't fit and aggregates of text."""
    for name in plan.columns():
        field(schema, name)
    if plan.where is not None:
        to_column(plan.where, schema)
    if plan.aggregate.column and not isinstance(schema[plan.aggregate.column].dataType, (T.IntegralType, T.FractionalType)):
        raise Unsupported(f"{plan.aggregate.kind} needs a numeric column, not {plan.aggregate.column}")
