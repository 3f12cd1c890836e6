"""Attribute and temporal predicates (PRD-1..19, TMP-1..9) as Column builders.

Each builder checks the property against the frame's columns (names are
lower-cased, unknown -> ``ValueError("Unknown property ...")``) and casts the
literal to the column's type, the way a bound parameter takes the column type
in the reference's database, so the column itself is never cast and Catalyst
can push the comparison into the Parquet scan.
"""

from __future__ import annotations

import datetime as _dt
import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CMP = {
    "=": operator.eq, "<>": operator.ne, "<": operator.lt,
    "<=": operator.le, ">": operator.gt, ">=": operator.ge,
}


# ---------------------------------------------------------------- helpers
def resolve(df: DataFrame, name: str, allowed=None) -> tuple[Column, T.DataType]:
    """Lower-case the property name and check it exists (and is allowed)."""
    key = name.lower()
    fields = {f.name.lower(): f for f in df.schema.fields}
    if key not in fields or (allowed is not None and key not in {a.lower() for a in allowed}):
        raise ValueError(f"Unknown property: {name}")
    f = fields[key]
    return F.col(f"`{f.name}`"), f.dataType


def typed_lit(value, dt: T.DataType) -> Column:
    """A literal cast to the column's type (the column is never cast)."""
    if isinstance(value, Column):
        return value.cast(dt)
    if isinstance(value, (_dt.datetime, _dt.date)):
        value = value.isoformat()
    return F.lit(value).cast(dt)


def all_of(*conds: Column) -> Column:
    """PRD-7 AND (n-ary); no condition -> TRUE (empty filter)."""
    conds = [c for c in conds if c is not None]
    return functools.reduce(operator.and_, conds) if conds else F.lit(True)


def any_of(*conds: Column) -> Column:
    """PRD-8 OR (n-ary)."""
    conds = [c for c in conds if c is not None]
    if not conds:
        raise ValueError("OR needs at least one operand")
    return functools.reduce(operator.or_, conds)


def negate(cond: Column) -> Column:
    """PRD-9 NOT (binds to one operand; group with Python parentheses)."""
    return ~cond


# ---------------------------------------------------------------- comparison (PRD-1..6)
def compare(df: DataFrame, name: str, op: str, value, allowed=None) -> Column:
    if op not in _CMP:
        raise ValueError(f"Unsupported comparison operator: {op}")
    col, dt = resolve(df, name, allowed)
    return _CMP[op](col, typed_lit(value, dt))


def eq(df, name, value, allowed=None):
    return compare(df, name, "=", value, allowed)


def ne(df, name, value, allowed=None):
    return compare(df, name, "<>", value, allowed)


def lt(df, name, value, allowed=None):
    return compare(df, name, "<", value, allowed)


def le(df, name, value, allowed=None):
    return compare(df, name, "<=", value, allowed)


def gt(df, name, value, allowed=None):
    return compare(df, name, ">", value, allowed)


def ge(df, name, value, allowed=None):
    return compare(df, name, ">=", value, allowed)


# ---------------------------------------------------------------- text (PRD-10..13)
def normalize_like(pattern: str) -> str:
    """Backslash escapes as in the reference's database: ``\\%``, ``\\_`` and
    ``\\\\`` stay escapes, a backslash before any other character just means
    that character (Spark would reject it)."""
    out = []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            out.append("\\" + nxt if nxt in "%_\\" else nxt)
            i += 2
            continue
        out.append(ch)
        i += 1
    return "".join(out)


def like(df, name, pattern: str, case_insensitive: bool = False, allowed=None) -> Column:
    col, dt = resolve(df, name, allowed)
    target = col if isinstance(dt, T.StringType) else col.cast("string")
    pat = normalize_like(pattern)
    return target.ilike(pat) if case_insensitive else target.like(pat)


def ilike(df, name, pattern, allowed=None):
    return like(df, name, pattern, True, allowed)


def not_like(df, name, pattern, allowed=None):
    return ~like(df, name, pattern, False, allowed)


def not_ilike(df, name, pattern, allowed=None):
    return ~like(df, name, pattern, True, allowed)


# ---------------------------------------------------------------- null, IN, BETWEEN (PRD-14..19)
def is_null(df, name, allowed=None):
    return resolve(df, name, allowed)[0].isNull()


def is_not_null(df, name, allowed=None):
    return resolve(df, name, allowed)[0].isNotNull()


def in_list(df, name, values, allowed=None) -> Column:
    """PRD-16.  Short lists become an ``In`` expression (``InSet`` above the
    optimizer threshold) that Parquet can push down; for a list held in a
    DataFrame use :func:`in_frame` (a broadcast semi-join)."""
    values = list(values)
    if not values:
        raise ValueError("IN needs at least one value")
    col, dt = resolve(df, name, allowed)
    return col.isin(*[typed_lit(v, dt) for v in values])


def not_in_list(df, name, values, allowed=None):
    return ~in_list(df, name, values, allowed)


def in_frame(df: DataFrame, name: str, values: DataFrame, value_col: str = "value") -> DataFrame:
    """IN against a list too long for a literal: left-semi join on the value."""
    col, dt = resolve(df, name)
    return df.join(values.select(F.col(value_col).cast(dt).alias("__in_v")).distinct(),
                   col == F.col("__in_v"), "left_semi")


def between(df, name, lo, hi, allowed=None) -> Column:
    col, dt = resolve(df, name, allowed)
    return col.between(typed_lit(lo, dt), typed_lit(hi, dt))


def not_between(df, name, lo, hi, allowed=None):
    return ~between(df, name, lo, hi, allowed)


# ---------------------------------------------------------------- temporal (TMP-1..7)
OPEN = ".."


def _instant(value, dt):
    return typed_lit(value, dt)


def t_before(df, name, instant, allowed=None):
    col, dt = resolve(df, name, allowed)
    return col < _instant(instant, dt)


def t_after(df, name, instant, allowed=None):
    col, dt = resolve(df, name, allowed)
    return col > _instant(instant, dt)


def t_equals(df, name, instant, allowed=None):
    col, dt = resolve(df, name, allowed)
    return col == _instant(instant, dt)


def t_during(df, name, start, end, allowed=None) -> Column:
    """TMP-4 / TMP-5: inclusive interval; ``..`` (or None) opens one end.

    An instant instead of an interval (``end`` omitted) means equality (TMP-7).
    """
    col, dt = resolve(df, name, allowed)
    open_s = start in (None, OPEN)
    open_e = end in (None, OPEN)
    if open_s and open_e:
        return F.lit(True)
    if open_s:
        return col <= _instant(end, dt)
    if open_e:
        return col >= _instant(start, dt)
    return col.between(_instant(start, dt), _instant(end, dt))


t_intersects = t_during


def t_disjoint(df, name, start, end, allowed=None) -> Column:
    """TMP-6: before the start or after the end; one open end drops that side."""
    col, dt = resolve(df, name, allowed)
    open_s = start in (None, OPEN)
    open_e = end in (None, OPEN)
    if open_s and open_e:
        return F.lit(False)
    if open_s:
        return col > _instant(end, dt)
    if open_e:
        return col < _instant(start, dt)
    return (col < _instant(start, dt)) | (col > _instant(end, dt))


def t_with_instant(df, name, op: str, instant, allowed=None) -> Column:
    """TMP-7: an interval operator applied to an instant: during/intersects -> =, disjoint -> <>."""
    op = op.lower()
    if op in ("t_during", "t_intersects"):
        return t_equals(df, name, instant, allowed)
    if op == "t_disjoint":
        col, dt = resolve(df, name, allowed)
        return col != _instant(instant, dt)
    raise ValueError(f"{op} does not take an instant")


# ---------------------------------------------------------------- datetime parameter (TMP-8, TMP-9)
def datetime_param(df, name: str | None, spec: str) -> Column:
    """The items ``datetime`` parameter.

    * ``2024-01-15`` (instant) -> same calendar day (UTC).  Written as a
      half-open range ``[day, day+1)`` instead of ``to_date(col) = day`` so the
      bounds reach the Parquet scan.
    * ``start/end`` -> inclusive bounds; empty or ``..`` is open.  A bare date
      as end means its midnight, as a date-to-timestamp cast does.
    """
    if name is None:
        raise ValueError("Collection has no datetime column")
    col, dt = resolve(df, name)
    spec = spec.strip()
    if "/" in spec:
        start, end = (s.strip() for s in spec.split("/", 1))
        conds = []
        if start not in ("", OPEN):
            conds.append(col >= _instant(start, dt))
        if end not in ("", OPEN):
            conds.append(col <= _instant(end, dt))
        return all_of(*conds)
    day = F.to_date(F.lit(spec))
    if isinstance(dt, T.DateType):
        return col == day
    lo = day.cast(dt)
    hi = F.date_add(day, 1).cast(dt)
    return (col >= lo) & (col < hi)
