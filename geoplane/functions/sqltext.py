"""Spark SQL expressions written with Python operators and kept as text.

The relations of two geometries are one expression with thousands of terms.  As
``Column`` objects each term costs several calls into the JVM; as text the whole
is parsed in one.  The functions carry the names of ``pyspark.sql.functions``;
``column()`` hands the finished text to ``expr``.
"""

from __future__ import annotations

import inspect
import itertools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as _F

_NAMES = itertools.count()


class Sql:
    """One expression: its text, and the name it has as a struct field."""

    __slots__ = ("text", "name")

    def __init__(self, text: str, name: str | None = None):
        self.text, self.name = text, name

    def column(self) -> Column:
        return _F.expr(self.text)

    def alias(self, name: str) -> Sql:
        return Sql(self.text, name)

    def cast(self, kind: str) -> Sql:
        return Sql(f"cast({self.text} AS {kind})")

    def __getitem__(self, key: str | int) -> Sql:
        return Sql(f"{self.text}.{key}", key) if isinstance(key, str) else Sql(f"get({self.text}, {key})")

    def isNull(self) -> Sql:  # noqa: N802 - as in pyspark
        return Sql(f"({self.text} IS NULL)")

    def isNotNull(self) -> Sql:  # noqa: N802
        return Sql(f"({self.text} IS NOT NULL)")

    def __invert__(self) -> Sql:
        return Sql(f"(NOT {self.text})")

    def __neg__(self) -> Sql:
        return Sql(f"(- {self.text})")


def _infix(op: str) -> Callable[[Sql, object], Sql]:
    return lambda self, other: Sql(f"({self.text} {op} {lit(other).text})")


for _name, _op in {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "mod": "%", "and": "AND", "or": "OR", "eq": "=",
                   "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    setattr(Sql, f"__{_name}__", _infix(_op))
for _name, _op in {"add": "+", "sub": "-", "mul": "*"}.items():
    setattr(Sql, f"__r{_name}__", lambda self, other, op=_op: Sql(f"({lit(other).text} {op} {self.text})"))


def col(name: str) -> Sql:
    return Sql(f"`{name}`", name)


def lit(value: object) -> Sql:
    if isinstance(value, Sql):
        return value
    if value is None:
        return Sql("null")
    if isinstance(value, bool):
        return Sql(str(value).lower())
    if isinstance(value, float):
        # an exponent keeps every double a double literal; nan and infinities have no literal
        return Sql(f"{value!r}D" if value - value == 0 else f"double('{value!r}')")
    return Sql(f"'{value}'" if isinstance(value, str) else str(value))


def call(name: str, *args: object) -> Sql:
    return Sql(f"{name}({', '.join(lit(a).text for a in args)})")


def _function(body: Callable[..., Sql]) -> str:
    names = [f"v{next(_NAMES)}" for _ in inspect.signature(body).parameters]
    head = names[0] if len(names) == 1 else f"({', '.join(names)})"
    return f"{head} -> {lit(body(*map(Sql, names))).text}"


def transform(array: Sql, body: Callable[..., Sql]) -> Sql:
    return Sql(f"transform({array.text}, {_function(body)})")


def filter(array: Sql, test: Callable[..., Sql]) -> Sql:  # noqa: A001 - as in pyspark
    return Sql(f"filter({array.text}, {_function(test)})")


def exists(array: Sql, test: Callable[[Sql], Sql]) -> Sql:
    return Sql(f"exists({array.text}, {_function(test)})")


def aggregate(array: Sql, start: Sql, merge: Callable[[Sql, Sql], Sql], finish: Callable[[Sql], Sql] | None = None) -> Sql:
    last = "" if finish is None else f", {_function(finish)}"
    return Sql(f"aggregate({array.text}, {lit(start).text}, {_function(merge)}{last})")


def struct(*fields: Sql) -> Sql:
    return call("named_struct", *[x for f in fields for x in (f.name, f)])


class _Case(Sql):
    __slots__ = ("arms",)

    def __init__(self, arms: list[tuple[Sql, object]]):
        self.arms = arms
        super().__init__(self._text(""))

    def _text(self, last: str) -> str:
        return f"(CASE {' '.join(f'WHEN {c.text} THEN {lit(v).text}' for c, v in self.arms)}{last} END)"

    def when(self, test: Sql, value: object) -> _Case:
        return _Case([*self.arms, (test, value)])

    def otherwise(self, value: object) -> Sql:
        return Sql(self._text(f" ELSE {lit(value).text}"))


def when(test: Sql, value: object) -> _Case:
    return _Case([(test, value)])


def let(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return get(transform(array(value), body), 0)


def _named(name: str) -> Callable[..., Sql]:
    return lambda *args: call(name, *args)


array, coalesce, concat, flatten, size, get, slice = map(  # noqa: A001
    _named, ("array", "coalesce", "concat", "flatten", "size", "get", "slice"))
abs, signum, least, greatest, sequence = map(_named, ("abs", "signum", "least", "greatest", "sequence"))  # noqa: A001
array_min, array_max, array_contains, array_distinct, endswith, contains = map(
    _named, ("array_min", "array_max", "array_contains", "array_distinct", "endswith", "contains"))
