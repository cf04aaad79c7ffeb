"""Metadata filters: a small syntax tree that compiles to one Column, so that filters take part in pruning and pushdown.

Truth is two-valued: a comparison with a missing key is false (also `ne`), `not_in` of a missing key is true, and `not` is
the complement. A key that is present with a null value exists; `eq` null is true of it. A field is either a plain column or
a key of a map<string,string> column, whose values are compared as numbers if the constant is a number; a value that isn't
one then compares false in the order relations and unequal otherwise. With strict=True, order relations coerce like a dynamic
store: what isn't a number counts as 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from vectrail.functions.vectors import haversine_m


@dataclass(frozen=True)
class Fields:
    """Where fields live: keys of a map column, or plain columns if there is none."""

    map_column: str | None = "metadata"
    strict: bool = False

    def value(self, name: str) -> Column:
        return F.col(self.map_column)[name] if self.map_column else F.col(name)

    def present(self, name: str) -> Column:
        if not self.map_column:
            return F.col(name).isNotNull()
        return F.coalesce(F.map_contains_key(F.col(self.map_column), name), F.lit(False))

    def typed(self, name: str, like: Any) -> Column:
        """The value in the type of the constant."""
        v = self.value(name)
        if isinstance(like, bool):
            return v.try_cast("boolean")
        return v.try_cast("double") if isinstance(like, (int, float)) else v


class Filter:
    def column(self, fields: Fields = Fields()) -> Column:  # noqa: B008
        """The filter as a Column that is never null."""
        raise NotImplementedError

    def __and__(self, other: Filter) -> Filter:
        return And((self, other))

    def __or__(self, other: Filter) -> Filter:
        return Or((self, other))

    def __invert__(self) -> Filter:
        return Not(self)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class Compare(Filter):
    name: str
    op: str
    const: Any

    def column(self, fields: Fields = Fields()) -> Column:  # noqa: B008
        here, v = fields.present(self.name), fields.typed(self.name, self.const)
        if self.op == "exists":
            return here
        if self.op == "eq":
            return here & (fields.value(self.name).isNull() if self.const is None else _sure(v == F.lit(self.const)))
        if self.op == "ne":
            return here & ~(fields.value(self.name).isNull() if self.const is None else _sure(v == F.lit(self.const)))
        const = F.lit(self.const)
        if fields.strict:
            v = F.coalesce(fields.value(self.name).try_cast("double"), F.lit(0.0))
            const = F.coalesce(F.lit(self.const).try_cast("double"), F.lit(0.0))
        tests = {"gt": lambda: v > const, "gte": lambda: v >= const, "lt": lambda: v < const, "lte": lambda: v <= const}
        if self.op not in tests:
            raise ValueError(f"unknown operator {self.op!r}")
        return here & _sure(tests[self.op]())


@dataclass(frozen=True)
class Range(Filter):
    """Inclusive; a bound of None is open."""

    name: str
    low: Any = None
    high: Any = None

    def column(self, fields: Fields = Fields()) -> Column:  # noqa: B008
        parts: list[Filter] = [Compare(self.name, op, b) for op, b in (("gte", self.low), ("lte", self.high)) if b is not None]
        return And(tuple(parts)).column(fields) & fields.present(self.name)


@dataclass(frozen=True)
class In(Filter):
    name: str
    values: tuple
    negate: bool = False

    def column(self, fields: Fields = Fields()) -> Column:  # noqa: B008
        hits = [Compare(self.name, "eq", v).column(fields) for v in self.values]
        hit = reduce(Column.__or__, hits) if hits else F.lit(False)
        return ~hit if self.negate else hit


@dataclass(frozen=True)
class Exists(Filter):
    name: str
    exists: bool = True

    def column(self, fields: Fields = Fields()) -> Column:  # noqa: B008
        return fields.present(self.name) if self.exists else ~fields.present(self.name)


@dataclass(frozen=True)
class GeoRadius(Filter):
    """Within a distance of a point, inclusive; metres win over kilometres if they aren't 0. lat and lon are columns, or
    fields of a struct column `name`; missing ones count as 0, a missing struct is no match."""

    name: str | None
    lat: float
    lon: float
    km: float = 0.0
    metres: float = 0.0

    def column(self, fields: Fields = Fields()) -> Column:  # noqa: B008
        part = lambda p: F.coalesce(F.col(f"{self.name}.{p}" if self.name else p).cast("double"), F.lit(0.0))
        most = self.metres if self.metres else self.km * 1000
        near = haversine_m(part("lat"), part("lon"), F.lit(float(self.lat)), F.lit(float(self.lon))) <= F.lit(float(most))
        return _sure(F.col(self.name).isNotNull() & near) if self.name else _sure(near)


@dataclass(frozen=True)
class And(Filter):
    parts: tuple[Filter, ...] = ()

    def column(self, fields: Fields = Fields()) -> Column:  # noqa: B008
        return reduce(Column.__and__, [p.column(fields) for p in self.parts], F.lit(True))


@dataclass(frozen=True)
class Or(Filter):
    parts: tuple[Filter, ...] = ()

    def column(self, fields: Fields = Fields()) -> Column:  # noqa: B008
        return reduce(Column.__or__, [p.column(fields) for p in self.parts], F.lit(False))


@dataclass(frozen=True)
class Not(Filter):
    part: Filter | None = None

    def column(self, fields: Fields = Fields()) -> Column:  # noqa: B008
        return F.lit(True) if self.part is None else ~self.part.column(fields)


@dataclass(frozen=True)
class Where(Filter):
    """A filter of the caller's own, from the fields to a Column."""

    make: Callable[[Fields], Column]

    def column(self, fields: Fields = Fields()) -> Column:  # noqa: B008
        return _sure(self.make(fields))


@dataclass
class FilterBuilder:
    """Collects conditions that must all hold."""

    parts: list[Filter] = field(default_factory=list)

    def equals(self, name: str, value: Any) -> FilterBuilder:
        self.parts.append(Compare(name, "eq", value))
        return self

    def greater_than(self, name: str, value: Any) -> FilterBuilder:
        self.parts.append(Compare(name, "gt", value))
        return self

    def less_than(self, name: str, value: Any) -> FilterBuilder:
        self.parts.append(Compare(name, "lt", value))
        return self

    def add(self, part: Filter) -> FilterBuilder:
        self.parts.append(part)
        return self

    def build(self) -> Filter:
        if not self.parts:
            raise ValueError("a filter needs a condition")
        return self.parts[0] if len(self.parts) == 1 else And(tuple(self.parts))


def from_dict(spec: dict) -> Filter:
    """A filter from its JSON form: one of comparison, range, list, geo_radius, exists and composite."""
    if len(spec) != 1:
        raise ValueError("a filter has exactly one kind")
    ((kind, body),) = spec.items()
    if kind == "comparison":
        if body["operator"] not in ("eq", "ne", "gt", "gte", "lt", "lte", "exists"):
            raise ValueError(f"unknown operator {body['operator']!r}")
        return Compare(body["field"], body["operator"], body.get("value"))
    if kind == "range":
        bounds = {k: body[k] for k in ("gte", "lte", "gt", "lt") if body.get(k) is not None}
        if not bounds:
            raise ValueError("a range needs a bound")
        return And(tuple(Compare(body["field"], op, b) for op, b in bounds.items()))
    if kind == "list":
        if body["operator"] not in ("in", "not_in"):
            raise ValueError(f"unknown operator {body['operator']!r}")
        return In(body["field"], tuple(body["values"]), body["operator"] == "not_in")
    if kind == "geo_radius":
        return GeoRadius(body.get("field"), body["latitude"], body["longitude"], body.get("radius_km", 0.0), body.get("radius_meters", 0.0))
    if kind == "exists":
        return Exists(body["field"], body.get("exists", True))
    if kind == "composite":
        parts = tuple(map(from_dict, body.get("filters", ())))
        op = body["operator"]
        if op == "not":
            if len(parts) != 1:
                raise ValueError("not takes exactly one filter")
            return Not(parts[0])
        if op not in ("and", "or"):
            raise ValueError(f"unknown operator {op!r}")
        return And(parts) if op == "and" else Or(parts)
    raise ValueError(f"unknown filter kind {kind!r}")
