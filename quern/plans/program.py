"""Relational-algebra programs: statements over relations, with lexical scopes, functions and fixpoint iteration."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.functions import scalar as S
from quern.operators.zset import W, ZSet
from quern.sources.scratch import written


class PlanError(ValueError):
    """A program that cannot be planned."""


@dataclass(frozen=True)
class Source:
    name: str


@dataclass(frozen=True)
class Alias:
    relation: object
    alias: str


@dataclass(frozen=True)
class Project:
    relation: object
    attributes: tuple[tuple[str, object], ...]


@dataclass(frozen=True)
class Pick:
    """Columns (new name, name) in a new order and under new names: only the schema changes."""

    relation: object
    columns: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Select:
    relation: object
    condition: object


@dataclass(frozen=True)
class EquiJoin:
    left: object
    right: object
    on: tuple[tuple[object, object], ...]
    attributes: tuple[tuple[str, object], ...] | None = None


@dataclass(frozen=True)
class Product:
    left: object
    right: object
    attributes: tuple[tuple[str, object], ...] | None = None


@dataclass(frozen=True)
class ThetaJoin:
    left: object
    right: object
    condition: object
    attributes: tuple[tuple[str, object], ...] | None = None
    on: tuple[tuple[object, object], ...] = ()


@dataclass(frozen=True)
class AntiJoin:
    left: object
    right: object
    on: tuple[tuple[object, object], ...]


@dataclass(frozen=True)
class Union:
    relations: tuple


@dataclass(frozen=True)
class Difference:
    left: object
    right: object


@dataclass(frozen=True)
class Distinct:
    relation: object


@dataclass(frozen=True)
class Iterate:
    """The least relation that holds `start` and what `step` makes of it under the name `name`; weights are 1.

    `bag_start` gives rows that both the start and the steps hold weight 2, as a sum of both would."""

    name: str
    start: object
    step: object
    bag_start: bool = False
    max_rounds: int = 1000


RELATIONAL = (Source, Alias, Project, Pick, Select, EquiJoin, Product, ThetaJoin, AntiJoin, Union, Difference, Distinct, Iterate)


def _mapping(pairs: tuple[tuple[str, object], ...] | None) -> Mapping[str, object] | None:
    return None if pairs is None else dict(pairs)


@dataclass
class Planner:
    """Turns a program into lazy plans; only Iterate runs jobs, one per round."""

    spark: SparkSession
    relations: dict[str, ZSet]
    scope: S.Scope = field(default_factory=S.Scope)

    def relation(self, e: object, scope: S.Scope | None = None) -> ZSet:
        got = self.value(e, scope or self.scope)
        if not isinstance(got, ZSet):
            raise PlanError("a relation is needed here")
        return got

    def value(self, e: object, scope: S.Scope):
        """A ZSet, a scalar's Typed column, a closure, or a tuple of these."""
        go = lambda x: self.relation(x, scope)
        match e:
            case ZSet():
                return e
            case S.Ref(name) if (at := scope.find(name)) is not None:
                return at.names[name]
            case S.Ref(name) | Source(name):
                if name not in self.relations:
                    raise PlanError(f"unknown relation {name}")
                return self.relations[name]
            case S.Let(name, v):
                scope.names[name] = self.value(v, scope)
                return scope.names[name]
            case S.Assign(name, v):
                if (at := scope.find(name)) is None:
                    raise PlanError(f"unknown name {name}")
                at.names[name] = self.value(v, scope)
                return at.names[name]
            case S.Block(statements):
                inner, last = S.Scope({}, scope), S.constant(None)
                for s in statements:
                    last = self.value(s, inner)
                return last
            case S.Tup(items):
                return tuple(self.value(x, scope) for x in items)
            case S.Call(function, arguments) if isinstance(f := self.value(function, scope), S.Closure):
                if len(f.params) != len(arguments):
                    raise PlanError(f"{len(f.params)} arguments expected, {len(arguments)} given")
                return self.value(f.body, S.Scope(dict(zip(f.params, (self.value(a, scope) for a in arguments), strict=True)), f.scope))
            case Alias(r, alias):
                return go(r).aliased(alias)
            case Project(r, attributes):
                return go(r).project(dict(attributes), scope)
            case Pick(r, columns):
                return go(r).pick(dict(columns))
            case Select(r, condition):
                return go(r).select(condition, scope)
            case EquiJoin(a, b, on, attributes):
                return go(a).join(go(b), on, _mapping(attributes), scope)
            case Product(a, b, attributes):
                return go(a).product(go(b), _mapping(attributes), scope)
            case ThetaJoin(a, b, condition, attributes, on):
                return go(a).theta_join(go(b), condition, _mapping(attributes), on, scope)
            case AntiJoin(a, b, on):
                return go(a).anti_join(go(b), on, scope)
            case Union(relations):
                if len(relations) < 2:
                    raise PlanError("a union needs two relations")
                first, *rest = map(go, relations)
                return first.union(*rest)
            case Difference(a, b):
                return go(a).difference(go(b))
            case Distinct(r):
                return go(r).distinct()
            case Iterate():
                return self._iterate(e, scope)
        return S.compile_expression(e, {}, scope)

    def _iterate(self, e: Iterate, scope: S.Scope) -> ZSet:
        """Steps from the rows found last until a step finds none that is new. A step must be linear in `name` for
        this to be the whole answer; one that uses it twice, negated or in a difference is run over all rows found."""
        start = self.relation(e.start, scope).distinct()
        linear = _linear(e.step, e.name)
        names = start.columns
        path, rows = written(start.df.select(*names), "start")
        files, new = [path], rows
        stepped: list[str] = []
        for _ in range(e.max_rounds):
            known = self.spark.read.schema(rows.schema).parquet(*files)
            inner = S.Scope({e.name: ZSet.of(new if linear else known, start.unsigned)}, scope)
            made = self.relation(e.step, inner)
            if len(made.columns) != len(names):
                raise PlanError(f"{e.name} has {len(names)} columns, its step {len(made.columns)}")
            found = made.distinct().df.select(*(F.col(f"`{c}`").cast(f.dataType).alias(n) for c, n, f in zip(made.columns, names, rows.schema, strict=True)))
            if e.bag_start:
                stepped.append(written(found, "step")[0])
            old = known.select(*(F.col(f"`{c}`").alias(f"old_{k}") for k, c in enumerate(names)))
            fresh = found.join(old, [F.col(f"`{c}`").eqNullSafe(F.col(f"old_{k}")) for k, c in enumerate(names)], "left_anti")
            path, new = written(fresh, "round")
            if new.isEmpty():
                break
            files.append(path)
        else:
            raise PlanError(f"{e.name} reached no fixpoint within {e.max_rounds} rounds")
        if not e.bag_start:
            return ZSet.of(self.spark.read.schema(rows.schema).parquet(*files), start.unsigned)
        steps = ZSet.of(self.spark.read.schema(rows.schema).parquet(*stepped), start.unsigned).distinct()
        return start.union(steps)


def _uses(e: object, name: str) -> int:
    """How often an expression reads a name."""
    if isinstance(e, S.Ref | Source):
        return int(e.name == name)
    if isinstance(e, tuple):
        return sum(_uses(x, name) for x in e)
    return sum(_uses(x, name) for x in vars(e).values()) if hasattr(e, "__dataclass_fields__") and not isinstance(e, ZSet | S.Typed | S.Closure) else 0


def _linear(e: object, name: str) -> bool:
    if isinstance(e, S.Block | S.Call | Iterate):
        return False if _uses(e, name) != 1 or not isinstance(e, S.Block) or len(e.statements) != 1 else _linear(e.statements[0], name)
    if _uses(e, name) > 1 or isinstance(e, Difference) and _uses(e, name) or isinstance(e, AntiJoin) and _uses(e.right, name):
        return False
    return all(_linear(x, name) for x in (vars(e).values() if isinstance(e, RELATIONAL) else ()) if isinstance(x, RELATIONAL))


__all__ = ["W", "Planner", "PlanError", "Source", "Alias", "Project", "Pick", "Select", "EquiJoin", "Product", "ThetaJoin", "AntiJoin", "Union", "Difference", "Distinct", "Iterate"]
