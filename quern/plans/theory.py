"""Theories as flat schemas: entities (tables) and rules, read from and written to their JSON form."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from quern.plans.ir import Lit, ProgramError, Term, Var

#: Types of the JSON form and their Spark types; a row id is a struct.
TYPES = {"builtinInt": "bigint", "builtinString": "string"}
ROW_ID = "struct<commit:string,n:bigint>"


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    target: str | None = None  # the table that a row id points to

    def spark(self) -> str:
        return ROW_ID if self.type == "rowId" else TYPES[self.type]


@dataclass(frozen=True)
class Entity:
    """`key` None: no key; empty: at most one row; else unique columns. Views and indexes keep their kind by name."""

    name: str
    columns: tuple[ColumnDef, ...]
    key: tuple[str, ...] | None = None
    kind: str = "table"

    def ddl(self) -> str:
        return ", ".join([f"_rid {ROW_ID}", *(f"`{c.name}` {c.spark()}" for c in self.columns)])


@dataclass(frozen=True)
class RuleAtom:
    """A row of `entity` whose mentioned columns (by number) have these terms; columns not mentioned are free."""

    entity: str
    values: tuple[tuple[int, Term], ...] = ()
    row_id: Term | None = None

    def variables(self) -> set[str]:
        return {t.name for t in [*(t for _, t in self.values), self.row_id] if isinstance(t, Var)}


@dataclass(frozen=True)
class Equal:
    left: Term
    right: Term


@dataclass(frozen=True)
class Law:
    """Wherever the antecedents hold, the consequents must: `enforced` and `chased` laws always, `monitored` ones as
    far as the caller asks."""

    name: str
    antecedents: tuple[RuleAtom | Equal, ...]
    consequents: tuple[RuleAtom | Equal, ...]
    variant: str = "enforced"

    def __str__(self) -> str:
        show = lambda t: t.name if isinstance(t, Var) else repr(t.value)

        def one(x) -> str:
            if isinstance(x, Equal):
                return f"{show(x.left)} = {show(x.right)}"
            at = f"{show(x.row_id)} @ " if x.row_id else ""
            return f"{at}{x.entity}[{', '.join(f'{k}: {show(t)}' for k, t in x.values)}]"

        return f"{self.name}: {' and '.join(map(one, self.antecedents)) or 'true'} => {' and '.join(map(one, self.consequents)) or 'true'}"


@dataclass(frozen=True)
class Theory:
    entities: tuple[Entity, ...]
    laws: tuple[Law, ...] = field(default=())

    def entity(self, name: str) -> Entity:
        for e in self.entities:
            if e.name == name:
                return e
        raise ProgramError(f"unknown table {name}")

    def check(self) -> Theory:
        for law in self.laws:
            bound: set[str] = set()
            for a in law.antecedents:
                if isinstance(a, RuleAtom):
                    bound |= a.variables()
                elif free := {t.name for t in (a.left, a.right) if isinstance(t, Var)} - bound:
                    raise ProgramError(f"{law.name}: {sorted(free)} stand in an equality before any atom binds them")
            for a in (*law.antecedents, *law.consequents):
                if isinstance(a, RuleAtom) and any(k >= len(self.entity(a.entity).columns) for k, _ in a.values):
                    raise ProgramError(f"{law.name}: {a.entity} has no such column")
        return self


def _name(path: list) -> str:
    """A path of dotted parts as one name: the root part stays, as names are unique only with it."""
    return ".".join(".".join(p) for p in path)


def _term(t: dict, names: list[str]) -> Term:
    if t["tag"] == "var":
        return Var(names[t["index"]])
    return Lit(t.get("value", t.get("literal")))


def from_json(text: str) -> Theory:
    """Entities and rules; names are the paths' parts, joined by dots."""
    raw = json.loads(text)
    entities = []
    for e in raw["entities"]:
        v = e["value"]
        columns = tuple(ColumnDef(_name(c["path"]), c["type"]["tag"], _name(c["type"]["path"]) if "path" in c["type"] else None) for c in v["columns"])
        key = v["primaryKey"]
        entities.append(Entity(_name(e["path"]), columns, None if key is None else tuple(map(_name, key)), v["entityVariant"]["tag"]))
    laws = []
    for r in raw["rules"]:
        v = r["value"]
        names = [f"{_name(n)}#{k}" for k, n in enumerate(v["varNames"])]

        def part(x: dict, names: list[str] = names) -> RuleAtom | Equal:
            if x["tag"] == "atom":
                a = x["atom"]
                return RuleAtom(_name(a["entity"]), tuple((w["column"], _term(w["term"], names)) for w in a["values"]), _term(a["rowId"], names) if a["rowId"] else None)
            pair = x.get("terms") or [x.get("left", x.get("lhs")), x.get("right", x.get("rhs"))]
            return Equal(_term(pair[0], names), _term(pair[1], names))

        laws.append(Law(_name(r["path"]), tuple(map(part, v["antecedents"])), tuple(map(part, v["consequents"])), v["ruleVariant"]))
    return Theory(tuple(entities), tuple(laws)).check()


def foreign_key(name: str, entity: Entity, column: int, target: str) -> Law:
    return Law(name, (RuleAtom(entity.name, ((column, Var("x")),)),), (RuleAtom(target, (), Var("x")),))
