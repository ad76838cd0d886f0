"""The rule language: terms, atoms, conjunctive queries, rules and programs, with a small text form.

    path(x, z) :- path(x, y), edge(y, z).

Lower-case words in argument places are variables, numbers and quoted strings are constants, `_` matches anything.
Relations are sets of rows; columns are positional.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Relation names with this front are the evaluator's own.
RESERVED = "__delta_"


class ProgramError(ValueError):
    """A query or program that cannot be evaluated."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Any:
    """Matches every value and binds nothing."""


Term = Var | Lit | Any


@dataclass(frozen=True)
class Atom:
    relation: str
    terms: tuple[Term, ...]

    def variables(self) -> set[str]:
        return {t.name for t in self.terms if isinstance(t, Var)}


@dataclass(frozen=True)
class Query:
    """The distinct values of `head` over all ways to satisfy every atom of `body`."""

    head: tuple[Term, ...]
    body: tuple[Atom, ...]

    def check(self, arity: dict[str, int]) -> None:
        if not self.head:
            raise ProgramError("a query needs at least one head term")
        if not self.body:
            raise ProgramError("a query needs at least one atom")
        bound = set().union(*(a.variables() for a in self.body))
        if any(isinstance(t, Any) for t in self.head):
            raise ProgramError("a head term must be a variable or a constant")
        if free := [t.name for t in self.head if isinstance(t, Var) and t.name not in bound]:
            raise ProgramError(f"head variables {free} are bound by no atom")
        for a in self.body:
            if a.relation not in arity:
                raise ProgramError(f"unknown relation {a.relation}")
            if arity[a.relation] != len(a.terms):
                raise ProgramError(f"{a.relation} has {arity[a.relation]} columns, the atom {len(a.terms)}")


@dataclass(frozen=True)
class Rule:
    relation: str
    head: tuple[Term, ...]
    body: tuple[Atom, ...]

    def query(self) -> Query:
        return Query(self.head, self.body)


@dataclass(frozen=True)
class Program:
    rules: tuple[Rule, ...]

    def derived(self) -> list[str]:
        return list(dict.fromkeys(r.relation for r in self.rules))

    def check(self, known: dict[str, int]) -> dict[str, int]:
        """Arities of all relations; raises where a rule disagrees with them."""
        arity = dict(known)
        for r in self.rules:
            if r.relation.startswith(RESERVED) or any(a.relation.startswith(RESERVED) for a in r.body):
                raise ProgramError(f"names that begin with {RESERVED} are reserved")
            if not any(isinstance(t, Var) for t in r.head):
                raise ProgramError(f"a rule for {r.relation} has no variable in its head")
            if arity.setdefault(r.relation, len(r.head)) != len(r.head):
                raise ProgramError(f"{r.relation} has {arity[r.relation]} columns, a rule head {len(r.head)}")
        for r in self.rules:
            r.query().check(arity)
        return arity


class Catalog(dict):
    """Relations by name; a relation is a DataFrame whose columns are taken by position."""

    def relation(self, name: str) -> DataFrame:
        if name not in self:
            raise ProgramError(f"unknown relation {name}")
        return self[name]

    def arity(self) -> dict[str, int]:
        return {k: len(v.columns) for k, v in self.items()}


_ATOM = re.compile(r"\s*(\w+)\s*\(([^()]*)\)\s*")
_ARG = re.compile(r"""\s*(?:(?P<int>-?\d+)|"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<any>_)|(?P<var>[A-Za-z]\w*))\s*(?:,|$)""")


def _terms(text: str) -> tuple[Term, ...]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _ARG.match(text, at)
        if not m:
            raise ProgramError(f"can't read the arguments ({text})")
        kind, value = m.lastgroup, m[m.lastgroup]
        out.append({"int": lambda v: Lit(int(v)), "dq": Lit, "sq": Lit, "any": lambda _: Any(), "var": Var}[kind](value))
        at = m.end()
    return tuple(out)


def _atoms(text: str) -> list[Atom]:
    out, at = [], 0
    while at < len(text):
        m = _ATOM.match(text, at)
        if not m:
            raise ProgramError(f"can't read {text[at:]!r}")
        out.append(Atom(m[1], _terms(m[2])))
        at = m.end()
        if at < len(text):
            if text[at] != ",":
                raise ProgramError(f"can't read {text[at:]!r}")
            at += 1
    return out


def rule(text: str) -> Rule:
    head, sep, body = text.strip().rstrip(".").partition(":-")
    if not sep or not body.strip():
        raise ProgramError(f"a rule needs a body: {text!r}")
    (h,) = _atoms(head.strip())
    return Rule(h.relation, h.terms, tuple(_atoms(body.strip())))


def program(text: str) -> Program:
    """Rules, each ended by a dot and a line's end; lines that begin with % are remarks."""
    lines = "\n".join(x for x in text.splitlines() if not x.lstrip().startswith("%"))
    return Program(tuple(rule(part) for part in re.split(r"\.\s*(?:\n|$)", lines) if part.strip()))


def query(text: str) -> Query:
    r = rule(text)
    return Query(r.head, r.body)
