"""Exhaustive evaluation of conjunctive queries in plain Python: what the plans are held against, for small relations."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from quern.plans.ir import Any, Atom, Lit, Query, Var


def matches(atom: Atom, rows: Sequence[tuple], binding: Mapping[str, object]) -> Iterator[dict[str, object]]:
    """The bindings that extend a given one to a row of an atom. A null equals nothing."""
    for row in rows:
        found = dict(binding)
        if all(_fits(t, v, found) for t, v in zip(atom.terms, row, strict=True)):
            yield found


def _fits(term: object, value: object, found: dict[str, object]) -> bool:
    if isinstance(term, Any):
        return True
    if isinstance(term, Lit):
        return value is not None and value == term.value
    if term.name not in found:
        found[term.name] = value
        return True
    return value is not None and found[term.name] == value


def brute_force(query: Query, tables: Mapping[str, Sequence[tuple]]) -> set[tuple]:
    """The distinct rows of a query, by trying every row of every atom."""
    found: list[dict[str, object]] = [{}]
    for atom in query.body:
        found = [b for f in found for b in matches(atom, tables[atom.relation], f)]
    return {tuple(b[t.name] if isinstance(t, Var) else t.value for t in query.head) for b in found}
