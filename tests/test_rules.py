"""Conjunctive queries and recursive programs against brute force."""

import itertools
import random

import pytest

from quern.plans import conjunctive, fixpoint, hypercube, ir
from quern.plans.reference import brute_force as brute


def frame(spark, rows, arity):
    return spark.createDataFrame(rows, ", ".join(f"c{k} long" for k in range(arity)))


def brute_fixpoint(program, tables):
    known = {k: set(v) for k, v in tables.items()}
    for d in program.derived():
        known.setdefault(d, set())
    while True:
        new = {r.relation: set() for r in program.rules}
        for r in program.rules:
            new[r.relation] |= brute(r.query(), known)
        if all(n <= known[d] for d, n in new.items()):
            return {d: known[d] for d in program.derived()}
        for d, n in new.items():
            known[d] |= n


HAND = {"r": [(1, 2), (1, 4), (2, 3)], "s": [(2, 5), (4, 7), (9, 9)], "u": [(1,), (2,)], "v": [(7,)], "t": [(4, 4), (5, 6), (7, 7)], "twice": [(1, 2), (2, 3), (2, 3)], "none": []}


@pytest.fixture(scope="module")
def hand(spark):
    arity = {"u": 1, "v": 1}
    return ir.Catalog({k: frame(spark, v, arity.get(k, 2)) for k, v in HAND.items()})


@pytest.mark.parametrize("text, n", [
    ("q(a, c) :- r(a, b), s(b, c)", 2), ("q(y) :- r(1, y)", 2), ("q(y) :- r(9, y)", 0), ("q(x) :- t(x, x)", 2), ("q(x, y) :- u(x), v(y)", 2),
    ("q(x) :- u(x), s(9, 9)", 2), ("q(x) :- u(x), s(9, 8)", 0), ("q(x, y) :- none(x, y)", 0), ("q(x) :- u(x), none(x, _)", 0), ("q(a) :- r(a, _)", 2),
    ("q(a, b) :- twice(a, b)", 2), ("q(x, 5) :- u(x)", 2), ("q(x) :- u(x), t(y, y)", 2), ("q(x, x) :- u(x)", 2),
])
def test_hand_cases(spark, hand, text, n):
    q = ir.query(text)
    got = {tuple(r) for r in conjunctive.evaluate(q, hand, [f"h{k}" for k in range(len(q.head))]).collect()}
    assert got == brute(q, HAND) and len(got) == n


@pytest.mark.parametrize("text", ["q(z) :- r(x, y)", "q(x) :- gone(x)", "q(x) :- r(x)", "q(_) :- r(x, _)"])
def test_bad_queries(hand, text):
    with pytest.raises(ir.ProgramError):
        conjunctive.evaluate(ir.query(text), hand)


def test_bad_programs(spark, hand):
    for text in ("p(1) :- u(x).", "__delta_p(x) :- u(x).", "p(x) :- u(x).\np(x, y) :- r(x, y).", "u(x) :- v(x)."):
        with pytest.raises(ir.ProgramError):
            fixpoint.evaluate(spark, ir.program(text), hand)
    with pytest.raises(ir.ProgramError):
        ir.query("q(x) :- ")
    with pytest.raises(ir.ProgramError):
        fixpoint.evaluate(spark, ir.program("p(x, y) :- r(x, y).\np(x, z) :- p(x, y), r(y, z)."), hand, max_rounds=1)


def random_query(rng, arities, most_atoms=4):
    names = [f"x{k}" for k in range(rng.randint(1, 4))]
    body = []
    for _ in range(rng.randint(1, most_atoms)):
        rel = rng.choice(list(arities))
        body.append(ir.Atom(rel, tuple(ir.Lit(rng.randrange(8)) if rng.random() < 0.25 else ir.Var(rng.choice(names)) for _ in range(arities[rel]))))
    bound = sorted(set().union(*(a.variables() for a in body)))
    return ir.Query(tuple(ir.Var(rng.choice(bound)) for _ in range(rng.randint(1, 3))), tuple(body)) if bound else None


@pytest.mark.parametrize("seed", range(14))
def test_random_queries(spark, seed):
    rng = random.Random(seed)
    arities = {f"r{k}": rng.randint(1, 3) for k in range(rng.randint(1, 4))}
    tables = {k: [tuple(rng.randrange(8) for _ in range(a)) for _ in range(rng.randrange(21))] for k, a in arities.items()}
    cat = ir.Catalog({k: frame(spark, v, arities[k]) for k, v in tables.items()})
    while (q := random_query(rng, arities)) is None:
        pass
    names = [f"h{k}" for k in range(len(q.head))]
    want = brute(q, tables)
    assert {tuple(r) for r in conjunctive.evaluate(q, cat, names).collect()} == want
    assert {tuple(r) for r in hypercube.evaluate(q, cat, names, cells=rng.choice((1, 8, 16))).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_random_programs(spark, seed):
    rng = random.Random(100 + seed)
    arities = {"e0": rng.randint(1, 2), "e1": 2}
    tables = {k: [tuple(rng.randrange(6) for _ in range(a)) for _ in range(rng.randrange(1, 10))] for k, a in arities.items()}
    idb = {"p": 2, "q": 1}
    rules = [ir.rule("p(x, y) :- e1(x, y)"), ir.rule("q(x) :- e1(x, _)")]
    while len(rules) < 4:
        got = random_query(rng, arities | idb, 2)
        if got:
            head = rng.choice(["p", "q"])
            rules.append(ir.Rule(head, (got.head * 2)[: idb[head]], got.body))
    program = ir.Program(tuple(rules))
    cat = ir.Catalog({k: frame(spark, v, arities[k]) for k, v in tables.items()})
    want = brute_fixpoint(program, tables)
    for semi in (True, False):
        got = fixpoint.evaluate(spark, program, cat, semi_naive=semi).relations
        assert {d: {tuple(r) for r in got[d].collect()} for d in idb} == want


CLOSURE = "anc(x, y) :- parent(x, y).\nanc(x, z) :- anc(x, y), parent(y, z)."


def test_rounds_and_new_facts(spark):
    chain = ir.Catalog(parent=frame(spark, [(k, k + 1) for k in range(5)], 2))
    got = fixpoint.evaluate(spark, ir.program(CLOSURE), chain)
    assert [r["anc"] for r in got.new_facts] == [5, 4, 3, 2, 1, 0] and got.rounds == 6 and got.relations["anc"].count() == 15
    fast = fixpoint.evaluate(spark, ir.program(CLOSURE), chain, double=True)
    assert fast.rounds < 6 and fast.relations["anc"].count() == 15
    ring = fixpoint.evaluate(spark, ir.program(CLOSURE), ir.Catalog(parent=frame(spark, [(1, 2), (2, 3), (3, 1)], 2)))
    assert [r["anc"] for r in ring.new_facts] == [3, 3, 3, 0]


def test_seeds_and_mutual_recursion(spark):
    chain = ir.Catalog(parent=frame(spark, [(0, 1), (1, 2)], 2))
    got = fixpoint.evaluate(spark, ir.program(CLOSURE), chain, {"anc": frame(spark, [(7, 8)], 2)}).relations["anc"]
    assert {tuple(r) for r in got.collect()} == {(0, 1), (0, 2), (1, 2), (7, 8)}
    succ = ir.Catalog(succ=frame(spark, [(k, k + 1) for k in range(4)], 2))
    both = fixpoint.evaluate(spark, ir.program("even(y) :- odd(x), succ(x, y).\nodd(y) :- even(x), succ(x, y)."), succ, {"even": frame(spark, [(0,)], 1)}).relations
    assert {r[0] for r in both["even"].collect()} == {0, 2, 4} and {r[0] for r in both["odd"].collect()} == {1, 3}


def test_doubling_derives_no_false_facts(spark):
    """With a second rule for its start, or with seeds, a closure's facts are not edges."""
    facts = {"e": [(1, 2), (2, 3), (3, 4), (12, 13)], "f": [(10, 11), (11, 12)]}
    cat = ir.Catalog({k: frame(spark, v, 2) for k, v in facts.items()})
    right, left = "p(x, z) :- p(x, y), e(y, z).", "p(x, z) :- e(x, y), p(y, z)."
    seeds = [(7, 8), (8, 9), (9, 1)]
    for first, chain, given, double in (("p(x, y) :- f(x, y).\n", right, seeds, True), ("", left, seeds, True), ("p(x, y) :- f(x, y).\n", left, [], False)):
        program = ir.program(f"p(x, y) :- e(x, y).\n{first}{chain}")
        want = brute_fixpoint(ir.Program((*program.rules, ir.rule("p(x, y) :- s(x, y)"))), facts | {"s": given})["p"]
        rules = program if double else fixpoint.doubled(program)
        got = fixpoint.evaluate(spark, rules, cat, {"p": frame(spark, given, 2)} if given else None, double=double).relations["p"]
        assert {tuple(r) for r in got.collect()} == want


def test_nulls_end_and_join_nothing(spark):
    edges = [(None, 1), (1, 2), (2, 1), (3, None)]
    got = fixpoint.evaluate(spark, ir.program(CLOSURE), ir.Catalog(parent=frame(spark, edges, 2)), max_rounds=12).relations["anc"]
    assert {tuple(r) for r in got.collect()} == {(None, 1), (None, 2), (1, 2), (2, 1), (1, 1), (2, 2), (3, None)}
    tables = {"r": [(0, 5), (None, 5), (1, None), (2, 6)], "s": [(5, 7), (None, 8), (6, None), (6, 9)]}
    cat = ir.Catalog({k: frame(spark, v, 2) for k, v in tables.items()})
    for text in ("q(x, y, z) :- r(x, y), s(y, z)", "q(x, z) :- r(x, y), s(y, z)", "q(x) :- r(x, _)", "q(x, y) :- r(x, y)"):
        q = ir.query(text)
        names = [f"h{k}" for k in range(len(q.head))]
        want = brute(q, tables)
        assert {tuple(r) for r in conjunctive.evaluate(q, cat, names).collect()} == want
        assert {tuple(r) for r in hypercube.evaluate(q, cat, names, cells=8).collect()} == want


def test_the_cube_needs_no_package_on_workers():
    """What is sent to the workers names no module of this package."""
    import pickletools

    from pyspark import cloudpickle

    sent = cloudpickle.dumps(hypercube.local_join)
    modules = {arg for op, arg, _ in pickletools.genops(sent) if isinstance(arg, str)}
    assert not any(m.split()[0] == "quern.plans.hypercube" and " " in m for m in modules)
    assert b"solve" in sent  # the code itself


def test_repeated_keys_do_not_multiply(spark):
    """An atom that drops columns holds each key once before it is joined on."""
    line = spark.range(1000).selectExpr("id % 2 as k", "id as n")
    cat = ir.Catalog(a=line, b=line, c=spark.range(2).selectExpr("id as k", "id as v"))
    plan = conjunctive.evaluate(ir.query("q(x, y, v) :- a(x, _), c(x, v), b(y, _), c(y, v)"), cat)
    assert {tuple(r) for r in plan.collect()} == {(0, 0, 0), (1, 1, 1)}
    joined = conjunctive.bind(ir.query("q(x) :- a(x, _)").body[0], line, {"x"}, distinct=True)
    assert joined.count() == 2


def test_small_relations_come_first():
    body = ir.query("q(a, c) :- big(a, b), small(b, c)").body
    assert conjunctive.join_order(body, {"big": 10**9, "small": 10}) == [1, 0]


def test_join_order_is_connected():
    body = ir.query("q(a, d) :- r(a, b), s(c, d), t(b, c)").body
    order = conjunctive.join_order(body)
    bound = body[order[0]].variables()
    for k in order[1:]:
        assert body[k].variables() & bound
        bound |= body[k].variables()
    assert list(itertools.chain(sorted(order))) == [0, 1, 2]
