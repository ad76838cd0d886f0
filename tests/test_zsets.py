"""Weighted relations, scalar expressions, programs and incremental circuits."""

import pytest

from quern.functions.scalar import At, Binary, Block, Call, Const, ExpressionError, Fn, Let, Ref, Tup, Unary, compile_expression, constant
from quern.operators.zset import W, ZSet
from quern.plans.program import Alias, AntiJoin, Difference, Distinct, EquiJoin, Iterate, Pick, Planner, PlanError, Project, Select, Source, ThetaJoin, Union
from quern.queries import visible_program
from quern.streaming.incremental import Circuit, CircuitError, StepTransaction


def rows_of(z):
    return {tuple(r)[:-1]: r[W] for r in z.consolidated().df.select(*z.columns, W).collect()}


def Z(spark, schema, rows, weights=None):
    return ZSet.rows(spark, schema, rows, weights)


def value(spark, e):
    t = compile_expression(e, {})
    return spark.range(1).select(t.column.alias("v")).first().v


@pytest.mark.parametrize("e, want", [
    (Binary("/", Const(-7), Const(2)), -3), (Binary("+", Const("a"), Const("b")), "ab"), (Binary("==", Const(None), Const(None)), True),
    (Binary("and", Const(0), Const("")), True), (Binary("or", Const(None), Const(False)), False), (Unary("not", Const(0)), False), (Unary("-", Const(3)), -3),
    (Call(Fn(("x",), Binary("*", Ref("x"), Const(2))), (Const(4),)), 8), (At(Tup((Const(1), Const("z"))), Const(1)), "z"),
    (Block((Let("a", Const(2)), Let("f", Fn(("y",), Binary("+", Ref("a"), Ref("y")))), Call(Ref("f"), (Const(5),)))), 7), (Block(()), None),
    (Binary("!=", Tup((Const(1), Const(2))), Tup((Const(1), Const(3)))), True), (Binary("-", Const(5, "uint"), Const(2, "uint")), 3),
])
def test_expressions(spark, e, want):
    assert value(spark, e) == want


@pytest.mark.parametrize("e", [
    Binary("==", Const(1), Const("a")), Binary("<", Const(None), Const(None)), Binary("+", Const(True), Const(False)), Unary("-", Const(1, "uint")), Ref("gone"),
    At(Tup((Const(1),)), Const(3)), Call(Fn(("x",), Ref("x")), ()), Binary("+", Const(1), Const(1, "uint")), Const(-1, "uint"), Binary("==", Const(None), Const(1)),
])
def test_bad_expressions(spark, e):
    with pytest.raises(ExpressionError):
        compile_expression(e, {})


def test_unsigned_subtraction_and_division_fail_at_run_time(spark):
    one = ZSet(spark.createDataFrame([(1, 2, 0, 1)], f"a long, b long, none long, {W} long"), frozenset({"a", "b"}))
    with pytest.raises(Exception, match="below zero"):
        one.project({"x": Binary("-", Ref("a"), Ref("b"))}).df.collect()
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        one.project({"x": Binary("/", Ref("none"), Ref("none"))}).df.collect()
    assert constant(True).type == "bool"


def test_weights(spark):
    a, b = Z(spark, "k long", [(1,), (2,), (2,)], [1, 2, -3]), Z(spark, "j long", [(2,), (3,)], [4, 1])
    assert rows_of(a) == {(1,): 1, (2,): -1}
    assert "weight" in a.table() and a.table().count("|") == 9
    assert rows_of(a.union(b)) == {(1,): 1, (2,): 3, (3,): 1}
    assert rows_of(a.difference(b)) == {(1,): 1, (2,): -5, (3,): -1}
    assert rows_of(a.distinct()) == {(1,): 1}
    assert rows_of(a.join(b, [(Ref("k"), Ref("j"))])) == {(2, 2): -4}
    assert rows_of(a.anti_join(b, [(Ref("k"), Ref("j"))])) == {(1,): 1}
    assert rows_of(a.product(b)) == {(1, 2): 4, (1, 3): 1, (2, 2): -4, (2, 3): -1}
    assert rows_of(a.project({"one": Const(1)})) == {}
    assert rows_of(a.select(Binary(">", Ref("k"), Const(1)))) == {(2,): -1}
    assert rows_of(a.intersect(Z(spark, "k long", [(1,)], [5]))) == {(1,): 1}


def test_join_columns_and_aliases(spark):
    a, b = Z(spark, "k long, v string", [(1, "a"), (None, "n")]), Z(spark, "k long, v string", [(1, "b"), (None, "m")])
    assert rows_of(a.join(b, [(Ref("k"), Ref("k"))])) == {(1, "a"): 1, (None, "n"): 1}
    both = a.aliased("l").join(b.aliased("r"), [(Ref("k"), Ref("k"))], {"x": Ref("l.v"), "y": Ref("r.v")})
    assert rows_of(both) == {("a", "b"): 1, ("n", "m"): 1}
    less = a.aliased("l").theta_join(b.aliased("r"), Binary("<", Ref("l.v"), Ref("r.v")), {"x": Ref("l.v"), "y": Ref("r.v")})
    assert rows_of(less) == {("a", "b"): 1, ("a", "m"): 1}
    with pytest.raises(ExpressionError):
        a.join(b, [(Ref("k"), Ref("v"))])


def test_programs(spark):
    e = Z(spark, "x long, y long", [(0, 1), (1, 2), (2, 0), (5, 6)])
    step = EquiJoin(Alias(Ref("p"), "a"), Alias(Source("e"), "b"), ((Ref("y"), Ref("x")),), (("x", Ref("a.x")), ("y", Ref("b.y"))))
    plan = lambda p: rows_of(Planner(spark, {"e": e}).relation(p))
    closed = {(a, b): 1 for a in range(3) for b in range(3)} | {(5, 6): 1}
    assert plan(Iterate("p", Source("e"), step)) == closed
    twice = EquiJoin(Alias(Ref("p"), "a"), Alias(Ref("p"), "b"), ((Ref("y"), Ref("x")),), (("x", Ref("a.x")), ("y", Ref("b.y"))))
    assert plan(Iterate("p", Source("e"), twice)) == closed
    assert plan(Iterate("p", Source("e"), step, bag_start=True))[0, 1] == 2
    with pytest.raises(PlanError):
        plan(Union((Source("e"),)))
    with pytest.raises(PlanError):
        plan(Source("gone"))
    with pytest.raises(PlanError):
        plan(Iterate("p", Source("e"), Project(Ref("p"), (("x", Ref("x")), ("y", Binary("+", Ref("y"), Const(1))))), max_rounds=5))


def test_circuit_deltas_equal_recomputation(spark):
    import random

    rng = random.Random(5)
    e, key = Source("e"), ((Ref("y"), Ref("x")),)
    programs = [
        Distinct(Project(e, (("x", Ref("x")),))),
        EquiJoin(Alias(e, "a"), Alias(Source("f"), "b"), key, (("x", Ref("a.x")), ("z", Ref("b.y")))),
        AntiJoin(e, Source("f"), key),
        Difference(Select(e, Binary(">", Ref("x"), Const(1))), Distinct(Source("f"))),
        ThetaJoin(Alias(e, "a"), Alias(Source("f"), "b"), Binary("<", Ref("a.x"), Ref("b.x")), (("x", Ref("a.x")), ("z", Ref("b.y")))),
    ]
    draw = lambda: Z(spark, "x long, y long", [(rng.randrange(4), rng.randrange(4)) for _ in range(4)], [rng.choice((1, 1, 2, -1)) for _ in range(4)])
    changes = [{"e": draw(), "f": draw()}, {"e": draw()}]
    for p in programs:
        c = Circuit(spark, p, {"e": "x long, y long", "f": "x long, y long"})
        total = {}
        for change in changes:
            for row, w in rows_of(c.step(change)).items():
                total[row] = total.get(row, 0) + w
            assert {r: w for r, w in total.items() if w} == rows_of(c.value()), p
    with pytest.raises(CircuitError):
        c.step({"gone": draw()})


def test_what_comes_early_waits(spark):
    said, after = "conv long, turn long", "conv long, prev long, turn long"
    c = Circuit(spark, visible_program(), {"said": said, "after": after})
    assert rows_of(c.step({"said": Z(spark, said, [(1, 0), (1, 2)]), "after": Z(spark, after, [(1, 1, 2)])})) == {(1, 0): 1}
    assert rows_of(c.step({"said": Z(spark, said, [(1, 1)]), "after": Z(spark, after, [(1, 0, 1)])})) == {(1, 0): -1, (1, 2): 1}
    assert rows_of(c.step({"said": Z(spark, said, [(1, 1)], [-1]), "after": Z(spark, after, [(1, 0, 1)], [-1])})) == {(1, 0): 1, (1, 2): -1}


def test_nested_operators_keep_their_state(spark):
    import random

    rng = random.Random(9)
    e, f, key = Source("e"), Source("f"), ((Ref("y"), Ref("x")),)
    join = EquiJoin(Alias(e, "a"), Alias(f, "b"), key, (("x", Ref("a.x")), ("y", Ref("b.y"))))
    path = EquiJoin(Alias(Ref("p"), "a"), Alias(Source("e"), "b"), key, (("x", Ref("a.x")), ("y", Ref("b.y"))))
    programs = [
        EquiJoin(Alias(Distinct(join), "j"), Alias(e, "c"), key, (("x", Ref("j.x")), ("z", Ref("c.y")))),
        AntiJoin(AntiJoin(e, Distinct(Project(f, (("x", Ref("x")),))), ((Ref("x"), Ref("x")),)), join, key),
        Union((Distinct(e), Pick(f, (("x", "y"), ("y", "x"))))),
        Iterate("p", AntiJoin(e, f, key), path),
    ]
    rows = [(rng.randrange(5), rng.randrange(5)) for _ in range(14)]
    step = lambda rs, w: Z(spark, "x long, y long", rs, [w] * len(rs))
    changes = [{"e": step(rows[:8], 1), "f": step(rows[8:], 1)}, {"e": Z(spark, "x long, y long", [*rows[:3], (4, 0)], [-1, -1, -1, 1]), "f": step(rows[9:11], -1)}]
    c = Circuit(spark, tuple(programs), {"e": "x long, y long", "f": "x long, y long"})
    totals = [{} for _ in programs]
    for change in changes:
        for total, d in zip(totals, c.step(change), strict=True):
            for row, w in rows_of(d).items():
                total[row] = total.get(row, 0) + w
        for p, total, want in zip(programs, totals, c.value(), strict=True):
            assert {r: w for r, w in total.items() if w} == rows_of(want), p


def test_a_step_reads_and_writes_what_it_changes(spark, monkeypatch):
    """Rows written by a small step, and rows read from traces, don't grow with what is there already."""
    from quern.streaming import incremental as I

    program = Distinct(EquiJoin(Alias(Distinct(Source("e")), "a"), Alias(Source("f"), "b"), ((Ref("y"), Ref("x")),), (("x", Ref("a.x")), ("z", Ref("b.y")))))
    work = []
    for n in (200, 5000):
        c = Circuit(spark, program, {"e": "x long, y long", "f": "x long, y long"})
        big = ZSet.of(spark.range(n).selectExpr("id as x", "id + 1 as y"))
        c.step({"e": big, "f": big})
        seen = []
        read, append = I.Trace.read, I.Trace.appended
        monkeypatch.setattr(I.Trace, "read", lambda self, touched=None: (lambda z: (seen.append(z.df.count() if touched is not None else 0), z)[1])(read(self, touched)))
        monkeypatch.setattr(I.Trace, "appended", lambda self, d: (lambda t: (seen.append(t.batches[-1][1] if len(t.batches) > len(self.batches) else 0), t)[1])(append(self, d)))
        c.step({"e": Z(spark, "x long, y long", [(n + 7, 3)])})
        monkeypatch.setattr(I.Trace, "read", read)
        monkeypatch.setattr(I.Trace, "appended", append)
        work.append(sum(seen))
    assert work[0] < 40 and work[1] < 40 + 4 * 5000 / 64 * 2  # a bucket or two of each trace


def test_a_failed_write_counts_once(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    c = Circuit(spark, Distinct(Source("e")), {"e": "x long"}, state_dir=state)
    got, broken = [], [True]

    def write(df, number):
        if broken.pop() if broken else False:
            raise OSError("no")
        got.append((number, sorted(tuple(r) for r in df.collect())))

    sink, rows = c.sink("e", write), spark.range(2).selectExpr("id as x")
    with pytest.raises(OSError):
        sink(rows, 0)
    sink(rows, 0), sink(rows, 0)
    assert got == [(0, [(0, 1), (1, 1)])] and c.steps == 1
    # the driver starts again from what was written: the batch is known, and so are its rows
    again = Circuit(spark, Distinct(Source("e")), {"e": "x long"}, state_dir=state)
    sink = again.sink("e", write)
    sink(rows, 0), sink(spark.range(3).selectExpr("id as x"), 1)
    assert got[1:] == [(1, [(2, 1)])] and rows_of(again.value()) == {(0,): 1, (1,): 1, (2,): 1}


def test_dataflow_primitives(spark):
    from quern.streaming import dataflow as D

    batch = lambda n: Z(spark, "x long", [(k,) for k in range(n)])
    looked = []
    batches = [z for _, z in zip(range(3), D.inspect(D.generator(batch), lambda n, z: looked.append(n)), strict=False)]
    assert looked == [0, 1, 2]
    total, late, change = D.Integrate(spark), D.Delay(spark), D.Differentiate(spark)
    assert [rows_of(total(b)) for b in batches][2] == {(0,): 2, (1,): 1}
    assert [rows_of(late(b)) for b in batches] == [{}, {}, {(0,): 1}]
    assert [rows_of(change(b)) for b in batches][2] == {(1,): 1}
    grown = D.feedback(spark, lambda new, old: new.union(old).distinct())
    assert [rows_of(grown(b)) for b in batches][2] == {(0,): 1, (1,): 1}
    assert rows_of(D.until(D.generator(batch), lambda z: len(rows_of(z)) == 2)) == {(0,): 1, (1,): 1}
    with pytest.raises(RuntimeError):
        D.until(D.generator(batch), lambda z: False, 2)


@pytest.mark.parametrize("a, b, want", [(9007199254740993, 1, 9007199254740993), (2**63 - 1, 2, 2**62 - 1), (-7, 2, -3), (7, -2, -3), (-(2**63) + 1, 3, -3074457345618258602)])
def test_division_is_exact(spark, a, b, want):
    assert value(spark, Binary("/", Const(a), Const(b))) == want
    got = compile_expression(Binary("/", Ref("a"), Ref("b")), {"a": compile_expression(Const(a), {}), "b": compile_expression(Const(b), {})})
    assert got.constant == want
    df = spark.createDataFrame([(a, b)], "a long, b long")
    assert ZSet.of(df).project({"q": Binary("/", Ref("a"), Ref("b"))}).df.first().q == want


def test_constants_are_worked_out_while_planning():
    items = Tup((Const("p"), Const("q"), Const("r")))
    index = Binary("+", Const(0, "uint"), Binary("*", Const(1, "uint"), Const(2, "uint")))
    assert compile_expression(At(items, index), {}).constant == "r"
    for bad in (Binary("-", Const(0, "uint"), Const(1, "uint")), Binary("/", Const(1), Const(0)), Binary("+", Const(2**63 - 1), Const(1))):
        with pytest.raises(ExpressionError):
            compile_expression(bad, {})


def test_transactions_and_streams(spark, tmp_path):
    c = Circuit(spark, Source("e"), {"e": "x long"})
    hard = {"negative": (Select(Source("e"), Binary("<", Ref("x"), Const(0))), True), "zero": (Select(Source("e"), Binary("==", Ref("x"), Const(0))), False)}
    t = StepTransaction(c, hard)
    t.insert("e", Z(spark, "x long", [(-1,)]))
    assert t.commit()[0] is None and t.state == "rejected" and c.steps == 0
    t = StepTransaction(c, hard)
    t.insert("e", Z(spark, "x long", [(0,)]))
    out, soft = t.commit()
    assert rows_of(out) == {(0,): 1} and list(soft) == ["zero"]
    with StepTransaction(c, hard) as t:
        t.insert("e", Z(spark, "x long", [(9,)]))
    assert t.state == "aborted" and c.steps == 1
    spark.range(3).selectExpr("id as x").write.parquet(str(tmp_path / "in"))
    got = []
    q = spark.readStream.schema("x long").parquet(str(tmp_path / "in")).writeStream.foreachBatch(c.sink("e", lambda df, n: got.append(df.count()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(got) == 3 and rows_of(c.value()) == {(0,): 2, (1,): 1, (2,): 1}
