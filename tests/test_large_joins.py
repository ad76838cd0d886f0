"""Joins whose results outgrow their inputs: no shuffle of the results, no needless intermediate rows."""

from quern.plans import conjunctive, ir


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_results_that_the_head_tells_apart_are_not_deduplicated(spark):
    c = spark.createDataFrame([(1, 3), (2, 3), (2, 3), (4, 5)], "c long, n long")
    s = spark.createDataFrame([(7, 3), (8, 3), (8, 5)], "s long, n long")
    got = conjunctive.evaluate(ir.query("q(c, s) :- a(c, n), b(s, n)"), ir.Catalog(a=c, b=s))
    assert sorted(map(tuple, got.collect())) == [(1, 7), (1, 8), (2, 7), (2, 8), (4, 8)]
    assert not _plan(got).startswith("Aggregate")
    twice = spark.createDataFrame([(1, 3), (1, 5)], "c long, n long")
    both = conjunctive.evaluate(ir.query("q(c, s) :- a(c, n), b(s, n)"), ir.Catalog(a=twice, b=s))
    assert sorted(map(tuple, both.collect())) == [(1, 7), (1, 8)]


def test_a_cyclic_query_starts_with_the_pair_that_makes_fewest_rows(spark):
    rows = spark.range(600).selectExpr("id div 4 as o", "id % 20 as p", "id % 3 as s")
    t = ir.Catalog(op=rows.select("o", "p"), ps=rows.select("p", "s"), so=rows.select("s", "o"))
    q = ir.query("q(o, p, s) :- op(o, p), ps(p, s), so(s, o)")
    assert conjunctive.cyclic(q.body) and sorted(conjunctive.measured_order(q.body, t)[:2]) == [0, 2]
    assert not conjunctive.cyclic(ir.query("q(x, z) :- op(x, y), ps(y, z)").body)


def test_a_fixpoint_joins_each_pair_of_facts_once(spark, monkeypatch):
    from quern.plans import fixpoint

    n, made, run = 9, [], fixpoint.run_query

    def counted(*a, **k):
        got = run(*a, **k)
        made.append(got.count())
        return got

    monkeypatch.setattr(fixpoint, "run_query", counted)
    rules = ir.program("p(x, y) :- e(x, y).\np(x, z) :- p(x, y), p(y, z).")
    e = spark.range(n - 1).selectExpr("id as x", "id + 1 as y")
    got = fixpoint.evaluate(spark, rules, ir.Catalog(e=e)).relations["p"]
    assert got.count() == n * (n - 1) // 2
    assert sum(made) == n - 1 + n * (n - 1) * (n - 2) // 6
