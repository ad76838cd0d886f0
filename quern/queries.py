"""The registered queries of the engine, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.scalar import Assign, At, Binary, Block, Call, Const, Fn, Let, Ref, Tup, Unary
from quern.operators.identity import Referenced, canonical
from quern.operators.integrity import key_violations, violations
from quern.operators.zset import ZSet
from quern.plans import fixpoint, hypercube, ir
from quern.plans.conjunctive import evaluate
from quern.plans.program import Alias, AntiJoin, Difference, Distinct, EquiJoin, Iterate, Pick, Planner, Product, Project, Select, Source, ThetaJoin, Union
from quern.plans.theory import Equal, Law, RuleAtom
from quern.registry import QUERIES, SQL, read, register
from quern.sources.tables import seek
from quern.streaming import dataflow
from quern.streaming.incremental import Circuit, StepTransaction

#: Queries that bench.py times.
HEADLINES = ["cq_chain", "cq_triangle", "cq_nested_terms", "dl_ancestor", "dl_ancestor_doubling", "ra_equi_join", "ra_anti_join", "ra_difference", "inc_join_delta", "rule_fk_violations", "pk_duplicates", "hashcons_docs"]


def catalog(spark: SparkSession, sf_dir: str) -> ir.Catalog:
    r = lambda t, *c: read(spark, sf_dir, t, *c)
    return ir.Catalog(
        customer=r("customer", "c_custkey", "c_nationkey"),
        orders=r("orders", "o_orderkey", "o_custkey"),
        line=r("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"),
        op=r("lineitem", "l_orderkey", "l_partkey"), ps=r("lineitem", "l_partkey", "l_suppkey"), so=r("lineitem", "l_suppkey", "l_orderkey"),
        slot=r("lineitem", "l_suppkey", "cast(l_linenumber as bigint) as l_linenumber", "l_orderkey"),
        region=r("region", "r_regionkey", "r_name"), nation=r("nation", "n_nationkey", "n_name", "n_regionkey"),
        parent=r("customer", "c_custkey div 2 as parent", "c_custkey as child").filter("child > 1"),
    )


def cq(spark: SparkSession, sf_dir: str, text: str, names: list[str] | None = None) -> DataFrame:
    return evaluate(ir.query(text), catalog(spark, sf_dir), names)


# conjunctive queries


@register("SELECT DISTINCT c_custkey AS c, o_orderkey AS o, l_partkey AS p FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey")
def cq_chain(spark, sf_dir):
    return cq(spark, sf_dir, "q(c, o, p) :- customer(c, _), orders(o, c), line(o, p, _, _, _)")


@register("SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1")
def cq_literal(spark, sf_dir):
    return cq(spark, sf_dir, "q(o, s) :- line(o, _, s, 1, 'R')")


@register("SELECT DISTINCT l_suppkey AS x, l_orderkey AS o FROM lineitem WHERE l_suppkey = l_linenumber")
def cq_repeated_var(spark, sf_dir):
    return cq(spark, sf_dir, "q(x, o) :- slot(x, x, o)")


@register("SELECT DISTINCT r_name AS r, n_name AS n FROM region CROSS JOIN nation")
def cq_cross(spark, sf_dir):
    return cq(spark, sf_dir, "q(r, n) :- region(_, r), nation(_, n, _)")


@register("SELECT DISTINCT r_name AS r FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3 AND n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3))")
def cq_exists(spark, sf_dir):
    return cq(spark, sf_dir, "q(r) :- region(_, r), nation(3, _, _)")


@register("SELECT DISTINCT r_name AS r FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 9999)")
def cq_exists_none(spark, sf_dir):
    return cq(spark, sf_dir, "q(r) :- region(_, r), nation(9999, _, _)")


@register(
    """SELECT DISTINCT a.l_orderkey AS o, a.l_partkey AS p, b.l_suppkey AS s
    FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) b ON a.l_partkey = b.l_partkey
    JOIN (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) c ON b.l_suppkey = c.l_suppkey AND c.l_orderkey = a.l_orderkey"""
)
def cq_triangle(spark, sf_dir):
    return cq(spark, sf_dir, "q(o, p, s) :- op(o, p), ps(p, s), so(s, o)")


SQL_TRIANGLE = SQL["cq_triangle"]


@register(SQL_TRIANGLE)
def cq_triangle_cube(spark, sf_dir):
    """The cyclic join, variable by variable in the cells of a cube."""
    c = catalog(spark, sf_dir)
    return hypercube.evaluate(ir.query("q(o, p, s) :- op(o, p), ps(p, s), so(s, o)"), ir.Catalog({k: c[k] for k in ("op", "ps", "so")}))


@register("SELECT DISTINCT f.l_orderkey AS f, f.l_suppkey AS a, f.l_partkey AS g FROM lineitem f JOIN lineitem g ON f.l_partkey = g.l_partkey AND f.l_suppkey = g.l_suppkey")
def cq_nested_terms(spark, sf_dir):
    return cq(spark, sf_dir, "q(f, a, g) :- line(f, g, a, _, _), ps(g, a)")


@register("SELECT DISTINCT c_custkey AS x FROM customer JOIN orders ON c_custkey = o_custkey")
def cq_semi_join(spark, sf_dir):
    return cq(spark, sf_dir, "q(x) :- customer(x, _), orders(_, x)")


# recursive programs

_TREE = "WITH RECURSIVE e AS (SELECT c_custkey // 2 AS x, c_custkey AS y FROM customer WHERE c_custkey > 1), r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)"
_ANCESTOR = "anc(x, y) :- parent(x, y).\nanc(x, z) :- anc(x, y), parent(y, z)."


def derived(spark: SparkSession, facts: ir.Catalog, text: str, relation: str, double: bool = False, **options) -> DataFrame:
    p = ir.program(text)
    return fixpoint.evaluate(spark, p, facts, double=double, **options).relations[relation]


@register(f"{_TREE} SELECT x, y FROM r")
def dl_ancestor(spark, sf_dir):
    return derived(spark, ir.Catalog(parent=catalog(spark, sf_dir)["parent"]), _ANCESTOR, "anc")


@register(f"{_TREE} SELECT x, y FROM r")
def dl_ancestor_doubling(spark, sf_dir):
    return derived(spark, ir.Catalog(parent=catalog(spark, sf_dir)["parent"]), _ANCESTOR, "anc", double=True)


@register(f"{_TREE} SELECT x, y FROM r")
def dl_ancestor_naive(spark, sf_dir):
    """Every round evaluates the rules over all facts."""
    return derived(spark, ir.Catalog(parent=catalog(spark, sf_dir)["parent"]), _ANCESTOR, "anc", semi_naive=False)


@register("WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS x, (n_nationkey * 3 + 1) % 25 AS y FROM nation), r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x, y FROM r")
def dl_cycle(spark, sf_dir):
    edges = read(spark, sf_dir, "nation", "n_nationkey as x", "(n_nationkey * 3 + 1) % 25 as y")
    return derived(spark, ir.Catalog(edge=edges), "path(x, y) :- edge(x, y).\npath(x, z) :- path(x, y), edge(y, z).", "path")


@register(
    """WITH RECURSIVE e AS (SELECT c_custkey // 2 AS x, c_custkey AS y FROM customer WHERE c_custkey > 1),
    r(n, even) AS (SELECT CAST(1 AS BIGINT), 1 UNION SELECT e.y, 1 - r.even FROM r JOIN e ON e.x = r.n)
    SELECT n FROM r WHERE even = 0"""
)
def dl_even_odd(spark, sf_dir):
    seeds = {"even": spark.createDataFrame([(1,)], "n long")}
    return derived(spark, ir.Catalog(succ=catalog(spark, sf_dir)["parent"]), "even(n) :- odd(m), succ(m, n).\nodd(n) :- even(m), succ(m, n).", "odd", seeds=seeds)


@register(
    """WITH RECURSIVE b AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_linenumber = 1),
    r(kind, id) AS (
        SELECT 'buyer', c_custkey FROM customer WHERE c_nationkey = 3
        UNION (
            SELECT 'item', b.p FROM r JOIN b ON r.id = b.c WHERE r.kind = 'buyer'
            UNION ALL SELECT 'buyer', b.c FROM r JOIN b ON r.id = b.p WHERE r.kind = 'item'))
    SELECT kind, id FROM r"""
)
def dl_buyers_and_items(spark, sf_dir):
    """Mutual recursion through joins of several atoms: from one nation's customers to the parts that they sent back, on
    to others who did so, and so forth."""
    c = catalog(spark, sf_dir)
    rules = """
    buyer(c) :- customer(c, 3).
    item(p) :- buyer(c), orders(o, c), line(o, p, _, 1, 'R').
    buyer(c) :- item(p), line(o, p, _, 1, 'R'), orders(o, c).
    """
    got = fixpoint.evaluate(spark, ir.program(rules), ir.Catalog(customer=c["customer"], orders=c["orders"], line=c["line"])).relations
    one, two = (got[k].select(F.lit(k).alias("kind"), F.col(got[k].columns[0]).alias("id")) for k in ("buyer", "item"))
    return one.unionAll(two)


@register("SELECT DISTINCT CAST(c_custkey // 2 AS BIGINT) AS x, CAST(1 AS INTEGER) AS c1 FROM customer WHERE c_custkey > 1")
def dl_head_literal(spark, sf_dir):
    return derived(spark, ir.Catalog(parent=catalog(spark, sf_dir)["parent"]), "flagged(x, 1) :- parent(x, _).", "flagged")


@register(
    """WITH RECURSIVE e AS (SELECT c_custkey // 2 AS x, c_custkey AS y FROM customer WHERE c_custkey > 1),
    r(x, y) AS (SELECT CAST(s.x AS BIGINT), CAST(s.y AS BIGINT) FROM (VALUES (-7, 3), (-8, 4)) s(x, y) UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
    SELECT x, y FROM r"""
)
def dl_seeded(spark, sf_dir):
    seeds = {"reach": spark.createDataFrame([(-7, 3), (-8, 4)], "x long, y long")}
    return derived(spark, ir.Catalog(parent=catalog(spark, sf_dir)["parent"]), "reach(x, z) :- reach(x, y), parent(y, z).", "reach", seeds=seeds)


@register("SELECT a.conv_id * 100 + a.turn AS a, b.conv_id * 100 + b.turn AS b FROM (SELECT DISTINCT conv_id, turn FROM conversations) a JOIN (SELECT DISTINCT conv_id, turn FROM conversations) b ON a.conv_id = b.conv_id")
def dl_same_conversation(spark, sf_dir):
    """Non-linear, over a relation and its converse: which turns hang together. Components are conversations."""
    turns = read(spark, sf_dir, "conversations", "conv_id * 100 + turn as y").distinct()
    e = turns.selectExpr("y - 1 as x", "y").join(turns.withColumnRenamed("y", "x"), "x").select("x", "y")
    rules = "con(x, y) :- e(x, y).\ncon(y, x) :- e(x, y).\ncon(x, z) :- con(x, y), con(y, z)."
    return derived(spark, ir.Catalog(e=e), rules, "con").selectExpr("x as a", "y as b")


@register(
    f"""{_TREE}, d(x, y, depth) AS (SELECT x, y, 1 FROM e UNION ALL SELECT d.x, e.y, d.depth + 1 FROM d JOIN e ON d.y = e.x)
    SELECT CAST(depth AS INTEGER) AS round, CAST(count(*) AS BIGINT) AS new_facts FROM d GROUP BY depth UNION ALL SELECT CAST(max(depth) + 1 AS INTEGER), CAST(0 AS BIGINT) FROM d"""
)
def dl_fixpoint_stats(spark, sf_dir):
    """How many facts each round of the closure found; the last one finds none."""
    got = fixpoint.evaluate(spark, ir.program(_ANCESTOR), ir.Catalog(parent=catalog(spark, sf_dir)["parent"]))
    return spark.createDataFrame([(k, r["anc"]) for k, r in enumerate(got.new_facts, 1)], "round int, new_facts long")


@register(
    f"""{_TREE}, d(x, y, depth) AS (SELECT x, y, 1 FROM e UNION ALL SELECT d.x, e.y, d.depth + 1 FROM d JOIN e ON d.y = e.x)
    SELECT CAST(b AS INTEGER) AS bound, b > (SELECT max(depth) FROM d) AS reached FROM (VALUES (2), (4), (30)) t(b)"""
)
def dl_bounded_rounds(spark, sf_dir):
    """A bound on the rounds is an error where the fixpoint needs more."""
    def reached(bound: int) -> bool:
        try:
            fixpoint.evaluate(spark, ir.program(_ANCESTOR), ir.Catalog(parent=catalog(spark, sf_dir)["parent"]), max_rounds=bound)
        except ir.ProgramError:
            return False
        return True

    return spark.createDataFrame([(b, reached(b)) for b in (2, 4, 30)], "bound int, reached boolean")


@register(
    """WITH RECURSIVE e AS (SELECT DISTINCT nullif(o_custkey % 7, 0) AS x, nullif((o_custkey * 3 + 1) % 7, 0) AS y FROM orders),
    r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x, y FROM r"""
)
def dl_cycle_with_nulls(spark, sf_dir):
    """Nulls are kept in facts, and join nothing."""
    edges = read(spark, sf_dir, "orders", "nullif(o_custkey % 7, 0) as x", "nullif((o_custkey * 3 + 1) % 7, 0) as y")
    return derived(spark, ir.Catalog(edge=edges), "path(x, y) :- edge(x, y).\npath(x, z) :- path(x, y), edge(y, z).", "path")


@register(
    """WITH RECURSIVE e AS (SELECT c_custkey // 2 AS x, c_custkey AS y FROM customer WHERE c_custkey > 1),
    s(x, y) AS (
        SELECT x, y FROM e UNION ALL SELECT CAST(-n_nationkey - 1 AS BIGINT), CAST(n_nationkey + 1 AS BIGINT) FROM nation
        UNION ALL SELECT CAST(-99 AS BIGINT), CAST(2 AS BIGINT)),
    r(x, y) AS (SELECT x, y FROM s UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x, y FROM r"""
)
def dl_doubled_with_seeds(spark, sf_dir):
    """A linear closure that also has facts from another rule and from seeds: doubling goes over the edges alone."""
    more = read(spark, sf_dir, "nation", "cast(-n_nationkey - 1 as bigint) as x", "cast(n_nationkey + 1 as bigint) as y")
    rules = "reach(x, y) :- parent(x, y).\nreach(x, y) :- more(x, y).\nreach(x, z) :- reach(x, y), parent(y, z)."
    seeds = {"reach": spark.createDataFrame([(-99, 2)], "x long, y long")}
    return derived(spark, ir.Catalog(parent=catalog(spark, sf_dir)["parent"], more=more), rules, "reach", double=True, seeds=seeds)


# relational algebra


def plan(spark: SparkSession, program: object, **relations: ZSet) -> ZSet:
    return Planner(spark, relations).relation(program)


def attrs(**kw: object) -> tuple[tuple[str, object], ...]:
    return tuple(kw.items())


@register(
    """SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) * 10 + 1 AS code, l_returnflag || '-' || l_linestatus AS flag, -(l_orderkey // 2) AS half,
    CAST(count(*) AS BIGINT) AS w FROM lineitem WHERE l_linenumber * 2 >= 4 AND NOT l_returnflag = 'A' GROUP BY ALL"""
)
def ra_select_project(spark, sf_dir):
    """Arithmetic, text, a function called per row, and its inlining."""
    line = ZSet.of(read(spark, sf_dir, "lineitem", "l_orderkey", "cast(l_linenumber as bigint) as n", "l_returnflag", "l_linestatus"))
    program = Block((
        Let("twice", Fn(("x",), Binary("*", Ref("x"), Const(2)))),
        Let("big", Fn(("x",), Binary(">=", Call(Ref("twice"), (Ref("x"),)), Const(4)))),
        Project(
            Select(Source("line"), Binary("and", Call(Ref("big"), (Ref("n"),)), Unary("not", Binary("==", Ref("l_returnflag"), Const("A"))))),
            attrs(k=Ref("l_orderkey"), code=Binary("+", Binary("*", Ref("n"), Const(10)), Const(1)), flag=Binary("+", Binary("+", Ref("l_returnflag"), Const("-")), Ref("l_linestatus")), half=Binary("/", Unary("-", Ref("l_orderkey")), Const(2))),
        ),
    ))
    return plan(spark, program, line=line).weighted()


@register("SELECT s_suppkey AS s, n_name AS nation, CAST(count(*) AS BIGINT) AS w FROM supplier JOIN nation ON s_nationkey + 1 = n_nationkey + 1 GROUP BY ALL")
def ra_equi_join(spark, sf_dir):
    on = ((Binary("+", Ref("s_nationkey"), Const(1)), Binary("+", Ref("n_nationkey"), Const(1))),)
    join = EquiJoin(Alias(Source("s"), "a"), Alias(Source("n"), "b"), on, attrs(s=Ref("a.s_suppkey"), nation=Ref("b.n_name")))
    return plan(spark, join, s=ZSet.of(read(spark, sf_dir, "supplier")), n=ZSet.of(read(spark, sf_dir, "nation"))).weighted()


@register("WITH e AS (SELECT n_regionkey AS x, n_nationkey AS y FROM nation) SELECT a.x AS x, b.y AS y, c.y AS z, CAST(count(*) AS BIGINT) AS w FROM e a JOIN e b ON a.y = b.x JOIN e c ON b.y = c.x GROUP BY ALL")
def ra_self_join(spark, sf_dir):
    e = ZSet.of(read(spark, sf_dir, "nation", "n_regionkey as x", "n_nationkey as y"))
    two = EquiJoin(Alias(Source("e"), "a"), Alias(Source("e"), "b"), ((Ref("y"), Ref("x")),), attrs(x=Ref("a.x"), y=Ref("b.y")))
    three = EquiJoin(Alias(two, "p"), Alias(Source("e"), "c"), ((Ref("y"), Ref("x")),), attrs(x=Ref("p.x"), y=Ref("p.y"), z=Ref("c.y")))
    return plan(spark, three, e=e).weighted()


@register("SELECT r_name, n_name, CAST(1 AS BIGINT) AS w FROM region, nation")
def ra_product(spark, sf_dir):
    return plan(spark, Product(Source("r"), Source("n")), r=ZSet.of(read(spark, sf_dir, "region", "r_name")), n=ZSet.of(read(spark, sf_dir, "nation", "n_name"))).weighted()


@register("SELECT c_custkey AS c, CAST(1 AS BIGINT) AS w FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def ra_anti_join(spark, sf_dir):
    """Customers none of whose orders is finished."""
    c, o = ZSet.of(read(spark, sf_dir, "customer", "c_custkey as c")), ZSet.of(read(spark, sf_dir, "orders", "o_custkey", "o_orderstatus"))
    return plan(spark, AntiJoin(Source("c"), Select(Source("o"), Binary("==", Ref("o_orderstatus"), Const("F"))), ((Ref("c"), Ref("o_custkey")),)), c=c, o=o).weighted()


@register("SELECT s_suppkey AS s, c_custkey AS c, CAST(1 AS BIGINT) AS w FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal < c_acctbal")
def ra_theta_join(spark, sf_dir):
    join = ThetaJoin(Source("s"), Source("c"), Binary("<", Ref("s_acctbal"), Ref("c_acctbal")), attrs(s=Ref("s_suppkey"), c=Ref("c_custkey")), ((Ref("s_nationkey"), Ref("c_nationkey")),))
    return plan(spark, join, s=ZSet.of(read(spark, sf_dir, "supplier")), c=ZSet.of(read(spark, sf_dir, "customer"))).weighted()


_PARTS = ("lineitem", "l_partkey as k"), ("part", "p_partkey as k")


@register("SELECT k, CAST(count(*) AS BIGINT) AS w FROM (SELECT l_partkey AS k FROM lineitem UNION ALL SELECT p_partkey FROM part) GROUP BY k")
def ra_union(spark, sf_dir):
    a, b = (ZSet.of(read(spark, sf_dir, *x)) for x in _PARTS)
    return plan(spark, Union((Source("a"), Source("b"))), a=a, b=b).weighted()


@register("SELECT k, CAST(sum(w) AS BIGINT) AS w FROM (SELECT p_partkey AS k, 1 AS w FROM part UNION ALL SELECT l_partkey, -1 FROM lineitem) GROUP BY k HAVING sum(w) <> 0")
def ra_difference(spark, sf_dir):
    a, b = (ZSet.of(read(spark, sf_dir, *x)) for x in _PARTS)
    return plan(spark, Difference(Source("b"), Source("a")), a=a, b=b).weighted()


@register("SELECT DISTINCT l_partkey AS k, l_returnflag AS f, CAST(1 AS BIGINT) AS w FROM lineitem")
def ra_distinct(spark, sf_dir):
    return plan(spark, Distinct(Source("a")), a=ZSet.of(read(spark, sf_dir, "lineitem", "l_partkey as k", "l_returnflag as f"))).weighted()


@register("SELECT DISTINCT l_suppkey AS k, CAST(1 AS BIGINT) AS w FROM lineitem WHERE l_suppkey IN (SELECT o_custkey FROM orders)")
def ra_intersect(spark, sf_dir):
    a, b = ZSet.of(read(spark, sf_dir, "lineitem", "l_suppkey as k")), ZSet.of(read(spark, sf_dir, "orders", "o_custkey as k"))
    return a.intersect(b).weighted()


@register(
    """WITH RECURSIVE e AS (SELECT c_custkey // 2 AS f, c_custkey AS t, c_custkey % 5 AS weight FROM customer WHERE c_custkey > 1),
    r(f, t, cost, hops) AS (SELECT f, t, weight, CAST(1 AS BIGINT) FROM e UNION ALL SELECT r.f, e.t, r.cost + e.weight, r.hops + 1 FROM r JOIN e ON r.t = e.f)
    SELECT f, t, cost, hops, CAST(1 AS BIGINT) AS w FROM r"""
)
def ra_fixpoint_paths(spark, sf_dir):
    """All paths of the table with their costs and hops."""
    e = ZSet.of(read(spark, sf_dir, "customer", "c_custkey div 2 as f", "c_custkey as t", "c_custkey % 5 as weight").filter("t > 1"))
    start = Project(Source("e"), attrs(f=Ref("f"), t=Ref("t"), cost=Ref("weight"), hops=Const(1)))
    step = EquiJoin(Alias(Ref("path"), "a"), Alias(Source("e"), "b"), ((Ref("t"), Ref("f")),), attrs(f=Ref("a.f"), t=Ref("b.t"), cost=Binary("+", Ref("a.cost"), Ref("b.weight")), hops=Binary("+", Ref("a.hops"), Const(1))))
    return plan(spark, Iterate("path", start, step), e=e).weighted()


@register("SELECT n_nationkey AS k, CASE WHEN n_regionkey = 2 OR n_nationkey < 5 THEN 'x' ELSE 'x' END AS tag, CAST(1 AS BIGINT) AS w FROM nation WHERE n_regionkey <> 1 AND (n_regionkey = 2 OR n_nationkey < 5)")
def ra_scopes(spark, sf_dir):
    """Assignment, tuples and nested scopes: the inner block changes the outer name."""
    program = Block((
        Let("pair", Tup((Const(1), Const("x")))),
        Let("limit", Const(0)),
        Block((Assign("limit", Const(5)), Let("pair", Const(None)))),
        Project(
            Select(Source("n"), Binary("and", Binary("!=", Ref("n_regionkey"), At(Ref("pair"), Binary("-", Const(1), Const(1)))), Binary("or", Binary("==", Ref("n_regionkey"), Const(2)), Binary("<", Ref("n_nationkey"), Ref("limit"))))),
            attrs(k=Ref("n_nationkey"), tag=At(Ref("pair"), Const(1))),
        ),
    ))
    return plan(spark, program, n=ZSet.of(read(spark, sf_dir, "nation"))).weighted()


@register("SELECT c_nationkey AS nation, c_custkey AS k, CAST(1 AS BIGINT) AS w FROM customer")
def ra_pick(spark, sf_dir):
    """Columns picked, renamed and put in another order: the schema changes, no row does."""
    return plan(spark, Pick(Source("c"), (("nation", "c_nationkey"), ("k", "c_custkey"))), c=ZSet.of(read(spark, sf_dir, "customer"))).weighted()


@register("SELECT n_nationkey AS k, n_name AS name, CAST(1 AS BIGINT) AS weight FROM nation")
def ra_table_text(spark, sf_dir):
    """A relation as a table of text, read back from the text."""
    text = ZSet.of(read(spark, sf_dir, "nation", "n_nationkey", "n_name")).table(1000)
    cells = [[c.strip() for c in line.strip("|").split("|")] for line in text.splitlines() if line.startswith("|")]
    return spark.createDataFrame([(int(k), name, int(w)) for w, k, name in cells[1:]], "k int, name string, weight long")


# incremental evaluation


def _events(spark: SparkSession, sf_dir: str, which: str) -> ZSet:
    return ZSet.of(read(spark, sf_dir, "events", "event_id", "user_id", "event_type").filter(which))


@register(
    """WITH o AS (SELECT * FROM events WHERE event_id % 2 = 0), n AS (SELECT * FROM events),
    a AS (SELECT x.user_id AS u, count(*) AS c FROM o x JOIN o y ON x.user_id = y.user_id WHERE x.event_type = 'purchase' AND y.event_type = 'click' GROUP BY 1),
    b AS (SELECT x.user_id AS u, count(*) AS c FROM n x JOIN n y ON x.user_id = y.user_id WHERE x.event_type = 'purchase' AND y.event_type = 'click' GROUP BY 1)
    SELECT b.u AS u, CAST(b.c - coalesce(a.c, 0) AS BIGINT) AS w FROM b LEFT JOIN a ON a.u = b.u WHERE b.c <> coalesce(a.c, 0)"""
)
def inc_join_delta(spark, sf_dir):
    """A self-join's delta when a second batch of events comes."""
    side = lambda kind: Project(Select(Source("e"), Binary("==", Ref("event_type"), Const(kind))), attrs(u=Ref("user_id")))
    c = Circuit(spark, EquiJoin(Alias(side("purchase"), "a"), Alias(side("click"), "b"), ((Ref("u"), Ref("u")),), attrs(u=Ref("a.u"))), {"e": "event_id long, user_id long, event_type string"})
    c.step({"e": _events(spark, sf_dir, "event_id % 2 = 0")})
    return c.step({"e": _events(spark, sf_dir, "event_id % 2 = 1")}).weighted()


@register(
    """WITH u AS (SELECT user_id AS u, event_type AS t, max(CASE WHEN event_id % 3 > 0 THEN 1 ELSE 0 END) AS before, max(CASE WHEN event_id % 3 > 1 THEN 1 ELSE 0 END) AS after FROM events GROUP BY 1, 2)
    SELECT u, t, CAST(after - before AS BIGINT) AS w FROM u WHERE after <> before"""
)
def inc_distinct_retract(spark, sf_dir):
    """Distinct users and what they did, when a third of the events is taken back."""
    c = Circuit(spark, Distinct(Project(Source("e"), attrs(u=Ref("user_id"), t=Ref("event_type")))), {"e": "event_id long, user_id long, event_type string"})
    c.step({"e": _events(spark, sf_dir, "event_id % 3 > 0")})
    return c.step({"e": _events(spark, sf_dir, "event_id % 3 = 1").negated()}).weighted()


@register(
    """WITH b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0), a AS (SELECT DISTINCT o_custkey AS k FROM orders)
    SELECT c_custkey AS c, CAST(-1 AS BIGINT) AS w FROM customer WHERE c_custkey IN (SELECT k FROM a) AND c_custkey NOT IN (SELECT k FROM b)"""
)
def inc_anti_join(spark, sf_dir):
    """Customers without orders, when the other half of the orders comes."""
    c = Circuit(spark, AntiJoin(Source("c"), Source("o"), ((Ref("c"), Ref("k")),)), {"c": "c long", "o": "k long"})
    orders = lambda rest: ZSet.of(read(spark, sf_dir, "orders", "o_custkey as k", "o_orderkey").filter(f"o_orderkey % 2 = {rest}").select("k"))
    c.step({"c": ZSet.of(read(spark, sf_dir, "customer", "c_custkey as c")), "o": orders(0)})
    return c.step({"o": orders(1)}).weighted()


_CLOSURE_STEP = EquiJoin(Alias(Ref("p"), "a"), Alias(Source("e"), "b"), ((Ref("y"), Ref("x")),), attrs(x=Ref("a.x"), y=Ref("b.y")))


@register(
    """WITH RECURSIVE e AS (SELECT c_custkey // 2 AS x, c_custkey AS y FROM customer WHERE c_custkey > 1),
    r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
    s(x, y) AS (SELECT x, y FROM e WHERE NOT (x = 2 AND y = 5) UNION SELECT s.x, e.y FROM s JOIN e ON s.y = e.x AND NOT (e.x = 2 AND e.y = 5))
    SELECT x, y, CAST(-1 AS BIGINT) AS w FROM (SELECT x, y FROM r EXCEPT SELECT x, y FROM s)"""
)
def inc_retract_closure(spark, sf_dir):
    """A transitive closure's delta when one edge of the whole table is taken away."""
    c = Circuit(spark, Iterate("p", Source("e"), _CLOSURE_STEP), {"e": "x long, y long"})
    c.step({"e": ZSet.of(read(spark, sf_dir, "customer", "c_custkey div 2 as x", "c_custkey as y").filter("y > 1"))})
    return c.step({"e": ZSet.rows(spark, "x long, y long", [(2, 5)], [-1])}).weighted()


def visible_program() -> object:
    """Turns that are ready (all that lead to them have come) and that no other ready one follows."""
    key = ((Ref("conv"), Ref("conv")), (Ref("turn"), Ref("turn")))
    ids = lambda r, turn: Distinct(Project(Source(r), attrs(conv=Ref("conv"), turn=Ref(turn))))
    root = AntiJoin(ids("said", "turn"), ids("after", "turn"), key)
    step = EquiJoin(Alias(Ref("ready"), "a"), Alias(Source("after"), "b"), ((Ref("conv"), Ref("conv")), (Ref("turn"), Ref("prev"))), attrs(conv=Ref("b.conv"), turn=Ref("b.turn")))
    ready = Iterate("ready", root, step)
    followed = Distinct(EquiJoin(Alias(Source("after"), "p"), Alias(ready, "r"), key, attrs(conv=Ref("p.conv"), turn=Ref("p.prev"))))
    return AntiJoin(ready, followed, key)


@register(
    """WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), s AS (SELECT unnest([1, 2]) AS step),
    a AS (SELECT step, conv_id, turn, bool_and(step = 2 OR turn % 3 <> 1) OVER (PARTITION BY step, conv_id ORDER BY turn) AS ready FROM t, s),
    v AS (SELECT step, conv_id, max(turn) AS turn FROM a WHERE ready GROUP BY 1, 2)
    SELECT step, conv_id AS conv, turn, CAST(1 AS BIGINT) AS w FROM v WHERE step = 1
    UNION ALL SELECT CAST(2 AS INTEGER), conv_id, turn, CAST(-1 AS BIGINT) FROM v WHERE step = 1 AND (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM v WHERE step = 2)
    UNION ALL SELECT step, conv_id, turn, CAST(1 AS BIGINT) FROM v WHERE step = 2 AND (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM v WHERE step = 1)"""
)
def inc_out_of_order(spark, sf_dir):
    """The last visible turn of every conversation, when every third turn comes late: what follows waits for it."""
    turns = read(spark, sf_dir, "conversations", "conv_id as conv", "turn").distinct()
    after = turns.withColumn("prev", F.lag("turn").over(Window.partitionBy("conv").orderBy("turn")))
    c = Circuit(spark, visible_program(), {"said": "conv long, turn long", "after": "conv long, prev long, turn long"})
    out = None
    for n, late in enumerate(("turn % 3 <> 1", "turn % 3 = 1"), 1):
        come = after.filter(late)
        d = c.step({"said": ZSet.of(come.select("conv", "turn")), "after": ZSet.of(come.filter("prev is not null").select("conv", "prev", "turn"))}).weighted().select(F.lit(n).alias("step"), "conv", "turn", "w")
        out = d if out is None else out.unionAll(d)
    return out


@register(
    """SELECT 'users' AS output, user_id AS k, CAST(1 AS BIGINT) AS w FROM events WHERE event_id % 2 = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 0) GROUP BY user_id
    UNION ALL SELECT 'purchases', event_id, CAST(1 AS BIGINT) FROM events WHERE event_id % 2 = 1 AND event_type = 'purchase'"""
)
def inc_multi_output(spark, sf_dir):
    """Two outputs of one circuit when the second half of the events comes: new users, and purchases."""
    users = Distinct(Project(Source("e"), attrs(k=Ref("user_id"))))
    purchases = Project(Select(Source("e"), Binary("==", Ref("event_type"), Const("purchase"))), attrs(k=Ref("event_id")))
    c = Circuit(spark, (users, purchases), {"e": "event_id long, user_id long, event_type string"})
    c.step({"e": _events(spark, sf_dir, "event_id % 2 = 0")})
    a, b = c.step({"e": _events(spark, sf_dir, "event_id % 2 = 1")})
    return a.weighted().select(F.lit("users").alias("output"), "k", "w").unionAll(b.weighted().select(F.lit("purchases").alias("output"), "k", "w"))


@register(
    """SELECT n AS transaction, CASE WHEN n = 2 THEN 'rejected' WHEN n = 4 THEN 'aborted' ELSE 'committed' END AS state,
    CASE WHEN n = 1 THEN (SELECT count(*) FROM customer WHERE c_acctbal >= 0) WHEN n = 3 THEN (SELECT count(*) FROM customer WHERE c_acctbal < 0) ELSE 0 END AS added,
    CASE WHEN n IN (2, 3) AND EXISTS (SELECT 1 FROM customer WHERE c_acctbal < 0) THEN 'in debt' ELSE '' END || CASE WHEN n = 2 THEN ',twice' ELSE '' END AS violated
    FROM (SELECT CAST(range AS INTEGER) AS n FROM range(1, 5))"""
)
def inc_transactions(spark, sf_dir):
    """Transactions over all customers: one that passes, one that a hard check rejects, one with soft violations, one
    that is left without a commit."""
    customer = ZSet.of(read(spark, sf_dir, "customer", "c_custkey as k", "c_acctbal < 0 as debt"))
    c = Circuit(spark, Source("c"), {"c": "k long, debt boolean"})
    one, two = Alias(Source("c"), "a"), Alias(Source("c"), "b")
    pairs = EquiJoin(Alias(Project(one, attrs(k=Ref("k"))), "x"), Alias(Project(two, attrs(j=Ref("k"))), "y"), ((Ref("k"), Ref("j")),), attrs(k=Ref("k")))
    twice = Difference(pairs, Project(Source("c"), attrs(k=Ref("k"))))  # a row that is there n times makes n * n pairs
    checks = {"twice": (twice, True), "in debt": (Select(Source("c"), Ref("debt")), False)}
    out = []
    for n, rows in enumerate((customer.select(Unary("not", Ref("debt"))), customer, customer.select(Ref("debt")), customer), 1):
        with StepTransaction(c, checks) as t:
            t.insert("c", rows)
            delta, bad = t.commit() if n < 4 else (None, {})
        out.append((n, t.state, delta.df.count() if delta else 0, ",".join(sorted(bad))))
    return spark.createDataFrame(out, "transaction int, state string, added long, violated string")


@register(
    """WITH b AS (SELECT CAST(event_id % 3 AS INTEGER) AS step, event_type AS t, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT DISTINCT step FROM b), k AS (SELECT DISTINCT t FROM b),
    g AS (SELECT s.step, k.t, coalesce(n, 0) AS n FROM s CROSS JOIN k LEFT JOIN b ON b.step = s.step AND b.t = k.t)
    SELECT step, t, CAST(sum(n) OVER w AS BIGINT) AS total, CAST(coalesce(lag(n) OVER w, 0) AS BIGINT) AS before, CAST(n - coalesce(lag(n) OVER w, 0) AS BIGINT) AS change FROM g
    WINDOW w AS (PARTITION BY t ORDER BY step)"""
)
def inc_dataflow(spark, sf_dir):
    """A stream of three batches: its running total, itself one step late, and what changes from step to step."""
    stream = dataflow.generator(lambda n: _events(spark, sf_dir, f"event_id % 3 = {n}").project({"t": Ref("event_type")}))
    total, late, change = dataflow.Integrate(spark), dataflow.Delay(spark), dataflow.Differentiate(spark)
    out = None
    types = read(spark, sf_dir, "events", "event_type as t").distinct()
    for n, batch in zip(range(3), stream, strict=False):
        parts = {"total": total(batch), "before": late(batch), "change": change(batch)}
        row = types.select(F.lit(n).alias("step"), "t")
        for name, z in parts.items():
            row = row.join(z.weighted(name).withColumnRenamed("t", f"t_{name}"), F.col("t") == F.col(f"t_{name}"), "left").drop(f"t_{name}")
        row = row.select("step", "t", *(F.coalesce(F.col(x), F.lit(0)).alias(x) for x in parts))
        out = row if out is None else out.unionAll(row)
    return out


# integrity


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    r = lambda t, *c: read(spark, sf_dir, t, *c)
    return {
        "customer": r("customer", "c_custkey", "c_nationkey"), "orders": r("orders", "o_orderkey", "o_custkey"),
        "lineitem": r("lineitem", "l_orderkey", "l_partkey", "l_suppkey"), "supplier": r("supplier", "s_suppkey"),
        "part": r("part", "p_partkey", "p_brand", "p_size"),
    }


X, Y, Z = ir.Var("x"), ir.Var("y"), ir.Var("z")


@register("SELECT DISTINCT o_orderkey AS x, o_custkey AS y FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def rule_fk_violations(spark, sf_dir):
    """Orders whose customer's number is no supplier's: a foreign key that most rows break."""
    law = Law("orders.supplier", (RuleAtom("orders", ((0, X), (1, Y))),), (RuleAtom("supplier", ((0, Y),)),))
    return violations(law, _tables(spark, sf_dir))


@register("SELECT DISTINCT l_orderkey AS x FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def rule_fk_holds(spark, sf_dir):
    law = Law("lineitem.order", (RuleAtom("lineitem", ((0, X),)),), (RuleAtom("orders", ((0, X),)),))
    return violations(law, _tables(spark, sf_dir))


@register("SELECT DISTINCT c_custkey AS x FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def rule_totality(spark, sf_dir):
    law = Law("orders.total", (RuleAtom("customer", ((0, X),)),), (RuleAtom("orders", ((1, X),)),), "monitored")
    return violations(law, _tables(spark, sf_dir))


@register("SELECT DISTINCT a.p_size AS x, a.p_brand AS y, b.p_brand AS z FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_brand <> b.p_brand")
def rule_equality(spark, sf_dir):
    """Size determines brand: the pairs that say otherwise."""
    law = Law("part.size.brand", (RuleAtom("part", ((2, X), (1, Y))), RuleAtom("part", ((2, X), (1, Z)))), (Equal(Y, Z),))
    return violations(law, _tables(spark, sf_dir))


@register("SELECT DISTINCT c_custkey AS x FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = c_custkey AND l_suppkey = 1)")
def rule_joined_consequent(spark, sf_dir):
    """Every customer has an order with a line from supplier 1: consequents that share a variable of their own."""
    law = Law("customer.supplier", (RuleAtom("customer", ((0, X),)),), (RuleAtom("orders", ((0, Y), (1, X))), RuleAtom("lineitem", ((0, Y), (2, ir.Lit(1))))))
    return violations(law, _tables(spark, sf_dir))


@register("SELECT DISTINCT l_orderkey AS x, l_partkey AS y, l_partkey AS z FROM lineitem WHERE l_partkey = l_suppkey AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)")
def rule_antecedent_equality(spark, sf_dir):
    """Lines whose part and supplier have one number belong to customer 7: an equality among the antecedents, over two
    variables, and one of a variable and a constant among the consequents."""
    w = ir.Var("w")
    law = Law("line.equal", (RuleAtom("lineitem", ((0, X), (1, Y), (2, Z))), Equal(Y, Z)), (RuleAtom("orders", ((0, X), (1, w))), Equal(w, ir.Lit(7))))
    return violations(law, _tables(spark, sf_dir))


@register("SELECT p_partkey AS x FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_suppkey % 2 = 1)")
def rule_row_id_membership(spark, sf_dir):
    """References by row id: every part is one that a line of an odd supplier points to."""
    part = read(spark, sf_dir, "part", "named_struct('commit', 'p', 'n', p_partkey) as _rid", "p_partkey")
    line = read(spark, sf_dir, "lineitem", "named_struct('commit', 'l', 'n', l_orderkey * 100 + l_linenumber) as _rid", "named_struct('commit', 'p', 'n', l_partkey) as part", "l_suppkey % 2 as odd")
    r = ir.Var("r")
    law = Law("part.sold", (RuleAtom("Part", ((0, X),), r),), (RuleAtom("Line", ((0, r), (1, ir.Lit(1)))),))
    return violations(law, {"Part": part, "Line": line}).select("x")


@register("SELECT l_orderkey, l_suppkey, CAST(count(*) AS BIGINT) AS \"rows\" FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def pk_duplicates(spark, sf_dir):
    return key_violations(read(spark, sf_dir, "lineitem"), ("l_orderkey", "l_suppkey"))


@register('SELECT CAST(count(*) AS BIGINT) AS "rows" FROM region HAVING count(*) > 1')
def pk_singleton(spark, sf_dir):
    return key_violations(read(spark, sf_dir, "region"), ())


@register("WITH m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text, lang) AS least FROM documents) SELECT DISTINCT coalesce(m.least, l.doc_id) AS doc_id, quality, toxic FROM labels l LEFT JOIN m ON m.doc_id = l.doc_id")
def hashcons_docs(spark, sf_dir):
    """Documents with equal text and language are one; labels follow."""
    tables = {"documents": Referenced(read(spark, sf_dir, "documents", "doc_id", "text", "lang"), "doc_id"), "labels": Referenced(read(spark, sf_dir, "labels"), "", {"doc_id": "documents"}, False)}
    return canonical(tables)["labels"]


@register(
    """WITH RECURSIVE e AS (SELECT DISTINCT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
    r(conv_id, a, d) AS (SELECT conv_id, prev, turn FROM e WHERE prev IS NOT NULL UNION SELECT r.conv_id, r.a, e.turn FROM r JOIN e ON e.conv_id = r.conv_id AND e.prev = r.d)
    SELECT conv_id AS c, a, d FROM r"""
)
def commit_ancestors(spark, sf_dir):
    """Ancestors in a graph of many small histories: a conversation's turns."""
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn").distinct()
    parent = turns.withColumn("prev", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("prev is not null").select("conv_id", "prev", "turn")
    return derived(spark, ir.Catalog(parent=parent), "anc(c, a, d) :- parent(c, a, d).\nanc(c, a, d) :- anc(c, a, m), parent(c, m, d).", "anc")


@register("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7")
def seek_orders(spark, sf_dir):
    return seek(read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus"), o_orderstatus="F", o_custkey=7).select("o_orderkey", "o_custkey")
