"""Registered queries of the engine read whole tables: every id of the recursive ones, against brute force."""

from quern import queries as Q

#: Large enough that a prefix of ids would show: 1,500 customers.
DATA = "/root/testdata/sf0.01"


def paths(spark):
    """{(ancestor, node): (cost, hops)} of the tree of all customers, node div 2 above node."""
    keys = {r[0] for r in spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey").collect()}
    out = {}
    for node in keys - {1}:
        at, cost, hops = node, 0, 0
        while at in keys and at > 1:
            cost, hops = cost + at % 5, hops + 1
            at //= 2
            out[at, node] = cost, hops
    return out


def test_closures_cover_the_whole_table(spark):
    want = paths(spark)
    assert sorted((r.x, r.y) for r in Q.dl_ancestor_doubling(spark, DATA).collect()) == sorted(want)
    assert sorted((r.f, r.t, r.cost, r.hops, r.w) for r in Q.ra_fixpoint_paths(spark, DATA).collect()) == sorted((*k, *v, 1) for k, v in want.items())


def test_retraction_reaches_the_whole_table(spark):
    def below_five(n):
        while n > 5:
            n //= 2
        return n == 5

    want = sorted((x, y, -1) for x, y in paths(spark) if x in (1, 2) and below_five(y))
    assert any(y > 100 for _, y, _ in want)
    assert sorted((r.x, r.y, r.w) for r in Q.inc_retract_closure(spark, DATA).collect()) == want
