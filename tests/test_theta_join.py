"""A theta join's result is added up only where its rows can repeat."""

from quern.functions.scalar import Binary, Ref
from quern.operators.zset import ZSet


def test_theta_join_adds_up_only_rows_that_can_repeat(spark):
    def joined(left):
        a = ZSet.of(spark.createDataFrame(left, "a long, n long, v long"))
        b = ZSet.of(spark.createDataFrame([(k, 1, k) for k in range(5)], "b long, m long, w long"))
        return a.theta_join(b, Binary("<", Ref("v"), Ref("w")), {"a": Ref("a"), "b": Ref("b")}, ((Ref("n"), Ref("m")),)).weighted()

    once = joined([(1, 1, 2), (2, 1, 3)])
    assert sorted(map(tuple, once.collect())) == [(1, 3, 1), (1, 4, 1), (2, 4, 1)]
    assert "Aggregate" not in once._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, joined([(1, 1, 2), (1, 1, 3)]).collect())) == [(1, 3, 1), (1, 4, 2)]
