import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import mixing as M
from quern.llm.queries import MIX, op1_temperature_mixing


def entropy(w):
    return -sum(p * math.log(p) for p in w if p > 0)


def plain_weights(n, a):
    raised = {s: x**a for s, x in n.items() if x}
    return {s: r / sum(raised.values()) for s, r in raised.items()}


def plain_exponent(n, target, limit, budget):
    """By small steps of bisection, from the definition."""
    n = {s: x for s, x in n.items() if x}
    if len(n) < 2:
        return 1.0
    goal = target * math.log(len(n)) - 1e-12

    def enough(a):
        return entropy(plain_weights(n, a).values()) >= goal

    def seen(a):
        w = plain_weights(n, a)
        whole = budget or max(x / w[s] for s, x in n.items())
        return max(whole * w[s] / x for s, x in n.items())

    low, high = 0.0, 1.0
    if enough(1.0):
        low = 1.0
    for _ in range(80 if low < 1 else 0):
        mid = (low + high) / 2
        low, high = (mid, high) if enough(mid) else (low, mid)
    if limit is None or seen(low) <= limit:
        return low
    a, b = low, 1.0
    for _ in range(80):
        mid = (a + b) / 2
        a, b = (a, mid) if seen(mid) <= limit else (mid, b)
    return b


@pytest.mark.parametrize("local", [True, False])
@pytest.mark.parametrize(("target", "limit", "budget"), [(0.5, None, None), (0.95, None, 1000), (0.99, 3.0, None), (0.9999, 1.5, None), (1.0, None, None), (0.9, 2.0, 700)])
def test_exponent_meets_entropy_and_limit(spark, target, limit, budget, local):
    n = {"a": 900, "b": 90, "c": 10, None: 0}
    totals = spark.createDataFrame(list(n.items()), "s string, n long")
    corpus = M.of_totals(list(n.values())) if local else M.of_table(totals)
    assert M.exponent_for(corpus, target, limit, budget) == pytest.approx(plain_exponent(n, target, limit, budget), abs=1e-9)


def test_plans(spark, monkeypatch):
    totals = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10), (None, 0)], "s string, n long")
    plans = []
    for local in (10_000, 2):  # the second: totals stay a table
        monkeypatch.setattr(M, "LOCAL_SOURCES", local)
        plans.append(sorted((tuple(r) for r in M.planned(totals, 0.9, None, 5000).collect()), key=str))
    for one, two in zip(*plans, strict=True):
        assert one[:2] == two[:2] and one[3:] == two[3:] and one[2] == pytest.approx(two[2])
    assert sum(r[3] for r in plans[0]) == 5000
    for r in M.planned(totals, 0.99, 3.0).collect():
        assert r.n == 0 and r.epochs == 1 or r.n <= r.budget <= 3.0 * r.n + 1 and r.epochs * r.n + r.rest == r.budget
    assert M.planned(totals.limit(0)).collect() == []


def plain_rows(spark, rows, target, limit, budget):
    """(times of each row by position): rows (id, source, tokens). Places in permutations are Spark's hash values."""
    n = Counter()
    for _, s, t in rows:
        n[s] += t
    a = plain_exponent(n, target, limit, budget)
    w = plain_weights(n, a)
    whole = budget or math.ceil(max((x / w[s] for s, x in n.items() if x), default=0) - 1e-6)
    given = {s: math.floor(whole * w.get(s, 0) + 1e-6) for s in n}
    if budget:
        given[max(n, key=lambda s: n[s])] += budget - sum(given.values())
    else:
        given = {s: max(g, n[s]) for s, g in given.items()}
    plan = {s: (divmod(given[s], n[s]) if n[s] else (1, 0)) for s in n}
    keyed = spark.createDataFrame([(k, i, s, plan[s][0]) for k, (i, s, _) in enumerate(rows)], "k int, i long, s string, e int")
    block = F.pmod(F.xxhash64(F.lit(1), "i"), F.lit(1024)).cast("int")
    hashed = keyed.select("k", block.alias("b"), F.xxhash64(F.lit(1), "e", "s", block).alias("bk"), F.xxhash64(F.lit(1), "e", "s", "i").alias("rk"))
    at = {r.k: (r.b, r.bk, r.rk) for r in hashed.collect()}
    out = Counter()
    for s, (epochs, rest) in plan.items():
        mine = [k for k, r in enumerate(rows) if r[1] == s]
        for k in mine:
            out[k] += epochs
        blocks = defaultdict(list)
        for k in mine:
            blocks[at[k][1], at[k][0]].append(k)
        left = rest
        for key in sorted(blocks) if rest else []:
            size = sum(rows[k][2] for k in blocks[key])
            if size <= left:
                left -= size
                out.update(blocks[key])
                continue
            groups = defaultdict(list)
            for k in blocks[key]:
                groups[at[k][2]].append(k)
            for g in sorted(groups):
                size = sum(rows[k][2] for k in groups[g])
                if size > left:
                    break
                left -= size
                out.update(groups[g])
            break
    return +out, a, w


def table_rows(docs):
    return [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in docs.collect()]


@pytest.mark.parametrize("data", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, data):
    rows = table_rows(spark.read.parquet(f"/root/testdata/{data}/documents.parquet"))
    want, a, w = plain_rows(spark, rows, MIX["target_entropy"], MIX["max_epochs"], None)
    assert a < 1  # the mix is flattened
    got = op1_temperature_mixing(spark, f"/root/testdata/{data}").collect()
    assert Counter(r.doc_id for r in got) == Counter({rows[k][0]: n for k, n in want.items()})
    tokens = {i: n for i, _, n in rows}
    assert all(r.tokens == tokens[r.doc_id] and r.weight == pytest.approx(w[r.source]) for r in got)
    assert Counter((r.doc_id, r.epoch) for r in got).most_common(1)[0][1] == 1
    assert max(Counter(r.doc_id for r in got).values()) == 2  # a partial second epoch
    share = Counter()
    for r in sorted(got, key=lambda r: r.order)[: len(got) // 2]:
        share[r.source] += r.tokens
    for s in w:
        assert share[s] / sum(share.values()) == pytest.approx(w[s], abs=0.06)


@pytest.mark.parametrize(("local", "cut"), [(10_000, 100_000), (1, 100_000), (10_000, 2), (1, 2)])
def test_budgets_and_paths_for_many_sources_and_large_blocks(spark, monkeypatch, local, cut):
    monkeypatch.setattr(M, "LOCAL_SOURCES", local)
    monkeypatch.setattr(M, "CUT_ROWS", cut)
    monkeypatch.setattr(M, "BLOCKS", 1024)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text", "case when doc_id % 10 < 7 then 'big' when doc_id % 10 < 9 then 'mid' else null end as source", "1 as mix_tokens")
    rows = table_rows(docs)
    for budget in (None, sum(r[2] for r in rows) // 2):
        want, _, _ = plain_rows(spark, rows, 0.97, 4.0, budget)
        got = Counter(r.doc_id for r in M.mixed_documents(docs, target_entropy=0.97, max_epochs=4.0, budget=budget).collect())
        assert got == Counter({rows[k][0]: n for k, n in want.items()})


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, "a", 7), (2, "", "b", 7), (3, "x y", None, 7), (3, "x y", None, 7), (None, "z", "a", 7)], "doc_id long, text string, source string, mix_tokens long")
    got = M.mixed_documents(docs)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {1, 2, 3, None} and {r.mix_tokens for r in got.collect()} == {7}
    names = M.column_names(docs.columns)
    assert names["tokens"] != "mix_tokens" and {r[names["tokens"]] for r in M.mixed(docs).collect()} == {0, 1, 2}
    assert M.mixed(docs.limit(0)).count() == 0
