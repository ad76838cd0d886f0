"""Registered queries of sources and of the store: whole tables go in by every way there is and come out again."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.cli import Prompt
from quern.operators.integrity import RID
from quern.operators.store import Rejected, Store, StoreError
from quern.plans import conjunctive, fixpoint, ir
from quern.plans.reference import brute_force
from quern.plans.theory import ColumnDef, Entity, Theory, from_json
from quern.registry import read, register
from quern.sources import generators, tables
from quern.sources.scratch import scratch_path, written

INT, STR = "builtinInt", "builtinString"


def _ints(*names: str) -> tuple[ColumnDef, ...]:
    return tuple(ColumnDef(n, INT) for n in names)


# sources


@register("SELECT o_orderkey AS k, CAST(9223372036854775807::HUGEINT + o_custkey AS VARCHAR) AS big FROM orders")
def src_arrow_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders saved as an Arrow file on the driver and loaded again; one column holds numbers from 2**63 on."""
    rows = read(spark, sf_dir, "orders", "o_orderkey as k", "cast(9223372036854775807 + cast(o_custkey as decimal(20,0)) as decimal(20,0)) as big")
    with tempfile.TemporaryDirectory() as at:
        tables.save_arrow(rows, f"{at}/orders.arrow")
        _, kept = written(tables.load_arrow(spark, f"{at}/orders.arrow"), "arrow")
    return kept.select("k", F.col("big").cast("string").alias("big"))


@register("SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def src_flat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = [int(x) for r in read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").collect() for x in r]
    return tables.from_flat(spark, ["nation", "region"], flat)


@register("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey >= 20 AND l_partkey < 40")
def src_sorted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines sorted by part, then order, and a range of parts sought in what was written so."""
    _, kept = written(tables.sorted_index(read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey"), ["l_partkey", "l_orderkey"]), "sorted")
    return tables.range_seek(kept, "l_partkey", 20, 40)


@register("SELECT a.range AS x, b.range AS y FROM range(0, 40) a JOIN range(0, 40) b ON a.range < b.range")
def src_chain_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated chain, closed."""
    facts = ir.Catalog(parent=generators.chain(spark, 40))
    return fixpoint.evaluate(spark, ir.program("anc(x, y) :- parent(x, y).\nanc(x, z) :- anc(x, y), parent(y, z)."), facts, double=True).relations["anc"]


_GENERATED = "SELECT CAST(range AS INTEGER) AS seed, true AS agree, true AS enough FROM range(7, 9)"


@register(_GENERATED)
def src_generated_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated triangles and nested terms: the join plans find what a plain join finds, and no fewer than planted."""
    out = []
    for seed in (7, 8):
        t, n = generators.triangles(spark, 300, 600, 80, seed), generators.nested_terms(spark, 300, 600, 80, seed)
        f, g, h = (t[k].toDF(f"{k}0", f"{k}1") for k in ("R_f", "R_g", "R_h"))
        plain = f.join(g, F.col("R_f1") == F.col("R_g0")).join(h, (F.col("R_g1") == F.col("R_h0")) & (F.col("R_h1") == F.col("R_f0"))).count()
        got = conjunctive.evaluate(ir.query("q(x, y, z) :- R_f(x, y), R_g(y, z), R_h(z, x)"), ir.Catalog(t)).count()
        terms = conjunctive.evaluate(ir.query("q(f, a, g) :- R_f(f, a, g), R_g(g, a)"), ir.Catalog(n)).count()
        nested = n["R_f"].join(n["R_g"].toDF("g", "a"), (F.col("c2") == F.col("g")) & (F.col("c1") == F.col("a"))).distinct().count()
        out.append((seed, got == plain and terms == nested, got >= 70 and terms >= 70))
    return spark.createDataFrame(out, "seed int, agree boolean, enough boolean")


@register("SELECT DISTINCT r_name AS r, n_name AS n, s_suppkey AS s FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def cq_brute_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exhaustive evaluation that the join plans are tested against, on the smallest tables."""
    facts = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "supplier": ("s_suppkey", "s_nationkey")}
    rows = {t: [tuple(r) for r in read(spark, sf_dir, t, *c).collect()] for t, c in facts.items()}
    found = brute_force(ir.query("q(r, n, s) :- region(k, r), nation(m, n, k), supplier(s, m)"), rows)
    return spark.createDataFrame(sorted(found), "r string, n string, s long")


# the store

_CUSTOMERS = Theory((Entity("Customer", (*_ints("key", "nation"), ColumnDef("name", STR)), ("key",)),))
_CUSTOMER_SQL = "SELECT c_custkey AS key, CAST(c_nationkey AS BIGINT) AS nation, c_name AS name FROM customer"


def _customers(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return read(spark, sf_dir, "customer", "c_custkey as key", "cast(c_nationkey as bigint) as nation", "c_name as name").filter(where)


def _loaded(spark: SparkSession, sf_dir: str, *parts: str) -> Store:
    """A store with a commit for each part of the customers."""
    store = Store(spark, _CUSTOMERS)
    for where in parts or ("true",):
        with store.transaction() as t:
            t.add_frame("Customer", _customers(spark, sf_dir, where))
    return store


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if c != RID))


@register(_CUSTOMER_SQL)
def store_commit_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers in two commits, then a scan."""
    return _plain(_loaded(spark, sf_dir, "key % 2 = 0", "key % 2 = 1").scan("Customer"))


@register("SELECT CAST(r_regionkey AS BIGINT) AS key, r_name AS name, r_regionkey >= 0 AS same FROM region")
def store_rows_by_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions added one by one, each twice: equal rows are one, and the handles of both find it, by id as well."""
    store = Store(spark, Theory((Entity("Region", (*_ints("key"), ColumnDef("name", STR))),)), frozenset({"Region"}))
    regions = [(int(r[0]), r[1]) for r in read(spark, sf_dir, "region", "r_regionkey", "r_name").collect()]
    with store.transaction() as t:
        handles = [(t.add("Region", *r), t.add("Region", *r)) for r in regions]
    out = []
    for one, two in handles:
        a, b = store.row_of(one, t), store.row_of(two, t)
        out.append((a.key, a.name, a == b == store.row("Region", t.id_of(two)) and t.id_of(one) == t.id_of(two)))
    return spark.createDataFrame(out, "key long, name string, same boolean")


@register(f"SELECT *, true AS found, false AS lost FROM ({_CUSTOMER_SQL}) WHERE key IN (1, 7)")
def store_index_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by key and by other columns, and whether there are any."""
    store = _loaded(spark, sf_dir)
    first = store.index_seek("Customer", (1,))
    second = store.seek("Customer", key=7, name=store.index_seek("Customer", (7,)).first().name)
    found = tables.lookup(store.scan("Customer"), key=7), tables.lookup(store.scan("Customer"), key=-7)
    return _plain(first.unionByName(second)).select("*", F.lit(found[0]).alias("found"), F.lit(found[1]).alias("lost"))


@register(_CUSTOMER_SQL)
def store_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as delimited text with a quoted header, read back in chunks of 100 rows, a commit each."""
    path = scratch_path(spark, "copy-text")
    rows = _customers(spark, sf_dir).selectExpr("name as `name, first`", "key", "nation")
    rows.coalesce(1).write.option("header", True).option("quoteAll", True).csv(path)
    theory = Theory((Entity("C", (*_ints("key", "nation"), ColumnDef("name, first", STR)), ("key",)),))
    store = Store(spark, theory)
    store.copy_into("C", path, chunk_rows=max(100, rows.count() // 5))
    return store.scan("C").selectExpr("key", "nation", "`name, first` as name")


@register(_CUSTOMER_SQL)
def store_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved as a log and replayed."""
    store, path = _loaded(spark, sf_dir, "key % 3 = 0", "key % 3 > 0"), scratch_path(spark, "saved")
    store.save(path)
    again = Store.load(spark, _CUSTOMERS, path)
    if again.heads() != store.heads():
        raise StoreError("the heads differ")
    return _plain(again.scan("Customer"))


@register(_CUSTOMER_SQL)
def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores that know different halves merge, both ways, one of them a second time."""
    one, two = _loaded(spark, sf_dir, "key % 2 = 0"), _loaded(spark, sf_dir, "key % 2 = 1")
    one.merge(two), two.merge(one)
    if one.merge(two) or sorted(one.commits) != sorted(two.commits) or len(one.heads()) != 2:
        raise StoreError("the merged stores differ")
    return _plain(two.scan("Customer"))


@register(_CUSTOMER_SQL)
def store_sync_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another store catches up by the bytes of the commits that it lacks, in the wrong order."""
    store, other = _loaded(spark, sf_dir, "key % 2 = 0", "key % 2 = 1"), Store(spark, _CUSTOMERS)
    other.apply_chunks(reversed(store.chunks_after(other.heads())))
    if other.heads() != store.heads() or store.chunks_after(other.heads()):
        raise StoreError("the heads differ")
    return _plain(other.scan("Customer"))


@register("SELECT DISTINCT true AS refused, (SELECT count(*) FROM customer) AS left_over, CAST(1 AS BIGINT) AS commits FROM customer")
def store_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit that repeats a key leaves the store as it was; so does one that is rolled back."""
    store = _loaded(spark, sf_dir)
    refused = False
    try:
        with store.transaction() as t:
            t.add_frame("Customer", _customers(spark, sf_dir).withColumn("name", F.lit("x")))
    except Rejected:
        refused = True
    t = store.transaction()
    t.add("Customer", -1, 1, "gone")
    t.rollback()
    return store.scan("Customer").agg(F.lit(refused).alias("refused"), F.count("*").alias("left_over")).withColumn("commits", F.lit(len(store.commits)).cast("long"))


@register("SELECT DISTINCT true AS same, true AS other FROM customer")
def store_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit's hash, and so its rows' ids, follow from what it holds, not from how its rows are spread."""
    hashes, ids = [], []
    for parts, where in ((1, "true"), (7, "true"), (3, "key <> 1")):
        store = Store(spark, _CUSTOMERS)
        with store.transaction() as t:
            t.add_frame("Customer", _customers(spark, sf_dir, where).repartition(parts))
        hashes.append(t.hash)
        ids.append(store.scan("Customer").agg(F.sum(F.xxhash64(RID, "key").cast("decimal(38,0)"))).first()[0])
    return spark.createDataFrame([(hashes[0] == hashes[1] and ids[0] == ids[1], hashes[0] != hashes[2])], "same boolean, other boolean")


_GRAPH = """WITH c AS (SELECT 0 AS n, 4 AS "all", 1 AS heads, 3 AS "after first") SELECT CAST("all" AS INTEGER) AS commits, CAST(heads AS INTEGER) AS heads, CAST("after first" AS INTEGER) AS lacking, true AS ordered FROM c"""


@register(_GRAPH)
def store_commit_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two heads that a further commit joins; what one who has the first commit lacks; parents come first."""
    one = _loaded(spark, sf_dir, "key % 3 = 0")
    (first,) = one.heads()
    two = Store(spark, _CUSTOMERS)
    two.merge(one)
    for s, rest in ((one, 1), (two, 2)):
        with s.transaction() as t:
            t.add_frame("Customer", _customers(spark, sf_dir, f"key % 3 = {rest}"))
    one.merge(two)
    with one.transaction() as t:
        t.add("Customer", -1, 1, "last")
    order = [c.hash for c in one.ordered()]
    ordered = all(order.index(p) < order.index(c.hash) for c in one.commits.values() for p in c.parents)
    return spark.createDataFrame([(len(one.commits), len(one.heads()), len(one.commits_after([first])), ordered)], "commits int, heads int, lacking int, ordered boolean")


# theories and functions


def _path(name: str) -> list:
    return [[p] for p in name.split(".")]


def _nations(chased: bool = False) -> str:
    """A theory in its JSON form: regions, nations and the function from nations to regions, with its laws."""
    def atom(entity: str, values: dict[int, int], row: int | None = None) -> dict:
        return {"tag": "atom", "atom": {"entity": _path(entity), "rowId": None if row is None else {"tag": "var", "index": row}, "values": [{"column": k, "term": {"tag": "var", "index": v}} for k, v in values.items()]}}

    def entity(name: str, columns: list[tuple[str, dict]], key: list[str] | None) -> dict:
        return {"path": _path(name), "value": {"entityVariant": {"tag": "table"}, "columns": [{"path": _path(c), "type": t} for c, t in columns], "primaryKey": None if key is None else [_path(k) for k in key]}}

    def rule(name: str, variant: str, names: list[str], given: list, then: list) -> dict:
        return {"path": _path(name), "value": {"ruleVariant": variant, "varNames": [_path(n) for n in names], "varTypes": [], "antecedents": given, "consequents": then}}

    text, number = {"tag": STR}, {"tag": INT}
    ref = lambda t: {"tag": "rowId", "path": _path(t)}
    return json.dumps({
        "entities": [
            entity("W.Region", [("name", text)], None), entity("W.Nation", [("key", number), ("name", text)], ["key"]),
            entity("W.region", [("nation", ref("W.Nation")), ("region", ref("W.Region"))], ["nation"]),
        ],
        "rules": [
            rule("W.region.foreignKey", "enforced", ["n", "r"], [atom("W.region", {0: 0, 1: 1})], [atom("W.Nation", {}, 0), atom("W.Region", {}, 1)]),
            rule("W.region.total", "monitored", ["n"], [atom("W.Nation", {}, 0)], [atom("W.region", {0: 0})]),
        ],
    })


def _world(spark: SparkSession, sf_dir: str, leave_out: int | None = None) -> Store:
    store = Store(spark, from_json(_nations()), strict=False)
    regions = {int(r[0]): r[1] for r in read(spark, sf_dir, "region", "r_regionkey", "r_name").collect()}
    with store.transaction() as t:
        at = {k: t.add("W.Region", name) for k, name in regions.items()}
        for k, name, region in read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey").collect():
            n = t.add("W.Nation", int(k), name)
            if k != leave_out:
                t.add("W.region", n, at[int(region)])
    return store


@register("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def theory_function_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of a theory is a table with its arguments as key: applied to all nations by a join, its values followed
    by row id."""
    store = _world(spark, sf_dir)
    nations = store.scan("W.Nation").selectExpr(f"{RID} as nation_id", "name as nation")
    applied = store.applied(nations, "W.region", ["nation_id"], "region_id")
    return applied.join(store.scan("W.Region").selectExpr(f"{RID} as r", "name as region"), F.col("region_id") == F.col("r")).select("nation", "region")


@register("SELECT n_name AS nation, CASE WHEN n_nationkey = 4 THEN 'no value' ELSE r_name END AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def theory_function_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value of a function at a time; where a row is missing that is an error."""
    store = _world(spark, sf_dir, leave_out=4)
    names = {tuple(r[RID]): r.name for r in store.scan("W.Region").collect()}
    out = []
    for r in store.scan("W.Nation").collect():
        try:
            out.append((r.name, names[tuple(store.cell("W.region", r[RID]))]))
        except StoreError:
            out.append((r.name, "no value"))
    return spark.createDataFrame(out, "nation string, region string")


@register("SELECT n_nationkey = 4 AS total, n_name AS nation FROM nation WHERE n_nationkey = 4")
def theory_monitored_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws that come with a function: foreign keys must hold, that it is total is reported."""
    store = _world(spark, sf_dir, leave_out=4)
    lost = store.soft_violations()["W.region.total"].toDF("id")
    return store.scan("W.Nation").join(lost, F.col(RID) == F.col("id")).select(F.lit(True).alias("total"), F.col("name").alias("nation"))


@register(
    """SELECT * FROM (VALUES ('table', 'W.Region(name builtinString)'), ('table', 'W.Nation(key builtinInt, name builtinString) key (''key'',)'),
    ('table', 'W.region(nation W.Nation, region W.Region) key (''nation'',)'), ('law', 'W.region.foreignKey: W.region[0: n#0, 1: r#1] => n#0 @ W.Nation[] and r#1 @ W.Region[]'),
    ('law', 'W.region.total: W.Nation[] => W.region[0: n#0]'.replace('W.Nation[]', 'n#0 @ W.Nation[]'))) t(kind, line)""".replace("'W.region.total: W.Nation[] => W.region[0: n#0]'.replace('W.Nation[]', 'n#0 @ W.Nation[]')", "'W.region.total: n#0 @ W.Nation[] => W.region[0: n#0]'")
)
def theory_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A theory's tables and laws as the prompt lists them."""
    prompt = _prompt(spark)
    return spark.createDataFrame([("table", x) for x in prompt.run(".schema").splitlines()] + [("law", x) for x in prompt.run(".rules").splitlines()], "kind string, line string")


def _prompt(spark: SparkSession) -> Prompt:
    prompt = Prompt(spark)
    with tempfile.TemporaryDirectory() as at:
        with open(os.path.join(at, "theory.json"), "w") as f:
            f.write(_nations())
        prompt.run(f".load {at}/theory.json")
    return prompt


@register("SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM nation")
def store_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nations and regions typed at the prompt as one transaction."""
    prompt = _prompt(spark)
    regions = read(spark, sf_dir, "region", "r_regionkey", "r_name").collect()
    nations = read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey").collect()
    lines = ["begin transact;", *(f"add W.Region values '{n}' as r{k};" for k, n in regions)]
    for k, n, r in nations:
        lines += [f"add W.Nation values {k}, '{n}' as n{k};", f"add W.region values n{k}, r{r};"]
    if errors := [x for x in prompt.session([*lines, "commit;"]) if x.startswith("error")]:
        raise StoreError(errors[0])
    return prompt.store.scan("W.Nation").select("key", "name")


def between(table: str, low: int, high: int) -> Callable[[SparkSession, str], DataFrame]:
    """A view with parameters: the keys of a table's rows in a range, with the number of the nation."""
    front = table[0]
    return lambda spark, sf_dir: read(spark, sf_dir, table, f"{front}_{'custkey' if front == 'c' else 'suppkey'} as key", f"{front}_nationkey as nation").filter(F.col("nation").between(low, high))


@register(
    "SELECT c.c_custkey AS customer, s.s_suppkey AS supplier FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey WHERE c.c_nationkey BETWEEN 3 AND 9"
)
def view_with_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conjunctive query over two views that one parametrised definition gives."""
    views = ir.Catalog(customer=between("customer", 3, 9)(spark, sf_dir), supplier=between("supplier", 0, 9)(spark, sf_dir))
    return conjunctive.evaluate(ir.query("q(c, s) :- customer(c, n), supplier(s, n)"), views, ["customer", "supplier"])



