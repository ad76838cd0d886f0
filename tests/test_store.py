"""Theories, integrity, identity, commits, and sources."""

import json

import pyarrow as pa
import pytest

from quern.operators import identity, integrity
from quern.operators.store import Rejected, RowId, Store, StoreError
from quern.plans.ir import Lit, ProgramError, Var
from quern.plans.theory import ColumnDef, Entity, Equal, Law, RuleAtom, Theory, foreign_key, from_json
from quern.sources import generators, tables

INT, STR = "builtinInt", "builtinString"
A, B, C, X = Var("a"), Var("b"), Var("c"), Var("x")


def ints(spark, rows, n=2):
    return spark.createDataFrame([((f"r{k}", k), *r) for k, r in enumerate(rows)], ", ".join(["_rid struct<commit:string,n:long>", *(f"c{k} long" for k in range(n))]))


def found(law, tabs):
    return {tuple(r) for r in integrity.violations(law, tabs).collect()}


def test_laws(spark):
    tabs = {"Left": ints(spark, [(1,)], 1), "Right": ints(spark, [(5,)], 1), "Link": ints(spark, [(1, 5), (1, 6), (2, 5)]), "T": ints(spark, [(5, 5), (1, 2)]), "G": ints(spark, [], 0)}
    link = RuleAtom("Link", ((0, A), (1, B)))
    assert found(Law("l", (link,), (RuleAtom("Left", ((0, A),)), RuleAtom("Right", ((0, B),)))), tabs) == {(1, 6), (2, 5)}
    assert found(Law("t", (RuleAtom("T", ((0, A), (1, B))),), (Equal(A, B),)), tabs) == {(1, 2)}
    assert integrity.violations(Law("g", (), (RuleAtom("G"),)), tabs).count() == 1
    assert integrity.violations(Law("g", (), (RuleAtom("T"),)), tabs).count() == 0
    assert found(Law("eq", (link, Equal(A, Lit(2))), (RuleAtom("Right", ((0, A),)),)), tabs) == {(2, 5)}
    both = Law("own", (RuleAtom("Left", ((0, A),)),), (RuleAtom("Link", ((0, A), (1, C))), RuleAtom("T", ((0, C), (1, C)))))
    assert found(both, tabs) == set()
    assert found(Law("own", both.antecedents, (RuleAtom("Link", ((0, A), (1, C))), RuleAtom("T", ((0, C), (1, Lit(9)))))), tabs) == {(1,)}


def test_row_ids_are_values(spark):
    v = spark.createDataFrame([(("c", 0),)], "_rid struct<commit:string,n:long>")
    e = spark.createDataFrame([(("c", 1), ("c", 0)), (("c", 2), ("c", 7))], "_rid struct<commit:string,n:long>, a struct<commit:string,n:long>")
    law = Law("fk", (RuleAtom("E", ((0, X),)),), (RuleAtom("V", (), X),))
    assert found(law, {"V": v, "E": e}) == {(("c", 7),)}
    assert integrity.bindings(Law("both", (RuleAtom("V", (), X), RuleAtom("E", ((0, X),))), ()), {"V": v, "E": e}).count() == 1


def test_keys(spark):
    t = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (1, 1)], "a long, b long")
    assert {tuple(r) for r in integrity.key_violations(t, ("a", "b")).collect()} == {(1, 1, 2)}
    assert integrity.key_violations(t, ()).first().rows == 4
    assert integrity.key_violations(t, None).count() == 0


def test_theory_from_json():
    path = lambda *p: [[x] for x in p]
    raw = {
        "entities": [
            {"path": path("R", "V"), "value": {"entityVariant": {"tag": "table"}, "columns": [], "primaryKey": None}},
            {"path": path("R", "E"), "value": {"entityVariant": {"tag": "table"}, "columns": [{"path": path("a"), "type": {"tag": "rowId", "path": path("R", "V")}}], "primaryKey": [path("a")]}},
        ],
        "rules": [{"path": path("R", "E", "fk"), "value": {"ruleVariant": "enforced", "varNames": [path("a")], "varTypes": [], "antecedents": [{"tag": "atom", "atom": {"entity": path("R", "E"), "rowId": None, "values": [{"column": 0, "term": {"tag": "var", "index": 0}}]}}], "consequents": [{"tag": "atom", "atom": {"entity": path("R", "V"), "rowId": {"tag": "var", "index": 0}, "values": []}}]}}],
    }
    t = from_json(json.dumps(raw))
    assert [e.name for e in t.entities] == ["R.V", "R.E"] and t.entity("R.E").key == ("a",) and t.entity("R.E").columns[0].target == "R.V"
    assert t.laws[0].name == "R.E.fk" and "R.V" in str(t.laws[0])
    with pytest.raises(ProgramError):
        Theory(t.entities, (Law("bad", (Equal(A, B),), ()),)).check()


def function_theory():
    x, y = Entity("X", ()), Entity("Y", ())
    f = Entity("next", (ColumnDef("a", "rowId", "X"), ColumnDef("b", "rowId", "Y")), ("a",))
    total = Law("next.total", (RuleAtom("X", (), A),), (RuleAtom("next", ((0, A),)),), "monitored")
    return Theory((x, y, f), (foreign_key("next.fk.a", f, 0, "X"), foreign_key("next.fk.b", f, 1, "Y"), total))


def test_commits_are_atomic(spark):
    store = Store(spark, function_theory())
    with pytest.raises(Rejected) as e, store.transaction() as t:
        t.add("X")
    assert e.value.law == "next.total" and not store.commits and store.scan("X").count() == 0
    with store.transaction() as t:
        x, y = t.add("X"), t.add("Y")
        t.add("next", x, y)
    assert store.heads() == [t.hash] and store.row("X", t.id_of(x)) and store.row("X", RowId("no", 0)) is None
    with pytest.raises(Rejected) as e, store.transaction() as t2:
        t2.add("next", t.id_of(x), t.id_of(x))
    assert e.value.law in ("next.fk.b", "next.key") and store.scan("next").count() == 1
    with pytest.raises(StoreError), store.transaction() as t3:
        t3.add("next", 1)
    assert t3.state == "rolled back" and store.scan("gone") is None
    loose = Store(spark, function_theory(), strict=False)
    with loose.transaction() as t:
        t.add("X")
    assert loose.soft_violations()["next.total"].count() == 1


def plain_theory():
    return Theory((Entity("P", (ColumnDef("name", STR), ColumnDef("age", INT)), ("name",)),))


def test_merge_save_and_replay(spark, tmp_path):
    one, two = Store(spark, plain_theory()), Store(spark, plain_theory())
    with one.transaction() as t:
        t.add("P", "ann", 30)
    with two.transaction() as u:
        u.add("P", "bob", 41)
        u.add_frame("P", spark.createDataFrame([("cy", 5), ("di", 6)], "name string, age long"))
    assert one.merge(two) == [u.hash] and one.merge(two) == [] and two.merge(one) == [t.hash]
    rows = lambda s: sorted((r.name, r.age) for r in s.scan("P").collect())
    assert rows(one) == rows(two) and len(rows(one)) == 4 and one.heads() == sorted([t.hash, u.hash])
    with one.transaction() as v:
        v.add("P", "eve", 1)
    assert one.heads() == [v.hash] and [c.hash for c in one.commits_after([t.hash, u.hash])] == [v.hash]
    with pytest.raises(StoreError):
        Store(spark, plain_theory()).apply([one.commits[v.hash]])
    one.save(str(tmp_path / "s"))
    back = Store.load(spark, plain_theory(), str(tmp_path / "s"))
    assert rows(back) == rows(one) and back.heads() == one.heads()
    clash = Store(spark, plain_theory())
    with clash.transaction() as w:
        w.add("P", "ann", 31)
    with pytest.raises(Rejected):
        one.merge(clash)
    assert len(rows(one)) == 5


def test_commits_do_not_depend_on_partitions(spark):
    rows = spark.range(100).selectExpr("concat('n', id) as name", "id % 7 as age")
    stores = [Store(spark, plain_theory()) for _ in range(3)]
    for s, df in zip(stores, (rows.repartition(5), rows.coalesce(1), rows.filter("age < 6")), strict=True):
        with s.transaction() as t:
            t.add_frame("P", df)
    assert stores[0].heads() == stores[1].heads() != stores[2].heads()
    ids = [sorted((r._rid.n, r.name) for r in s.scan("P").collect()) for s in stores[:2]]
    assert ids[0] == ids[1] and [n for n, _ in ids[0]] == list(range(ids[0][0][0], ids[0][0][0] + 100))


def test_a_failed_commit_changes_nothing(spark, monkeypatch):
    theory = Theory((Entity("Term", (ColumnDef("v", INT),)),))
    store = Store(spark, theory, frozenset({"Term"}))
    with store.transaction() as t:
        t.add("Term", 1)
    before = dict(store.moves), dict(store.tables), dict(store.commits)
    from quern.operators import store as module

    monkeypatch.setattr(module, "written", lambda df, label, real=module.written: (_ for _ in ()).throw(OSError("disk")) if label == "table" else real(df, label))
    with pytest.raises(OSError), store.transaction() as t:
        t.add("Term", 1)
    assert (store.moves, store.tables, store.commits) == before


def test_chunks_carry_commits(spark):
    one, two = Store(spark, plain_theory()), Store(spark, plain_theory())
    for n in range(3):
        with one.transaction() as t:
            t.add("P", f"n{n}", n)
    chunks = one.chunks_after(two.heads())
    bad = json.loads(chunks[1])
    bad["rows"] = json.loads(chunks[2])["rows"]
    with pytest.raises(StoreError):
        two.apply_chunks([chunks[0], json.dumps(bad).encode()])
    assert not two.commits
    assert len(two.apply_chunks(chunks[::-1])) == 3 and two.heads() == one.heads() and two.apply_chunks(chunks) == []
    with one.transaction() as t:
        t.add("P", "late", 9)
    assert len(two.apply_chunks(one.chunks_after(two.heads()))) == 1


def test_functions_are_looked_up(spark):
    store = Store(spark, function_theory())
    with store.transaction() as t:
        xs, y = [t.add("X") for _ in range(2)], t.add("Y")
        for x in xs:
            t.add("next", x, y)
    assert tuple(store.cell("next", t.id_of(xs[0]))) == t.id_of(y).value()
    with pytest.raises(StoreError):
        store.cell("next", RowId("no", 1))
    with pytest.raises(StoreError):
        store.cell("next")
    applied = store.applied(store.scan("X").withColumnRenamed("_rid", "x"), "next", ["x"], "y")
    assert {tuple(r.y) for r in applied.collect()} == {t.id_of(y).value()}


def test_equalities_between_bindings_and_matches(spark):
    """A consequent whose equality ties its own variable to one of the antecedents."""
    tabs = {"A": ints(spark, [(1, 1), (2, 3), (4, 4)]), "B": ints(spark, [(1, 1), (2, 9), (4, None)])}
    law = Law("tie", (RuleAtom("A", ((0, A), (1, B))),), (RuleAtom("B", ((0, A), (1, C))), Equal(C, B)))
    assert found(law, tabs) == {(2, 3), (4, 4)}


def test_identity(spark):
    theory = Theory((Entity("Term", (ColumnDef("v", INT),)), Entity("Plus", (ColumnDef("a", "rowId", "Term"), ColumnDef("b", "rowId", "Term"))), Entity("F", (ColumnDef("x", "rowId", "Term"), ColumnDef("y", "rowId", "Term")), ("x",))))
    store = Store(spark, theory, frozenset({"Term", "Plus"}))
    with store.transaction() as t:
        a, b, c = t.add("Term", 1), t.add("Term", 1), t.add("Term", 2)
        p, q = t.add("Plus", a, b), t.add("Plus", b, a)
    assert {n: df.count() for n, df in store.tables.items()} == {"Term": 2, "Plus": 1, "F": 0}
    assert store.row("Term", t.id_of(b))._rid == store.row("Term", t.id_of(a))._rid and store.row("Plus", t.id_of(q))._rid.n == p.n
    with pytest.raises(Rejected), store.transaction() as t2:
        d = t2.add("Term", 2)
        t2.add("F", t.id_of(c), t.id_of(a))
        t2.add("F", d, d)
    assert store.scan("F").count() == 0
    docs = identity.Referenced(spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "id long, t string"), "id")
    marks = identity.Referenced(spark.createDataFrame([(2,), (4,), (9,), (None,)], "of long"), "", {"of": "docs"}, False)
    got = identity.canonical({"docs": docs, "marks": marks})
    assert {r[0] for r in got["marks"].collect()} == {1, 3, 9, None} and got["docs"].count() == 2


def test_copy(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    store = Store(spark, plain_theory())
    store.copy_into("P", put("a.csv", "age,name\n30,alice\n41,bob\n"))
    store.copy_into("P", put("b.tsv", "name\tage\ncid\t7\n"), delimiter="\t")
    assert sorted((r.name, r.age) for r in store.scan("P").collect()) == [("alice", 30), ("bob", 41), ("cid", 7)]
    for name, text in (("bad.csv", "age,name\nold,x\n"), ("dup.csv", "age,name,name\n1,a,b\n"), ("less.csv", "age\n1\n"), ("none.csv", "")):
        with pytest.raises(Exception):  # noqa: B017
            store.copy_into("P", put(name, text))
    assert store.scan("P").count() == 3 and store.index_seek("P", ("bob",)).first().age == 41
    odd = Store(spark, Theory((Entity("Q", (ColumnDef("name, first", STR), ColumnDef("age", INT))),)))
    odd.copy_into("Q", put("q.csv", 'age,"name, first"\n1,"x, y"\n'))
    assert [(r[1], r.age) for r in odd.scan("Q").collect()] == [("x, y", 1)]
    # chunks are commits of their own: those before one that fails stay
    parts = Store(spark, plain_theory())
    lines = [f"{k},n{k}" for k in range(10)]
    parts.copy_into("P", put("c.csv", "\n".join(["age,name", *lines])), chunk_rows=4)
    assert len(parts.commits) == 3 and parts.scan("P").count() == 10
    half = Store(spark, plain_theory())
    with pytest.raises(StoreError):
        half.copy_into("P", put("d.csv", "\n".join(["age,name", *lines[:5], "old,x", *lines[5:]])), chunk_rows=4)
    assert sorted(r.age for r in half.scan("P").collect()) == [0, 1, 2, 3] and len(half.commits) == 1
    with pytest.raises(tables.SourceError):
        store.index_seek("P", ("bob", 1))
    assert tables.lookup(store.scan("P"), age=7) and not tables.lookup(store.scan("P"), age=8)
    with pytest.raises(tables.SourceError):
        store.seek("P", gone=1)


def test_arrow_and_generators(spark, tmp_path):
    df = tables.from_flat(spark, ["a", "b"], [1, 2, 3, 4])
    tables.save_arrow(df, str(tmp_path / "x.arrow"))
    assert sorted(map(tuple, tables.load_arrow(spark, str(tmp_path / "x.arrow")).collect())) == [(1, 2), (3, 4)]
    for bad in (pa.table({"a": pa.array([1, None], pa.uint64())}), pa.table({"a": [1]})):
        with pytest.raises(tables.SourceError):
            tables.from_record_batch(spark, bad)
    whole = pa.table({"a": pa.array([0, 2**63, 2**64 - 1], pa.uint64()), "b": pa.array([1, 2, 3], pa.uint64())})
    loaded = tables.from_record_batch(spark, whole)
    assert [(int(r.a), r.b) for r in loaded.collect()] == [(0, 1), (2**63, 2), (2**64 - 1, 3)]
    tables.save_arrow(loaded, str(tmp_path / "y.arrow"))
    with pa.ipc.open_file(str(tmp_path / "y.arrow")) as back:
        assert back.read_all().equals(whole)
    with pytest.raises(tables.SourceError):
        tables.from_flat(spark, ["a", "b"], [1])
    assert [r.a for r in tables.range_seek(df, "a", 2).collect()] == [3]
    assert tables.sorted_index(df, ["b", "a"]).count() == 2
    t = generators.triangles(spark, 50, 100, 20, 7)
    assert t == {} or t["R_f"].count() > 60 and t["R_f"].columns == ["src", "dst"]
    assert generators.chain(spark, 6).count() == 5 and generators.dag(spark, 20, 40, 1).filter("parent >= child").count() == 0
    assert set(generators.nested_terms(spark, 50, 100, 10, 8)) == {"R_f", "R_g"}
