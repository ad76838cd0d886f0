"""Versioned tables under a theory: atomic commits that keys and laws must pass, a commit graph, merge and sync.

A table is an immutable DataFrame with a row id per row; a commit builds the next tables, checks them, and only then
puts them in place, so a rejected one leaves nothing behind. Rows come from the driver one by one (`add`) or as
DataFrames (`add_frame`, COPY); both end up as files in the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quern.operators.identity import Referenced, canonical
from quern.operators.integrity import RID, key_violations, violations
from quern.plans.theory import ROW_ID, Entity, Theory
from quern.sources.scratch import written
from quern.sources.tables import copy_chunks, copy_from, index_seek, seek


class StoreError(ValueError):
    """A request that the store cannot serve."""


class Rejected(StoreError):
    """A commit that breaks a key or a law; `law` names it, `rows` are some of its counterexamples."""

    def __init__(self, law: str, rows: list[Row]):
        super().__init__(f"{law}: {rows[:3]}")
        self.law, self.rows = law, rows


def digest(rows: DataFrame) -> list[str]:
    """What identifies a set of numbered rows, whatever their order: their number and two sums of hashes."""
    cols = [F.col(f"`{c}`") for c in rows.columns]
    return [str(x) for x in rows.agg(F.count("*").alias("n"), *(F.sum(F.xxhash64(F.lit(s), *cols).cast("decimal(38,0)")).alias(f"s{s}") for s in (1, 2))).first()]


def commit_hash(parents: Iterable[str], digests: Mapping[str, list[str]]) -> str:
    return hashlib.sha256(json.dumps([list(parents), digests], sort_keys=True).encode()).hexdigest()


def numbered(rows: DataFrame, first: int) -> DataFrame:
    """`rows` with `_n` in front: from `first` on, in the order of their values. Numbers follow from the rows alone, not
    from how they are spread; rows that are equal may change places. Counts of partitions come to the driver."""
    cols = [F.col(f"`{c}`") for c in rows.columns]
    ordered = rows.repartitionByRange(*cols).sortWithinPartitions(*cols) if cols else rows
    _, placed = written(ordered.select(F.monotonically_increasing_id().alias("_p"), *cols), "numbered")
    part = F.shiftright("_p", 33)
    at, offsets = first, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((r.part, at))
        at += r["count"]
    starts = rows.sparkSession.createDataFrame(offsets, "part long, start long")
    joined = placed.join(F.broadcast(starts), part == F.col("part"))
    return joined.select((F.col("start") + F.col("_p").bitwiseAND(F.lit((1 << 33) - 1))).alias("_n"), *cols)


@dataclass(frozen=True)
class RowId:
    commit: str
    n: int

    def value(self) -> tuple[str, int]:
        return (self.commit, self.n)


def _id_literal(rid: RowId) -> Column:
    return F.struct(F.lit(rid.commit).alias("commit"), F.lit(rid.n).cast("long").alias("n"))


@dataclass(frozen=True)
class Handle:
    """A row that a transaction adds; its id is known once the commit is."""

    table: str
    n: int


@dataclass(frozen=True)
class Commit:
    """Added rows by table, as parquet files with the op numbers that make the row ids."""

    hash: str
    parents: tuple[str, ...]
    files: Mapping[str, str]


@dataclass
class Store:
    spark: SparkSession
    theory: Theory
    hash_consed: frozenset[str] = frozenset()
    strict: bool = True
    tables: dict[str, DataFrame] = field(default_factory=dict)
    commits: dict[str, Commit] = field(default_factory=dict)
    moves: dict[str, list[DataFrame]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.theory.check()
        for e in self.theory.entities:
            if e.kind == "table":
                self.tables.setdefault(e.name, self.spark.createDataFrame([], e.ddl()))

    # reading

    def scan(self, table: str) -> DataFrame | None:
        """A table's rows; None for an unknown table."""
        return self.tables.get(table)

    def _table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise StoreError(f"unknown table {name}")
        return self.tables[name]

    def row(self, table: str, rid: RowId) -> Row | None:
        """The row with an id, or with the id that took its place when equal rows were united."""
        rows = self._table(table).filter(F.col(RID).eqNullSafe(_id_literal(rid))).limit(1).collect()
        if rows:
            return rows[0]
        for m in self.moves.get(table, ()):
            found = m.filter((F.col("id")["commit"] == rid.commit) & (F.col("id")["n"] == rid.n)).limit(1).collect()
            if found:
                return self.row(table, RowId(*found[0]["least"]))
        return None

    def row_of(self, handle: Handle, transaction: Transaction) -> Row | None:
        """The row that a handle stands for. A handle whose row has given way to an equal one is repaired: from then on
        it stands for the row that took its place."""
        rid = transaction.id_of(handle)
        found = self.row(handle.table, rid)
        if found is not None and tuple(found[RID]) != rid.value():
            transaction.repair(handle, RowId(*found[RID]))
        return found

    def cell(self, table: str, *arguments: object) -> object:
        """The value of a function table, whose last column is the result, at these arguments; an error where it has
        none."""
        data = [c for c in self._table(table).columns if c != RID]
        if len(arguments) != len(data) - 1:
            raise StoreError(f"{table} takes {len(data) - 1} arguments, not {len(arguments)}")
        values = {c: _id_literal(RowId(*a)) if isinstance(a, tuple) else _id_literal(a) if isinstance(a, RowId) else a for c, a in zip(data[:-1], arguments, strict=True)}
        got = seek(self._table(table), **values).select(F.col(f"`{data[-1]}`").alias("v")).limit(1).collect()
        if not got:
            raise StoreError(f"{table} has no value at {arguments}")
        return got[0].v

    def applied(self, rows: DataFrame, table: str, arguments: Sequence[str], name: str) -> DataFrame:
        """`rows` with a column `name`: a function table's value at the columns `arguments`. Rows for which it has none
        go, as in a join of antecedents."""
        data = [c for c in self._table(table).columns if c != RID]
        if len(arguments) != len(data) - 1:
            raise StoreError(f"{table} takes {len(data) - 1} arguments, not {len(arguments)}")
        right = self._table(table).select(*(F.col(f"`{c}`").alias(f"arg_{k}") for k, c in enumerate(data[:-1])), F.col(f"`{data[-1]}`").alias("result"))
        on = F.lit(True)
        for k, a in enumerate(arguments):
            on = on & F.col(f"`{a}`").eqNullSafe(F.col(f"arg_{k}"))
        return rows.join(right, on).select(*(F.col(f"`{c}`") for c in rows.columns), F.col("result").alias(name))

    def seek(self, table: str, **equals: object) -> DataFrame:
        return seek(self._table(table), **equals)

    def index_seek(self, table: str, key: tuple) -> DataFrame:
        e = self.theory.entity(table)
        if e.key is None:
            raise StoreError(f"{table} has no key")
        return index_seek(self._table(table), e.key, key)

    # the commit graph

    def heads(self) -> list[str]:
        """Commits that no other builds on."""
        return sorted(set(self.commits) - {p for c in self.commits.values() for p in c.parents})

    def ordered(self) -> list[Commit]:
        """All commits, parents first; of those that could come next, the least hash."""
        left, out = dict(self.commits), []
        while left:
            h = min(k for k, c in left.items() if not set(c.parents) & set(left))
            out.append(left.pop(h))
        return out

    def ancestors(self, heads: Iterable[str]) -> set[str]:
        seen, todo = set(), list(heads)
        while todo:
            if (h := todo.pop()) not in seen and h in self.commits:
                seen.add(h)
                todo += self.commits[h].parents
        return seen

    def commits_after(self, heads: Iterable[str]) -> list[Commit]:
        """What someone who has these heads lacks, parents first."""
        known = self.ancestors(heads)
        return [c for c in self.ordered() if c.hash not in known]

    # writing

    def transaction(self) -> Transaction:
        return Transaction(self)

    def copy_into(self, table: str, path: str, delimiter: str = ",", header: bool = True, chunk_rows: int | None = None) -> str:
        """COPY: a file's rows as one commit, or as one for each `chunk_rows` rows in the file's order; the last commit's
        hash, none for a file without rows. A chunk that breaks a type, a key or a law is an error; the chunks before it
        stay."""
        e = self.theory.entity(table)
        types = {c.name: c.spark() for c in e.columns}
        if chunk_rows is None:
            with self.transaction() as t:
                t.add_frame(table, copy_from(self.spark, path, types, delimiter, header))
            return t.hash
        rows, last = copy_chunks(self.spark, path, types, chunk_rows, delimiter, header), ""
        for r in rows.groupBy("chunk").agg(F.min("bad").alias("bad")).orderBy("chunk").collect():
            if r.bad is not None:
                raise StoreError(f"{path}: can't read {r.bad!r}")
            with self.transaction() as t:
                t.add_frame(table, rows.filter(F.col("chunk") == r.chunk).select(*(F.col(f"`{c}`") for c in types)))
            last = t.hash
        return last

    def _rows(self, c: Commit, table: str, hash_: str) -> DataFrame:
        """A commit's rows of a table, with ids made of its hash; ids of its own pending rows get the hash, too."""
        e = self.theory.entity(table)
        raw = self.spark.read.schema(f"_n bigint, {', '.join(x for x in e.ddl().split(', ', 1)[1:])}" if e.columns else "_n bigint").parquet(c.files[table])
        rid = F.struct(F.lit(hash_).alias("commit"), F.col("_n").alias("n")).cast(ROW_ID)
        cells = []
        for x in e.columns:
            col = F.col(f"`{x.name}`")
            if x.type == "rowId":
                col = F.when(col["commit"] == "", F.struct(F.lit(hash_).alias("commit"), col["n"].alias("n")).cast(ROW_ID)).otherwise(col)
            cells.append(col.alias(x.name))
        return raw.select(rid.alias(RID), *cells)

    def _next(self, new: list[Commit]) -> tuple[dict[str, DataFrame], dict[str, list[DataFrame]]]:
        """The tables with these commits applied, canonical and checked, and the ids that gave way, or Rejected. The
        store itself is not changed."""
        after, moves = dict(self.tables), {}
        for c in new:
            for t in c.files:
                after[t] = after[t].unionByName(self._rows(c, t, c.hash))
        if self.hash_consed:
            refs = {e.name: {c.name: c.target for c in e.columns if c.type == "rowId"} for e in self.theory.entities}
            after |= canonical({t: Referenced(df, RID, refs[t], t in self.hash_consed) for t, df in after.items()}, moves=moves)
        touched = {t for c in new for t in c.files}
        for t in touched | set(self.hash_consed):
            e: Entity = self.theory.entity(t)
            if rows := key_violations(after[t], e.key).limit(5).collect():
                raise Rejected(f"{t}.key", rows)
        for law in self.theory.laws:
            if (self.strict or law.variant != "monitored") and (rows := violations(law, after).limit(5).collect()):
                raise Rejected(law.name, rows)
        return {t: written(df, "table")[1] if t in touched or self.hash_consed else df for t, df in after.items()}, moves

    def _publish(self, c: Commit) -> None:
        """Put one commit's tables in place, all or nothing: what can fail comes first."""
        tables, moves = self._next([c])
        self.tables, self.commits = tables, {**self.commits, c.hash: c}
        self.moves = {t: [*self.moves.get(t, []), *moves.get(t, [])] for t in {*self.moves, *moves}}

    def soft_violations(self) -> dict[str, DataFrame]:
        """Counterexamples of monitored laws, for stores that let them pass."""
        return {law.name: violations(law, self.tables) for law in self.theory.laws if law.variant == "monitored"}

    def apply(self, commits: Iterable[Commit]) -> list[str]:
        """Add others' commits, in any order, each whole or not at all; known ones are passed over. A commit whose
        parents are neither here nor among them is an error, before anything is changed."""
        todo = {c.hash: c for c in commits if c.hash not in self.commits}
        if lost := {p for c in todo.values() for p in c.parents} - set(todo) - set(self.commits):
            raise StoreError(f"missing commits {sorted(lost)}")
        done = []
        while todo:
            c = todo.pop(min(h for h, c in todo.items() if not set(c.parents) & set(todo)))
            self._publish(c)
            done.append(c.hash)
        return done

    def chunks_after(self, heads: Iterable[str]) -> list[bytes]:
        """What someone who has these heads lacks, as bytes, a chunk per commit, parents first: its hash, its parents
        and its rows by table in Arrow's stream form. Commits travel whole, so a chunk has the size of its commit."""
        out = []
        for c in self.commits_after(heads):
            rows = {}
            for t, path in c.files.items():
                sink = pa.BufferOutputStream()
                table = self.spark.read.parquet(path).orderBy("_n").toArrow()
                with pa.ipc.new_stream(sink, table.schema) as w:
                    w.write_table(table)
                rows[t] = base64.b64encode(sink.getvalue().to_pybytes()).decode()
            out.append(json.dumps({"hash": c.hash, "parents": c.parents, "rows": rows}).encode())
        return out

    def apply_chunks(self, chunks: Iterable[bytes]) -> list[str]:
        """Add the commits of chunks, in any order. A chunk whose rows don't give its hash is an error; nothing of any
        chunk is then applied."""
        commits = []
        for raw in chunks:
            c = json.loads(raw)
            files, digests = {}, {}
            for t, text in c["rows"].items():
                with pa.ipc.open_stream(base64.b64decode(text)) as source:
                    files[t], df = written(self._in_types(t, self.spark.createDataFrame(source.read_all())), "chunk")
                digests[t] = digest(df)
            if commit_hash(c["parents"], digests) != c["hash"]:
                raise StoreError(f"a chunk does not hold what commit {c['hash']} says")
            commits.append(Commit(c["hash"], tuple(c["parents"]), files))
        return self.apply(commits)

    def _in_types(self, table: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.col("_n").cast("long").alias("_n"), *(F.col(f"`{c.name}`").cast(c.spark()).alias(c.name) for c in self.theory.entity(table).columns))

    def merge(self, other: Store) -> list[str]:
        return self.apply(other.commits.values())

    # persistence

    def save(self, path: str) -> None:
        """The commit log as parquet: one row per commit, and the added rows beside it."""
        log = [(k, c.hash, list(c.parents), t, f"{path}/rows/{c.hash}/{hashlib.sha256(t.encode()).hexdigest()[:16]}") for k, c in enumerate(self.ordered()) for t in c.files]
        for _, h, _, t, to in log:
            self.spark.read.parquet(self.commits[h].files[t]).write.mode("overwrite").parquet(to)
        schema = "place long, hash string, parents array<string>, table string, file string"
        self.spark.createDataFrame(log, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/log")

    @staticmethod
    def load(spark: SparkSession, theory: Theory, path: str, **options) -> Store:
        """Replay a saved log; every commit is checked again."""
        commits: dict[str, Commit] = {}
        for r in spark.read.parquet(f"{path}/log").orderBy("place").collect():
            c = commits.setdefault(r.hash, Commit(r.hash, tuple(r.parents), {}))
            c.files[r.table] = r.file
        store = Store(spark, theory, **options)
        store.apply(commits.values())
        return store


class Transaction:
    """Rows to add together. As a context manager it commits at the end, and rolls back on an exception."""

    def __init__(self, store: Store):
        self.store, self.state, self.hash = store, "open", ""
        self._rows: dict[str, list[tuple]] = {}
        self._frames: list[tuple[str, DataFrame]] = []
        self._next = 0
        self._repaired: dict[Handle, RowId] = {}

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self.rollback()
        elif self.state == "open":
            self.commit()

    def _open(self) -> None:
        if self.state != "open":
            raise StoreError(f"the transaction is {self.state}")

    def add(self, table: str, *values: object) -> Handle:
        """Add a row; a value that is a Handle or RowId refers to a row of this transaction or of an earlier commit."""
        self._open()
        e = self.store.theory.entity(table)
        if len(values) != len(e.columns):
            raise StoreError(f"{table} has {len(e.columns)} columns, not {len(values)}")
        cells = []
        for c, v in zip(e.columns, values, strict=True):
            if isinstance(v, Handle | RowId):
                if c.type != "rowId":
                    raise StoreError(f"{table}.{c.name} holds no row ids")
                v = ("", v.n) if isinstance(v, Handle) else v.value()
            elif {"builtinInt": int, "builtinString": str}.get(c.type, tuple) is not type(v):
                raise StoreError(f"{table}.{c.name} is {c.type}, not {v!r}")
            cells.append(v)
        self._rows.setdefault(table, []).append((self._next, *cells))
        self._next += 1
        return Handle(table, self._next - 1)

    def add_frame(self, table: str, rows: DataFrame) -> None:
        """Add many rows: columns by name, in the theory's types."""
        self._open()
        self.store.theory.entity(table)
        self._frames.append((table, rows))

    def rollback(self) -> None:
        self.state = "rolled back" if self.state == "open" else self.state

    def commit(self) -> str:
        """Hash, check and publish; on any failure the store is as before and the transaction rejected."""
        self._open()
        store = self.store
        self.state = "rejected"
        parts: dict[str, list[DataFrame]] = {}
        for t, rows in self._rows.items():
            parts.setdefault(t, []).append(store.spark.createDataFrame(rows, ", ".join(["_n bigint", *(f"`{c.name}` {c.spark()}" for c in store.theory.entity(t).columns)])))
        for k, (t, rows) in enumerate(self._frames, 1):
            e = store.theory.entity(t)
            cells = [F.col(f"`{c.name}`").cast(c.spark()).alias(c.name) for c in e.columns]
            # numbers of a frame's rows start where no other frame or added row can reach
            parts.setdefault(t, []).append(numbered(rows.select(*cells), k << 54))
        files, digests = {}, {}
        for t, dfs in sorted(parts.items()):
            df = dfs[0]
            for d in dfs[1:]:
                df = df.unionByName(d)
            files[t], df = written(df, "commit")
            digests[t] = digest(df)
        parents = tuple(store.heads())
        self.hash = commit_hash(parents, digests)
        if self.hash not in store.commits:
            c = Commit(self.hash, parents, files)
            store._publish(c)
        self.state = "committed"
        return self.hash

    def id_of(self, handle: Handle) -> RowId:
        if self.state != "committed":
            raise StoreError("ids are known after the commit")
        return self._repaired.get(handle, RowId(self.hash, handle.n))

    def repair(self, handle: Handle, rid: RowId) -> None:
        self._repaired[handle] = rid
