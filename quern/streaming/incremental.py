"""Incremental evaluation: transactions of weighted deltas in, the outputs' deltas out.

Every operator that needs the past keeps it as a trace: the deltas that have reached one of its inputs, as files that are
dealt to buckets by the operator's key. A step appends its delta and reads only the buckets that the delta's keys fall
in, so what it reads and writes follows from the change, not from all that came before. Deltas of one size are merged
now and then, so a bucket has few files and a row is written again a logarithm of times.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.zset import W, ZSet
from quern.plans import program as P
from quern.sources.scratch import scratch_path, written

#: Buckets of a trace; a delta with keys in all of them reads all of it.
BUCKETS = 16
_BUCKET = "__bucket"


class CircuitError(ValueError):
    """A program that cannot be kept up incrementally."""


@dataclass
class Trace:
    """The sum of deltas, in files by bucket of `key` (expressions over the rows; none: a single bucket). `batches` are
    (path, rows) of the deltas that are not merged yet."""

    spark: SparkSession
    key: tuple
    empty: ZSet
    batches: list[tuple[str, int]] = field(default_factory=list)

    def bucket(self, z: ZSet, key: Sequence | None = None) -> Column:
        typed = [z.compile(k) for k in (self.key if key is None else key)]
        columns = [t.column.cast("long") if t.type in ("int", "uint") else t.column for t in typed]  # one hash for all widths
        return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int") if columns else F.lit(0)

    def read(self, touched: Sequence[int] | None = None) -> ZSet:
        """All rows, or those of some buckets; equal rows may stand in several lines."""
        if not self.batches:
            return self.empty
        schema = T.StructType([*self.empty.df.schema.fields, T.StructField(_BUCKET, T.IntegerType())])
        rows = None
        for path, _ in self.batches:
            part = self.spark.read.schema(schema).parquet(path)
            part = part if touched is None else part.filter(F.col(_BUCKET).isin(list(touched)) if touched else F.lit(False))
            rows = part if rows is None else rows.unionAll(part)
        return ZSet(rows.drop(_BUCKET), self.empty.unsigned)

    def _write(self, z: ZSet) -> str:
        path = scratch_path(self.spark, "trace")
        z.df.withColumn(_BUCKET, self.bucket(z)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(path)
        return path

    def appended(self, d: ZSet) -> Trace:
        """This trace with a consolidated delta more. As long as the last two batches are of like size they are merged."""
        now = Trace(self.spark, self.key, self.empty, list(self.batches))
        if n := d.df.count():
            now.batches.append((now._write(d), n))
            while len(now.batches) > 1 and now.batches[-2][1] <= 2 * now.batches[-1][1]:
                two = Trace(self.spark, self.key, self.empty, now.batches[-2:])
                now.batches[-2:] = [(two._write(two.read().consolidated()), sum(n for _, n in two.batches))]
        return now


#: A node's place in a program, by which its traces are known.
Place = tuple


@dataclass
class Circuit:
    """A relational program over named inputs that is stepped by transactions. A program that is a tuple of relations
    has that many outputs.

    Selections, projections, unions and differences are linear, so they run over deltas alone. A join's delta is
    dL x R + L x dR + dL x dR over the traces of its sides. Distinct and anti-join compare before and after for the rows
    and keys that a delta touches. An iteration over a step that is linear in what it iterates deletes what may have
    lost its ground, derives again what has another one, and goes on from what is new; other iterations are evaluated
    anew and compared. Nothing of a step is kept unless all of it was written.
    """

    spark: SparkSession
    program: object
    schemas: Mapping[str, str]
    state_dir: str | None = None
    steps: int = 0
    batch: int | None = None  # the number of the stream's last batch that is part of the state
    traces: dict[Place, Trace] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._types = {n: ZSet(self.spark.createDataFrame([], f"{ddl}, {W} long")) for n, ddl in self.schemas.items()}
        if self.state_dir:
            self._restore()
        for n, z in self._types.items():
            self.traces.setdefault(("input", n), Trace(self.spark, (), z))

    # what operators are

    def _full(self, e: object, inputs: Mapping[str, ZSet]) -> ZSet:
        return P.Planner(self.spark, dict(inputs)).relation(e)

    def _type(self, e: object) -> ZSet:
        """An empty relation with an expression's columns and types."""
        z = self._full(_without_iterations(e), self._types)
        return ZSet(self.spark.createDataFrame([], z.df.select(*(F.col(f"`{c}`") for c in z.columns), W).schema), z.unsigned)

    def _trace(self, place: Place, e: object, key: tuple | None) -> Trace:
        """The trace of what `e` gives at a place, by `key` (None: by whole rows)."""
        if place not in self.traces:
            kind = self._type(e)
            self.traces[place] = Trace(self.spark, tuple(P.S.Ref(c) for c in kind.columns) if key is None else key, kind)
        return self.traces[place]

    def totals(self, change: Mapping[str, ZSet] | None = None) -> dict[str, ZSet]:
        """The inputs as the steps have left them, with a further change."""
        now = {n: self.traces["input", n].read() for n in self._types}
        return {n: z.union(change[n]) if change and n in change else z for n, z in now.items()}

    # a step

    def delta(self, e: object, step: _Step, place: Place) -> ZSet:
        """What the step's change adds to an expression's value; what comes to each trace is noted in `step`. An
        expression that stands in a program twice is worked out once."""
        if not isinstance(e, P.Distinct | P.AntiJoin | P.EquiJoin | P.Product | P.ThetaJoin | P.Iterate):
            return self._delta(e, step, place)
        if id(e) not in step.done:
            step.done[id(e)] = e, step.kept(self._delta(e, step, place))
        return step.done[id(e)][1]

    def _delta(self, e: object, step: _Step, place: Place) -> ZSet:
        go = lambda x, k: self.delta(x, step, (*place, k))
        match e:
            case P.Source(name) | P.S.Ref(name) if name in self._types:
                return step.change[name] if name in step.change else self._types[name]
            case P.Alias(r, alias):
                return go(r, 0).aliased(alias)
            case P.Project(r, attributes):
                return go(r, 0).project(dict(attributes))
            case P.Pick(r, columns):
                return go(r, 0).pick(dict(columns))
            case P.Select(r, condition):
                return go(r, 0).select(condition)
            case P.Union(relations):
                first, *rest = [go(r, k) for k, r in enumerate(relations)]
                return first.union(*rest)
            case P.Difference(a, b):
                return go(a, 0).difference(go(b, 1))
            case P.EquiJoin(a, b, on, attributes):
                return self._pairs(e, step, place, on, lambda x, y: x.join(y, on, P._mapping(attributes)))
            case P.Product(a, b, attributes):
                return self._pairs(e, step, place, (), lambda x, y: x.product(y, P._mapping(attributes)))
            case P.ThetaJoin(a, b, condition, attributes, on):
                return self._pairs(e, step, place, on, lambda x, y: x.theta_join(y, condition, P._mapping(attributes), on))
            case P.Distinct(r):
                d, old = self._come(r, step, (*place, 0), None)
                before = old(d, None)
                return before.union(d).distinct().difference(before.distinct())
            case P.AntiJoin(a, b, on):
                left, right = tuple(x for x, _ in on), tuple(y for _, y in on)
                da, old_a = self._come(a, step, (*place, 0), left)
                db, old_b = self._come(b, step, (*place, 1), right)
                a0, b0 = old_a(da, left, db, right), old_b(da, left, db, right)
                return a0.union(da).anti_join(b0.union(db), on).difference(a0.anti_join(b0, on))
            case P.Iterate() if _monotone(e):
                return self._iteration(e, step, place)
        return self._anew(e, step, place)

    def _come(self, e: object, step: _Step, place: Place, key: tuple | None) -> tuple[ZSet, Callable[..., ZSet]]:
        """An input's delta, written once, and a function of rows and their keys (in turn): the rows that the input's
        trace held under any of these keys."""
        d = self.delta(e, step, place)
        if not isinstance(e, P.Source) and id(e) not in step.done:
            d = step.kept(d)
        trace = self._trace(place, e, key)
        step.come[place] = trace, d
        return d, lambda *of: _held(trace, step, *of)

    def _pairs(self, e: object, step: _Step, place: Place, on: tuple, join: Callable[[ZSet, ZSet], ZSet]) -> ZSet:
        left, right = tuple(x for x, _ in on), tuple(y for _, y in on)
        da, old_a = self._come(e.left, step, (*place, 0), left)
        db, old_b = self._come(e.right, step, (*place, 1), right)
        named = lambda z, side: z.aliased(side.alias) if isinstance(side, P.Alias) else z
        a, b = named(old_a(db, right), e.left), named(old_b(da, left), e.right)
        da, db = named(da, e.left), named(db, e.right)
        return join(da, b).union(join(a, db), join(da, db))

    def _anew(self, e: object, step: _Step, place: Place) -> ZSet:
        """The delta of what can only be evaluated as a whole: its value now less its value then."""
        trace = self._trace((*place, "value"), e, None)
        if not step.touches(e) and self.steps:
            return trace.empty
        now = self._full(e, self.totals(step.change))
        d = step.kept(now.difference(trace.read()))
        step.come[(*place, "value")] = trace, d
        return d

    def _iteration(self, e: P.Iterate, step: _Step, place: Place) -> ZSet:
        """The delta of a least fixpoint whose step is linear in its name and only adds facts when an input grows.

        Facts that a deletion may have taken the ground from go first, with all that follows from them, whatever else
        supports them. Those that the rest still derives come back, with all that is new. Inputs are taken to hold no
        row a negative number of times."""
        start, old = self._come(P.Distinct(e.start), step, (*place, "start"), None)
        trace = self._trace((*place, "value"), e, None)
        if not step.touches(e):
            return trace.empty
        before, after = self.totals(), self.totals(step.change)
        kinds = [f.dataType for f in trace.empty.df.schema.fields]

        def run(inputs: Mapping[str, ZSet], facts: ZSet) -> ZSet:
            got = P.Planner(self.spark, dict(inputs), P.S.Scope({e.name: facts})).relation(e.step)
            cells = [F.col(f"`{c}`").cast(k).alias(n) for c, n, k in zip(got.columns, trace.empty.columns, kinds, strict=False)]
            return ZSet(got.df.select(*cells, W), trace.empty.unsigned).distinct()

        def signed(d: ZSet, sign: int) -> ZSet:
            return ZSet(d.df.filter(F.col(W) * sign > 0).withColumn(W, F.lit(1).cast("long")), d.unsigned)

        def caused(sign: int, facts: ZSet) -> ZSet:
            """Facts that rows of the change with this sign give at once: in the start, or in a step from `facts`."""
            inputs, found = after if sign > 0 else before, [signed(start, sign)]
            for n, d in step.change.items():
                if uses := P._uses(e.step, n):
                    found.append(run({**inputs, n: signed(d, sign)} if uses == 1 else inputs, facts))
            return found[0].union(*found[1:]).distinct() if found[1:] else found[0]

        def closure(new: ZSet, inputs: Mapping[str, ZSet], keep: Callable[[ZSet], ZSet]) -> ZSet:
            """All facts that follow from `new`, as far as `keep` lets them through. Rounds don't overlap, so what they
            found is the union of their files."""
            paths: list[str] = []
            total = trace.empty
            for _ in range(e.max_rounds):
                path, found = written(keep(_minus(new, total) if paths else new.distinct()).df.select(*trace.empty.columns, W), "facts")
                if found.isEmpty():
                    return total
                paths.append(path)
                total = ZSet(self.spark.read.schema(found.schema).parquet(*paths), trace.empty.unsigned)
                new = run(inputs, ZSet(found, trace.empty.unsigned))
            raise P.PlanError(f"{e.name} reached no fixpoint within {e.max_rounds} rounds")

        value = trace.read()
        removed = bool(trace.batches) and any(not signed(d, -1).df.isEmpty() for d in (start, *step.change.values()))
        gone = closure(caused(-1, value.distinct()), before, lambda z: z.intersect(value)) if removed else trace.empty
        new = caused(1, _minus(value, gone) if removed else value.distinct())
        if removed:
            again = old(gone, None).union(start).distinct().intersect(gone)
            new = new.union(again, run(after, _minus(value, gone)).intersect(gone))
        came = closure(new, after, lambda z: _minus(z, value).union(z.intersect(gone)) if removed else _minus(z, value))
        d = step.kept(came.difference(gone))
        step.come[(*place, "value")] = trace, d
        return d

    def _outputs(self) -> tuple:
        return self.program if isinstance(self.program, tuple) else (self.program,)

    def step(self, change: Mapping[str, ZSet]) -> ZSet | tuple[ZSet, ...]:
        """One transaction: the outputs' consolidated deltas. The state then holds the change, or, if anything fails,
        is as before."""
        out, publish = self.prepared(change)
        publish(None)
        return out

    def prepared(self, change: Mapping[str, ZSet]) -> tuple[ZSet | tuple[ZSet, ...], Callable[[int | None], None]]:
        """A transaction's output deltas, and a function that makes it part of the state, with a stream's batch number
        if it has one. Until that is called the state is as before."""
        for name in change:
            if name not in self._types:
                raise CircuitError(f"unknown input {name}")
        step = _Step({})
        step.change = {n: step.kept(ZSet(z.df, self._types[n].unsigned)) for n, z in change.items()}
        outs = [ZSet((d if id(e) in step.done else step.kept(d)).df) for k, e in enumerate(self._outputs()) for d in [self.delta(e, step, (k,))]]
        for n, d in step.change.items():
            step.come["input", n] = self.traces["input", n], d

        def publish(batch: int | None) -> None:
            with ThreadPoolExecutor(8) as pool:  # traces don't depend on each other
                grown = list(pool.map(lambda x: x[0].appended(x[1]), step.come.values()))
            now = {**self.traces, **dict(zip(step.come, grown, strict=True))}
            if self.state_dir:
                self._persist(now, self.steps + 1, batch if batch is not None else self.batch)
            self.traces, self.steps, self.batch = now, self.steps + 1, batch if batch is not None else self.batch

        return (tuple(outs) if isinstance(self.program, tuple) else outs[0]), publish

    def value(self) -> ZSet | tuple[ZSet, ...]:
        """The outputs over all that the steps have brought."""
        if isinstance(self.program, tuple):
            return tuple(self._full(e, self.totals()).consolidated() for e in self.program)
        return self._full(self.program, self.totals()).consolidated()

    # persistence

    def _persist(self, traces: Mapping[Place, Trace], steps: int, batch: int | None) -> None:
        """One small file a step, put in place by a rename: the files of all traces, the step and the batch."""
        state = {"steps": steps, "batch": batch, "traces": [[json.dumps(p), t.batches] for p, t in traces.items()]}
        path = f"{self.state_dir.rstrip('/')}/{steps:012d}"
        self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(path)

    def _restore(self) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.state_dir)
        fs = where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        fs.mkdirs(where)
        steps = sorted(s.getPath().getName() for s in fs.listStatus(where) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
        if not steps:
            return
        state = json.loads(self.spark.read.text(f"{self.state_dir.rstrip('/')}/{steps[-1]}").first()[0])
        self.steps, self.batch = state["steps"], state["batch"]
        places = {json.dumps(p): (p, e, key) for p, e, key in self._places()}
        for name, batches in state["traces"]:
            place = tuple(json.loads(name))
            if place[0] == "input":
                self.traces[place] = Trace(self.spark, (), self._types[place[1]])
            else:
                self._trace(*places[name])
            self.traces[place].batches = [tuple(b) for b in batches]

    def _places(self) -> list[tuple[Place, object, tuple | None]]:
        """All traces that the program can have, but for the inputs': place, what reaches it, key."""
        found: list[tuple[Place, object, tuple | None]] = []

        def walk(e: object, place: Place) -> None:
            match e:
                case P.EquiJoin(a, b, on) | P.ThetaJoin(a, b, _, _, on) | P.AntiJoin(a, b, on):
                    found.extend([((*place, 0), a, tuple(x for x, _ in on)), ((*place, 1), b, tuple(y for _, y in on))])
                case P.Product(a, b):
                    found.extend([((*place, 0), a, ()), ((*place, 1), b, ())])
                case P.Distinct(r):
                    found.append(((*place, 0), r, None))
                case P.Iterate(_, start) if _monotone(e):
                    found.append(((*place, "start"), P.Distinct(start), None))
                    walk(P.Distinct(start), (*place, "start"))
            found.append(((*place, "value"), e, None))
            for k, x in enumerate(_inputs(e)):
                walk(x, (*place, k))

        for k, e in enumerate(self._outputs()):
            walk(e, (k,))
        return found

    def sink(self, name: str, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """A function for `writeStream.foreachBatch`: each micro-batch of input `name` is a transaction, and `write`
        gets its output delta (a list of them, if there are several) and the batch's number. Rows without `__w` count
        once each. The state takes a batch in only after `write` has returned, so one that fails and comes again gives
        the same delta again, under the same number, and counts once; with `state_dir` that holds across restarts of
        the driver, too. A `write` that may be cut off half-way should replace what it wrote for the same number."""
        def batch(df: DataFrame, number: int) -> None:
            if self.batch is None or number > self.batch:
                out, publish = self.prepared({name: ZSet.of(df)})
                write([z.df for z in out] if isinstance(out, tuple) else out.df, number)
                publish(number)

        return batch


@dataclass
class _Step:
    """What one transaction has worked out: its inputs' changes, and what has come to each trace."""

    change: dict[str, ZSet]
    come: dict[Place, tuple[Trace, ZSet]] = field(default_factory=dict)
    done: dict[int, tuple[object, ZSet]] = field(default_factory=dict)

    def kept(self, z: ZSet) -> ZSet:
        return ZSet(written(z.consolidated().df, "delta")[1], z.unsigned, z.alias)

    def touches(self, e: object) -> bool:
        return any(P._uses(e, n) for n in self.change)


def _held(trace: Trace, step: _Step, *of: object) -> ZSet:
    """The rows that a trace holds under the keys of some rows: of its buckets, which are few for few keys. `of` is rows
    and the expressions of their keys, in turn; None: the trace's own."""
    keys, touched = None, set()
    if not trace.batches:
        return trace.empty
    for z, by in zip(of[::2], of[1::2], strict=True):
        by = trace.key if by is None else by
        if not by:
            return trace.read() if not z.df.isEmpty() else trace.empty
        touched |= {r[0] for r in z.df.select(trace.bucket(z, by).alias("b")).distinct().collect()}
        mine = _rows(z.project({f"key{k}": x for k, x in enumerate(by)}))
        keys = mine if keys is None else keys.union(mine)
    return trace.read(sorted(touched)).semi_join(_rows(keys), [(x, P.S.Ref(f"key{k}")) for k, x in enumerate(trace.key)])


def _rows(keys: ZSet) -> ZSet:
    """Keys, whatever their weights: a row that goes is touched as well."""
    return ZSet(keys.df.drop(W).distinct().withColumn(W, F.lit(1).cast("long")), keys.unsigned)


def _minus(a: ZSet, b: ZSet) -> ZSet:
    """The rows of `a`, each once, that `b` does not hold."""
    return a.distinct().anti_join(b, [(P.S.Ref(x), P.S.Ref(y)) for x, y in zip(a.columns, b.columns, strict=True)])


def _inputs(e: object) -> tuple:
    match e:
        case P.Alias(r) | P.Project(r) | P.Pick(r) | P.Select(r) | P.Distinct(r):
            return (r,)
        case P.Union(relations):
            return tuple(relations)
        case P.Difference(a, b) | P.EquiJoin(a, b) | P.Product(a, b) | P.ThetaJoin(a, b) | P.AntiJoin(a, b):
            return a, b
    return ()


def _without_iterations(e: object) -> object:
    """An expression of the same type that needs no rounds: an iteration has the type of its start."""
    if isinstance(e, P.Iterate):
        return P.Distinct(_without_iterations(e.start))
    if isinstance(e, P.RELATIONAL):
        return replace(e, **{f.name: _without_iterations(getattr(e, f.name)) for f in fields(e) if isinstance(getattr(e, f.name), (*P.RELATIONAL, tuple))})
    return tuple(map(_without_iterations, e)) if isinstance(e, tuple) else e


def _monotone(e: P.Iterate) -> bool:
    """Whether a step only joins, picks and adds: more rows of any input can then only give more facts."""
    def adds(x: object) -> bool:
        if isinstance(x, P.Source | P.S.Ref):
            return True
        return isinstance(x, P.Alias | P.Project | P.Pick | P.Select | P.EquiJoin | P.Product | P.ThetaJoin | P.Union | P.Distinct) and all(map(adds, _inputs(x)))

    return not e.bag_start and P._linear(e.step, e.name) and adds(e.step)


@dataclass
class StepTransaction:
    """Prepare, then commit, abort or be rejected. `checks` are programs whose rows are violations, hard or soft."""

    circuit: Circuit
    checks: Mapping[str, tuple[object, bool]] = field(default_factory=dict)
    state: str = "preparing"
    change: dict[str, ZSet] = field(default_factory=dict)

    def insert(self, name: str, z: ZSet) -> None:
        if self.state != "preparing":
            raise CircuitError(f"the transaction is {self.state}")
        self.change[name] = self.change[name].union(z) if name in self.change else z

    def violations(self) -> dict[str, ZSet]:
        after = self.circuit.totals(self.change)
        found = {n: self.circuit._full(p, after).distinct() for n, (p, _) in self.checks.items()}
        return {n: z for n, z in found.items() if not z.df.isEmpty()}

    def commit(self) -> tuple[ZSet | tuple[ZSet, ...] | None, dict[str, ZSet]]:
        """The output delta and the soft violations; None and all violations if a hard one rejects the transaction."""
        if self.state != "preparing":
            raise CircuitError(f"the transaction is {self.state}")
        bad = self.violations()
        if any(self.checks[n][1] for n in bad):
            self.state = "rejected"
            return None, bad
        self.state = "committed"
        return self.circuit.step(self.change), bad

    def abort(self) -> None:
        self.state = "aborted"

    def __enter__(self) -> StepTransaction:
        return self

    def __exit__(self, *_) -> None:
        if self.state == "preparing":
            self.abort()
