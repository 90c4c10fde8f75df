"""A plan over a DataFrame of runs: one row a run, one lazy plan.

Wires are columns.  A failing row halts alone: flags say which steps failed, the first of them
counts, and no later step does anything for it.  Flags stand side by side and wires that are merged
have a column after each contribution, so a plan's expressions don't nest from step to step: its
size and its time are linear in the steps.  Bodies of columns stay inside the JVM; Python bodies, services and
model calls are Arrow batches and get told which rows are alive.  What talks to the outside is marked
nondeterministic and passes through ``barrier``, by default a checkpoint in the shared folder, so that
neither later reads of the result nor a lost executor call it again; a retried task does, unless calls are logged.

Elapsed times are whole milliseconds of bodies, services and models.  A body of columns has no time
of its own, as Catalyst computes it with all others: it counts as zero.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from loomwork.functions import rules as value_rules
from loomwork.functions.canonical import canonical_object, correlation_id, remaining_ms
from loomwork.functions.rendering import object_schema, payload_text
from loomwork.functions.types import Field, loose
from loomwork.operators.eventlog import EVENT_COLUMNS
from loomwork.operators.folds import start, step
from loomwork.plans.compile import Call, Plan
from loomwork.plans.identity import pipeline_hash
from loomwork.plans.model import Registry
from loomwork.plans.values import from_arrow, from_json, shape_misfits, takes, to_arrow
from loomwork.sources.calls import CallLog
from loomwork.sources.shared import cut

HALT = f"struct<error_class:string,category:string,cause:string,message:string,position:int,name:string,fields:array<{value_rules.FAILURE}>>"
CONTRACT, VALUE, FAILURE = "ContractViolation", "SchemaValidationError", "PipelineFailure"
#: Takes the pieces of a streaming call: run, place, piece, whether it is the end.
Sink = Callable[[str, int, "str | None", bool], None]
#: Calls to the outside that a task has under way at once.
CONCURRENT = 8


class ContractViolation(RuntimeError):
    """What a hook or a body does against its contract; never absorbed."""


@dataclass
class Failing:
    """One way in which a run can fail: where, and with what; the steps' order is the list's."""

    when: str  # a boolean column
    entry: Callable[[Column], Column]  # from its fields' failures
    found: Callable[[], Column] | None = None  # the fields' failures, where it has any


@dataclass
class Logged:
    """An event that runs emit whose first failure has an index from ``least`` up and below ``below``."""

    kind: str
    least: int
    below: int | None
    known: dict[str, Callable[[], Column] | Column]
    also: Column | None = None


@dataclass
class Result:
    """The rows of all runs; state, errors and events are views of one plan, each with what it needs.

    A step adds narrow columns only: its outputs, and a flag for each way to fail.  What a failure
    says and what an event holds is computed by the view that asks, for the rows that have it.
    """

    rows: DataFrame
    plan: Plan
    run_col: str
    failing: list[Failing]
    log: list[Logged]
    wires: dict[str, Column]

    def _placed(self) -> DataFrame:
        """The rows with ``__at``, the index of a run's first failure, else their number.

        The number comes out of a generator: a stage boundary, beneath which no condition on it moves
        and above which no step's expressions do, while conditions on a run's id still reach the scan.
        """
        flags = [F.when(F.col(f.when), k) for k, f in enumerate(self.failing)]
        return self.rows.withColumn("__at", F.explode(F.array(F.coalesce(*flags, F.lit(len(flags))))))

    def _fine(self) -> DataFrame:
        return self._placed().where(F.col("__at") == len(self.failing))

    def _told(self, rows: DataFrame) -> DataFrame:
        """The rows with what their first failure says, as ``__halt``."""
        rows = rows.withColumn("__found", self._case([None if f.found is None else f.found() for f in self.failing], _no_fields()))
        said = [f.entry(F.col("__found")).cast(HALT) for f in self.failing]
        return rows.withColumn("__halt", self._case(said, F.lit(None).cast(HALT)))

    def _case(self, values: list[Column | None], other: Column) -> Column:
        picked = F.when(F.lit(False), other)
        for k, v in enumerate(values):
            picked = picked if v is None else picked.when(F.col("__at") == k, v)
        return picked.otherwise(other)

    def state(self) -> DataFrame:
        """(run, public wires by name) of the runs that didn't fail."""
        return self._fine().select(self.run_col, *(self.wires[w].alias(w) for w in self.plan.public))

    def outputs(self) -> DataFrame:
        """(run, declared outputs) of the runs that didn't fail."""
        return self._fine().select(self.run_col, *(self.wires[w].alias(w) for w in self.plan.outputs))

    def errors(self) -> DataFrame:
        """(run, error_class, category, cause, message, position, name, fields) of the runs that failed."""
        failed = self._placed().where(F.col("__at") < len(self.failing))
        return self._told(failed).select(self.run_col, "__halt.*")

    def events(self) -> DataFrame:
        """The event log of all runs, nested ones included.

        A row is repeated for each event that a run can emit, and picks its event's values by number;
        columns that nothing reads are not computed.
        """
        at, k = F.col("__at"), F.col("__event")
        end = len(self.failing) + 1
        rows = self._placed().withColumn("__event", F.explode(F.lit(list(range(len(self.log))))))
        bounds = [[e.least for e in self.log], [end if e.below is None else e.below for e in self.log]]
        kept = (at >= F.get(F.lit(bounds[0]), k)) & (at < F.get(F.lit(bounds[1]), k))
        for i, e in enumerate(self.log):
            if e.also is not None:
                kept &= (k != i) | e.also
        rows = rows.where(kept)
        if any(_HALTED in e.known for e in self.log):
            rows = self._told(rows)
        return rows.select(*(self._picked(c, kind).alias(c) for c, kind in EVENT_COLUMNS.items()))

    def _picked(self, column: str, kind: str) -> Column:
        if column == "event_type":
            return F.get(F.lit([e.kind for e in self.log]), F.col("__event"))
        if column == "timestamp":
            return F.current_timestamp()
        out = F.when(F.lit(False), F.lit(None).cast(kind))
        for i, e in enumerate(self.log):
            known = F.col("__halt")[_OF_HALT[column]] if _HALTED in e.known and column in _OF_HALT else e.known.get(column)
            if known is not None:
                out = out.when(F.col("__event") == i, (known() if callable(known) else known).cast(kind))
        return out

    hooks: list[tuple] = field(default_factory=list)
    barrier: Callable[[DataFrame], DataFrame] = cut

    def observe(self, registry: Registry) -> None:
        """Runs the hooks' bodies for the rows that reached them, on rows that are computed once.

        A hook's own failure is ignored.  What breaks its contract is not: a result other than None,
        and a ``ContractViolation`` that it raises, stop the job.
        """
        if self.hooks:
            self.rows = self.barrier(self.rows)
        for name, least, body, given in self.hooks:
            reads = F.struct(*(c.alias(p) for p, c in given["reads"].items()))
            seen = self._placed().where(F.col("__at") >= least).select(reads.alias("r"))

            def emit(rows, name=name, body=body, extra=given["extra"]):
                for row in rows:
                    try:
                        said = body(**row.r.asDict(True), **extra)
                    except ContractViolation:
                        raise
                    except Exception:  # a hook's failure never reaches the run
                        continue
                    if said is not None:
                        raise ContractViolation(f"the hook {name} gave {type(said).__name__}, not None")

            seen.foreachPartition(emit)


def _no_fields() -> Column:
    return F.array().cast(f"array<{value_rules.FAILURE}>")


#: Marks an event that tells the run's failure, and the failure's fields by event column.
_HALTED = "__halted"
_OF_HALT = {
    "error_class": "error_class", "failed_name": "name", "failed_position": "position", "error_message": "message", "cause_class": "cause",
    "failure_category": "category",
}


class _Runner:
    def __init__(
        self, plan: Plan, registry: Registry, run: Column, prefix: str, barrier: Callable, parent: Column | None, deadline: float | None,
        sink: Callable | None = None, failing: list[Failing] | None = None, calls: CallLog | None = None,
        later: dict[str, Column] | None = None,
    ):
        self.sink, self.calls = sink, calls
        self.elapsed: list[Column] = []
        self.plan, self.registry, self.run, self.prefix, self.barrier, self.parent, self.deadline = plan, registry, run, prefix, barrier, parent, deadline
        self.now: dict[str, Column] = {}  # each wire's value so far
        self.made: dict[str, str] = {}  # and its column's name, if it has one of its own
        self.checked: set[str] = set()
        self.failing: list[Failing] = [] if failing is None else failing
        self.later: dict[str, Column] = {} if later is None else later  # columns to be added together
        self.log: list[Logged] = []
        self.hooks: list[tuple] = []
        self.hash = pipeline_hash(plan, registry)

    def event(self, least: int, kind: str, below: int | None = None, also: Column | None = None, **known: Column) -> None:
        self.log.append(Logged(kind, least, below, {"pipeline_run_id": self.run.cast("string"), **known}, also))

    def contribute(self, rows: DataFrame, wire: str, value: Column, place: str) -> DataFrame:
        """The wire's value with one more contribution, as a column of its own where it is merged."""
        strategy = self.plan.merge.get(wire)
        if strategy is None:
            self.now[wire] = value
            return rows
        kind = loose(self.plan.wires[wire].type.to_spark())
        so_far = self.now.get(wire)
        name = f"__w{place}"
        if self.made.get(wire) in self.later:  # one step's second contribution
            rows = self.flushed(rows)
        self.now[wire], self.made[wire] = F.col(name), name
        self.later[name] = start(strategy, value, kind) if so_far is None else step(strategy, so_far, value, kind)
        return rows

    def flushed(self, rows: DataFrame) -> DataFrame:
        """The rows with the columns that were put off; analysing a plan costs more than a column."""
        if self.later:
            rows = rows.withColumns(dict(self.later))
            self.later.clear()
        return rows

    def snapshot(self, values: Mapping[str, Column], fields: Mapping[str, Field]) -> Callable[[], Column]:
        """Canonical text of the values, for the view that reads it."""
        return lambda: canonical_object({k: (v, loose(fields[k].type.to_spark())) for k, v in values.items()})

    def total(self) -> Column:
        """Milliseconds of all calls so far."""
        return sum((F.coalesce(x, F.lit(0)) for x in self.elapsed), F.lit(0)).cast("long")

    def fails(self, rows: DataFrame, failing: Column, entry: Callable[[Column], Column], found: Callable[[], Column] | None = None) -> DataFrame:
        name = f"__c{len(self.failing)}"
        self.failing.append(Failing(name, entry, found))
        self.later[name] = F.coalesce(failing, F.lit(False))
        return rows

    def alive(self) -> Column:
        """Whether a row has not failed yet."""
        return ~reduce(Column.__or__, (F.col(f.when) for f in self.failing), F.lit(False))

    def entry(self, kind: str, category: str | None, cause: Column | None, message: Column, c: Call, fields: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(
            F.lit(kind), F.lit(category), none if cause is None else cause, message, F.lit(c.position), F.lit(c.name),
            _no_fields() if fields is None else fields,
        )

    def validated(self, rows: DataFrame, values: Mapping[str, tuple[Column, Field]], c: Call, what: str) -> DataFrame:
        fields = {k: (v, f.type, f.rules) for k, (v, f) in values.items()}
        if value_rules.in_python(fields):  # called once, so its findings are kept
            name = f"__f{self.prefix}{c.position}{what[0]}"
            rows = self.flushed(rows).withColumn(name, value_rules.failures(fields))
            failed, found = F.size(name) > 0, lambda: F.col(name)
        else:
            failed, found = value_rules.failed(fields), lambda: value_rules.failures(fields)

        def entry(found: Column) -> Column:
            said = F.array_join(F.transform(found, lambda x: F.concat_ws(" ", x.path, x.rule)), ", ")
            broke = self.entry(FAILURE, "engine", F.lit("rule"), F.lit(f"a rule of {what} failed itself"), c).cast(HALT)
            return F.when(F.exists(found, lambda x: x.broke), broke).otherwise(self.entry(VALUE, None, None, said, c, found).cast(HALT))

        return rows if failed is None else self.fails(rows, failed, entry, found)

    def go(self, rows: DataFrame, seeds: Mapping[str, Column]) -> DataFrame:
        for k, w in enumerate(self.plan.inputs):
            rows = self.contribute(rows, w, seeds[w], f"{self.prefix}i{k}")
        begun = len(self.failing)
        self.seeds = dict(seeds)
        up = {} if self.parent is None else {"parent_run_id": self.parent.cast("string")}
        self.event(begun, "pipeline_start", pipeline_hash=F.lit(self.hash), inputs_snapshot=self.snapshot(dict(seeds), self.plan.inputs), **up)
        for c in self.plan.calls:
            rows = self.call(rows, c)
        end, told = len(self.failing), {"pipeline_hash": F.lit(self.hash), "elapsed_ms": self.total()}
        self.event(end, "pipeline_complete", outputs_snapshot=self.snapshot({w: self.now[w] for w in self.plan.outputs}, self.plan.outputs), **told)
        if end > begun:
            self.event(begun, "pipeline_error", below=end, **told, **{_HALTED: F.lit(True)})
        return rows

    def call(self, rows: DataFrame, c: Call) -> DataFrame:
        tag = f"{self.prefix}{c.position}"
        if self.deadline is not None:
            # looked at when the row gets here, not when the plan is built
            late = F.java_method(F.lit("java.lang.System"), F.lit("currentTimeMillis")).cast("long") >= int(self.deadline * 1000)
            rows = self.fails(rows, late, lambda _: self.entry(FAILURE, "engine", F.lit("Timeout"), F.lit("the time is over"), c))
        rows = self.first_use(rows, c)
        alive = len(self.failing)
        reads = {p: self.now[w] for p, w in c.reads.items()}
        if c.inner is not None:
            return self.embed(rows, c, reads)
        known = {"handler_position": F.lit(c.position), "handler_name": F.lit(c.name), "node_kind": F.lit(c.kind)}
        self.event(alive, "handler_enter", reads_snapshot=self.snapshot(reads, c.read_fields), **known)
        body = self.registry.bodies.get(c.name)
        if c.kind == "hook":
            if body is not None:
                self.hooks.append((c.name, alive, body.call, {"reads": reads, "extra": {**c.bindings, **c.transport}}))
            self.event(alive, "handler_exit", elapsed_ms=F.lit(0), **known)
            return rows
        took = F.lit(0)
        if c.kind == "transform" and body is not None and body.style == "columns":
            out = body.call(**reads, **c.bindings)
            if set(out) != set(c.step.outputs):
                raise ValueError(f"{c.name} gives {sorted(out)}, not {sorted(c.step.outputs)}")
            made = {p: out[p].cast(loose(f.type.to_spark())) for p, f in c.step.outputs.items()}
            rows = self.flushed(rows).withColumns({f"__o{tag}_{k}": v for k, v in enumerate(made.values())})
        else:
            rows = self.python(rows, c, reads, tag, body.call if body else None)
            took = F.col(f"__r{tag}")["ms"]
            self.elapsed.append(took)
        cols = {p: F.col(f"__o{tag}_{k}") for k, p in enumerate(c.step.outputs)}
        rows = self.validated(rows, {p: (cols[p], f) for p, f in c.step.outputs.items()}, c, "outputs")
        link = {"correlation_id": correlation_id(self.run, c.position)} if c.kind == "service" else {}
        if c.kind == "service":
            said = F.col(f"__r{tag}")
            payload = {"input_payload": said["asked"], "output_payload": said["answered"], "pipeline_hash": F.lit(self.hash), "elapsed_ms": said["call_ms"]}
            # a call that was answered is told even if its step fails afterwards
            self.event(alive, "service_invocation", also=said["call_ms"].isNotNull(), **known, **payload, **link)
        self.event(len(self.failing), "handler_exit", writes_snapshot=self.snapshot(cols, c.step.outputs), elapsed_ms=took, **known, **link)
        for k, (p, w) in enumerate(c.writes.items()):
            rows = self.contribute(rows, w, cols[p], f"{tag}_{k}")
        return rows

    def first_use(self, rows: DataFrame, c: Call) -> DataFrame:
        """Seeds are validated where a step first reads them, or first folds into them."""
        now = [w for w in [*c.reads.values(), *c.writes.values()] if w in self.plan.inputs and w not in self.checked]
        self.checked.update(now)
        if not now:
            return rows
        return self.validated(rows, {w: (self.seeds[w], self.plan.inputs[w]) for w in dict.fromkeys(now)}, c, "seeds")

    def embed(self, rows: DataFrame, c: Call, reads: Mapping[str, Column]) -> DataFrame:
        """A nested flow, in the same rows: a run of its own with its own events, none in this stream."""
        run = F.concat(self.run.cast("string"), F.lit(f"/{c.position}"))
        inner = _Runner(c.inner, self.registry, run, f"{self.prefix}{c.position}_", self.barrier, self.run, self.deadline, self.sink, self.failing, self.calls, self.later)
        rows = inner.go(rows, dict(reads))
        self.elapsed += inner.elapsed
        self.log += inner.log
        self.hooks += inner.hooks
        for k, (p, w) in enumerate(c.writes.items()):
            rows = self.contribute(rows, w, inner.now[p], f"{self.prefix}{c.position}_e{k}")
        return rows

    def python(self, rows: DataFrame, c: Call, reads: Mapping[str, Column], tag: str, call: Callable | None) -> DataFrame:
        backend = self.registry.backends.get(next(iter(c.step.services.values()), ""))
        if call is None and (c.kind != "trainable" or backend is None):
            raise ValueError(f"{c.name} has no body" if c.kind != "trainable" else f"{c.name} has no backend")
        outputs = c.step.outputs
        fields = [T.StructField(f"v{k}", loose(f.type.to_spark())) for k, f in enumerate(outputs.values())]
        outside = c.kind in ("service", "trainable")
        sink = self.sink if c.streamable else None
        task = _Task(c, call, backend, self.deadline, object_schema(outputs) if c.kind == "trainable" else None, sink)
        if self.calls is not None:
            task.log, task.name = self.calls, f"{self.hash.removeprefix('sha256:')[:16]}-{tag}"
        schema = T.StructType([*fields, *T.StructType.fromDDL(_SAID).fields])
        task.made = to_arrow_type(schema)

        def run(given: pa.Array, live: pa.Array, run_id: pa.Array) -> pa.Array:
            return task.batch(given, live, run_id)

        run.__annotations__ = {"given": pa.Array, "live": pa.Array, "run_id": pa.Array, "return": pa.Array}
        udf = F.arrow_udf(run, schema)
        udf = udf.asNondeterministic() if outside else udf
        given = F.struct(*(v.alias(p) for p, v in reads.items())) if reads else F.struct(F.lit(0).alias("__none"))
        rows = self.flushed(rows).withColumn(f"__r{tag}", udf(given, self.alive(), self.run.cast("string")))
        if outside:
            rows = self.barrier(rows)
        r = F.col(f"__r{tag}")
        rows = rows.withColumns({f"__o{tag}_{k}": r[f"v{k}"] for k in range(len(outputs))})
        e = r["error"]
        return self.fails(
            rows, e.kind.isNotNull(), lambda found: F.struct(e.kind, e.category, e.cause, e.message, F.lit(c.position), F.lit(c.name), found),
            lambda: F.coalesce(e.fields, _no_fields()),
        )


_SAID = (
    f"error struct<kind:string,category:string,cause:string,message:string,fields:array<{value_rules.FAILURE}>>, "
    "ms long, call_ms long, asked string, answered string"
)


class _Error(Exception):
    """A row's failure, with what its ``halt`` says."""

    def __init__(self, kind: str, category: str | None, cause: str | None, message: str, fields: tuple = ()):
        self.entry = {"kind": kind, "category": category, "cause": cause, "message": message, "fields": list(fields)}


class _Task:
    """A step's Python side: bodies, services and model calls, row by row on the executors.

    A backend with ``open`` is opened once a task; one that declares ``remaining_budget_ms`` gets what
    is left of the run's time when it is called.  Calls to the outside wait for each other no more
    than ``CONCURRENT`` at once.
    """

    def __init__(self, c: Call, call: Callable | None, backend: Any, deadline: float | None, schema: Any, sink: Callable | None):
        self.kind, self.outputs, self.reads = c.kind, dict(c.step.outputs), dict(c.step.reads)
        self.bindings, self.service = dict(c.bindings), next(iter(c.step.services), None)
        self.extra = {"identity": dict(c.supply), "config": dict(c.config), "transport": dict(c.transport)}
        self.call, self.backend, self.deadline, self.schema, self.sink = call, backend, deadline, schema, sink
        self.ready: Any = None
        self.made: pa.DataType | None = None  # of the results
        self.position, self.log, self.name = c.position, None, ""
        self.logged: Any = None
        self.pool: ThreadPoolExecutor | None = None

    def opened(self) -> Any:
        if self.ready is None:
            self.ready = self.backend.open() if hasattr(self.backend, "open") else self.backend
        return self.ready

    def calls(self) -> Any:
        """The task's log of calls, if there is one."""
        if self.logged is None and self.log is not None:
            self.logged = self.log.of_task(self.name)
        return self.logged

    def once(self, run: str, number: int, make: Callable[[], Any]) -> Any:
        """A call to the outside, or its answer from the log of an earlier attempt."""
        calls = self.calls()
        return make() if calls is None else calls.once(f"{run}:{self.position}" + (f"#{number}" if number else ""), make)

    def budget(self, call: Callable) -> dict[str, Any]:
        if not takes(call, "remaining_budget_ms"):
            return {}
        return {"remaining_budget_ms": None if self.deadline is None else remaining_ms(self.deadline * 1000, time.time() * 1000)}

    def batch(self, given: pa.Array, live: pa.Array, run_id: pa.Array) -> pa.Array:
        rows = [{k: from_arrow(r[k], f.type) for k, f in self.reads.items()} for r in given.to_pylist()]
        runs, alive = run_id.to_pylist(), live.to_pylist()

        def one(k: int) -> dict[str, Any] | None:
            return self.row(rows[k], runs[k]) if alive[k] else None

        if self.kind in ("service", "trainable") and len(rows) > 1:
            self.opened()
            self.calls()
            self.pool = self.pool or ThreadPoolExecutor(CONCURRENT)  # one for all of the task's batches
            found = list(self.pool.map(one, range(len(rows))))
        else:
            found = [one(k) for k in range(len(rows))]
        return pa.array(found, self.made)

    def row(self, given: dict, run: str) -> dict[str, Any]:
        out: dict[str, Any] = {"error": None, "ms": 0, "call_ms": None, "asked": None, "answered": None}
        began = time.monotonic()
        try:
            values = self.values(given, run, out)
            out |= {f"v{k}": to_arrow(values[n], f.type) for k, (n, f) in enumerate(self.outputs.items())}
        except _Error as e:
            out["error"] = e.entry
        out["ms"] = int((time.monotonic() - began) * 1000)
        return out

    def values(self, given: dict, run: str, out: dict) -> dict[str, Any]:
        if self.deadline is not None and time.time() >= self.deadline:
            raise _Error(FAILURE, "engine", "Timeout", "the time is over")
        try:
            if self.kind == "trainable":
                answer = json.loads(self.answer(payload_text(given), run))
                made = {k: from_json(v, self.outputs[k].type) if k in self.outputs else v for k, v in answer.items()} if isinstance(answer, dict) else answer
            elif self.service is not None:
                made = self.call(**given, **self.bindings, **{self.service: _Service(self, out, run)})
            else:
                made = self.call(**given, **self.bindings)
        except _Error:
            raise
        except ContractViolation as e:
            raise _Error(CONTRACT, None, None, str(e)) from e
        except _Outside as e:
            raise _Error(FAILURE, "service", type(e.cause).__name__, str(e.cause)) from e
        except Exception as e:  # the row fails, not the batch
            where = "service" if self.kind == "trainable" else "handler"
            raise _Error(FAILURE, where, type(e).__name__, str(e)) from e
        if not isinstance(made, dict) or set(made) != set(self.outputs):
            keys = sorted(map(str, made)) if isinstance(made, dict) else type(made).__name__
            raise _Error(CONTRACT, None, None, f"gave {keys}, not {sorted(self.outputs)}")
        wrong = [x for n, f in self.outputs.items() for x in shape_misfits(made[n], f.type, n, deep_rules=False)]
        wrong = [x for x in wrong if x.rule != "nullable"]  # nulls are told by the rules over columns
        if wrong:
            names = [f.split(":")[0] for f in value_rules.FAILURE[len("struct<") : -1].split(",")]
            entries = [dict(zip(names, x.entry(), strict=True)) for x in wrong]
            raise _Error(VALUE, None, None, ", ".join(f"{x.path} {x.rule}" for x in wrong), tuple(entries))
        return made

    def answer(self, payload: str, run: str) -> str:
        """The model's whole text; its pieces go to the sinks while it streams.

        A sink that fails is left behind, for this run and alone: the pieces are no value, and the run
        goes on without it.  All others get the end mark.
        """
        backend = self.opened()
        if self.sink is None or not hasattr(backend, "fragments"):
            return self.once(run, 0, lambda: backend(payload, self.schema, **self.extra, **self.budget(backend)))
        pieces, sinks = [], list(self.sink) if isinstance(self.sink, (list, tuple)) else [self.sink]
        for seq, piece in enumerate(backend.fragments(payload, self.schema, **self.extra, **self.budget(backend.fragments))):
            pieces.append(piece)
            sinks = [sink for sink in sinks if _told(sink, run, seq, piece, False)]
        for sink in sinks:
            _told(sink, run, len(pieces), None, True)
        return "".join(pieces)


def _told(sink: Callable, *piece: Any) -> bool:
    """Whether the sink took the piece."""
    try:
        sink(*piece)
    except Exception:  # the observer's failure is not the run's
        return False
    return True


class _Outside(Exception):
    """A failure of the backend, apart from one of the body that called it."""

    def __init__(self, cause: Exception):
        super().__init__(str(cause))
        self.cause = cause


class _Service:
    """What a service step's body calls, once a row; keeps what was asked and answered."""

    def __init__(self, task: _Task, out: dict, run: str):
        self.task, self.out, self.run, self.number = task, out, run, 0

    def invoke(self, **payload: Any) -> Any:
        backend = self.task.opened()
        began = time.monotonic()
        try:
            number, self.number = self.number, self.number + 1
            answer = self.task.once(self.run, number, lambda: backend(payload, None, **self.task.extra, **self.task.budget(backend)))
        except ContractViolation:
            raise
        except Exception as e:
            raise _Outside(e) from e
        # captured before the body can change either
        self.out["call_ms"] = int((time.monotonic() - began) * 1000)
        self.out["asked"], self.out["answered"] = _json(payload), _json(answer)
        return answer


def _json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def transform(
    plan: Plan, runs: DataFrame, registry: Registry, run_col: str = "run_id", barrier: Callable[[DataFrame], DataFrame] = cut,
    timeout_ms: int | None = None, sink: Sink | Sequence[Sink] | None = None, calls: CallLog | None = None,
) -> Result:
    """The plan over a DataFrame of runs, with a column for the run and one for each input.

    Other columns are dropped; a missing one is an error before anything runs.  sink gets the pieces
    of a streaming model call, on the executors, as (run, place, piece, done); a plan whose last
    call doesn't stream takes none.  Several sinks get the pieces side by side.  calls: a log of services' and models' whole answers, which are JSON
    data, by which a retried task takes them instead of calling again.
    """
    if sink is not None and not streams(plan):
        raise ValueError(f"{CONTRACT}: no call of {plan.name} streams, so the sink would get nothing")
    missing = [c for c in (run_col, *plan.inputs) if c not in runs.columns]
    if missing:
        raise ValueError(f"{CONTRACT}: no column {', '.join(missing)}")
    named = {w: f"__i{k}" for k, w in enumerate(plan.inputs)}
    rows = runs.select(F.col(run_col), *(F.col(f"`{w}`").cast(loose(f.type.to_spark())).alias(named[w]) for w, f in plan.inputs.items()))
    deadline = None if timeout_ms is None else time.time() + timeout_ms / 1000
    runner = _Runner(plan, registry, F.col(run_col), "", barrier, None, deadline, sink, calls=calls)
    rows = runner.flushed(runner.go(rows, {w: F.col(n) for w, n in named.items()}))
    return Result(rows, plan, run_col, runner.failing, runner.log, {w: runner.now[w] for w in plan.contributors}, runner.hooks, barrier)


def streams(plan: Plan) -> bool:
    """Whether the last call but hooks streams, in the plan or in the flow that it embeds."""
    last = next((c for c in reversed(plan.calls) if c.kind != "hook"), None)
    return last is not None and (last.streamable or (last.inner is not None and streams(last.inner)))
