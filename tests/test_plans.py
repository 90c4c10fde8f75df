"""Declarations, checks, execution and hash laws."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from loomwork.functions.types import parse_type
from loomwork.plans import identity, load
from loomwork.plans.compile import compile_flow, substitute
from loomwork.plans.errors import CODES, PlanError, PlanErrorGroup
from loomwork.plans.execute import transform
from loomwork.plans.model import Registry
from loomwork.plans.problems import problem_details
from loomwork.sources import tables

S = {"type": "str"}


def step(name, reads, outputs, kind="transform", **more):
    data = {kind: {}, "reads": {k: {"type": v} for k, v in reads.items()}, **more}
    if kind != "hook":
        data["output_schema"] = {k: v if isinstance(v, dict) else {"type": v} for k, v in outputs.items()}
    return load.step(data, name)


def node(name, **more):
    return {"kind": "handler", "name": name, **more}


def flow(*nodes, **more):
    return load.flow({"meta": {"name": "f"}, "nodes": list(nodes), **more})


@pytest.fixture
def registry():
    r = Registry().add(step("up", {"a": "str"}, {"b": "str"}), step("two", {"b": "str"}, {"c": "str", "d": "int"}), step("see", {"b": "str"}, {}, "hook", service_bindings={}, transport_schema={"path": S}))
    r.columns("up")(lambda a: {"b": F.upper(a)})
    r.columns("two")(lambda b: {"c": F.concat(b, b), "d": F.length(b)})
    return r


def codes(make):
    with pytest.raises(PlanError) as e:
        make()
    return e.value.codes if isinstance(e.value, PlanErrorGroup) else {e.value.code}


IN = {"inputs": {"a": S}}


@pytest.mark.parametrize(
    "want,make",
    [
        ({"unknown-step"}, lambda: flow(node("nope"), **IN)),
        ({"unknown-port"}, lambda: flow(node("up", reads_map={"z": "a"}), **IN)),
        ({"dangling-port"}, lambda: flow(node("up"))),
        ({"unclosed-read"}, lambda: flow(node("two"), node("up"), **IN)),
        ({"two-writers"}, lambda: flow(node("up"), node("up"), **IN)),
        ({"read-write-overlap"}, lambda: flow(node("up", writes_map={"b": "a"}), **IN)),
        ({"unwired-merge"}, lambda: flow(node("up"), merge={"q": "last_wins"}, **IN)),
        ({"merge-type"}, lambda: flow(node("up"), node("up"), merge={"b": "append_list"}, **IN)),
        ({"dead-boundary"}, lambda: flow(node("up"), inputs={"a": S, "x": S})),
        ({"dead-boundary", "shape-mismatch"}, lambda: flow(node("up"), outputs={"q": S, "b": {"type": "int"}}, **IN)),
        ({"unknown-embed"}, lambda: flow({"kind": "composition", "name": "zzz"}, **IN)),
        ({"binding-unknown"}, lambda: flow(node("up", bindings={"k": 1}), **IN)),
    ],
)
def test_findings(registry, want, make):
    assert codes(lambda: compile_flow(make(), registry)) == want and want <= set(CODES)


@pytest.mark.parametrize(
    "code,kind,data",
    [
        ("step-header", "handler", {"reads": {}, "output_schema": {"a": S}}),
        ("closed-keys", "handler", {"transform": {}, "reads": {}, "output_schema": {"a": S}, "extra": 1}),
        ("missing-section", "handler", {"transform": {}, "output_schema": {"a": S}}),
        ("empty-section", "handler", {"transform": {}, "reads": {}, "output_schema": {}}),
        ("bad-type", "handler", {"transform": {}, "reads": {"a": {"type": "text"}}, "output_schema": {"a": S}}),
        ("bad-type", "handler", {"transform": {}, "reads": {"a": {"type": "table"}}, "output_schema": {"a": S}}),
        ("bad-rule", "handler", {"transform": {}, "reads": {"a": {"type": "str", "minimum": 1}}, "output_schema": {"a": S}}),
        ("service-count", "handler", {"service": {}, "reads": {}, "output_schema": {"a": S}, "service_bindings": {}}),
        ("unknown-kind", "composition", {"meta": {"kind": "other", "name": "x"}}),
        ("merge-type", "pipeline", {"meta": {"name": "x"}, "merge": {"a": "sum"}}),
        ("missing-section", "deployment", {}),
    ],
)
def test_declarations_that_do_not_load(code, kind, data):
    assert codes(lambda: load.parse(data, kind, "x")) == {code}


def test_any_declaration_loads_or_gives_the_one_error():
    rng = random.Random(8)
    keys = ["transform", "reads", "output_schema", "bindings", "hook", "service", "service_bindings", "transport_schema", "meta", "nodes", "inputs", "outputs", "merge", "kind", "name"]

    def value(depth):
        kind = rng.randrange(5 if depth < 3 else 3)
        if kind == 3:
            return {rng.choice([*keys, "a", "type"]): value(depth + 1) for _ in range(rng.randrange(3))}
        return [value(depth + 1)] if kind == 4 else ("str", 3, {})[kind]

    for _ in range(4000):
        data = {rng.choice(keys): value(0) for _ in range(rng.randrange(6))}
        for kind in ("handler", "pipeline", "composition"):
            try:
                load.parse(data, kind, "x")
            except PlanError:
                continue


def test_random_wiring_compiles_or_gives_findings(registry):
    rng = random.Random(2)
    wires = list("abcdef")
    for _ in range(600):
        nodes = [node(rng.choice(["up", "two", "see"]), reads_map={rng.choice("ab"): rng.choice(wires)}, **({"writes_map": {rng.choice("bcd"): rng.choice(wires)}} if rng.random() < 0.5 else {})) for _ in range(rng.randrange(4))]
        try:
            compile_flow(flow(*nodes, merge={rng.choice(wires): "last_wins"} if rng.random() < 0.3 else {}, **IN), registry)
        except PlanError:
            continue


def test_bundles_are_substituted_and_cycles_found(registry):
    registry.add(load.composition({"meta": {"kind": "bundle", "name": "x"}, "nodes": [node("up"), {"kind": "composition", "name": "y"}]}), load.composition({"meta": {"kind": "bundle", "name": "y"}, "nodes": [node("two")]}))
    assert [n.name for n in substitute(flow({"kind": "composition", "name": "x"}).nodes, registry)] == ["up", "two"]
    registry.add(load.composition({"meta": {"kind": "bundle", "name": "y"}, "nodes": [{"kind": "composition", "name": "x"}]}))
    assert codes(lambda: compile_flow(flow({"kind": "composition", "name": "x"}), registry)) == {"embed-cycle"}


def test_rows_fail_alone_and_hooks_do_not_matter(spark, registry, tmp_path):
    registry.rows("two")(lambda b: {"c": b, "d": 1} if b != "BAD" else {"c": b})
    seen = str(tmp_path / "seen")

    def see(b, path):
        with open(path, "a") as f:
            f.write(b + "\n")
        raise OSError("ignored")

    registry.rows("see")(see)
    deployment = load.deployment({"training_contract": {}, "hook_transport": {"see": {"path": seen}}})
    plan = compile_flow(flow(node("up"), node("see"), node("two"), inputs={"a": {"type": "str", "maxLength": 5}}), registry, deployment)
    runs = spark.createDataFrame([("1", "ok", 0), ("2", "bad", 0), ("3", "much too long", 0), ("4", None, 0)], "run_id string, a string, extra int")
    out = transform(plan, runs, registry)
    assert [tuple(r) for r in out.state().collect()] == [("1", "OK", "OK", 1)]
    failed = {r.run_id: (r.error_class, r.position, r.name) for r in out.errors().collect()}
    assert failed == {"2": ("ContractViolation", 2, "two"), "3": ("SchemaValidationError", 0, "up"), "4": ("SchemaValidationError", 0, "up")}
    out.observe(registry)
    assert sorted(open(seen).read().split()) == ["BAD", "OK"]
    statuses = {r.run_id: (r.status, json.loads(r.problem)) for r in problem_details(out.errors()).collect()}
    assert statuses["2"][0] == 500 and statuses["3"][0] == 502 and "cause" not in statuses["2"][1]
    kinds = [r.event_type for r in out.events().where("pipeline_run_id = '2'").collect()]
    assert kinds == ["pipeline_start", "handler_enter", "handler_exit", "handler_enter", "handler_exit", "handler_enter", "pipeline_error"]
    with pytest.raises(ValueError, match="no column a"):
        transform(plan, runs.drop("a"), registry)
    late = transform(plan, runs, registry, timeout_ms=0)
    assert {(r.cause, r.position) for r in late.errors().collect()} == {("Timeout", 0)}


def test_services_and_fixtures(spark, tmp_path):
    registry = Registry().add(load.service_type({"name": "echo", "identity_schema": {"model": S}, "transport_schema": {"endpoint": S}, "config_schema": {}}))
    registry.add(step("ask", {"a": "str"}, {"b": "str"}, "service", service_bindings={"api": {"type": "echo"}}))
    registry.backends["echo"] = lambda payload, schema, identity, config, transport: payload["q"] + identity["model"] + transport["endpoint"]
    registry.rows("ask")(lambda a, api: {"b": api.invoke(q=a)})
    made = flow(node("ask"), service_bindings={"api": {"type": "echo", "model": "!"}}, **IN)
    assert codes(lambda: compile_flow(made, registry, load.deployment({"training_contract": {}}))) == {"transport-missing"}
    plan = compile_flow(made, registry, load.deployment({"training_contract": {}, "transport": {"api": {"endpoint": "?"}}}))
    out = transform(plan, tables.seeds(spark, [{"run_id": "r", "a": "x", "more": 1}], plan), registry)
    assert out.state().first().b == "x!?"
    path = str(tmp_path / "fixtures")
    tables.write_fixtures(out.events(), path)
    same = tables.read_fixtures(spark, path, identity.pipeline_hash(plan)).collect()
    assert len(same) == 1 and json.loads(same[0].output_payload) == "x!?" and json.loads(same[0].input_payload) == {"q": "x"} and tables.read_fixtures(spark, path, "sha256:0").count() == 0
    log = str(tmp_path / "log")
    tables.append_events(out.events(), log)
    assert tables.read_events(spark, log).count() == out.events().count() == 5


def test_hash_laws(registry):
    def h(f, r=registry):
        return identity.pipeline_hash(compile_flow(f, r))

    base = h(flow(node("up"), node("two"), **IN))
    assert base == h(flow(node("up", reads_map={"a": "a"}), node("two"), **IN))  # identity map written out
    assert base == h(load.flow({"meta": {"name": "other"}, "nodes": [node("up"), node("two")], **IN}))  # name
    assert base == h(flow(node("up"), node("see"), node("two"), **IN))  # hook
    assert base != h(flow(node("up", writes_map={"b": "q"}), node("two", reads_map={"b": "q"}), **IN))  # wiring
    assert base != h(flow(node("up"), node("two"), outputs={"c": S}, **IN))  # boundary
    other = Registry(dict(registry.steps), bodies=registry.bodies).add(step("two", {"b": "str"}, {"c": {"type": "str", "maxLength": 9}, "d": "int"}))
    assert base != h(flow(node("up"), node("two"), **IN), other)  # a rule
    swapped = Registry(dict(registry.steps)).add(step("two", {"b": "str"}, {"d": "int", "c": "str"}))
    text, digest = identity.serialized(compile_flow(flow(node("up"), node("two"), **IN), registry))
    assert digest == identity.serialized(compile_flow(flow(node("up"), node("two"), **IN), registry))[1] and json.loads(text)["pipeline_hash"] == base
    assert swapped.steps["two"].outputs.keys() == {"c", "d"}


def trainable(outputs=None, streamable=False, config=None, name="t"):
    return {
        "meta": {"kind": "trainable", "name": name}, "inputs": {"a": S}, "outputs": {"x": S, "y": S}, "service_bindings": {"llm": {"type": "m", "model": "1"}},
        "trainable": {"streamable": streamable, "config": config or {}, "service_bindings": {"llm": {"type": "m"}}, "reads": {"a": S}, "output_schema": outputs or {"x": S, "y": S}},
    }


def test_trainable_hash_laws():
    def both(*given, **more):
        r = Registry().add(load.service_type({"name": "m", "identity_schema": {"model": S}, "transport_schema": {"e": S}, "config_schema": {"t": {"type": "float", "default": more.pop("default", 1.0)}}}))
        made = load.composition(trainable(*given, **more))
        r.add(made, at="t")
        plan = compile_flow(flow({"kind": "composition", "name": "t"}, **IN), r)
        return identity.pipeline_hash(plan), next(iter(identity.bundle_hashes(plan).values()))

    base = both()
    assert base == both(streamable=True) == both(name="renamed") == both(config={"t": 1.0})
    for changed in (both({"y": S, "x": S}), both({"x": {"type": "str", "description": "d"}, "y": S}), both({"x": {"type": "str", "maxLength": 3}, "y": S}), both(config={"t": 0.5}), both(default=2.0)):
        assert changed[0] != base[0] and changed[1] != base[1]


def test_fragments_go_to_a_sink_and_the_value_after_validation(spark, tmp_path):
    from loomwork.catalogue import trainable_flow
    from loomwork.streaming.live import assembled

    folder = str(tmp_path)

    def sink(run, seq, piece, done):
        if run == "broken" and seq == 1:
            raise OSError("the observer is gone")
        with open(f"{folder}/{run}.{seq}", "w") as f:
            json.dump({"run": run, "seq": seq, "piece": piece, "done": done}, f)

    plan, registry = trainable_flow(streamable=True)
    runs = spark.createDataFrame([("a", "hello"), ("broken", "hi")], "run_id string, said string")
    out = transform(plan, runs, registry, sink=sink)
    state = {r.run_id: r.mood for r in out.state().collect()}
    assert set(state) == {"a", "broken"} and set(state.values()) <= {"calm", "loud"}
    pieces = spark.read.schema("run string, seq long, piece string, done boolean").json(folder)
    whole = {r.run: json.loads(r.text) for r in assembled(pieces).collect()}
    assert whole == {"a": {"mood": state["a"]}} and pieces.where("run = 'a'").count() > 2
    quiet, registry = trainable_flow()
    with pytest.raises(ValueError, match="streams"):
        transform(quiet, runs, registry, sink=sink)


def test_several_sinks_get_all_pieces_but_what_fails(spark, tmp_path):
    from loomwork.catalogue import trainable_flow

    folder = str(tmp_path)

    def to(name, fails_at=None):
        def sink(run, seq, piece, done):
            if seq == fails_at:
                raise OSError("gone")
            with open(f"{folder}/{name}", "a") as f:
                f.write("." if done else piece)

        return sink

    plan, registry = trainable_flow(streamable=True)
    out = transform(plan, spark.createDataFrame([("a", "hello")], "run_id string, said string"), registry, sink=[to("first"), to("second", 1), to("third")])
    mood = out.state().first().mood
    texts = {p.name: p.read_text() for p in tmp_path.iterdir()}
    assert texts["first"] == texts["third"] and json.loads(texts["first"][:-1]) == {"mood": mood} and texts["first"].endswith(".")
    assert texts["first"].startswith(texts["second"]) and 0 < len(texts["second"]) < len(texts["first"]) - 1


def test_snapshots_as_tables(spark, registry):
    registry.add(step("bound", {"b": "str"}, {"e": "str"}, bindings={"mark": {"sep": S}}), load.composition({"meta": {"kind": "pipeline", "name": "in"}, "nodes": [node("up")], "inputs": {"a": S}, "outputs": {"b": S}}))
    plan = compile_flow(flow({"kind": "composition", "name": "in"}, node("bound", bindings={"mark": "+"}), **IN), registry)
    made = identity.snapshots(spark, plan)
    outer, inner = identity.pipeline_hash(plan), identity.pipeline_hash(plan.calls[0].inner)
    assert {(r.flow, r.position, r.name) for r in made["nodes"].collect()} >= {(outer, 1, "bound"), (inner, 0, "up")}
    assert [(r.flow, r.position, r.name, r.constant, json.loads(r.value)["value"]) for r in made["bindings"].collect()] == [(outer, 1, "bound", "mark", {"sep": "+"})]
    assert {(r.flow, r.wire, r.type) for r in made["wires"].collect()} == {(outer, "a", "str"), (outer, "b", "str"), (outer, "e", "str"), (inner, "a", "str"), (inner, "b", "str")}
    assert made["compositions"].count() == 0


def test_a_hook_that_breaks_its_contract_stops_the_job(spark, registry):
    deployment = load.deployment({"training_contract": {}, "hook_transport": {"see": {"path": "p"}}})
    plan = compile_flow(flow(node("up"), node("see"), **IN), registry, deployment)
    runs = spark.createDataFrame([("1", "x")], "run_id string, a string")
    registry.rows("see")(lambda b, path: b)
    with pytest.raises(Exception, match="gave str, not None"):
        transform(plan, runs, registry).observe(registry)
    registry.rows("see")(lambda b, path: None)
    transform(plan, runs, registry).observe(registry)


def test_backends_are_opened_once_a_task_and_fail_apart_from_bodies(spark):
    registry = Registry().add(load.service_type({"name": "echo", "identity_schema": {"model": S}, "transport_schema": {"endpoint": S}, "config_schema": {}}))
    registry.add(step("ask", {"a": "str"}, {"b": "str", "n": "int"}, "service", service_bindings={"api": {"type": "echo"}}))
    opened = spark.sparkContext.accumulator(0)

    class Backend:
        def open(self):
            opened.add(1)
            return lambda payload, schema, identity, config, transport, remaining_budget_ms=None: (payload["q"], remaining_budget_ms)

    def ask(a, api):
        said, left = api.invoke(q=a)
        if a == "body":
            raise KeyError("mine")
        return {"b": said, "n": -1 if left is None else left}

    registry.backends["echo"] = Backend()
    registry.rows("ask")(ask)
    made = flow(node("ask"), service_bindings={"api": {"type": "echo", "model": "!"}}, **IN)
    plan = compile_flow(made, registry, load.deployment({"training_contract": {}, "transport": {"api": {"endpoint": "?"}}}))
    runs = spark.createDataFrame([(str(k), "body" if k == 3 else "x") for k in range(20)], "run_id string, a string").coalesce(1)
    out = transform(plan, runs, registry, timeout_ms=600_000)
    assert all(0 < r.n <= 600_000 for r in out.state().collect()) and opened.value == 1
    assert [(r.run_id, r.category, r.cause) for r in out.errors().collect()] == [("3", "handler", "KeyError")]
    events = out.events().where("pipeline_run_id = '3'").collect()
    assert [e.event_type for e in events] == ["pipeline_start", "handler_enter", "service_invocation", "pipeline_error"]
    assert {r.n for r in transform(plan, runs, registry).state().collect()} == {-1}


def test_optional_integers_reach_bodies_as_integers(spark):
    registry = Registry().add(step("take", {"k": "int | None", "xs": "list[int | None]"}, {"said": "str", "pair": "tuple[int, float]"}))
    registry.rows("take")(lambda k, xs: {"said": repr((k, xs)), "pair": (1, 2)})
    plan = compile_flow(load.flow({"meta": {"name": "f"}, "nodes": [node("take")], "inputs": {"k": "int | None", "xs": "list[int | None]"}}), registry)
    runs = spark.createDataFrame([("1", 3, [1, None]), ("2", None, [])], "run_id string, k long, xs array<long>").coalesce(1)
    out = transform(plan, runs, registry)
    assert {r.run_id: (r.said, tuple(r.pair)) for r in out.state().collect()} == {"1": ("(3, [1, None])", (1, 2.0)), "2": ("(None, [])", (1, 2.0))}
    exits = {e.pipeline_run_id: e.writes_snapshot for e in out.events().where("event_type = 'handler_exit'").collect()}
    assert exits["2"] == '{"pair":[1,2.0],"said":"(None, [])"}'


def test_toml_and_files(tmp_path):
    (tmp_path / "k.toml").write_text('x = "v"\n')
    made = load.loads('[meta]\nname = "f"\n[[nodes]]\nkind = "handler"\nname = "s"\nbindings = { k = { file = "k.toml" } }\n', "pipeline")
    assert load.resolve_files(made, tmp_path).nodes[0].bindings == {"k": {"x": "v"}}
    assert codes(lambda: load.loads("= 1", "pipeline")) == {"bad-value"} and parse_type("str").text() == "str"


def _chain(n, merged=None):
    """n steps one after the other; each also writes to one merged wire where there is a strategy."""
    r, nodes = Registry(), []
    for k in range(n):
        out = {f"w{k + 1}": {"type": "str", "maxLength": 40}, **({"t": "str"} if merged else {})}
        r.add(step(f"s{k}", {f"w{k}": "str"}, out))
        r.columns(f"s{k}")(lambda k=k, **given: {f"w{k + 1}": F.concat(given[f"w{k}"], F.lit(str(k % 10))), **({"t": F.when(F.length(given[f"w{k}"]) % 3 == 0, "").otherwise(given[f"w{k}"])} if merged else {})})
        nodes.append(node(f"s{k}"))
    return compile_flow(flow(*nodes, inputs={"w0": S}, **({"merge": {"t": merged}} if merged else {})), r), r


def test_thirty_steps_and_a_million_rows(spark):
    """Time and plan are linear in the steps: nothing nests from one to the next."""
    runs = spark.range(1_000_000).select(F.col("id").alias("run_id"), F.when(F.col("id") % 4 == 3, F.repeat(F.lit("x"), 20)).otherwise(F.lit("y")).alias("w0"))
    began = time.monotonic()
    result = transform(*_chain(30)[:1], runs, _chain(30)[1])
    got = result.state().agg(F.count("*").alias("n"), F.max(F.length("w30")).alias("longest")).first()
    assert (got.n, got.longest) == (750_000, 31)
    failed = result.errors().groupBy("name", "position", "message").count().collect()
    assert [tuple(r) for r in failed] == [("s20", 20, "w21 maxLength", 250_000)]
    kinds = {r.event_type: r["count"] for r in result.events().groupBy("event_type").count().collect()}
    assert kinds == {"pipeline_start": 1_000_000, "handler_enter": 750_000 * 30 + 250_000 * 21, "handler_exit": 750_000 * 30 + 250_000 * 20, "pipeline_complete": 750_000, "pipeline_error": 250_000}
    assert time.monotonic() - began < 120  # minutes for eleven steps, if halts nest
    sizes = [len(transform(p, runs, r).state()._jdf.queryExecution().optimizedPlan().toString()) for p, r in (_chain(10), _chain(20))]
    assert sizes[1] < 2.5 * sizes[0]


@pytest.mark.parametrize("strategy,want", [("last_present_wins", lambda t: next((x for x in reversed(t) if x), t[-1])), ("concat_str", "".join), ("first_wins", lambda t: t[0])])
def test_a_wire_with_twenty_writers(spark, strategy, want):
    plan, r = _chain(20, strategy)
    got = transform(plan, spark.createDataFrame([(1, "ab")], "run_id int, w0 string"), r).state().first()
    texts = ["ab" + "".join(str(j % 10) for j in range(k)) for k in range(20)]
    assert got.t == want(["" if len(t) % 3 == 0 else t for t in texts])


def test_a_condition_on_the_run_reaches_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("run_id"), F.lit("a").alias("w0")).write.parquet(f"{tmp_path}/runs")
    plan, r = _chain(3)
    state = transform(plan, spark.read.parquet(f"{tmp_path}/runs"), r).state().where("run_id = 7")
    assert state.count() == 1 and "EqualTo(run_id,7)" in state._jdf.queryExecution().toString()


def test_an_inner_run_that_ended_before_its_outer_run_failed(spark, registry):
    registry.add(step("late", {"b": "str"}, {"e": {"type": "str", "maxLength": 1}}), load.composition({"meta": {"kind": "pipeline", "name": "in"}, "nodes": [node("up")], "inputs": {"a": S}, "outputs": {"b": S}}))
    registry.columns("late")(lambda b: {"e": b})
    plan = compile_flow(flow({"kind": "composition", "name": "in"}, node("late"), **IN), registry)
    events = transform(plan, spark.createDataFrame([(1, "xyz")], "run_id int, a string"), registry).events().collect()
    assert sorted((e.pipeline_run_id, e.event_type) for e in events if e.event_type.startswith("pipeline")) == [("1", "pipeline_error"), ("1", "pipeline_start"), ("1/0", "pipeline_complete"), ("1/0", "pipeline_start")]
