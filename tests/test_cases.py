"""Declarations, checks, hashes and renderings by cases: what each must give."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pytest

from loomwork.functions import canonical, rendering
from loomwork.functions.types import TypeTokenError, parse_type
from loomwork.plans import identity, load
from loomwork.plans.artifacts import SUFFIX, DriftError, check_artifacts, manifest, side_file
from loomwork.plans.compile import Plan, compile_flow
from loomwork.plans.errors import PlanError, PlanErrorGroup
from loomwork.plans.model import FileText, Flow, Registry

S = {"type": "str"}
CASES: list[tuple[str, Callable, dict[str, str]]] = []


def cases(name: str, expected: dict[str, str]) -> Callable:
    def keep(f: Callable[[], dict[str, str]]) -> Callable:
        CASES.append((name, f, expected))
        return f

    return keep


def _steps() -> Registry:
    r = Registry()
    r.add(load.step({"transform": {}, "reads": {"a": S}, "output_schema": {"b": S}}, "up"))
    r.add(load.step({"transform": {}, "reads": {"b": S}, "output_schema": {"c": S, "d": {"type": "int"}}}, "two"))
    r.add(load.step({"transform": {}, "reads": {"a": S}, "output_schema": {"e": S}, "bindings": {"mark": {"sep": S}}}, "bound"))
    r.add(load.step({"hook": {}, "reads": {"b": S}, "service_bindings": {}, "transport_schema": {"path": S}}, "see"))
    r.add(load.service_type({"name": "m", "identity_schema": {"model": S}, "transport_schema": {"endpoint": S, "key": {"type": "secret_ref", "nullable": True}}, "config_schema": {"t": {"type": "float", "default": 1.0}}}))
    r.add(load.step({"service": {}, "reads": {"a": S}, "output_schema": {"s": S}, "service_bindings": {"api": {"type": "m"}}}, "ask"))
    return r


def _flow(*nodes: Any, **more: Any) -> Flow:
    listed = [n if isinstance(n, dict) else {"kind": "handler", "name": n} for n in nodes]
    return load.flow({"meta": {"name": "f"}, "nodes": listed, "inputs": {"a": S}, **more})


def _node(name: str, **more: Any) -> dict[str, Any]:
    return {"kind": "handler", "name": name, **more}


_API = {"api": {"type": "m", "model": "x"}}


def _codes(make: Callable[[], Any]) -> str:
    try:
        make()
    except PlanErrorGroup as e:
        return ",".join(sorted(e.codes))
    except PlanError as e:
        return e.code
    return "fine"


def _trainable(outputs: dict[str, Any] | None = None, **more: Any) -> dict[str, Any]:
    inner = {"streamable": more.pop("streamable", False), "config": more.pop("config", {}), "service_bindings": {"llm": {"type": "m"}}, "reads": {"a": S}}
    return {
        "meta": {"kind": "trainable", "name": more.pop("name", "t")}, "inputs": {"a": S}, "outputs": {"x": S, "y": S}, "service_bindings": {"llm": {"type": "m", "model": more.pop("model", "1")}},
        "trainable": {**inner, "output_schema": outputs or {"x": S, "y": S}}, **more,
    }


def _with_trainable(registry: Registry, *given: Any, **more: Any) -> Plan:
    registry.add(load.composition(_trainable(*given, **more)), at="t")
    return compile_flow(_flow({"kind": "composition", "name": "t"}), registry)


class _Whole:
    """A backend that gives whole answers only."""

    def __call__(self, payload, schema, identity, config, transport):
        return "{}"


class _Odd:
    """A backend that wants what nobody gives."""

    def __call__(self, payload, schema, identity, config, transport, more):
        return "{}"


@cases(
    "check_flows",
    {
        "nothing wrong": "fine", "no such step": "unknown-step", "no such port": "unknown-port", "nothing writes what is read": "dangling-port",
        "written later only": "unclosed-read", "two writers": "two-writers", "a merge lets them": "fine", "reads what it writes": "read-write-overlap",
        "merge of nothing": "unwired-merge", "merge of another type": "merge-type", "unread input": "dead-boundary", "output of another type": "shape-mismatch",
        "no such composition": "unknown-embed", "no such constant": "binding-unknown", "constant missing": "binding-missing", "constant of another type": "binding-value",
        "no supply": "identity-missing", "too much identity": "identity-unknown", "unknown configuration": "config-unknown", "two in one stage": "unknown-port,unknown-step",
    },
)
def check_flows() -> dict[str, str]:
    """What the static checks find in small flows: wiring, merges, boundary, constants and supplies."""
    r = _steps()
    made = {
        "nothing wrong": lambda: _flow("up", "two"), "no such step": lambda: _flow("nope"), "no such port": lambda: _flow(_node("up", reads_map={"z": "a"})),
        "nothing writes what is read": lambda: _flow("up", inputs={}), "written later only": lambda: _flow("two", "up"),
        "two writers": lambda: _flow("up", "up"), "a merge lets them": lambda: _flow("up", "up", merge={"b": "concat_str"}),
        "reads what it writes": lambda: _flow(_node("up", writes_map={"b": "a"})), "merge of nothing": lambda: _flow("up", merge={"q": "last_wins"}),
        "merge of another type": lambda: _flow("up", "up", merge={"b": "append_list"}), "unread input": lambda: _flow("up", inputs={"a": S, "x": S}),
        "output of another type": lambda: _flow("up", outputs={"b": {"type": "int"}}), "no such composition": lambda: _flow({"kind": "composition", "name": "zzz"}),
        "no such constant": lambda: _flow(_node("up", bindings={"k": 1})), "constant missing": lambda: _flow("bound"),
        "constant of another type": lambda: _flow(_node("bound", bindings={"mark": 3})), "no supply": lambda: _flow("ask"),
        "too much identity": lambda: _flow("ask", service_bindings={"api": {"type": "m", "model": "x", "more": 1}}),
        "unknown configuration": lambda: _flow("ask", service_bindings={"api": {"type": "m", "model": "x", "config": {"q": 1}}}),
        "two in one stage": lambda: _flow("nope", _node("up", reads_map={"z": "a"})),
    }
    return {k: _codes(lambda f=f: compile_flow(f(), r)) for k, f in made.items()}


@cases(
    "check_deployments",
    {
        "covered": "fine", "no endpoint": "transport-missing", "unknown transport": "transport-unknown", "endpoint of another type": "transport-value",
        "secret of no form": "secret-form", "secret by name": "fine", "hook without transport": "hook-transport-missing", "hook with too much": "transport-unknown",
    },
)
def check_deployments() -> dict[str, str]:
    """What covering a flow by a deployment finds."""
    asks, sees = _flow("ask", service_bindings=_API), _flow("up", "see")

    def over(flow: Flow, **given: Any) -> Callable:
        return lambda: compile_flow(flow, _steps(), load.deployment({"training_contract": {}, **given}))

    made = {
        "covered": over(asks, transport={"api": {"endpoint": "e"}}), "no endpoint": over(asks), "unknown transport": over(asks, transport={"api": {"endpoint": "e", "z": 1}}),
        "endpoint of another type": over(asks, transport={"api": {"endpoint": 3}}), "secret of no form": over(asks, transport={"api": {"endpoint": "e", "key": "bare"}}),
        "secret by name": over(asks, transport={"api": {"endpoint": "e", "key": "[env]KEY"}}), "hook without transport": over(sees),
        "hook with too much": over(sees, hook_transport={"see": {"path": "p", "z": "q"}}),
    }
    return {k: _codes(f) for k, f in made.items()}


@cases(
    "check_declarations",
    {
        "step": "fine", "bare token": "fine", "no header": "step-header", "unknown key": "closed-keys", "no reads": "missing-section", "no output": "empty-section",
        "unknown type": "bad-type", "table as a wire": "bad-type", "two shapes": "bad-type", "rule of another type": "bad-rule", "limit is no number": "bad-rule",
        "pattern doesn't compile": "bad-rule", "enum beyond the length": "bad-rule", "rule on an element": "closed-keys", "null shorthand": "bad-nullable",
        "service without service": "service-count", "composition kind": "unknown-kind", "no such strategy": "merge-type", "no contract": "missing-section", "no TOML": "bad-value",
    },
)
def check_declarations() -> dict[str, str]:
    """What loading declarations finds: closed keys, sections, types, rules and their parameters."""

    def step(field: Any, **more: Any) -> Callable:
        return lambda: load.parse({"transform": {}, "reads": {"a": field}, "output_schema": {"b": S}, **more}, "handler", "x")

    made: dict[str, Callable] = {
        "step": step(S), "bare token": step("list[int]"), "no header": lambda: load.parse({"reads": {}, "output_schema": {"b": S}}, "handler", "x"), "unknown key": step(S, extra=1),
        "no reads": lambda: load.parse({"transform": {}, "output_schema": {"b": S}}, "handler", "x"), "no output": lambda: load.parse({"transform": {}, "reads": {}, "output_schema": {}}, "handler", "x"),
        "unknown type": step({"type": "text"}), "table as a wire": step({"type": "table"}), "two shapes": step({"type": "str", "fields": {}}),
        "rule of another type": step({"type": "str", "minimum": 1}), "limit is no number": step({"type": "int", "minimum": "x"}), "pattern doesn't compile": step({"type": "str", "pattern": "("}),
        "enum beyond the length": step({"type": "str", "maxLength": 1, "enum": ["ab"]}), "rule on an element": step({"item": {"fields": {"n": "int"}, "minItems": 1}}),
        "null shorthand": step({"type": "str", "nullable": "yes"}),
        "service without service": lambda: load.parse({"service": {}, "reads": {}, "output_schema": {"b": S}, "service_bindings": {}}, "handler", "x"),
        "composition kind": lambda: load.parse({"meta": {"kind": "other", "name": "x"}}, "composition"), "no such strategy": lambda: load.parse({"meta": {"name": "x"}, "merge": {"a": "sum"}}, "pipeline"),
        "no contract": lambda: load.parse({}, "deployment"), "no TOML": lambda: load.loads("= 1", "pipeline"),
    }
    return {k: _codes(f) for k, f in made.items()}


@cases(
    "check_backends",
    {
        "whole answers": "fine", "streams without fragments": "backend-capability", "odd arguments": "backend-capability", "open keys in a strict schema": "backend-capability",
        "reserved extras": "config-unknown", "bundle in itself": "embed-cycle", "streams before a step": "stream-placement",
    },
)
def check_backends() -> dict[str, str]:
    """What is found of backends and compositions before anything runs."""

    def of(backend: Any, *given: Any, **more: Any) -> Callable:
        def make() -> None:
            r = _steps()
            r.backends["m"] = backend
            if "config" in more:
                r.services["m"] = load.service_type({"name": "m", "identity_schema": {"model": S}, "transport_schema": {"endpoint": S}, "config_schema": {"extras": {"type": "table"}}})
            _with_trainable(r, *given, **more)

        return make

    def cycle() -> None:
        r = _steps().add(load.composition({"meta": {"kind": "bundle", "name": "x"}, "nodes": [{"kind": "composition", "name": "x"}]}))
        compile_flow(_flow({"kind": "composition", "name": "x"}), r)

    def early() -> None:
        r = _steps().add(load.composition(_trainable(streamable=True)))
        compile_flow(_flow({"kind": "composition", "name": "t"}, "up"), r)

    made = {
        "whole answers": of(_Whole()), "streams without fragments": of(_Whole(), streamable=True), "odd arguments": of(_Odd()),
        "open keys in a strict schema": of(_Whole(), {"x": {"type": "dict[str, str]"}, "y": S}), "reserved extras": of(_Whole(), config={"extras": {"model": "z"}}),
        "bundle in itself": cycle, "streams before a step": early,
    }
    return {k: _codes(f) for k, f in made.items()}


@cases(
    "type_tokens",
    {
        "str": "str string", "list[int]": "list[int] array<bigint>", " dict[ str ,float ] | None": "dict[str, float] | None map<string,double>",
        "tuple[str, bool]": "tuple[str, bool] struct<_0:string,_1:boolean>", "Literal['a', \"b\"]": "Literal['a', 'b'] string", "Literal[1, 2]": "Literal[1, 2] bigint",
        "list[str | None]": "list[str | None] array<string>", "dict[int, str]": "no type", "text": "no type", "list[": "no type", "bytes": "no type", "Literal[1.5]": "no type",
    },
)
def type_tokens() -> dict[str, str]:
    """Type tokens read, written back canonically, and as column types."""
    out = {}
    for token in (
        "str", "list[int]", " dict[ str ,float ] | None", "tuple[str, bool]", "Literal['a', \"b\"]", "Literal[1, 2]", "list[str | None]", "dict[int, str]", "text", "list[", "bytes", "Literal[1.5]",
    ):
        try:
            t = parse_type(token)
            out[token] = f"{t.text()} {t.to_spark().simpleString()}"
        except TypeTokenError:
            out[token] = "no type"
    return out


_CLOSED = '"additionalProperties":false'


@cases(
    "schema_texts",
    {
        "str": '{"type":"string"}', "int": '{"type":"integer"}', "float": '{"type":"number"}', "bool": '{"type":"boolean"}',
        "list[str]": '{"items":{"type":"string"},"type":"array"}', "str | None": '{"anyOf":[{"type":"string"},{"type":"null"}]}', "Literal['a', 'b']": '{"enum":["a","b"]}',
        "dict[str, int]": "no form", "tuple[int, int]": "no form",
        "object": f'{{{_CLOSED},"properties":{{"mood":{{"description":"how it sounds","enum":["x"],"type":"string"}},"n":{{"type":"integer"}}}},"required":["mood","n"],"type":"object"}}',
    },
)
def schema_texts() -> dict[str, str]:
    """Types as strict JSON Schema; rules that a backend doesn't enforce stay out."""
    out = {}
    for token in ("str", "int", "float", "bool", "list[str]", "str | None", "Literal['a', 'b']", "dict[str, int]", "tuple[int, int]"):
        try:
            out[token] = canonical.canonical_json(rendering.schema_of(parse_type(token)))
        except rendering.RenderError:
            out[token] = "no form"
    fields = load.parse_fields({"mood": {"type": "str", "enum": ["x"], "maxLength": 5, "description": "how it sounds"}, "n": "int"}, "x", description=True)
    return out | {"object": canonical.canonical_json(rendering.object_schema(fields))}


@cases(
    "grammar_texts",
    {
        "bool": 'root ::= boolean boolean ::= "true" | "false"', "int": 'root ::= integer integer ::= "-"? ("0" | [1-9] [0-9]*)',
        "Literal['a', 'b']": 'root ::= "\\"a\\"" | "\\"b\\""', "bool | None": 'root ::= boolean | null boolean ::= "true" | "false" null ::= "null"',
    },
)
def grammar_texts() -> dict[str, str]:
    """Schemas as GBNF grammars."""
    tokens = ("bool", "int", "Literal['a', 'b']", "bool | None")
    return {t: rendering.grammar(rendering.schema_of(parse_type(t), backend="gbnf")).replace("\n", " ") for t in tokens}


@cases(
    "canonical_values",
    {
        "keys": '{"a":1,"b":[1,2]}', "accent": '"é"', "tuple": "[1,2.5,true,null]", "date": '{"$date":"2020-01-02"}', "nan": "error", "two keys": "error", "object": "error",
        "hash": "sha256:4f53cda18c2baa0c0354bb5f9a3ecbe5ed12ab4d8e11ba873c2f11161202b945",
    },
)
def canonical_values() -> dict[str, str]:
    """Declaration data as canonical JSON, and its hash."""
    import datetime as dt

    given: dict[str, Any] = {
        "keys": {"b": [1, 2], "a": 1}, "accent": "é", "tuple": (1, 2.5, True, None), "date": dt.date(2020, 1, 2), "nan": float("nan"), "two keys": {1: 0, "1": 0}, "object": object(),
    }
    out = {}
    for k, v in given.items():
        try:
            out[k] = canonical.canonical_json(canonical.canon_value(v))
        except (ValueError, TypeError):
            out[k] = "error"
    return out | {"hash": canonical.sha256_of([])}


@cases(
    "hash_laws",
    {
        "maps written out": "same", "another flow's name": "same", "a hook": "same", "other wires": "other", "another boundary": "other", "a rule": "other", "order of steps": "other",
        "constant from a file": "same", "constant by a bare value": "same", "another constant": "other", "compiled: same pattern": "same", "compiled: other beyond 200 characters": "other",
        "compiled: from a file": "other", "trainable: another name": "same", "trainable: streams": "same", "trainable: default written out": "same", "trainable: order of outputs": "other",
        "trainable: description": "other", "trainable: model": "other", "bundle or its nodes": "same",
    },
)
def hash_laws() -> dict[str, str]:
    """What changes a plan's hash, and what doesn't."""
    r = _steps()

    def h(flow: Flow, registry: Registry = r) -> str:
        return identity.pipeline_hash(compile_flow(flow, registry))

    long = "x" * 250
    r.add(load.step({"transform": {}, "reads": {"a": S}, "output_schema": {"e": S}, "bindings": {"find": {"pattern": S, "compile": "regex"}}}, "find"))

    def found(pattern: str) -> str:
        return h(_flow(_node("find", bindings={"find": {"pattern": pattern}})))

    def bound(value: Any) -> str:
        return h(_flow(_node("bound", bindings={"mark": value})))

    def model(*given: Any, **more: Any) -> str:
        registry = _steps()
        return identity.pipeline_hash(_with_trainable(registry, *given, **more))

    ruled = _steps().add(load.step({"transform": {}, "reads": {"b": S}, "output_schema": {"c": {"type": "str", "maxLength": 9}, "d": {"type": "int"}}}, "two"))
    bundled = _steps().add(load.composition({"meta": {"kind": "bundle", "name": "x"}, "nodes": [_node("up"), _node("two")]}))
    base = h(_flow("up", "two"))
    pairs = {
        "maps written out": (base, h(_flow(_node("up", reads_map={"a": "a"}), "two"))),
        "another flow's name": (base, h(load.flow({"meta": {"name": "g"}, "nodes": [_node("up"), _node("two")], "inputs": {"a": S}}))),
        "a hook": (base, h(_flow("up", "see", "two"))), "other wires": (base, h(_flow(_node("up", writes_map={"b": "q"}), _node("two", reads_map={"b": "q"})))),
        "another boundary": (base, h(_flow("up", "two", outputs={"c": S}))), "a rule": (base, h(_flow("up", "two"), ruled)),
        "order of steps": (h(_flow("up", _node("bound", bindings={"mark": "-"}))), h(_flow(_node("bound", bindings={"mark": "-"}), "up"))),
        "constant from a file": (bound({"sep": "-"}), bound({"sep": FileText("-")})), "constant by a bare value": (bound({"sep": "-"}), bound("-")), "another constant": (bound("-"), bound("+")),
        "compiled: same pattern": (found(long), found(long)), "compiled: other beyond 200 characters": (found(long + "a"), found(long + "b")), "compiled: from a file": (found("a"), found(FileText("a"))),
        "trainable: another name": (model(), model(name="renamed")), "trainable: streams": (model(), model(streamable=True)), "trainable: default written out": (model(), model(config={"t": 1.0})),
        "trainable: order of outputs": (model(), model({"y": S, "x": S})), "trainable: description": (model(), model({"x": {"type": "str", "description": "d"}, "y": S})),
        "trainable: model": (model(), model(model="2")), "bundle or its nodes": (base, h(_flow({"kind": "composition", "name": "x"}), bundled)),
    }
    return {k: "same" if a == b else "other" for k, (a, b) in pairs.items()}


@cases(
    "derived_bundle",
    {
        "members": "bindings,compositions,embedded,merge,nodes,pipeline_hash,training_bundle_hashes,wires", "nodes": "up>a>b,two>b>c+d", "wires": "a:str,b:str,c:str,d:int", "twice": "same bytes",
        "trainables": "t", "hash of a part": "sha256:", "bindings": "0.mark=+", "composition": "0 streams",
    },
)
def derived_bundle() -> dict[str, str]:
    """What derives from a plan, as one canonical text."""
    plan = compile_flow(_flow("up", "two"), _steps())
    data = json.loads(identity.serialized(plan)[0])
    model = identity.derived(_with_trainable(_steps()))
    bound = identity.derived(compile_flow(_flow(_node("bound", bindings={"mark": "+"})), _steps()))
    streaming = identity.derived(_with_trainable(_steps(), streamable=True))
    return {
        "members": ",".join(sorted(data)), "nodes": ",".join(f"{n['name']}>{'+'.join(n['reads'].values())}>{'+'.join(sorted(n['writes'].values()))}" for n in data["nodes"]),
        "wires": ",".join(f"{k}:{v}" for k, v in sorted(data["wires"].items())), "twice": "same bytes" if identity.serialized(plan) == identity.serialized(plan) else "other bytes",
        "trainables": ",".join(model["training_bundle_hashes"]), "hash of a part": model["training_bundle_hashes"]["t"][:7],
        "bindings": ",".join(f"{k}={v['value']['sep']}" for k, v in bound["bindings"].items()),
        "composition": ",".join(f"{v['positions'][0]} {'streams' if v['streamable'] else 'whole'}" for v in streaming["compositions"].values()),
    }


@cases(
    "drift_events",
    {
        "as trained": "loads", "another shape": "training_bundle_hash_changed pipeline_hash_changed, loads", "another shape, enforced": "training_bundle_hash_changed, halts: drift",
        "acknowledged": "training_bundle_hash_changed pipeline_hash_changed, loads", "another flow only, enforced": "pipeline_hash_changed, loads", "no side file": "loads",
        "no side file, enforced": "halts: manifest-missing", "no such trainable": "halts: artifact-unknown", "side file of no form": "halts: manifest-form",
    },
)
def drift_events() -> dict[str, str]:
    """Artifacts' side files against a plan: the events of the log, and which loads halt."""
    import tempfile
    from pathlib import Path

    plan = _with_trainable(_steps())
    other = _with_trainable(_steps(), {"x": {"type": "str", "maxLength": 3}, "y": S})
    registry = _steps().add(load.composition(_trainable()), at="t")
    wider = compile_flow(_flow({"kind": "composition", "name": "t"}, "up"), registry)

    def load_of(side: str | None, name: str = "t", enforced: bool = False, taken: bool = False) -> str:
        with tempfile.TemporaryDirectory() as folder:  # the driver's own, as deployments are
            if side is not None:
                Path(folder, f"model.bin{SUFFIX}").write_text(side, encoding="utf-8")
            given: dict[str, Any] = {"training_contract": {"integrity_enforcement": enforced}, "artifacts": {name: "model.bin"}}
            if taken:
                given["acknowledged_drift"] = [{"artifact": "model.bin", "trainable": name}]
            try:
                events = check_artifacts(plan, Registry(), load.deployment(given), folder)
                return ", ".join([*([" ".join(e["event_type"] for e in events)] if events else []), "loads"])
            except DriftError as e:
                return f"{' '.join(x['event_type'] for x in e.events)}, halts: {e.code}"
            except PlanError as e:
                return f"halts: {e.code}"

    own, changed = side_file("model.bin", plan), side_file("model.bin", other)
    return {
        "as trained": load_of(own, enforced=True), "another shape": load_of(changed), "another shape, enforced": load_of(changed, enforced=True),
        "acknowledged": load_of(changed, enforced=True, taken=True), "another flow only, enforced": load_of(side_file("model.bin", wider), enforced=True), "no side file": load_of(None),
        "no side file, enforced": load_of(None, enforced=True), "no such trainable": load_of(own, name="z"), "side file of no form": load_of("artifact = 3\n"),
    }


@cases("manifest_rows", {"m t": "sha256:1 a,b", "m u": "sha256:2 a,b"})
def manifest_rows() -> dict[str, str]:
    """An artifact's side file as rows."""
    m = manifest('artifact = "m"\npipeline_hash_set = ["a", "b"]\n[training_bundle_hashes]\nt = "sha256:1"\nu = "sha256:2"\n')
    return {f"{m['artifact']} {t}": f"{h} {','.join(m['pipelines'])}" for t, h in m["bundles"].items()}


@pytest.mark.parametrize("name,made,expected", CASES, ids=[c[0] for c in CASES])
def test_cases(name, made, expected):
    assert made() == expected


def test_seeds_leave_out_undeclared_keys(spark):
    from pyspark.sql import functions as F

    from loomwork.plans.execute import transform
    from loomwork.sources import tables

    r = Registry().add(load.step({"transform": {}, "reads": {"a": S}, "output_schema": {"b": S}}, "up"))
    r.columns("up")(lambda a: {"b": F.upper(a)})
    plan = compile_flow(load.flow({"meta": {"name": "f"}, "nodes": [_node("up")], "inputs": {"a": S}}), r)
    rows = [{"run_id": "1", "a": "a", "more": 1}, {"run_id": "2", "a": "b"}]
    assert sorted(map(tuple, transform(plan, tables.seeds(spark, rows, plan), r).state().collect())) == [("1", "A"), ("2", "B")]
