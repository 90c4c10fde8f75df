"""Declarations from TOML.  Key sets are closed; tables that must be present may be empty."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from loomwork.functions import rules as value_rules
from loomwork.functions.types import Field, Type, TypeTokenError, column_safe, dict_of, list_of, nested, optional, parse_type
from loomwork.operators.folds import STRATEGIES
from loomwork.plans.errors import PlanError
from loomwork.plans.model import BindingDecl, Bundle, Deployment, FileText, Flow, Node, ServiceType, Step, Supply, Trainable

_SHAPE = ("type", "fields", "item", "value")


def _closed(data: Mapping[str, Any], allowed: str, where: str) -> None:
    if not isinstance(data, Mapping):
        raise PlanError("bad-value", "a table is needed", where)
    extra = set(data) - set(allowed.split())
    if extra:
        raise PlanError("closed-keys", f"unknown {', '.join(sorted(extra))}", where)


def _present(data: Mapping[str, Any], needed: str, where: str) -> None:
    for key in needed.split():
        if key not in data:
            raise PlanError("missing-section", f"no {key}", where)


def _body(data: Mapping[str, Any], needed: str, where: str) -> None:
    for key in needed.split():
        if key in data and not data[key]:
            raise PlanError("empty-section", f"{key} has no field", where)


def parse_field(data: Any, where: str, description: bool = False, default: bool = False, ports: bool = True) -> Field:
    """A field: a type token, or a table with one of type, fields, item and value, then nullable and rules."""
    if isinstance(data, str):
        data = {"type": data}
    if not isinstance(data, Mapping):
        raise PlanError("bad-value", "a field is a table", where)
    shape = [k for k in _SHAPE if k in data]
    if len(shape) != 1:
        raise PlanError("bad-type", "a field has exactly one of type, fields, item and value", where)
    try:
        match shape[0]:
            case "type":
                t = parse_type(data["type"])
            case "fields":
                t = nested({k: parse_field(v, f"{where}.{k}", description, False, ports) for k, v in data["fields"].items()})
            case "item" | "value":
                inner = data[shape[0]]
                _closed(inner, "fields item value", f"{where}.{shape[0]}")  # an element has its shape only
                t = (list_of if shape[0] == "item" else dict_of)(parse_field(inner, f"{where}.{shape[0]}", description, False, ports).type)
    except (TypeTokenError, AttributeError) as e:
        raise PlanError("bad-type", str(e), where) from e
    if ports and not column_safe(t):
        raise PlanError("bad-type", f"{t.text()} is declaration data, not a wire's type", where)
    if "nullable" in data:
        if not isinstance(data["nullable"], bool):
            raise PlanError("bad-nullable", "nullable is a boolean", where)
        t = optional(t) if data["nullable"] else t
    rest = {k: v for k, v in data.items() if k not in (*_SHAPE, "nullable", "description", "default")}
    if "description" in data and not description:
        raise PlanError("closed-keys", "description is for the outputs of a trainable", where)
    if "default" in data and not default:
        raise PlanError("closed-keys", "default is for configuration", where)
    found = tuple(rest.items())
    try:
        for keyword, parameter in found:
            value_rules.check_rule(keyword, parameter, t)
        value_rules.check_together(found, t)
    except value_rules.RuleError as e:
        raise PlanError("bad-rule", str(e), where) from e
    return Field(t, found, data.get("description"), data.get("default"), "default" in data)


def parse_fields(data: Any, where: str, **admits: bool) -> dict[str, Field]:
    if not isinstance(data, Mapping):
        raise PlanError("bad-value", "a table of fields is needed", where)
    return {k: parse_field(v, f"{where}.{k}", **admits) for k, v in data.items()}


def _binding_decl(data: Any, where: str) -> BindingDecl:
    if not isinstance(data, Mapping):
        raise PlanError("bad-value", "a binding is declared by a table", where)
    special = {k: data[k] for k in ("default", "compile", "delivery") if k in data and not isinstance(data[k], Mapping)}
    if "default" in data and any(k in data for k in _SHAPE):
        special["default"] = data["default"]
    rest = {k: v for k, v in data.items() if k not in special}
    single = any(k in rest for k in _SHAPE) and not all(isinstance(v, Mapping) and any(s in v for s in _SHAPE) for v in rest.values())
    fields = {"": parse_field(rest, where, ports=False)} if single else parse_fields(rest, where, ports=False)
    return BindingDecl(fields, single, special.get("default"), "default" in special, special.get("compile"), special.get("delivery", "copy"))


def step(data: Mapping[str, Any], name: str) -> Step:
    heads = [k for k in ("transform", "service", "hook") if k in data]
    if len(heads) != 1 or data[heads[0]] != {}:
        raise PlanError("step-header", "a step has one bare header: transform, service or hook", name)
    kind = heads[0]
    keys = {"transform": "reads output_schema bindings annotations", "service": "reads output_schema service_bindings bindings annotations", "hook": "reads service_bindings transport_schema bindings annotations"}[kind]
    _closed(data, f"{kind} {keys}", name)
    _present(data, {"transform": "reads output_schema", "service": "reads output_schema service_bindings", "hook": "reads service_bindings transport_schema"}[kind], name)
    _body(data, "output_schema", name)
    services = _service_refs(data.get("service_bindings", {}), name)
    if kind == "service" and len(services) != 1:
        raise PlanError("service-count", "a service step has exactly one service binding", name)
    return Step(
        name, kind, parse_fields(data["reads"], f"{name}.reads"), parse_fields(data.get("output_schema", {}), f"{name}.output_schema"),
        {k: _binding_decl(v, f"{name}.bindings.{k}") for k, v in data.get("bindings", {}).items()}, services,
        parse_fields(data.get("transport_schema", {}), f"{name}.transport_schema", ports=False), data.get("annotations", {}),
    )


def _service_refs(data: Mapping[str, Any], where: str) -> dict[str, str]:
    for k, v in data.items():
        _closed(v, "type", f"{where}.service_bindings.{k}")
        _present(v, "type", f"{where}.service_bindings.{k}")
    return {k: v["type"] for k, v in data.items()}


def service_type(data: Mapping[str, Any], name: str = "") -> ServiceType:
    _closed(data, "name description identity_schema transport_schema config_schema annotations", name)
    _present(data, "name identity_schema transport_schema config_schema", name)
    _body(data, "identity_schema transport_schema", name)
    name = data["name"]
    return ServiceType(
        name, parse_fields(data["identity_schema"], f"{name}.identity_schema", ports=False), parse_fields(data["transport_schema"], f"{name}.transport_schema", ports=False),
        parse_fields(data["config_schema"], f"{name}.config_schema", ports=False, default=True), data.get("description"), data.get("annotations", {}),
    )


def _node(data: Mapping[str, Any], where: str, prepare: bool = False) -> Node:
    if not isinstance(data, Mapping) or data.get("kind") not in ("handler", "composition") or (prepare and data["kind"] != "handler"):
        raise PlanError("unknown-kind", "a node's kind is handler or composition", where)
    if data["kind"] == "composition":
        _closed(data, "kind name", where)
    else:
        _closed(data, "kind name bindings reads_map writes_map" + " id" * prepare, where)
    _present(data, "name" + " id" * prepare, where)
    for key in ("reads_map", "writes_map"):
        if not all(isinstance(v, str) for v in data.get(key, {}).values()):
            raise PlanError("bad-value", f"{key} maps ports to names", where)
    return Node(data["kind"], data["name"], data.get("bindings", {}), data.get("reads_map", {}), data.get("writes_map", {}), data.get("id"))


def _supplies(data: Mapping[str, Any], where: str) -> dict[str, Supply]:
    out = {}
    for k, v in data.items():
        _present(v, "type", f"{where}.service_bindings.{k}")
        out[k] = Supply(v["type"], {a: b for a, b in v.items() if a not in ("type", "config")}, v.get("config", {}))
    return out


def _merge(data: Mapping[str, Any], where: str) -> dict[str, str]:
    for k, v in data.items():
        if v not in STRATEGIES:
            raise PlanError("merge-type", f"no strategy {v!r} for {k}", where)
    return dict(data)


def _meta(data: Mapping[str, Any], kinded: bool) -> str:
    _present(data, "meta", "")
    _closed(data["meta"], "kind name" if kinded else "name", "meta")
    _present(data["meta"], "name", "meta")
    return data["meta"]["name"]


def flow(data: Mapping[str, Any], nested: bool = False) -> Flow:
    _closed(data, "meta nodes service_bindings merge inputs outputs", "pipeline")
    name = _meta(data, nested)
    _body(data, "outputs", name)
    return Flow(
        name, tuple(_node(n, f"{name}.nodes[{i}]") for i, n in enumerate(data.get("nodes", []))), parse_fields(data.get("inputs", {}), f"{name}.inputs"),
        parse_fields(data.get("outputs", {}), f"{name}.outputs"), _merge(data.get("merge", {}), name), _supplies(data.get("service_bindings", {}), name), nested,
    )


def composition(data: Mapping[str, Any]) -> Flow | Trainable | Bundle:
    """By the kind in meta: trainable, bundle, or a nested pipeline."""
    name = _meta(data, True)
    kind = data["meta"].get("kind")
    if kind == "pipeline":
        return flow(data, True)
    if kind == "bundle":
        _closed(data, "meta nodes annotations", name)
        _body(data, "nodes", name)
        return Bundle(name, tuple(_node(n, f"{name}.nodes[{i}]") for i, n in enumerate(data.get("nodes", []))), data.get("annotations", {}))
    if kind != "trainable":
        raise PlanError("unknown-kind", f"no composition kind {kind!r}", name)
    _closed(data, "meta inputs outputs preprocessors service_bindings trainable merge annotations", name)
    _present(data, "inputs outputs trainable", name)
    _body(data, "outputs", name)
    t = data["trainable"]
    _closed(t, "streamable config service_bindings reads output_schema", f"{name}.trainable")
    _present(t, "config service_bindings reads output_schema", f"{name}.trainable")
    _body(t, "reads output_schema", f"{name}.trainable")
    services = _service_refs(t["service_bindings"], f"{name}.trainable")
    if len(services) != 1:
        raise PlanError("service-count", "a trainable has exactly one service binding", name)
    prepare = tuple(_node(n, f"{name}.preprocessors[{i}]", True) for i, n in enumerate(data.get("preprocessors", [])))
    if len({n.id for n in prepare}) < len(prepare):
        raise PlanError("duplicate-name", "two preprocessors have one id", name)
    return Trainable(
        name, parse_fields(data["inputs"], f"{name}.inputs"), parse_fields(data["outputs"], f"{name}.outputs"), prepare, parse_fields(t["reads"], f"{name}.reads"),
        parse_fields(t["output_schema"], f"{name}.output_schema", description=True), services, t["config"], _supplies(data.get("service_bindings", {}), name),
        _merge(data.get("merge", {}), name), bool(t.get("streamable", False)), data.get("annotations", {}),
    )


def deployment(data: Mapping[str, Any]) -> Deployment:
    _closed(data, "transport hook_transport training_contract training_export artifacts acknowledged_drift annotations pipelines", "deployment")
    _present(data, "training_contract", "deployment")
    taken = tuple((a["artifact"], a["trainable"]) for a in data.get("acknowledged_drift", []))
    return Deployment(
        data.get("transport", {}), data.get("hook_transport", {}), bool(data["training_contract"].get("integrity_enforcement", False)),
        data.get("artifacts", {}), taken, data.get("pipelines", {}),
    )


_KINDS: dict[str, Callable[..., Any]] = {"handler": step, "service_type": service_type, "composition": composition, "pipeline": flow, "deployment": deployment}


def parse(data: Mapping[str, Any], kind: str, name: str = "") -> Any:
    """A declaration of one of the kinds handler, service_type, composition, pipeline and deployment."""
    if kind not in _KINDS:
        raise PlanError("unknown-kind", f"no declaration is a {kind!r}")
    try:
        return _KINDS[kind](data, name) if kind == "handler" else _KINDS[kind](data)
    except (AttributeError, TypeError, KeyError) as e:  # a value where a table is needed, or the reverse
        raise PlanError("bad-value", f"a part has the wrong form: {e}", name) from e


def loads(text: str, kind: str, name: str = "") -> Any:
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise PlanError("bad-value", f"no TOML: {e}", name) from e
    return parse(data, kind, name)


def from_file(value: Any, folder: str | Path) -> Any:
    """A binding's value; ``{file = "path"}`` is what the file holds (TOML, JSON, or text by its suffix)."""
    if isinstance(value, Mapping) and set(value) == {"file"}:
        path = Path(folder) / value["file"]
        text = path.read_text(encoding="utf-8")
        if path.suffix == ".toml":
            return tomllib.loads(text)
        if path.suffix == ".json":
            import json

            return json.loads(text)
        return FileText(text)
    if isinstance(value, Mapping) and any(isinstance(v, Mapping) and set(v) == {"file"} for v in value.values()):
        return {k: from_file(v, folder) for k, v in value.items()}  # a compiler's parameters may each be a file
    return value


def resolve_files(found: Flow, folder: str | Path) -> Flow:
    """The flow with all bindings' files read; a binding from a file equals the same value inline."""
    from dataclasses import replace

    nodes = tuple(replace(n, bindings={k: from_file(v, folder) for k, v in n.bindings.items()}) for n in found.nodes)
    return replace(found, nodes=nodes)
