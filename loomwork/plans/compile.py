"""From declarations to a checked plan: substitution, flattening, wiring and the static checks.

Checks run in three stages, each of which reports all that it finds: the nodes and their wiring,
the topology of wires, and the cover of the deployment.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from loomwork.functions.canonical import embed_name
from loomwork.functions.rendering import RESERVED, RenderError, grammar, object_schema
from loomwork.functions.types import Field
from loomwork.operators.folds import accepts
from loomwork.plans.errors import Findings, PlanError
from loomwork.plans.model import Bundle, Deployment, FileText, Flow, Node, Registry, Step, Trainable
from loomwork.plans.values import misfits, signature_misfit

SEED = -1
_SECRET = re.compile(r"\[[a-z]+\].+", re.S)


@dataclass(frozen=True)
class Call:
    """A node of a plan: what it runs, where its ports are wired, and what constants it gets."""

    position: int
    name: str
    kind: str
    step: Step | None
    reads: Mapping[str, str]
    writes: Mapping[str, str]
    bindings: Mapping[str, Any] = field(default_factory=dict)
    service: str | None = None
    supply: Mapping[str, Any] = field(default_factory=dict)
    config: Mapping[str, Any] = field(default_factory=dict)
    transport: Mapping[str, Any] = field(default_factory=dict)
    inner: Plan | None = None
    composition: str | None = None
    streamable: bool = False
    #: What compiled constants were made from.
    sources: Mapping[str, Any] = field(default_factory=dict)

    @property
    def read_fields(self) -> Mapping[str, Field]:
        return self.inner.inputs if self.inner else self.step.reads

    @property
    def write_fields(self) -> Mapping[str, Field]:
        return self.inner.outputs if self.inner else self.step.outputs


@dataclass(frozen=True)
class Plan:
    """A checked flow: its calls in order, the type of each wire, and who contributes to it in order."""

    name: str
    calls: tuple[Call, ...]
    wires: Mapping[str, Field]
    inputs: Mapping[str, Field]
    outputs: Mapping[str, Field]
    merge: Mapping[str, str]
    contributors: Mapping[str, tuple[tuple[int, str | None], ...]]
    scoped: frozenset[str]
    flow: Flow

    @property
    def public(self) -> list[str]:
        """The wires of a result: written, and of no composition's scope."""
        return sorted(w for w, c in self.contributors.items() if w not in self.scoped and any(p != SEED for p, _ in c))


def substitute(nodes: tuple[Node, ...], registry: Registry, path: tuple[str, ...] = ()) -> tuple[Node, ...]:
    """The nodes with every bundle replaced by its own, at any depth."""
    out: list[Node] = []
    for n in nodes:
        found = registry.embeds.get(n.name) if n.kind == "composition" else None
        if isinstance(found, Bundle):
            if n.name in path:
                raise PlanError("embed-cycle", " in ".join((n.name, *reversed(path))))
            out.extend(substitute(found.nodes, registry, (*path, n.name)))
        else:
            out.append(n)
    return tuple(out)


def _wired(node: Node, step: Step, found: Findings, where: str) -> tuple[dict[str, str], dict[str, str]]:
    """Total maps from ports to wires; a port that isn't mapped is wired to its own name."""
    for given, ports, what in ((node.reads, step.reads, "reads"), (node.writes, step.outputs, "writes")):
        for port in given:
            if port not in ports:
                found.add("unknown-port", f"{what} no port {port}", where)
    reads = {p: node.reads.get(p, p) for p in step.reads}
    named = [p for p in node.writes if p in step.outputs]  # mapped ports in the map's order, then the rest
    writes = {p: node.writes.get(p, p) for p in [*named, *(p for p in step.outputs if p not in node.writes)]}
    both = set(reads.values()) & set(writes.values())
    if both:
        found.add("read-write-overlap", f"reads and writes {', '.join(sorted(both))}", where)
    return reads, writes


def _bound(node: Node, step: Step, found: Findings, where: str) -> tuple[dict[str, Any], dict[str, Any]]:
    """The step's constants as its body gets them, and what compilers made them from."""
    out: dict[str, Any] = {}
    sources: dict[str, Any] = {}
    for name in node.bindings:
        if name not in step.bindings:
            found.add("binding-unknown", f"no binding {name}", where)
    for name, decl in step.bindings.items():
        if name in node.bindings:
            value = node.bindings[name]
            value = None if value == {"null": True} else value if decl.compiler else _inline(value)
            if decl.single or not isinstance(value, Mapping):
                if not decl.single and len(decl.fields) == 1:
                    value = {next(iter(decl.fields)): value}  # a lone field takes a bare value
                elif not decl.single:
                    found.add("binding-value", f"{name} takes a table", where)
                    continue
            if isinstance(value, Mapping) and not decl.single:
                for k in set(value) ^ set(decl.fields):
                    found.add("binding-value", f"{name}.{k} is " + ("not declared" if k in value else "missing"), where)
            if not decl.compiler:
                wanted = {"": value} if decl.single else value
                for k, f in decl.fields.items():
                    if isinstance(wanted, Mapping) and k in wanted:
                        for said in misfits(wanted[k], f, f"{name}.{k}".rstrip(".")):
                            found.add("binding-value", said, where)
        elif decl.has_default:
            value = decl.default
        else:
            found.add("binding-missing", f"no value for {name}", where)
            continue
        out[name] = _compiled(decl.compiler, value, found, where)
        if decl.compiler:
            sources[name] = value
    return out, sources


def _inline(value: Any) -> Any:
    """Text from a file as the same text written out."""
    if isinstance(value, FileText):
        return str(value)
    return {k: _inline(v) for k, v in value.items()} if isinstance(value, Mapping) else value


def _compiled(name: str | None, value: Any, found: Findings, where: str) -> Any:
    if name is None:
        return value
    from loomwork.functions.rendering import COMPILERS

    if name not in COMPILERS:
        found.add("binding-value", f"no compiler {name}", where)
        return value
    try:
        return COMPILERS[name](**value) if isinstance(value, Mapping) else COMPILERS[name](value)
    except Exception as e:  # any failure of a compiler is a finding
        found.add("binding-value", f"{name} fails: {e}", where)
        return value


def _service(refs: Mapping[str, str], supplies: Mapping, own_config: Mapping[str, Any] | None, registry: Registry, found: Findings, where: str):
    """(binding, identity, configuration) of a step's service."""
    if not refs:
        return None, {}, {}
    binding, type_name = next(iter(refs.items()))
    service = registry.services.get(type_name)
    supply = supplies.get(binding)
    if service is None:
        found.add("unknown-service", f"no service type {type_name}", where)
        return binding, {}, {}
    if supply is None or supply.type != type_name:
        found.add("identity-missing", f"no supply for {binding} of type {type_name}", where)
        return binding, {}, {}
    for k in set(service.identity) - set(supply.identity):
        found.add("identity-missing", f"{binding} has no {k}", where)
    for k in set(supply.identity) - set(service.identity):
        found.add("identity-unknown", f"{binding} has no identity {k}", where)
    given = supply.config if own_config is None else own_config
    for k in set(given) - set(service.config):
        found.add("config-unknown", f"{binding} has no configuration {k}", where)
    config = {}
    for k, f in service.config.items():
        if k in given:
            config[k] = given[k]
        elif f.has_default:
            config[k] = f.default
        else:
            found.add("config-missing", f"{binding} needs {k}", where)
    for values, fields, code in ((supply.identity, service.identity, "binding-value"), (config, service.config, "binding-value")):
        for k, f in fields.items():
            for said in misfits(values[k], f, f"{binding}.{k}") if k in values else ():
                found.add(code, said, where)
    return binding, dict(supply.identity), config


def compile_flow(flow: Flow, registry: Registry, deployment: Deployment | None = None, _path: tuple[str, ...] = ()) -> Plan:
    """The flow's plan; raises PlanError or a group of them."""
    if flow.name in _path:
        raise PlanError("embed-cycle", " in ".join((flow.name, *reversed(_path))))
    found = Findings()
    calls: list[Call] = []
    scoped: set[str] = set()
    embedded: set[str] = set()
    extra_merge: dict[str, str] = {}
    for node in substitute(flow.nodes, registry):
        where = f"{embed_name(flow.name, len(calls))} {node.name}"
        if node.kind == "handler":
            _add_step(calls, node, flow.supplies, registry, found, where)
            continue
        inner = registry.embeds.get(node.name)
        if inner is None:
            found.add("unknown-embed", f"no composition {node.name}", where)
        elif isinstance(inner, Flow):
            plan = compile_flow(inner, registry, None, (*_path, flow.name))
            reads, writes = {p: p for p in plan.inputs}, {p: p for p in plan.outputs}
            calls.append(Call(len(calls), inner.name, "pipeline", None, reads, writes, inner=plan))
        else:
            if inner.name in embedded:
                found.add("duplicate-name", f"{inner.name} is embedded twice", where)
            embedded.add(inner.name)
            _add_trainable(calls, inner, registry, found, where, scoped, extra_merge)
    for k, c in enumerate(calls):
        if c.streamable and k < len(calls) - 1 and any(x.kind != "hook" for x in calls[k + 1 :]):
            found.add("stream-placement", f"{c.name} streams but isn't last", flow.name)
    found.done()
    plan = _topology(flow, calls, {**flow.merge, **extra_merge}, frozenset(scoped))
    return cover(plan, registry, deployment) if deployment is not None else plan


def _add_step(calls: list[Call], node: Node, supplies: Mapping, registry: Registry, found: Findings, where: str) -> None:
    step = registry.steps.get(node.name)
    if step is None:
        found.add("unknown-step", f"no step {node.name}", where)
        return
    reads, writes = _wired(node, step, found, where)
    binding, identity, config = _service(step.services, supplies, None, registry, found, where)
    body = registry.bodies.get(step.name)
    if body is not None:
        misfit = signature_misfit(body.call, [*step.reads, *step.bindings, *step.services, *step.transport])
        if misfit:
            found.add("step-signature", f"its body {misfit}", where)
    bound, sources = _bound(node, step, found, where)
    calls.append(Call(len(calls), step.name, step.kind, step, reads, writes, bound, binding, identity, config, sources=sources))


def _add_trainable(calls: list[Call], t: Trainable, registry: Registry, found: Findings, where: str, scoped: set[str], merge: dict[str, str]) -> None:
    """Preparing steps, then the model call; wires but inputs and outputs get the composition's scope."""
    public = set(t.inputs) | set(t.outputs)

    def name(wire: str) -> str:
        if wire in public:
            return wire
        scoped.add(f"{t.name}.{wire}")
        return f"{t.name}.{wire}"

    first = len(calls)
    for node in t.prepare:
        _add_step(calls, node, t.supplies, registry, found, f"{where}/{node.id}")
    for k in range(first, len(calls)):
        c = calls[k]
        calls[k] = replace(c, reads={p: name(w) for p, w in c.reads.items()}, writes={p: name(w) for p, w in c.writes.items()}, composition=t.name)
    binding, identity, config = _service(t.services, t.supplies, t.config, registry, found, where)
    step = Step(t.name, "trainable", t.reads, t.emits, services=t.services)
    backend = registry.backends.get(next(iter(t.services.values()), ""))
    if backend is not None:
        _certified(backend, t, found, where)
    reads, writes = {p: name(p) for p in t.reads}, {p: name(p) for p in t.emits}
    calls.append(Call(len(calls), t.name, "trainable", step, reads, writes, {}, binding, identity, config, composition=t.name, streamable=t.streamable))
    merge.update({name(w): s for w, s in t.merge.items()})


def _certified(backend: Any, t: Trainable, found: Findings, where: str) -> None:
    """What a backend must be able to do for a trainable, told before anything runs."""
    if t.streamable and not callable(getattr(backend, "fragments", None)) and not hasattr(backend, "open"):
        found.add("backend-capability", f"{t.name} streams, but its backend has no fragments", where)
    form = getattr(backend, "form", "json_schema")
    try:
        grammar(object_schema(t.emits, "gbnf")) if form == "gbnf" else object_schema(t.emits, form)
    except RenderError as e:
        found.add("backend-capability", f"{t.name}: {e}", where)
    extras = t.config.get("extras") if isinstance(t.config, Mapping) else None
    taken = RESERVED & set(extras) if isinstance(extras, Mapping) else set()
    if taken:
        found.add("config-unknown", f"extras may not set {', '.join(sorted(taken))}", where)
    if not hasattr(backend, "open") and callable(backend):
        misfit = signature_misfit(backend if not hasattr(backend, "__call__") else backend.__call__, ["payload", "schema", "identity", "config", "transport"])
        if misfit and not _optional_budget(misfit):
            found.add("backend-capability", f"the backend of {t.name} {misfit}", where)


def _optional_budget(misfit: str) -> bool:
    return misfit == "needs remaining_budget_ms"


def _topology(flow: Flow, calls: list[Call], merge: Mapping[str, str], scoped: frozenset[str]) -> Plan:
    found = Findings()
    wires: dict[str, Field] = {}
    contributors: dict[str, list[tuple[int, str | None]]] = {}

    def meet(wire: str, f: Field, where: str) -> None:
        known = wires.setdefault(wire, f)
        if known.type.text() != f.type.text():
            found.add("shape-mismatch", f"{wire} is {known.type.text()} and {f.type.text()}", where)

    for w, f in flow.inputs.items():
        meet(w, f, f"{flow.name}.inputs")
        contributors.setdefault(w, []).append((SEED, None))
    read: set[str] = set()
    for c in calls:
        where = f"{flow.name}[{c.position}] {c.name}"
        for port, w in c.reads.items():
            read.add(w)
            meet(w, c.read_fields[port], where)
            if w not in contributors:
                later = any(w in x.writes.values() for x in calls[c.position :])
                identity = w == port and not later
                found.add("dangling-port" if identity else "unclosed-read", f"reads {w}, which nothing before it writes", where)
        for port, w in c.writes.items():
            meet(w, c.write_fields[port], where)
            contributors.setdefault(w, []).append((c.position, port))
    for w, who in contributors.items():
        if len(who) > 1 and w not in merge:
            found.add("two-writers", f"{w} has {len(who)} contributors and no merge", flow.name)
    for w, strategy in merge.items():
        if w not in contributors:
            found.add("unwired-merge", f"nothing contributes to {w}", flow.name)
        elif wires[w].type.kind == "optional" or not accepts(strategy, wires[w].type.to_spark()):
            found.add("merge-type", f"{strategy} doesn't fold {wires[w].type.text()}", flow.name)
    for w in flow.inputs:
        if w not in read and w not in flow.outputs:
            found.add("dead-boundary", f"nothing reads the input {w}", flow.name)
    for w, f in flow.outputs.items():
        if w not in contributors:
            found.add("dead-boundary", f"nothing writes the output {w}", flow.name)
        else:
            meet(w, f, f"{flow.name}.outputs")
    found.done()
    return Plan(flow.name, tuple(calls), wires, flow.inputs, flow.outputs, dict(merge), {w: tuple(c) for w, c in contributors.items()}, scoped, flow)


def cover(plan: Plan, registry: Registry, deployment: Deployment) -> Plan:
    """The plan with the deployment's transport; raises what the deployment lacks or has too much of."""
    found = Findings()
    shared = {**deployment.transport, **deployment.flows.get(plan.name, {}).get("transport", {})}
    calls, used = [], set()
    for c in plan.calls:
        where = f"{plan.name}[{c.position}] {c.name}"
        if c.inner is not None:
            calls.append(replace(c, inner=cover(c.inner, registry, deployment)))
            continue
        given: Mapping[str, Any] = {}
        if c.service is not None:
            used.add(c.service)
            schema = registry.services[next(iter(c.step.services.values()))].transport
            given = shared.get(c.service, {})
            _transport(schema, given, found, c.service, where)
        if c.kind == "hook":
            given = {**given, **deployment.hook_transport.get(c.name, {})}
            for k in c.step.transport:
                if k not in given and c.step.transport[k].type.kind != "optional":
                    found.add("hook-transport-missing", f"no {k}", where)
                for said in misfits(given[k], c.step.transport[k], k) if k in given else ():
                    found.add("transport-value", said, where)
            for k in set(deployment.hook_transport.get(c.name, {})) - set(c.step.transport):
                found.add("transport-unknown", f"{c.name} has no transport {k}", where)
        calls.append(replace(c, transport=dict(given)))
    found.done()
    return replace(plan, calls=tuple(calls))


def _transport(schema: Mapping[str, Field], given: Mapping[str, Any], found: Findings, binding: str, where: str) -> None:
    for k, f in schema.items():
        if k not in given and f.type.kind != "optional":
            found.add("transport-missing", f"{binding} has no {k}", where)
        elif f.type.bare.kind == "secret_ref" and given.get(k) is not None and not _SECRET.fullmatch(str(given[k])):
            found.add("secret-form", f"{binding}.{k} is no [scheme]name", where)
        elif k in given:
            for said in misfits(given[k], f, f"{binding}.{k}"):
                found.add("transport-value", said, where)
    for k in set(given) - set(schema):
        found.add("transport-unknown", f"{binding} has no transport {k}", where)
