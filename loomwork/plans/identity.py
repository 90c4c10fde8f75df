"""Content hashes of plans and trainables, and the bundle of what derives from a plan.

The pipeline hash covers ordered nodes but hooks, their wiring, constants and supplies, the merges
and the boundary; names of flows and annotations don't count.  A trainable is covered by its own
bundle hash: preparing steps, the model call's reads and ordered outputs (nested members in order
too), services' identity and effective configuration.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from loomwork.functions.canonical import canon_schema, canon_value, canonical_json, sha256_of
from loomwork.plans.compile import Call, Plan
from loomwork.plans.model import FileText, Registry


def _constants(c: Call) -> Any:
    out = {}
    for k, v in c.bindings.items():
        decl = c.step.bindings.get(k)
        compiled = decl is not None and decl.compiler is not None
        # a compiled constant is told by its compiler and what that was given, never by the object
        value = _compiled_from(c.sources[k]) if compiled else canon_value(v)
        out[k] = {"value": value, "delivery": decl.delivery if decl else "copy", "compiler": decl.compiler if decl else None}
    return out


def _compiled_from(value: Any) -> Any:
    """A compiler's parameters; text that came from a file is told apart from the same text written out."""
    if isinstance(value, FileText):
        return {"$file": str(value)}
    if isinstance(value, Mapping):
        return {k: _compiled_from(v) for k, v in value.items()}
    return canon_value(value)


def _call(c: Call, name: str | None) -> dict[str, Any]:
    return {
        "name": name, "kind": c.kind, "reads": dict(c.reads), "writes": dict(c.writes), "read_fields": canon_schema(c.read_fields),
        "write_fields": canon_schema(c.write_fields, ordered=c.kind == "trainable"), "constants": _constants(c) if c.step else {},
        "services": dict(c.step.services) if c.step else {}, "identity": canon_value(c.supply), "config": canon_value(c.config),
    }


def bundle_hash(plan: Plan, name: str) -> str:
    """Of the trainable composition with that name in the plan."""
    calls = [c for c in plan.calls if c.composition == name]
    scope = f"{name}."

    def bare(wires: Any) -> dict[str, str]:
        return {p: w.removeprefix(scope) for p, w in wires.items()}

    out = []
    for c in calls:
        if c.kind == "hook":
            continue
        shown = _call(c, None if c.kind == "trainable" else c.name)
        out.append(shown | {"reads": bare(c.reads), "writes": bare(c.writes)})
    merge = {w.removeprefix(scope): s for w, s in plan.merge.items() if w in plan.scoped and w.startswith(scope)}
    return sha256_of({"calls": out, "merge": merge})


def trainables(plan: Plan) -> list[str]:
    """The names of all trainables, nested flows' included."""
    out: list[str] = []
    for c in plan.calls:
        if c.inner is not None:
            out += trainables(c.inner)
        elif c.kind == "trainable":
            out.append(c.name)
    if len(set(out)) < len(out):
        raise ValueError("one trainable is reached twice, so its hash has no one place")
    return out


def bundle_hashes(plan: Plan) -> dict[str, str]:
    out = {c.name: bundle_hash(plan, c.name) for c in plan.calls if c.kind == "trainable"}
    for c in plan.calls:
        if c.inner is not None:
            out |= bundle_hashes(c.inner)
    return out


def pipeline_hash(plan: Plan, registry: Registry | None = None) -> str:
    nodes: list[Any] = []
    for c in plan.calls:
        if c.kind == "hook":
            continue
        if c.inner is not None:
            nodes.append({"embed": pipeline_hash(c.inner, registry), "reads": dict(c.reads), "writes": dict(c.writes)})
        elif c.kind == "trainable":
            nodes.append({"trainable": bundle_hash(plan, c.name)})
        elif c.composition is None:
            nodes.append(_call(c, c.name))
    return sha256_of({
        "nodes": nodes, "merge": {w: s for w, s in plan.merge.items() if w not in plan.scoped},
        "inputs": canon_schema(plan.inputs), "outputs": canon_schema(plan.outputs),
    })


def derived(plan: Plan) -> dict[str, Any]:
    """What derives from a plan, as JSON data: hashes, nodes, constants, wires and compositions."""
    compositions = {}
    for name in sorted({c.composition for c in plan.calls if c.composition}):
        own = [c for c in plan.calls if c.composition == name]
        compositions[name] = {
            "positions": [c.position for c in own], "streamable": any(c.streamable for c in own),
            "training_bundle_hash": bundle_hash(plan, name), "wires": sorted(w for w in plan.scoped if w.startswith(f"{name}.")),
        }
    return {
        "pipeline_hash": pipeline_hash(plan),
        "training_bundle_hashes": bundle_hashes(plan),
        "nodes": [_call(c, c.name) | {"position": c.position} for c in plan.calls],
        "wires": {w: f.type.text() for w, f in plan.wires.items()},
        "merge": dict(plan.merge),
        "compositions": compositions,
        "bindings": {f"{c.position}.{k}": v for c in plan.calls if c.step for k, v in _constants(c).items()},
        "embedded": {str(c.position): derived(c.inner) for c in plan.calls if c.inner is not None},
    }


def serialized(plan: Plan) -> tuple[str, str]:
    """The derived bundle as canonical text, and the hash of that."""
    data = derived(plan)
    return canonical_json(data), sha256_of(data)


_TABLES = {
    "nodes": "flow string, position int, name string, kind string, reads map<string,string>, writes map<string,string>",
    "wires": "flow string, wire string, type string, strategy string, scoped boolean",
    "bindings": "flow string, position int, name string, constant string, value string, hash string",
    "compositions": "flow string, composition string, position int, streamable boolean, training_bundle_hash string",
}


def snapshots(spark: SparkSession, plan: Plan) -> dict[str, DataFrame]:
    """Nodes, wires, bindings and compositions of a plan and of those nested in it, as tables to join with the log.

    flow is the pipeline hash; what a node of a nested flow is called there has that flow's hash.
    """
    rows: dict[str, list[tuple]] = {name: [] for name in _TABLES}

    def add(p: Plan) -> None:
        flow = pipeline_hash(p)
        for c in p.calls:
            rows["nodes"].append((flow, c.position, c.name, c.kind, dict(c.reads), dict(c.writes)))
            if c.step:
                rows["bindings"] += [(flow, c.position, c.name, k, canonical_json(v), sha256_of(v)) for k, v in _constants(c).items()]
            if c.composition:
                rows["compositions"].append((flow, c.composition, c.position, c.streamable, bundle_hash(p, c.composition)))
            if c.inner is not None:
                add(c.inner)
        rows["wires"] += [(flow, w, f.type.text(), p.merge.get(w), w in p.scoped) for w, f in p.wires.items()]

    add(plan)
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in _TABLES.items()}
