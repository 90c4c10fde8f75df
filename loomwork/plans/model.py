"""What declarations say: steps, services, flows, compositions and deployments."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from loomwork.functions.types import Field

#: Groups of entry points, and what their entries are.
ENTRY_POINTS = {"loomwork.bodies": "body", "loomwork.backends": "backend"}
STEP_KINDS = ("transform", "service", "hook", "trainable")


class FileText(str):
    """Text that a binding's file holds."""


@dataclass(frozen=True)
class BindingDecl:
    """A constant that a step gets: its fields (one unnamed field for a bare value), default and delivery."""

    fields: Mapping[str, Field]
    single: bool = False
    default: Any = None
    has_default: bool = False
    compiler: str | None = None
    delivery: str = "copy"


@dataclass(frozen=True)
class Step:
    """A declared step.  body: how it runs, see ``Registry.implement``."""

    name: str
    kind: str
    reads: Mapping[str, Field]
    outputs: Mapping[str, Field]
    bindings: Mapping[str, BindingDecl] = field(default_factory=dict)
    services: Mapping[str, str] = field(default_factory=dict)
    transport: Mapping[str, Field] = field(default_factory=dict)
    annotations: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class ServiceType:
    name: str
    identity: Mapping[str, Field]
    transport: Mapping[str, Field]
    config: Mapping[str, Field]
    description: str | None = None
    annotations: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Supply:
    """What a flow gives a service: its type, identity values and configuration."""

    type: str
    identity: Mapping[str, Any] = field(default_factory=dict)
    config: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Node:
    """A place in a flow: a step, or an embedded composition, by name."""

    kind: str
    name: str
    bindings: Mapping[str, Any] = field(default_factory=dict)
    reads: Mapping[str, str] = field(default_factory=dict)
    writes: Mapping[str, str] = field(default_factory=dict)
    id: str | None = None


@dataclass(frozen=True)
class Flow:
    """A pipeline; nested: one that others embed as a node of its own runs."""

    name: str
    nodes: tuple[Node, ...]
    inputs: Mapping[str, Field] = field(default_factory=dict)
    outputs: Mapping[str, Field] = field(default_factory=dict)
    merge: Mapping[str, str] = field(default_factory=dict)
    supplies: Mapping[str, Supply] = field(default_factory=dict)
    nested: bool = False
    annotations: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Trainable:
    """A composition of preparing steps and one model call, flattened where it is embedded."""

    name: str
    inputs: Mapping[str, Field]
    outputs: Mapping[str, Field]
    prepare: tuple[Node, ...]
    reads: Mapping[str, Field]
    emits: Mapping[str, Field]
    services: Mapping[str, str]
    config: Mapping[str, Any] = field(default_factory=dict)
    supplies: Mapping[str, Supply] = field(default_factory=dict)
    merge: Mapping[str, str] = field(default_factory=dict)
    streamable: bool = False
    annotations: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Bundle:
    """Nodes that stand in for a node that names them."""

    name: str
    nodes: tuple[Node, ...]
    annotations: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Deployment:
    transport: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    hook_transport: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    enforced: bool = False
    artifacts: Mapping[str, Any] = field(default_factory=dict)
    acknowledged: tuple[tuple[str, str], ...] = ()
    flows: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)


@dataclass
class Body:
    """columns: f(reads and bindings) -> {port: Column}; rows: f(reads and bindings) -> {port: value}."""

    call: Callable[..., Any]
    style: str = "columns"


@dataclass
class Registry:
    """Declarations and bodies by name; backends by the name of their service type."""

    steps: dict[str, Step] = field(default_factory=dict)
    services: dict[str, ServiceType] = field(default_factory=dict)
    embeds: dict[str, Flow | Trainable | Bundle] = field(default_factory=dict)
    bodies: dict[str, Body] = field(default_factory=dict)
    backends: dict[str, Any] = field(default_factory=dict)

    def add(self, *declared: Step | ServiceType | Flow | Trainable | Bundle, at: str | None = None) -> Registry:
        """at: the name under which a composition is embedded, its own by default."""
        for d in declared:
            if isinstance(d, Step):
                self.steps[d.name] = d
            elif isinstance(d, ServiceType):
                self.services[d.name] = d
            else:
                self.embeds[at or d.name] = d
        return self

    def columns(self, name: str) -> Callable:
        """Registers a function of columns as a step's body: Catalyst sees through it."""
        return self._keep(name, "columns")

    def rows(self, name: str) -> Callable:
        """Registers a Python function of values as a step's body; it runs in Arrow batches."""
        return self._keep(name, "rows")

    def installed(self, found: Any = None) -> Registry:
        """Adds what installed packages offer under the groups of ``ENTRY_POINTS``.

        Bodies are functions with an attribute ``style`` (columns by default), backends are made by
        calling what the entry names.  A name that is taken already is an error.
        """
        from importlib.metadata import entry_points

        for group, kind in ENTRY_POINTS.items():
            for entry in (found if found is not None else entry_points()).select(group=group):
                made, known = entry.load(), self.bodies if kind == "body" else self.backends
                if entry.name in known:
                    raise ValueError(f"{entry.name} is offered twice")
                known[entry.name] = Body(made, getattr(made, "style", "columns")) if kind == "body" else made()
        return self

    def _keep(self, name: str, style: str) -> Callable:
        def keep(f: Callable) -> Callable:
            self.bodies[name] = Body(f, style)
            return f

        return keep
