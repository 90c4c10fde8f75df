"""Helpers for tests of flows: run some rows, look at what happened, and check fakes."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Row, SparkSession

from loomwork.functions.rendering import object_schema
from loomwork.operators.folds import STRATEGIES
from loomwork.plans.compile import Plan, compile_flow
from loomwork.plans.execute import transform
from loomwork.plans.load import loads
from loomwork.plans.model import Deployment, Registry
from loomwork.plans.values import misfits
from loomwork.sources.tables import seeds


@dataclass
class Captured:
    state: list[Row]
    errors: list[Row]
    events: list[Row]


def run_and_capture(spark: SparkSession, plan: Plan, registry: Registry, rows: list[Mapping[str, Any]]) -> Captured:
    """The results of a few runs, on the driver."""
    out = transform(plan, seeds(spark, rows, plan), registry)
    return Captured(out.state().collect(), out.errors().collect(), out.events().collect())


def inspect_state(events: list[Row], plan: Plan, run: str, position: int) -> dict[str, Any]:
    """What each wire without a merge holds before the position, from a run's events."""
    mine = [e for e in events if e.pipeline_run_id == run]
    start = next(e for e in mine if e.event_type == "pipeline_start")
    state = json.loads(start.inputs_snapshot)
    for e in sorted((e for e in mine if e.event_type == "handler_exit" and e.handler_position < position), key=lambda e: e.handler_position):
        written = json.loads(e.writes_snapshot or "{}")
        state.update({w: written[p] for p, w in plan.calls[e.handler_position].writes.items()})
    return {w: v for w, v in state.items() if plan.merge.get(w) not in STRATEGIES}


class VerifiedFake:
    """A backend of canned answers that rejects what it is not declared to give."""

    def __init__(self, plan: Plan, name: str, answer: Callable[[Any], Mapping[str, Any]]):
        call = next(c for c in plan.calls if c.name == name and c.kind == "trainable")
        self.fields, self.answer, self.schema = dict(call.step.outputs), answer, object_schema(call.step.outputs)

    def __call__(self, payload: Any, schema: Mapping[str, Any] | None, **_: Any) -> str:
        if schema != self.schema:
            raise ValueError("asked for another schema than the declared one")
        out = dict(self.answer(payload))
        wrong = [s for k, f in self.fields.items() if k in out for s in misfits(out[k], f, k)]
        if set(out) != set(self.fields) or wrong:
            raise ValueError(f"the fake's answer doesn't fit: {wrong or sorted(out)}")
        return json.dumps(out)


def body_of(registry: Registry, name: str) -> Callable:
    """A step's body, to be called in a test."""
    return registry.bodies[name].call


def load_plan(text: str, registry: Registry, deployment_text: str | None = None) -> Plan:
    """A plan from TOML text."""
    deployment: Deployment | None = loads(deployment_text, "deployment") if deployment_text is not None else None
    return compile_flow(loads(text, "pipeline"), registry, deployment)
