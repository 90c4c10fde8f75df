"""Trained artifacts against the plan that deploys them: side files, the check, and its drift events."""

from __future__ import annotations

import datetime as dt
import tomllib
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from loomwork.plans.compile import Plan
from loomwork.plans.errors import PlanError
from loomwork.plans.identity import bundle_hash, bundle_hashes, pipeline_hash
from loomwork.plans.model import Deployment, Registry

SUFFIX = ".loomwork.toml"


def side_file(artifact: str, plan: Plan) -> str:
    """The text of an artifact's side file: its name and the hashes of the plan that it was trained for."""
    bundles = "".join(f'"{k}" = "{v}"\n' for k, v in sorted(bundle_hashes(plan).items()))
    return f'artifact = "{Path(artifact).name}"\npipeline_hash_set = ["{pipeline_hash(plan)}"]\n[training_bundle_hashes]\n{bundles}'


def manifest(text: str) -> dict[str, Any]:
    """An artifact's side file: its name, bundle hashes by trainable, and known pipeline hashes."""
    try:
        data = tomllib.loads(text)
        found = {"artifact": data["artifact"], "bundles": dict(data.get("training_bundle_hashes", {})), "pipelines": list(data.get("pipeline_hash_set", []))}
    except (tomllib.TOMLDecodeError, KeyError, TypeError, ValueError) as e:
        raise PlanError("manifest-form", f"the side file doesn't read: {e}") from e
    if not all(isinstance(x, str) for x in (found["artifact"], *found["bundles"].values(), *found["pipelines"])):
        raise PlanError("manifest-form", "hashes and names are text")
    return found


def _places(plan: Plan, out: dict[str, list[Plan]]) -> dict[str, list[Plan]]:
    for c in plan.calls:
        if c.inner is not None:
            _places(c.inner, out)
        elif c.kind == "trainable":
            out.setdefault(c.name, []).append(plan)
    return out


def check_artifacts(plan: Plan, registry: Registry, deployment: Deployment, folder: str | Path = ".") -> list[dict[str, Any]]:
    """The drift events that the deployment's artifacts give, as rows of the event log; raises where a load must halt.

    In the order of registration: a name of no trainable, or of several, halts; a missing side file
    halts under enforcement and is nothing otherwise.  A bundle hash that differs is an event, and
    halts under enforcement unless it is acknowledged; a pipeline hash that the side file hasn't
    seen is an event and never halts.
    """
    events: list[dict[str, Any]] = []
    known, now = _places(plan, {}), pipeline_hash(plan, registry)
    for name, artifact in deployment.artifacts.items():
        where = f"artifacts.{name}"
        if name not in known:
            raise PlanError("artifact-unknown", f"{name} is no trainable of {plan.name}", where)
        if len(known[name]) > 1:
            raise PlanError("artifact-ambiguous", f"{len(known[name])} trainables are called {name}", where)
        side = Path(folder) / f"{artifact}{SUFFIX}"
        if not side.is_file():
            if deployment.enforced:
                raise PlanError("manifest-missing", f"{artifact} has no side file", where)
            continue
        said = manifest(side.read_text(encoding="utf-8"))
        current, recorded = bundle_hash(known[name][0], name), said["bundles"].get(name)
        if current != recorded:
            events.append(_event("training_bundle_hash_changed", trainable_name=name, old_hash=recorded, new_hash=current, pipeline_hash=now))
            if deployment.enforced and (artifact, name) not in deployment.acknowledged:
                raise DriftError(f"{name} was trained as {recorded}, and is {current}", where, events)
        if now not in said["pipelines"]:
            old = said["pipelines"][0] if said["pipelines"] else None
            events.append(_event("pipeline_hash_changed", old_hash=old, new_hash=now))
    return events


class DriftError(PlanError):
    """A halt by drift, with the events up to it."""

    def __init__(self, message: str, where: str, events: list[dict[str, Any]]):
        super().__init__("drift", message, where)
        self.events = events


def _event(kind: str, **known: Any) -> Mapping[str, Any]:
    return {"event_type": kind, "timestamp": dt.datetime.now(dt.UTC).replace(tzinfo=None), **known}
