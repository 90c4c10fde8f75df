"""python -m loomwork derive FLOW.toml [--declarations DIR] | tag ARTIFACT FLOW.toml [...] | move FROM TO
    | check FLOW.toml DEPLOYMENT.toml [...]

derive prints the derived bundle of a flow.  tag writes ARTIFACT.loomwork.toml beside an artifact,
with the hashes of the flow that it was trained for.  move renames both.
check covers the flow by the deployment, looks at the side files of its artifacts, and prints the drift
events; what must not be loaded is an error.
Declarations are found as DIR/handlers/<name>.toml, DIR/service_types/*.toml and DIR/compositions/<name>.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from loomwork.functions.canonical import canonical_json
from loomwork.plans import identity, load
from loomwork.plans.artifacts import SUFFIX, check_artifacts, side_file
from loomwork.plans.compile import Plan, compile_flow, cover
from loomwork.plans.errors import PlanError
from loomwork.plans.model import Registry


def read_registry(folder: Path) -> Registry:
    registry = Registry()
    for path in sorted(folder.glob("handlers/*.toml")):
        registry.add(load.loads(path.read_text(encoding="utf-8"), "handler", path.stem))
    for path in sorted(folder.glob("service_types/*.toml")):
        registry.add(load.loads(path.read_text(encoding="utf-8"), "service_type"))
    for path in sorted(folder.glob("compositions/**/*.toml")):
        registry.add(load.loads(path.read_text(encoding="utf-8"), "composition"), at=str(path.relative_to(folder / "compositions")))
    return registry


def read_plan(flow: Path, declarations: Path) -> Plan:
    found = load.resolve_files(load.loads(flow.read_text(encoding="utf-8"), "pipeline"), flow.parent)
    return compile_flow(found, read_registry(declarations))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("loomwork")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("derive", "tag", "check"):
        one = commands.add_parser(name)
        if name == "tag":
            one.add_argument("artifact")
        one.add_argument("flow", type=Path)
        if name == "check":
            one.add_argument("deployment", type=Path)
        one.add_argument("--declarations", type=Path, default=Path())
    move = commands.add_parser("move")
    move.add_argument("source", type=Path)
    move.add_argument("target", type=Path)
    args = parser.parse_args(argv)
    try:
        if args.command == "derive":
            print(canonical_json(identity.derived(read_plan(args.flow, args.declarations))))
        elif args.command == "check":
            deployment = load.loads(args.deployment.read_text(encoding="utf-8"), "deployment")
            plan, registry = read_plan(args.flow, args.declarations), read_registry(args.declarations)
            cover(plan, registry, deployment)
            for event in check_artifacts(plan, registry, deployment, args.deployment.parent):
                print(canonical_json({k: str(v) if k == "timestamp" else v for k, v in event.items()}))
        elif args.command == "tag":
            Path(args.artifact + SUFFIX).write_text(side_file(args.artifact, read_plan(args.flow, args.declarations)), encoding="utf-8")
        else:
            side = Path(f"{args.source}{SUFFIX}")
            if args.target.exists() or not side.exists():
                raise PlanError("drift", "the target exists, or the artifact has no side file")
            args.source.rename(args.target)
            side.rename(f"{args.target}{SUFFIX}")
    except (PlanError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
