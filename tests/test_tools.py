"""The testing helpers, value checks and the command line."""

import json

import pytest

from loomwork import testing
from loomwork.__main__ import main
from loomwork.catalogue import trainable_flow
from loomwork.functions.types import Field, parse_type
from loomwork.plans import load
from loomwork.plans.compile import compile_flow
from loomwork.plans.errors import PlanError
from loomwork.plans.model import Registry
from loomwork.plans.values import misfits, signature_misfit
from loomwork.sources import tables


@pytest.mark.parametrize("token,good,bad", [
    ("int", [1, -5], [True, 1.0, 2**63, None]), ("float", [1, 1.5], [True, "x"]), ("str | None", ["", None], [1]), ("list[int]", [[], [1]], [(1,), [None]]),
    ("tuple[str, int]", [("a", 1)], [["a", 1], ("a",)]), ("dict[str, bool]", [{}, {"a": True}], [{"a": 1}, {1: True}]), ("Literal['a', 1]", ["a", 1], [True, "b"]),
])
def test_values(token, good, bad):
    f = Field(parse_type(token))
    assert not [v for v in good if list(misfits(v, f))] and all(list(misfits(v, f)) for v in bad)


def test_signatures():
    assert signature_misfit(lambda a, b=1: 0, ["a"]) is None and signature_misfit(lambda **k: 0, ["a"]) is None
    assert signature_misfit(lambda a: 0, ["a", "b"]) == "takes no b" and signature_misfit(lambda a, b: 0, ["a"]) == "needs b"
    r = Registry().add(load.step({"transform": {}, "reads": {"a": {"type": "str"}}, "output_schema": {"b": {"type": "str"}}, "bindings": {"k": {"type": "int", "minimum": 3}}}, "s"))
    made = {"meta": {"name": "f"}, "nodes": [{"kind": "handler", "name": "s", "bindings": {"k": 1}}], "inputs": {"a": {"type": "str"}}}
    with pytest.raises(PlanError, match="binding-value.*minimum"):
        compile_flow(load.flow(made), r)
    r.columns("s")(lambda a: {"b": a})
    made["nodes"][0]["bindings"]["k"] = 3
    with pytest.raises(PlanError, match="step-signature"):
        compile_flow(load.flow(made), r)


def test_capture_and_verified_fake(spark):
    plan, registry = trainable_flow()
    registry.backends["fake.chat"] = testing.VerifiedFake(plan, "answer", lambda payload: {"mood": "calm"} if "ok" in payload else {"mood": "other"})
    got = testing.run_and_capture(spark, plan, registry, [{"run_id": "1", "said": "ok"}, {"run_id": "2", "said": "no"}])
    assert [(r.run_id, r.mood) for r in got.state] == [("1", "calm")] and [(r.run_id, r.category, r.cause) for r in got.errors] == [("2", "service", "ValueError")]
    assert testing.inspect_state(got.events, plan, "1", 1) == {"said": "ok", "answer.full": "Q: ok"}
    assert callable(testing.body_of(registry, "chat.prompt"))


def test_command_line(tmp_path, capsys):
    (tmp_path / "handlers").mkdir()
    (tmp_path / "handlers" / "s.toml").write_text('[transform]\n[reads]\na = { type = "str" }\n[output_schema]\nb = { type = "str" }\n')
    flow = tmp_path / "f.toml"
    flow.write_text('[meta]\nname = "f"\n[[nodes]]\nkind = "handler"\nname = "s"\n[inputs]\na = { type = "str" }\n')
    assert main(["derive", str(flow), "--declarations", str(tmp_path)]) == 0
    data = json.loads(capsys.readouterr().out)
    artifact = tmp_path / "model.bin"
    artifact.write_text("x")
    assert main(["tag", str(artifact), str(flow), "--declarations", str(tmp_path)]) == 0
    assert main(["move", str(artifact), str(tmp_path / "new.bin")]) == 0
    assert tables.manifest((tmp_path / "new.bin.loomwork.toml").read_text())["pipelines"] == [data["pipeline_hash"]]
    assert main(["derive", str(tmp_path / "none.toml")]) == 1
    (tmp_path / "d.toml").write_text("[training_contract]\nintegrity_enforcement = true\n")
    assert main(["check", str(flow), str(tmp_path / "d.toml"), "--declarations", str(tmp_path)]) == 0
    (tmp_path / "d.toml").write_text('[training_contract]\n[artifacts]\nt = "new.bin"\n')
    assert main(["check", str(flow), str(tmp_path / "d.toml"), "--declarations", str(tmp_path)]) == 1 and "artifact-unknown" in capsys.readouterr().err


def test_installed_bodies_and_backends():
    class Entry:
        def __init__(self, name, made):
            self.name, self.load = name, lambda: made

    class Found:
        def select(self, group):
            return {"loomwork.bodies": [Entry("up", len)], "loomwork.backends": [Entry("m", dict)]}[group]

    r = Registry().installed(Found())
    assert r.bodies["up"].call is len and r.bodies["up"].style == "columns" and r.backends["m"] == {}
    with pytest.raises(ValueError, match="twice"):
        r.installed(Found())
    assert Registry().installed().bodies == {}
