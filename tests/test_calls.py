"""Calls that a retried task takes from the log, and answers that aren't whole."""

import json
import os
import subprocess
import sys

import pytest

from loomwork.sources import backends
from loomwork.sources.calls import CallLog, UnknownCall

KILLED = """
import os, sys
from pyspark.sql import SparkSession, functions as F
from loomwork.plans import load
from loomwork.plans.compile import compile_flow
from loomwork.plans.execute import transform
from loomwork.plans.model import Registry
from loomwork.sources.calls import CallLog

folder, logged = sys.argv[1], sys.argv[2] == "logged"

class Counting:
    def __call__(self, payload, schema, identity, config, transport):
        with open(f"{folder}/calls", "a") as f:
            f.write(payload["q"] + "\\n")
        if payload["q"] == "37" and not os.path.exists(f"{folder}/died"):
            open(f"{folder}/died", "w").close()
            os._exit(1)  # the worker dies within a call, after others of its task
        return {"got": payload["q"] * 2}

spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", folder + "/cp").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
S = {"type": "str"}
r = Registry().add(load.service_type({"name": "m", "identity_schema": {"model": S}, "transport_schema": {"endpoint": S}, "config_schema": {}}), load.step({"service": {}, "reads": {"a": S}, "output_schema": {"b": S}, "service_bindings": {"api": {"type": "m"}}}, "ask"))
r.rows("ask")(lambda a, api: {"b": api.invoke(q=a)["got"]})
r.backends["m"] = Counting()
flow = {"meta": {"name": "f"}, "nodes": [{"kind": "handler", "name": "ask"}], "inputs": {"a": S}, "service_bindings": {"api": {"type": "m", "model": "1"}}}
plan = compile_flow(load.flow(flow), r, load.deployment({"training_contract": {}, "transport": {"api": {"endpoint": "e"}}}))
runs = spark.range(0, 60, 1, 2).select(F.col("id").cast("string").alias("run_id"), F.col("id").cast("string").alias("a"))
got = transform(plan, runs, r, calls=CallLog(folder + "/log") if logged else None).state().collect()
assert sorted((x.run_id, x.b) for x in got) == sorted((str(k), str(k) * 2) for k in range(60))
"""


@pytest.mark.parametrize("logged", ["logged", "not logged"])
def test_a_killed_task_does_not_repeat_its_answered_calls(tmp_path, logged):
    done = subprocess.run([sys.executable, "-c", KILLED, str(tmp_path), logged], env=os.environ, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    calls = (tmp_path / "calls").read_text().split()
    repeated = {c for c in calls if calls.count(c) > 1}
    assert (tmp_path / "died").exists() and set(calls) == {str(k) for k in range(60)}
    # those under way when the worker died have no answer, eight at most
    assert "37" in repeated and (len(repeated) <= 8 or logged != "logged")


def test_the_log_of_calls(tmp_path):
    made = []

    def make(answer):
        made.append(answer)
        return answer

    first = CallLog(str(tmp_path)).of_task("s")
    assert [first.once("r:0", lambda: make({"a": "é"})), first.once("r:0#1", lambda: make(2))] == [{"a": "é"}, 2]
    with pytest.raises(OSError):
        first.once("q:0", lambda: (_ for _ in ()).throw(OSError("down")))
    with open(next(tmp_path.glob("s-0/*.jsonl")), "ab") as f:
        f.write(b'{"call": "half')
    again = CallLog(f"file://{tmp_path}").of_task("s")
    assert again.once("r:0", lambda: make(None)) == {"a": "é"} and again.once("r:0#1", lambda: make(None)) == 2 and len(made) == 2
    with pytest.raises(UnknownCall):
        CallLog(str(tmp_path), repeat=False).of_task("s").once("q:0", lambda: make(3))
    assert again.once("q:0", lambda: make(3)) == 3
    assert CallLog(str(tmp_path)).of_task("other").answers == {}


def chunks(*datas, done=True):
    texts = [*map(json.dumps, datas), *(["[DONE]"] if done else [])]
    return lambda *a: (line for t in texts for line in (f"data: {t}\n".encode(), b"\n"))


def said(text=None, end=None, **more):
    return {"choices": [{"delta": {"content": text, **more}, "finish_reason": end}]}


def test_streams_that_are_not_whole():
    def of(*datas, done=True):
        return list(backends.ChatCompletions(chunks(*datas, done=done)).fragments("hi", {}, {"model": "m"}, {}, {"endpoint": "e"}))

    assert of(said("a"), {"choices": [], "usage": {"n": 1}}, {"usage": {}}, said("b", "stop")) == ["a", "b"]
    assert of(said("a"), said(None, "stop"), done=False) == ["a"]
    for bad in ((said("a"),), (said("a", "length"),), (said("a"), said(refusal="no"), said(None, "stop")), ()):
        with pytest.raises(ValueError, match="end|refused"):
            of(*bad)


@pytest.mark.parametrize("choice,error", [
    ({"message": {"content": "x"}, "finish_reason": "stop"}, None), ({"message": {"content": "x"}}, "no end"), ({"message": {"content": "x"}, "finish_reason": "length"}, "length"),
    ({"message": {"content": None, "refusal": "no"}, "finish_reason": "stop"}, "refused"), ({"message": {"content": None}, "finish_reason": "stop"}, "no text"),
])
def test_whole_answers(choice, error):
    backend = backends.ChatCompletions(lambda *a: iter([json.dumps({"choices": [choice]}).encode()]))
    if error is None:
        assert backend("hi", {}, {"model": "m"}, {}, {"endpoint": "e"}) == "x"
    else:
        with pytest.raises(ValueError, match=error):
            backend("hi", {}, {"model": "m"}, {}, {"endpoint": "e"})
