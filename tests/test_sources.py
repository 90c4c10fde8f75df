"""Renderings, backends, canonical forms and streams."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from loomwork.functions import canonical, rendering
from loomwork.functions.types import Field, parse_type
from loomwork.operators import eventlog
from loomwork.plans.load import parse_fields
from loomwork.sources import backends, tables
from loomwork.streaming import live


def fields(**kinds):
    return parse_fields({k: v if isinstance(v, dict) else {"type": v} for k, v in kinds.items()}, "x")


def test_canonical_forms():
    assert canonical.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    assert canonical.sha256_of([]) == "sha256:4f53cda18c2baa0c0354bb5f9a3ecbe5ed12ab4d8e11ba873c2f11161202b945"
    assert canonical.canon_value({"d": dt.date(2020, 1, 2), "t": (1, 2)}) == {"d": {"$date": "2020-01-02"}, "t": [1, 2]}
    for bad in (float("nan"), {1: 0, "1": 0}, object()):
        with pytest.raises((ValueError, TypeError)):
            canonical.canon_value(bad)
    assert re.fullmatch(r"run_\d{8}T\d{6}Z_[0-9a-f]{12}", canonical.new_run_id())
    assert canonical.remaining_ms(5, 9) == 0 and canonical.embed_name("a", 2) == "a[2]"


def test_schema_and_grammar():
    made = rendering.object_schema(fields(a={"type": "str", "enum": ["x", "y"]}, b="int | None", c="list[float]"))
    assert list(made["properties"]) == ["a", "b", "c"] and made["required"] == ["a", "b", "c"] and made["additionalProperties"] is False
    assert "minLength" not in json.dumps(rendering.object_schema(fields(a={"type": "str", "minLength": 2})))
    text = rendering.grammar(rendering.object_schema(fields(a={"type": "str", "minLength": 2, "maxLength": 3}, b="bool", c="dict[str, int]"), "gbnf"))
    rules = dict(line.split(" ::= ", 1) for line in text.splitlines())
    assert text.startswith("root ::=") and "char{2,3}" in text and {"space", "string", "integer", "boolean"} <= rules.keys()
    for kind in ("tuple[str, int]", "dict[str, int]"):
        with pytest.raises(rendering.RenderError):
            rendering.schema_of(parse_type(kind))
    assert rendering.payload_text({"a": "x"}) == "x" and rendering.payload_text({"a": 1}) == '{"a":1}'
    assert rendering.COMPILERS["regex"]("a", "i").search("A")


def test_an_escaped_pair_of_surrogates_is_one_character():
    text = rendering.grammar(rendering.object_schema(fields(a={"type": "str", "minLength": 2, "maxLength": 2}), "gbnf"))
    rule = dict(line.split(" ::= ", 1) for line in text.splitlines())["char"]
    # the rule as a regular expression: literals unquoted, blanks between terms dropped
    parts = re.findall(r'"(?:[^"\\]|\\.)*"|\[(?:[^\]\\]|\\.)*\]|\{\d+\}|[()|]', rule)
    char = "".join(re.escape(json.loads(x)) if x[0] == '"' else x for x in parts)
    assert re.fullmatch(f"(?:{char}){{2}}", r"a\ud83d\ude00") and re.fullmatch(f"(?:{char}){{2}}", "\\u00e9\\n")
    assert not re.fullmatch(f"(?:{char}){{2}}", r"\ud83d\ude00") and not re.fullmatch(f"(?:{char}){{2}}", r"a\ud83d")


def test_fragments_come_before_the_stream_ends():
    def lines():
        yield b'data: {"choices":[{"delta":{"content":"a"}}]}\n'
        yield b"\n"
        raise AssertionError("read too far")

    stream = backends.ChatCompletions(lambda *a: lines()).fragments("hi", {}, {"model": "m"}, {}, {"endpoint": "e"})
    assert next(stream) == "a"
    with pytest.raises(TimeoutError):
        backends.ChatCompletions(lambda *a: lines())("hi", {}, {"model": "m"}, {}, {"endpoint": "e"}, remaining_budget_ms=0)


def test_backends(monkeypatch):
    schema = rendering.object_schema({"mood": Field(parse_type("str"), (("enum", ["a", "b"]),))})
    chat = backends.ChatCompletions(lambda url, body, key, ms: iter([json.dumps({"choices": [{"message": {"content": json.dumps([url, key, body["model"]])}, "finish_reason": "stop"}]}).encode()]))
    monkeypatch.setenv("KEY", "k")
    said = chat("hi", schema, {"model": "m"}, {"extras": {"seed": 1}}, {"endpoint": "http://h/v1", "api_key_ref": "[env]KEY"})
    assert json.loads(said) == ["http://h/v1/chat/completions", "k", "m"]
    with pytest.raises(ValueError, match="extras"):
        chat("hi", schema, {"model": "m"}, {"extras": {"model": 1}}, {"endpoint": "e"})
    lines = [b": note\n", b'data: {"choices":[{"delta":{"content":"a"}}]}\n', b"\n", b'data: {"choices":[{"delta":{"content":"b"},"finish_reason":"stop"}]}\n', b"\n", b"data: [DONE]\n", b"\n", b"data: no\n"]
    stream = backends.ChatCompletions(lambda *a: iter(lines))
    assert list(stream.fragments("hi", schema, {"model": "m"}, {}, {"endpoint": "e"})) == ["a", "b"]
    full = backends.GrammarCompletion(lambda url, body, key, ms: iter([json.dumps({"content": body["grammar"][:4]}).encode()]))
    assert full("p", schema, {}, {}, {"endpoint": "e"}) == "root"
    fake = backends.Fake()
    assert fake("p", schema, {}, {}, {}) == fake("p", schema, {}, {}, {})
    with pytest.raises(ValueError):
        backends.secret("plain")


def test_blob_lines_and_manifests(spark, tmp_path):
    assert tables.blob_line("r") == '{"reference": "r"}' and tables.blob_line("r", "kv") == "reference=r"
    out = str(tmp_path / "lines")
    tables.write_blob_lines(spark.createDataFrame([("a",)], "reference string"), out)
    assert [r.value for r in spark.read.text(out).collect()] == ['{"reference":"a"}']
    m = tables.manifest('artifact = "x"\npipeline_hash_set = ["h"]\n[training_bundle_hashes]\nt = "b"\n')
    assert [tuple(r) for r in tables.manifests(spark, [m]).collect()] == [("x", "t", "b", ["h"])]


def test_streams(spark, tmp_path):
    def event(kind, run, at, second, **more):
        known = {"event_type": kind, "pipeline_run_id": run, "handler_position": at, "node_kind": "trainable", "timestamp": dt.datetime(2024, 1, 1, 0, 0, second), **more}
        return tuple(known.get(c) for c in eventlog.EVENT_COLUMNS)

    rows = [event("handler_enter", "a", 0, 1, reads_snapshot="r"), event("handler_exit", "a", 0, 2, writes_snapshot="w"), event("handler_enter", "b", 0, 3)]
    log = str(tmp_path / "log")
    spark.createDataFrame(rows, eventlog.event_schema()).write.parquet(log)
    got = []
    query = live.fan_out(live.live_pairs(live.event_stream(spark, log)), lambda df, n: got.extend(df.collect()), str(tmp_path / "c"))
    assert query.awaitTermination(120)
    assert [(r.pipeline_run_id, r.reads_snapshot, r.writes_snapshot) for r in got] == [("a", "r", "w")]
    pieces = [("x", 1, "b", False), ("x", 0, "a", False), ("x", 2, None, True), ("y", 0, "a", False), ("z", 1, "b", True)]
    out = live.assembled(spark.createDataFrame(pieces, "run string, seq long, piece string, done boolean")).collect()
    assert [tuple(r) for r in out] == [("x", "ab")]


def test_unknown_events_are_errors(spark, tmp_path):
    odd = spark.createDataFrame([("other", "r")], "event_type string, pipeline_run_id string")
    assert eventlog.unknown_kinds(odd).count() == 1
    with pytest.raises(Exception, match="unknown kind"):
        tables.append_events(odd, str(tmp_path / "x"))
    assert eventlog.of_run(spark.createDataFrame([("pipeline_complete", "r")], "event_type string, pipeline_run_id string"), "r").select(F.max("closes")).first()[0]
