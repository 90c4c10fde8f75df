"""Queries that show rules, hashes, renderings, sources, services and the log on the tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.catalogue import conversation_log, drift_tables, order_flow, query, table, trainable_flow
from loomwork.functions import canonical, rendering, rules
from loomwork.operators import drift, eventlog, folds
from loomwork.plans import identity, load
from loomwork.plans.compile import Plan, compile_flow
from loomwork.plans.execute import transform
from loomwork.plans.model import Registry
from loomwork.plans.problems import problem_details
from loomwork.sources import tables
from loomwork.sources.shared import cut, drop_path, shared_path
from loomwork.streaming import live

S = {"type": "str"}


def _node(name: str, **more: Any) -> dict[str, Any]:
    return {"kind": "handler", "name": name, **more}


# types and renderings --------------------------------------------------------------------------


@query(
    "canonical_rows",
    """select o_orderkey as id, 'sha256:' || sha256('{"custkey":' || o_custkey || ',"price":' || o_totalprice || ',"tags":{"priority":"' || o_orderpriority || '","status":"'
  || o_orderstatus || '"}}') as hash from orders""",
)
def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as canonical JSON, whatever the order of a map's entries, and their hashes."""
    o = table(spark, sf_dir, "orders")
    tags = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority"))
    tags = tags.otherwise(F.create_map(F.lit("priority"), "o_orderpriority", F.lit("status"), "o_orderstatus"))
    text = canonical.canonical_object({
        "tags": (tags, T.MapType(T.StringType(), T.StringType())), "price": (F.col("o_totalprice"), T.DoubleType()), "custkey": (F.col("o_custkey"), T.LongType()),
    })
    return o.select(F.col("o_orderkey").alias("id"), canonical.sha256_text(text).alias("hash"))


@query("payload_rows", """select p_partkey as id, p_name as alone, '{"key":' || p_retailprice || ',"name":"' || p_name || '"}' as both from part""")
def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is sent: a single text as it is, anything else as canonical JSON."""
    name, key = {"name": (F.col("p_name"), T.StringType())}, {"key": (F.col("p_retailprice"), T.DoubleType())}
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), rendering.payload(name).alias("alone"), rendering.payload(name | key).alias("both"))


# rules -----------------------------------------------------------------------------------------


@query(
    "rule_items",
    """with t as (select conv_id, turn, role, length(text) as n, row_number() over (partition by conv_id order by turn) - 1 as i from conversations),
f as (select conv_id, i, 0 as k, 'turns[' || i || '].n:minimum:' || n as x from t where n < 60
  union all select conv_id, i, 1, 'turns[' || i || '].role:enum:' || role from t where role = 'system')
select conv_id, string_agg(x, ',' order by i, k) as failed from f group by conv_id""",
)
def rule_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules inside the items of a list: path, rule and value of each that fails."""
    fields = load.parse_fields({"turns": {"item": {"fields": {"n": {"type": "int", "minimum": 60}, "role": {"type": "str", "enum": ["user", "assistant"]}}}}}, "x")
    turns = F.struct("turn", F.length("text").cast("long").alias("n"), "role")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turns)).alias("x"))
    value = F.transform("x", lambda t: F.struct(t.n.alias("n"), t.role.alias("role")))
    found = rows.select("conv_id", rules.failures({"turns": (value, fields["turns"].type, fields["turns"].rules)}).alias("f")).where(F.size("f") > 0)
    return found.select("conv_id", F.array_join(F.transform("f", lambda x: F.concat_ws(":", x.path, x.rule, x.value)), ",").alias("failed"))


@query(
    "rule_custom",
    """select p_partkey as id, case when p_size = 13 then 'broke' else 'odd number of letters' end as said from part where p_size = 13 or length(p_name) % 2 = 1""",
)
def rule_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of the user's own: its verdict, and its own failures, which are no verdict."""

    @rules.custom_rule("shop.even")
    def even(value: dict) -> str | None:
        if value["size"] == 13:
            raise ValueError("thirteen")
        return None if len(value["name"]) % 2 == 0 else "odd number of letters"

    said = rules.verdict(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size")), "shop.even", {})
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), said.alias("v"))
    return rows.where(~F.col("v.ok")).select("id", F.when(F.col("v.broke"), F.lit("broke")).otherwise(F.col("v.message")).alias("said"))


# sources, sinks and the log --------------------------------------------------------------------


@query(
    "event_table",
    """select event_type, count(*) as n from (select 'pipeline_start' as event_type from (select distinct conv_id from conversations)
  union all select 'handler_enter' from conversations union all select 'service_invocation' from conversations where role <> 'user'
  union all select 'service_invocation' from conversations where role <> 'user' and length(text) % 11 = 0
  union all select 'handler_exit' from conversations where length(text) % 7 <> 0) group by 1""",
)
def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a table by kind, and read back."""
    path = shared_path(spark, "events")
    tables.append_events(conversation_log(spark, sf_dir), path)
    counts = cut(tables.read_events(spark, path).groupBy("event_type").agg(F.count("*").alias("n")))
    drop_path(spark, path)
    return counts


@query(
    "fixture_rows",
    """select cast(conv_id as varchar) as pipeline_run_id, cast(turn as integer) as handler_position, role as reads_snapshot, case when length(text) % 7 <> 0 then sha256(text) end as writes_snapshot
from conversations where conv_id % 4 = 1""",
)
def fixture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What steps read and wrote, written as JSON rows and read back for runs of one plan."""
    path = shared_path(spark, "fixtures")
    tables.write_fixtures(conversation_log(spark, sf_dir), path)
    rows = cut(tables.read_fixtures(spark, path, "h1").select("pipeline_run_id", "handler_position", "reads_snapshot", "writes_snapshot").distinct())
    drop_path(spark, path)
    return rows


@query("blob_rows", """select '{"reference":"' || p_name || '/' || p_partkey || '"}' as value from part""")
def blob_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to blobs, a line each, written as text and read back."""
    path = shared_path(spark, "blobs")
    tables.write_blob_lines(table(spark, sf_dir, "part").select(F.concat_ws("/", "p_name", "p_partkey").alias("reference")), path)
    lines = cut(spark.read.text(path))
    drop_path(spark, path)
    return lines


@query("unknown_events", "select conv_id || ':' || turn as id from conversations where role = 'system' or turn = 3")
def unknown_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose kind is none of the log's."""
    t = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "system", F.lit(None)).when(F.col("turn") == 3, F.lit("Handler_Enter")).otherwise("handler_enter")
    return eventlog.unknown_kinds(t.select(F.concat_ws(":", "conv_id", "turn").alias("id"), kind.cast("string").alias("event_type"))).select("id")


@query(
    "fragments_assembled",
    """select conv_id as run, string_agg(text, '' order by turn) as text from conversations group by conv_id having max(turn) % 3 <> 0 and count(*) = max(turn) + 1""",
)
def fragments_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token streams put together: only those whole to their end mark give a text."""
    t = table(spark, sf_dir, "conversations").withColumn("top", F.max("turn").over(folds.Window.partitionBy("conv_id")))
    done = (F.col("turn") == F.col("top")) & (F.col("top") % 3 != 0)
    return live.assembled(t.select(F.col("conv_id").alias("run"), F.col("turn").alias("seq"), F.col("text").alias("piece"), done.alias("done")))


@query(
    "problem_rows",
    """select o_orderkey as run_id, 502 as status, 'SchemaValidationError' as kind, case when o_orderstatus not in ('O', 'F') then 'status' else 'price' end as path,
  case when o_orderstatus not in ('O', 'F') then o_orderstatus else cast(o_totalprice as varchar) end as value
from orders where o_orderstatus not in ('O', 'F') or o_totalprice > 400000""",
)
def problem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed runs as problem details, with the failing field's path and value."""
    from loomwork.catalogue import _orders

    plan, registry = order_flow()
    found = problem_details(transform(plan, _orders(spark, sf_dir), registry).errors())
    return found.select(
        "run_id", "status", F.get_json_object("problem", "$.type").alias("kind"), F.get_json_object("problem", "$.fields[0].path").alias("path"),
        F.get_json_object("problem", "$.fields[0].value").alias("value"),
    )


@query(
    "pipeline_elapsed",
    "select unnest(['pipeline_complete', 'handler_exit']) as event_type, unnest([count(*), 2 * count(*)])::bigint as n, unnest([count(*), 2 * count(*)])::bigint as timed from conversations",
)
def pipeline_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events tell how long something took, and how many of these a time that isn't negative."""
    plan, registry = trainable_flow()
    turns = table(spark, sf_dir, "conversations")
    runs = turns.select(F.concat_ws(":", "conv_id", "turn").alias("run_id"), F.col("text").alias("said"))
    events = transform(plan, runs, registry).events().where("event_type not in ('pipeline_start', 'handler_enter')")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("elapsed_ms") >= 0).alias("timed"))


def _echo(payload: Any, schema: Any, identity: Any, config: Any, transport: Any, remaining_budget_ms: int | None = None) -> Any:
    if payload["name"].endswith("2"):
        raise OSError("no route")
    left = remaining_budget_ms is not None and 0 < remaining_budget_ms <= 3_600_000
    return f"{payload['name']}{config['t']}{transport['endpoint']}{left}"


def service_flow() -> tuple[Plan, Registry]:
    """A service step, its backend, and a deployment that covers it."""
    r = Registry().add(load.service_type({"name": "m", "identity_schema": {"model": S}, "transport_schema": {"endpoint": S}, "config_schema": {"t": {"type": "int", "default": 4}}}))
    r.add(load.step({"service": {}, "reads": {"name": S}, "output_schema": {"said": S}, "service_bindings": {"api": {"type": "m"}}}, "ask"))
    r.backends["m"] = _echo
    r.rows("ask")(lambda name, api: {"said": api.invoke(name=name).lower()})
    flow = load.flow({"meta": {"name": "f"}, "nodes": [_node("ask")], "inputs": {"name": S}, "service_bindings": {"api": {"type": "m", "model": "x"}}})
    return compile_flow(flow, r, load.deployment({"training_contract": {}, "transport": {"api": {"endpoint": "@"}}})), r


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("run_id"), F.col("n_name").alias("name"))


@query("service_rows", "select cast(n_nationkey as varchar) as run_id, lower(n_name) || '4@true' as said from nation where n_name not like '%2'")
def service_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service step under a time limit: its configuration, transport, and what is left of the time."""
    plan, registry = service_flow()
    return transform(plan, _nations(spark, sf_dir), registry, timeout_ms=3_600_000).state()


@query(
    "service_events",
    """select n_nationkey || ':0' as correlation_id, '{"name":"' || n_name || '"}' as input_payload, '"' || n_name || '4@False"' as output_payload,
  '{"said":"' || lower(n_name) || '4@false"}' as writes_snapshot from nation where n_name not like '%2'""",
)
def service_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What services were asked and answered, beside what their steps wrote: all differ by the body's lower-casing."""
    plan, registry = service_flow()
    events = cut(transform(plan, _nations(spark, sf_dir), registry).events())
    call = events.where("event_type = 'service_invocation'").select("correlation_id", "input_payload", "output_payload")
    return call.join(eventlog.divergence(events).select("correlation_id", "writes_snapshot"), "correlation_id")


@query("service_errors", "select cast(n_nationkey as varchar) as run_id, 'PipelineFailure' as error_class, 'service' as category, 'OSError' as cause from nation where n_name like '%2'")
def service_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose backend failed; the others went on."""
    plan, registry = service_flow()
    return transform(plan, _nations(spark, sf_dir), registry).errors().select("run_id", "error_class", "category", "cause")


@query(
    "body_types",
    """select cast(n_nationkey as varchar) as run_id, case n_nationkey % 4 when 1 then 'out.n type' when 2 then 'out.m keys_subset_of' else 'out.n required' end as message
from nation where n_nationkey % 4 <> 0""",
)
def body_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of Python bodies that don't have their declared form: rows that fail alone."""
    r = Registry().add(load.step({"transform": {}, "reads": {"k": "int"}, "output_schema": {"out": {"fields": {"n": "int"}}}}, "make"))
    r.rows("make")(lambda k: {"out": ({"n": k}, {"n": str(k)}, {"n": k, "m": 1}, {})[k % 4]})
    plan = compile_flow(load.flow({"meta": {"name": "f"}, "nodes": [_node("make")], "inputs": {"k": "int"}}), r)
    runs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("run_id"), F.col("n_nationkey").cast("long").alias("k"))
    return transform(plan, runs, r).errors().select("run_id", "message")


@query("compiled_rows", "select cast(p_partkey as varchar) as run_id, regexp_matches(p_name, '(?i)^R.*T$') as hit from part")
def compiled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant that a compiler made, once a plan, used by a Python body."""
    r = Registry().add(load.step({"transform": {}, "reads": {"name": S}, "output_schema": {"hit": {"type": "bool"}}, "bindings": {"find": {"pattern": S, "flags": S, "compile": "regex"}}}, "find"))
    r.rows("find")(lambda name, find: {"hit": find.search(name) is not None})
    plan = compile_flow(load.flow({"meta": {"name": "f"}, "nodes": [_node("find", bindings={"find": {"pattern": "^R.*T$", "flags": "i"}})], "inputs": {"name": S}}), r)
    runs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("run_id"), F.col("p_name").alias("name"))
    return transform(plan, runs, r).state()


@query(
    "log_replay_maps",
    "select cast(p_partkey as varchar) as pipeline_run_id, side from part, (select unnest(['first', 'second']) as side) where p_size = 7",
)
def log_replay_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays whose maps come in another order are equal; only other values differ."""

    def log(reverse: bool) -> DataFrame:
        r = Registry().add(load.step({"transform": {}, "reads": {"name": S, "size": "int"}, "output_schema": {"tags": {"type": "dict[str, str]"}}}, "tag"))

        def tag(name: Column, size: Column) -> dict[str, Column]:
            shown = F.when((size == 7) & F.lit(reverse), F.lit("changed")).otherwise(name)
            pairs = [(F.lit("name"), shown), (F.lit("size"), size.cast("string"))]
            return {"tags": F.create_map(*(x for p in (reversed(pairs) if reverse else pairs) for x in p))}

        r.columns("tag")(tag)
        plan = compile_flow(load.flow({"meta": {"name": "f"}, "nodes": [_node("tag")], "inputs": {"name": S, "size": "int"}}), r)
        runs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("run_id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size"))
        return eventlog.pairs(transform(plan, runs, r).events(), None)

    return eventlog.replay_differences(log(False), log(True)).select("pipeline_run_id", "side")


@query(
    "fold_nested_merge",
    """with c as (select user_id as run, event_id as position, event_type as a, 'k' || (event_id % 3) as b, 'v' || (event_id % 2) as d, value from events),
f as (select run, a, b, d, arg_max(value, position) as v from c group by run, a, b, d), g as (select run, a, b, string_agg(d || '=' || cast(v as varchar), ';' order by d) as x from f group by run, a, b),
h as (select run, a, string_agg(b || '>' || x, '|' order by b) as y from g group by run, a)
select run, string_agg(a || ':' || y, ',' order by a) as value from h group by run""",
)
def fold_nested_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of maps of maps merged at all levels, in order of position."""
    e = table(spark, sf_dir, "events")
    name = lambda mark, n: F.concat(F.lit(mark), (F.col("event_id") % n).cast("string"))
    inner = F.create_map(name("k", 3), F.create_map(name("v", 2), F.col("value").cast("string")))
    rows = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("position"), F.lit(0).alias("port"), F.create_map("event_type", inner).alias("value"))
    out = folds.fold_long(rows, ["run"], ["position", "port"], "value", "deep_merge_dict")

    def shown(m: Column, value: Callable[[Column], Column], mark: str, between: str) -> Column:
        keys = F.array_sort(F.map_keys(m))
        return F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit(mark), value(F.element_at(m, k)))), between)

    return out.select("run", shown(F.col("value"), lambda x: shown(x, lambda y: shown(y, lambda z: z, "=", ";"), ">", "|"), ":", ",").alias("value"))


@query("flow_bundle", "select cast(n_nationkey as varchar) as run_id, upper(n_name) as b, upper(n_name) || upper(n_name) as c from nation")
def flow_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle's nodes stand in for the node that names it."""
    r = Registry().add(
        load.step({"transform": {}, "reads": {"name": S}, "output_schema": {"b": S}}, "up"), load.step({"transform": {}, "reads": {"b": S}, "output_schema": {"c": S}}, "two"),
        load.composition({"meta": {"kind": "bundle", "name": "x"}, "nodes": [_node("up"), _node("two")]}),
    )
    r.columns("up")(lambda name: {"b": F.upper(name)})
    r.columns("two")(lambda b: {"c": F.concat(b, b)})
    plan = compile_flow(load.flow({"meta": {"name": "f"}, "nodes": [{"kind": "composition", "name": "x"}], "inputs": {"name": S}}), r)
    return transform(plan, _nations(spark, sf_dir), r).state()


@query(
    "drift_rows",
    """with a as (select p_partkey as k, p_size as s, 'art' || p_partkey as artifact, 't' || (p_partkey % 10) as trainable from part)
select 'training_bundle_hash_changed' as event_type, artifact, trainable as trainable_name, 'old' as old_hash, 'now' as new_hash, 'current' as pipeline_hash from a where s % 5 <> 0 and s % 2 <> 0
union all select 'pipeline_hash_changed', artifact, null, 'former', 'current', null from a where s % 5 <> 0 and k % 3 <> 0""",
)
def drift_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift events of every artifact whose side file tells other hashes than what is deployed."""
    artifacts, manifests, current, _ = drift_tables(spark, sf_dir)
    return drift.events(artifacts, manifests, current)


@query("log_lineage_cycle", "select cast(conv_id as varchar) as run from (select distinct conv_id from conversations) where conv_id % 3 = 0")
def log_lineage_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose chain of parents never ends: of three chains of conversations the first is closed to a ring."""
    convs = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    ring = convs.agg(F.max(F.when(F.col("conv_id") % 3 == 0, F.col("conv_id"))).alias("last"))
    parent = F.when(F.col("conv_id") >= 3, F.col("conv_id") - 3).when(F.col("conv_id") == 0, F.col("last"))
    log = convs.crossJoin(ring).select(F.lit("pipeline_start").alias("event_type"), F.col("conv_id").cast("string").alias("pipeline_run_id"), parent.cast("string").alias("parent_run_id"))
    return eventlog.entangled(log).select("run")


@query(
    "node_snapshots",
    """with f as (select case when o_orderstatus not in ('O', 'F') then 0 when o_totalprice > 400000 then 1 else 2 end as got from orders)
select 'shop.label' as name, 'priority<urgency,status<status' as reads, 'label>label,tags>tags' as writes, count_if(got >= 1) as n from f
union all select 'shop.price', 'label<label,price<price', 'band>band,tags>tags', count_if(got >= 2) from f""",
)
def node_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each node of a flow was left, with its wiring, from the log and the plan's own tables."""
    from loomwork.catalogue import _orders

    plan, registry = order_flow()
    nodes = identity.snapshots(spark, plan)["nodes"].select(F.col("position").alias("handler_position"), "name", "reads", "writes")
    left = transform(plan, _orders(spark, sf_dir), registry).events().where("event_type = 'handler_exit'").groupBy("handler_position").agg(F.count("*").alias("n"))

    def shown(wiring: str, mark: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.map_entries(wiring)), lambda e: F.concat(e.key, F.lit(mark), e.value)), ",").alias(wiring)

    return nodes.join(left, "handler_position").select("name", shown("reads", "<"), shown("writes", ">"), "n")
