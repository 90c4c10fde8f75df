"""Queries that show every operator on the tables, each with its equivalent in SQL.

Lists and maps come out as text with a fixed order, so that results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions import rules
from loomwork.functions.canonical import correlation_id
from loomwork.functions.types import STR, parse_type
from loomwork.operators import drift, eventlog, folds, reduce
from loomwork.plans import load
from loomwork.plans.compile import Plan, compile_flow
from loomwork.plans.execute import transform
from loomwork.plans.model import Registry
from loomwork.sources.backends import Fake

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


# folds -----------------------------------------------------------------------------------------

def _contributions(spark: SparkSession, sf_dir: str, strategy: str) -> tuple[DataFrame, T.DataType]:
    """(run, position, port, value) rows for a strategy: events by user, or turns by conversation."""
    if strategy in ("last_present_wins", "concat_str"):
        rows = table(spark, sf_dir, "conversations")
        text = F.col("text") if strategy == "concat_str" else F.when(F.col("turn") % 3 == 2, "").otherwise(F.col("role"))
        out = rows.select(F.col("conv_id").alias("run"), F.col("turn").alias("position"), F.lit(0).alias("port"), text.alias("value"))
    else:
        rows = table(spark, sf_dir, "events")
        value = {
            "last_wins": F.col("event_type"),
            "first_wins": F.col("event_type"),
            "append_list": F.array("event_type"),
            "union_set": F.array("event_type"),
            "deep_merge_dict": F.create_map("event_type", F.get_json_object("props", "$.k").cast("long")),
        }[strategy]
        out = rows.select(F.col("user_id").alias("run"), F.col("event_id").alias("position"), F.lit(0).alias("port"), value.alias("value"))
    return out, out.schema["value"].dataType


def shown(value: Column, kind: T.DataType) -> Column:
    """A list or map as text: items comma-joined, entries as key=value by key."""
    if isinstance(kind, T.ArrayType):
        return F.array_join(value, ",")
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value))
        return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ",")
    return value


def _fold_query(strategy: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, kind = _contributions(spark, sf_dir, strategy)
        out = folds.fold_long(rows, ["run"], ["position", "port"], "value", strategy)
        return out.select("run", shown(F.col("value"), kind).alias("value"))

    return run


def _so_far_query(strategy: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, kind = _contributions(spark, sf_dir, strategy)
        out = folds.fold_so_far(rows, rows.select("run", "position"), ["run"], "position", "port", "value", strategy)
        return out.select("run", "position", F.coalesce(shown(F.col("value"), kind), F.lit("(none)")).alias("value"))

    return run


_BASE = {
    "last_present_wins": "select conv_id as run, turn as position, case when turn % 3 = 2 then '' else role end as v from conversations",
    "concat_str": "select conv_id as run, turn as position, text as v from conversations",
    "deep_merge_dict": "select user_id as run, event_id as position, event_type as v, cast(json_extract_string(props, '$.k') as bigint) as k from events",
}
_EVENTS = "select user_id as run, event_id as position, event_type as v from events"
_MERGED = "string_agg(v || '=' || k, ',' order by v)"
_FOLD_SQL = {
    "last_wins": "arg_max(v, position)",
    "first_wins": "arg_min(v, position)",
    "last_present_wins": "coalesce(arg_max(v, position) filter (where v <> ''), arg_max(v, position))",
    "append_list": "string_agg(v, ',' order by position)",
    "concat_str": "string_agg(v, '' order by position)",
}
for _strategy in folds.STRATEGIES:
    _rows = _BASE.get(_strategy, _EVENTS)
    if _strategy in _FOLD_SQL:
        _all = f"with c as ({_rows}) select run, {_FOLD_SQL[_strategy]} as value from c group by run"
    elif _strategy == "union_set":
        _all = f"with c as ({_rows}), f as (select run, v, min(position) as p from c group by run, v) select run, string_agg(v, ',' order by p) as value from f group by run"
    else:
        _all = f"with c as ({_rows}), f as (select run, v, arg_max(k, position) as k from c group by run, v) select run, {_MERGED} as value from f group by run"
    query(f"fold_{_strategy}", _all)(_fold_query(_strategy))

# the folds so far, read at every position
_BEFORE = "order by position range between unbounded preceding and 1 preceding"
_SEEN_SQL = {
    "last_wins": "last_value(v) over w",
    "first_wins": "first_value(v) over w",
    "last_present_wins": "coalesce(last_value(case when v <> '' then v end ignore nulls) over w, last_value(v) over w)",
    "append_list": "string_agg(v, ',') over w",
    "concat_str": "string_agg(v, '') over w",
    "union_set": "string_agg(case when nth = 1 then v end, ',') over w",
}
for _strategy in folds.STRATEGIES:
    _rows = _BASE.get(_strategy, _EVENTS)
    if _strategy in _SEEN_SQL:
        _every = (
            f"with c as ({_rows}), n as (select *, row_number() over (partition by run, v order by position) as nth from c) "
            f"select run, position, coalesce({_SEEN_SQL[_strategy]}, '(none)') as value from n window w as (partition by run {_BEFORE})"
        )
    else:
        _every = (
            f"with c as ({_rows}), d as (select distinct run, v from c), f as (select c.run, c.position, d.v, "
            f"last_value(case when c.v = d.v then c.k end ignore nulls) over (partition by c.run, d.v {_BEFORE.replace('position', 'c.position')}) as k "
            f"from c join d on c.run = d.run) select run, position, coalesce({_MERGED}, '(none)') as value from f group by run, position"
        )
    query(f"fold_so_far_{_strategy}", _every)(_so_far_query(_strategy))


@query(
    "pairs_concat_prefix",
    """
select conv_id, turn, coalesce(reads, '') as reads, text as writes from (
  select *, string_agg(text, '') over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as reads
  from conversations) where role = 'assistant'
""",
)
def pairs_concat_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training pairs: what an assistant's turn could read, and what it wrote."""
    turns = table(spark, sf_dir, "conversations")
    writes = turns.select("conv_id", "turn", F.lit(0).alias("port"), "text")
    readers = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("writes"))
    out = folds.fold_so_far(writes, readers, ["conv_id"], "turn", "port", "text", "concat_str", out="reads")
    return out.select("conv_id", "turn", F.coalesce("reads", F.lit("")).alias("reads"), "writes")


@query(
    "state_at_position",
    """
select conv_id, turn, coalesce(last_value(case when role <> 'user' then role end ignore nulls) over w, '') as speaker,
  string_agg(role, '>') over w as path
from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and current row)
""",
)
def state_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wires' values after each position: a last-present fold and an appending one."""
    turns = table(spark, sf_dir, "conversations").withColumn("port", F.lit(0))
    writes = turns.select("conv_id", "turn", "port", F.when(F.col("role") != "user", F.col("role")).otherwise("").alias("said"), F.array("role").alias("step"))
    out = folds.folds_running(writes, ["conv_id"], "turn", "port", {"speaker": ("said", "last_present_wins"), "path": ("step", "append_list")})
    return out.select("conv_id", "turn", "speaker", F.array_join("path", ">").alias("path"))


@query(
    "fold_wide_row",
    """
select o_orderkey, o_orderpriority || o_orderstatus as text, case when o_orderstatus <> 'O' then o_orderstatus else o_orderpriority end as present,
  case when o_orderstatus = o_orderpriority then o_orderstatus else o_orderstatus || ',' || o_orderpriority end as tags,
  'a=' || case when o_totalprice > 100000 then '2' else '1' end || ',b=' || cast(o_custkey as varchar) as merged
from orders
""",
)
def fold_wide_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folds over the columns of a row."""
    o = table(spark, sf_dir, "orders")
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    text, tags, merged = T.StringType(), T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.StringType())
    second = F.when(F.col("o_totalprice") > 100000, F.create_map(F.lit("a"), F.lit("2"))).otherwise(F.create_map().cast(merged))
    base = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.col("o_custkey").cast("string"))
    return o.select(
        "o_orderkey",
        folds.fold_wide("concat_str", [p, s], text).alias("text"),
        folds.fold_wide("last_present_wins", [p, F.when(s != "O", s).otherwise("")], text).alias("present"),
        shown(folds.fold_wide("union_set", [F.array(s), F.array(p, s)], tags), tags).alias("tags"),
        shown(folds.fold_wide("deep_merge_dict", [base, second], merged), merged).alias("merged"),
    )


# rules: the rows that fail ---------------------------------------------------------------------

_WORDS = "split(text, ' ')"
#: a text's different words, each with its length
_LENGTHS, _DIFFERENT = f"map_from_arrays(array_distinct({_WORDS}), transform(array_distinct({_WORDS}), x -> length(x)))", "len(list_distinct(string_split(text, ' ')))"
#: keyword -> table, its key, the value, the rule's parameter, and what fails in SQL
_RULES: dict[str, tuple[str, str, str, object, str]] = {
    "minimum": ("part", "p_partkey", "p_size", 20, "p_size < 20"),
    "maximum": ("part", "p_partkey", "p_retailprice", 950.0, "p_retailprice > 950"),
    "exclusiveMinimum": ("part", "p_partkey", "p_size", 20, "p_size <= 20"),
    "exclusiveMaximum": ("orders", "o_orderkey", "o_totalprice", 250000.0, "o_totalprice >= 250000"),
    "multipleOf": ("part", "p_partkey", "p_size", 3, "p_size % 3 <> 0"),
    "minLength": ("documents", "doc_id", "text", 500, "length(text) < 500"),
    "maxLength": ("documents", "doc_id", "text", 5000, "length(text) > 5000"),
    "pattern": ("part", "p_partkey", "p_name", "a.*e", "not regexp_matches(p_name, 'a.*e')"),
    "minItems": ("documents", "doc_id", _WORDS, 50, "len(string_split(text, ' ')) < 50"),
    "maxItems": ("documents", "doc_id", _WORDS, 2000, "len(string_split(text, ' ')) > 2000"),
    "uniqueItems": ("documents", "doc_id", _WORDS, True, "len(list_distinct(string_split(text, ' '))) <> len(string_split(text, ' '))"),
    "minProperties": ("documents", "doc_id", _LENGTHS, 50, f"{_DIFFERENT} < 50"),
    "maxProperties": ("documents", "doc_id", _LENGTHS, 150, f"{_DIFFERENT} > 150"),
    "enum": ("orders", "o_orderkey", "o_orderstatus", ["O", "F"], "o_orderstatus not in ('O', 'F')"),
}


def _rule_query(keyword: str) -> Query:
    name, key, value, parameter, _ = _RULES[keyword]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, name).withColumn("__v", F.expr(value))
        ok = rules.passes(F.col("__v"), rows.schema["__v"].dataType, keyword, parameter)
        return rows.where(~ok).select(F.col(key).alias("id"))

    return run


for _keyword, (_name, _key, _, _, _fails) in _RULES.items():
    query(f"rule_{_keyword}", f"select {_key} as id from {_name} where {_fails}")(_rule_query(_keyword))


@query(
    "rule_report",
    """
with f as (
  select doc_id, 0 as place, case when length(text) < 300 then 'text:minLength' when length(text) > 9000 then 'text:maxLength' end as failed from documents
  union all select doc_id, 1, case when lang not in ('en', 'de') then 'lang:enum' end from documents
  union all select doc_id, 2, case when n_chars > 4000 then 'n_chars:maximum' when n_chars % 2 <> 0 then 'n_chars:multipleOf' end from documents)
select doc_id, string_agg(failed, ',' order by place) as failed from f where failed is not null group by doc_id
""",
)
def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry a failed field: its first failing rule, fields in declared order."""
    docs = table(spark, sf_dir, "documents")
    found = rules.failures({
        "text": (F.col("text"), STR, [("minLength", 300), ("maxLength", 9000)]),
        "lang": (F.col("lang"), STR, [("enum", ["en", "de"])]),
        "n_chars": (F.col("n_chars"), parse_type("int"), [("maximum", 4000), ("multipleOf", 2)]),
    })
    listed = docs.select("doc_id", found.alias("failed")).where(F.size("failed") > 0)
    return listed.select("doc_id", F.array_join(F.transform("failed", lambda x: F.concat_ws(":", x.path, x.rule)), ",").alias("failed"))


# event logs ------------------------------------------------------------------------------------


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event log with a run a conversation and a step a turn, some of them incomplete or repeated."""
    turns = table(spark, sf_dir, "conversations").withColumn("run", F.col("conv_id").cast("string"))
    size = F.length("text")
    kind = F.when(F.col("role") == "assistant", "trainable").when(F.col("role") == "user", "transform").otherwise("service")
    step = {
        "pipeline_run_id": F.col("run"), "handler_position": F.col("turn").cast("int"), "handler_name": F.col("role"), "node_kind": kind,
        "correlation_id": correlation_id(F.col("run"), F.col("turn")), "reads_snapshot": F.col("role"), "writes_snapshot": F.sha2("text", 256),
        "input_payload": F.col("role"), "output_payload": F.when(size % 5 == 0, F.col("role")).otherwise(F.sha2("text", 256)),
        "timestamp": F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn") * F.col("turn") * 7),
    }

    def made(event: str, rows: DataFrame, known: dict[str, Column]) -> DataFrame:
        known = known | {"event_type": F.lit(event)}
        return rows.select(*(known.get(c, F.lit(None)).cast(k).alias(c) for c, k in eventlog.EVENT_COLUMNS.items()))

    def some(*names: str) -> dict[str, Column]:
        return {k: v for k, v in step.items() if k in ("pipeline_run_id", "handler_position", "handler_name", "node_kind", "timestamp", *names)}

    convs = turns.groupBy("run", "conv_id").agg(F.count("*").alias("n"))
    parent = F.when(F.col("conv_id") >= 2, F.floor(F.col("conv_id") / 2).cast("string"))
    begin = {"pipeline_run_id": F.col("run"), "pipeline_hash": F.concat(F.lit("h"), (F.col("conv_id") % 4).cast("string")), "parent_run_id": parent}
    calls = turns.where("role <> 'user'")
    parts = [
        made("pipeline_start", convs, begin),
        made("handler_enter", turns, some("reads_snapshot")),
        made("service_invocation", calls, some("correlation_id", "input_payload", "output_payload")),
        made("service_invocation", calls.where(size % 11 == 0), some("correlation_id", "input_payload", "output_payload")),
        made("handler_exit", turns.where(size % 7 != 0), some("correlation_id", "writes_snapshot")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_TURN = "cast(conv_id as varchar) as pipeline_run_id, cast(turn as integer) as handler_position"
_EXITS = "(select * from conversations where length(text) % 7 <> 0)"


@query("log_pair_join", f"select {_TURN}, role as handler_name, role as reads_snapshot, sha256(text) as writes_snapshot from {_EXITS} where role = 'assistant'")
def log_pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = eventlog.pairs(conversation_log(spark, sf_dir))
    return found.select("pipeline_run_id", "handler_position", "handler_name", "reads_snapshot", "writes_snapshot")


@query("log_incomplete", f"select {_TURN}, role as handler_name from conversations where length(text) % 7 = 0")
def log_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.incomplete(conversation_log(spark, sf_dir))


@query(
    "log_holes",
    f"""select pipeline_run_id, handler_position as after, next as before from (
  select {_TURN}, cast(lead(turn) over (partition by conv_id order by turn) as integer) as next from {_EXITS}) where next > handler_position + 1""",
)
def log_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.holes(conversation_log(spark, sf_dir))


@query("log_multicall", "select conv_id || ':' || turn as correlation_id, cast(2 as bigint) as n from conversations where role <> 'user' and length(text) % 11 = 0")
def log_multicall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.repeated_calls(conversation_log(spark, sf_dir))


@query(
    "log_divergence",
    f"""with d as (select conv_id || ':' || turn as correlation_id, role as output_payload, sha256(text) as writes_snapshot, length(text) as n
  from {_EXITS} where role <> 'user' and length(text) % 5 = 0)
select correlation_id, output_payload, writes_snapshot from d union all select correlation_id, output_payload, writes_snapshot from d where n % 11 = 0""",
)
def log_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.divergence(conversation_log(spark, sf_dir))


_LINEAGE = """with recursive run as (select distinct conv_id as id, case when conv_id >= 2 then conv_id // 2 end as up from conversations),
tree as (
  select id, id as root, 0 as depth from run where up is null or up not in (select id from run)
  union all select run.id, tree.root, tree.depth + 1 from run join tree on run.up = tree.id)
select cast(id as varchar) as run, cast(root as varchar) as root, cast(depth as bigint) as depth from tree"""


@query("log_lineage", _LINEAGE)
def log_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.lineage(conversation_log(spark, sf_dir))


@query("log_lineage_appended", _LINEAGE)
def log_lineage_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from two appends: the second has parents and children of what the first has."""
    log = conversation_log(spark, sf_dir).where("event_type = 'pipeline_start'")
    second = F.col("pipeline_hash").isin("h1", "h2")
    none = spark.createDataFrame([], eventlog.STORED)
    stored = eventlog.lineage_appended(eventlog.lineage_appended(none, log.where(~second)), log.where(second))
    return stored.select("run", "root", "depth")


@query(
    "log_bucket",
    f"""with s as (select conv_id from conversations
  union all select conv_id from conversations where role <> 'user'
  union all select conv_id from conversations where role <> 'user' and length(text) % 11 = 0
  union all select conv_id from {_EXITS})
select 'h' || (conv_id % 4) as run_hash, count(distinct conv_id) as runs, count(*) as steps from s group by 1""",
)
def log_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.buckets(conversation_log(spark, sf_dir))


@query(
    "log_replay",
    f"""select {_TURN}, 'first' as side from {_EXITS} where turn = 1
union all select cast(conv_id as varchar), cast(turn as integer), 'second' from {_EXITS} where turn = 1""",
)
def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run against its replay in which every second step wrote something else."""
    left = eventlog.pairs(conversation_log(spark, sf_dir), None)
    other = left.withColumn("writes_snapshot", F.when(F.col("handler_position") == 1, F.lit("other")).otherwise(F.col("writes_snapshot")))
    return eventlog.replay_differences(left, other).select("pipeline_run_id", "handler_position", "side")


@query(
    "log_gaps",
    """select user_id, event_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by event_id))) / 1000.0 as gap_ms from events""",
)
def log_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    log = rows.select(
        F.col("user_id").alias("pipeline_run_id"), F.col("event_id").alias("handler_position"), F.lit("handler_exit").alias("event_type"), F.col("ts").cast("timestamp").alias("timestamp")
    )
    return eventlog.gaps(log).select(F.col("pipeline_run_id").alias("user_id"), F.col("handler_position").alias("event_id"), "gap_ms")


@query(
    "log_harvest",
    f"""with e as (select {_TURN}, conv_id, turn, role, text from conversations),
c as (select conv_id, turn, role, text from conversations where role <> 'user' union all
  select conv_id, turn, role, text from conversations where role <> 'user' and length(text) % 11 = 0)
select e.pipeline_run_id, e.handler_position, e.role as reads_snapshot, sha256(x.text) as writes_snapshot,
  case when c.text is null then null when length(c.text) % 5 = 0 then c.role else sha256(c.text) end as output_payload
from e left join {_EXITS} x on x.conv_id = e.conv_id and x.turn = e.turn left join c on c.conv_id = e.conv_id and c.turn = e.turn""",
)
def log_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.harvest(conversation_log(spark, sf_dir)).select("pipeline_run_id", "handler_position", "reads_snapshot", "writes_snapshot", "output_payload")


def drift_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Artifacts, their side files, what is deployed, and what drift is acknowledged."""
    p = table(spark, sf_dir, "part").select(
        F.concat(F.lit("art"), F.col("p_partkey").cast("string")).alias("artifact"), F.concat(F.lit("t"), (F.col("p_partkey") % 10).cast("string")).alias("trainable"), "p_size", "p_partkey"
    )
    manifests = p.where("p_size % 5 <> 0").select(
        "artifact", "trainable", F.when(F.col("p_size") % 2 == 0, "now").otherwise("old").alias("bundle_hash"),
        F.array(F.when(F.col("p_partkey") % 3 == 0, "current").otherwise("former")).alias("pipeline_hashes"),
    )
    current = p.select("trainable", F.lit("now").alias("bundle_hash"), F.lit("current").alias("pipeline_hash")).distinct()
    return p.select("artifact", "trainable"), manifests, current, p.where("p_partkey % 7 = 0").select("artifact", "trainable")


@query(
    "drift_ladder",
    """with a as (select p_partkey as k, p_size as s from part)
select 'art' || k as artifact, 't' || (k % 10) as trainable, case
  when s % 5 = 0 then 'halt'
  when s % 2 = 0 and k % 3 = 0 then 'proceed'
  when s % 2 <> 0 then case when k % 7 = 0 then 'event' else 'halt' end
  else 'warn' end as outcome from a""",
)
def drift_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rung of the ladder under enforcement; each part is an artifact."""
    return drift.ladder(*drift_tables(spark, sf_dir), True)


# reductions of one's own -----------------------------------------------------------------------


@query("reduce_spread", "select user_id as run, count(value) as n, round(avg(value), 9) as mean, round(var_pop(value), 7) as variance from events group by user_id")
def reduce_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reduction with states that are merged in any order."""
    got = reduce.reduce_runs(table(spark, sf_dir, "events"), ["user_id"], ["value"], reduce.spread("value"))
    return got.select(F.col("user_id").alias("run"), "value.n", F.round("value.mean", 9).alias("mean"), F.round("value.variance", 7).alias("variance"))


@query(
    "reduce_longest_rise",
    """with a as (select user_id, event_id, value, case when value > lag(value) over (partition by user_id order by event_id) then 0 else 1 end as breaks from events),
b as (select user_id, sum(breaks) over (partition by user_id order by event_id rows unbounded preceding) as stretch from a),
c as (select user_id, stretch, count(*) as n from b group by user_id, stretch) select user_id as run, max(n) as longest from c group by user_id""",
)
def reduce_longest_rise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reduction in order: states of stretches, merged one after the other."""
    got = reduce.reduce_runs(table(spark, sf_dir, "events"), ["user_id"], ["value"], reduce.longest_rise("value"), ["event_id"], "longest")
    return got.select(F.col("user_id").alias("run"), "longest")


# flows -----------------------------------------------------------------------------------------


def order_flow() -> tuple[Plan, Registry]:
    """Two steps over orders: text is made, then tags and a total are folded from both and a seed."""
    registry = Registry()
    declared = {
        "shop.label": (
            {"status": "str", "priority": "str"}, {"label": {"type": "str", "maxLength": 40}, "tags": {"type": "list[str]"}}, {"sep": {"type": "str", "default": "/"}},
        ),
        "shop.price": ({"label": "str", "price": "float"}, {"tags": {"type": "list[str]"}, "band": {"type": "str", "enum": ["low", "high"]}}, {}),
    }
    for name, (reads, outputs, bindings) in declared.items():
        registry.add(load.step({"transform": {}, "reads": {k: {"type": v} for k, v in reads.items()}, "output_schema": outputs, "bindings": bindings}, name))

    @registry.columns("shop.label")
    def label(status: Column, priority: Column, sep: str) -> dict[str, Column]:
        return {"label": F.concat(priority, F.lit(sep), status), "tags": F.array(status)}

    @registry.columns("shop.price")
    def price(label: Column, price: Column) -> dict[str, Column]:
        band = F.when(price < 0, "none").when(price < 150000, "low").otherwise("high")
        return {"tags": F.array(F.substring(label, 1, 1)), "band": band}

    text = """
[meta]
name = "shop.orders"
[[nodes]]
kind = "handler"
name = "shop.label"
reads_map = { priority = "urgency" }
[[nodes]]
kind = "handler"
name = "shop.price"
[merge]
tags = "append_list"
[inputs]
status = { type = "str", enum = ["O", "F"] }
urgency = { type = "str" }
price = { type = "float", maximum = 400000 }
tags = { type = "list[str]" }
[outputs]
label = { type = "str" }
tags = { type = "list[str]" }
"""
    return compile_flow(load.loads(text, "pipeline"), registry), registry


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("urgency"),
        F.col("o_totalprice").alias("price"), F.array(F.lit("seed")).alias("tags"), "o_custkey",
    )


_FINE = "o_orderstatus in ('O', 'F') and o_totalprice <= 400000"


@query(
    "pipeline_state",
    f"""select o_orderkey as run_id, case when o_totalprice < 150000 then 'low' else 'high' end as band, o_orderpriority || '/' || o_orderstatus as label,
  'seed,' || o_orderstatus || ',' || substr(o_orderpriority, 1, 1) as tags from orders where {_FINE}""",
)
def pipeline_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, registry = order_flow()
    state = transform(plan, _orders(spark, sf_dir), registry).state()
    return state.select("run_id", "band", "label", F.array_join("tags", ",").alias("tags"))


@query(
    "pipeline_outputs",
    f"select o_orderkey as run_id, o_orderpriority || '/' || o_orderstatus as label, 'seed,' || o_orderstatus || ',' || substr(o_orderpriority, 1, 1) as tags from orders where {_FINE}",
)
def pipeline_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, registry = order_flow()
    return transform(plan, _orders(spark, sf_dir), registry).outputs().select("run_id", "label", F.array_join("tags", ",").alias("tags"))


@query(
    "pipeline_errors",
    """select o_orderkey as run_id, 'SchemaValidationError' as error_class, case when o_orderstatus not in ('O', 'F') then 0 else 1 end as position,
  case when o_orderstatus not in ('O', 'F') then 'status enum' else 'price maximum' end as message
from orders where o_orderstatus not in ('O', 'F') or o_totalprice > 400000""",
)
def pipeline_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds are validated where they are first used, so the price fails at the second step."""
    plan, registry = order_flow()
    return transform(plan, _orders(spark, sf_dir), registry).errors().select("run_id", "error_class", "position", "message")


@query(
    "pipeline_events",
    f"""select event_type, cast(coalesce(handler_position, -1) as integer) as handler_position, count(*) as n from (
  select unnest(['pipeline_start', 'handler_enter', 'handler_exit', 'handler_enter', 'handler_exit', 'pipeline_complete']) as event_type,
    unnest([null, 0, 0, 1, 1, null]) as handler_position from orders where {_FINE}
  union all select unnest(['pipeline_start', 'pipeline_error']), null from orders where o_orderstatus not in ('O', 'F')
  union all select unnest(['pipeline_start', 'handler_enter', 'handler_exit', 'pipeline_error']), unnest([null, 0, 0, null])
    from orders where o_orderstatus in ('O', 'F') and o_totalprice > 400000) group by 1, 2""",
)
def pipeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, registry = order_flow()
    events = transform(plan, _orders(spark, sf_dir), registry).events()
    return events.groupBy("event_type", F.coalesce("handler_position", F.lit(-1)).alias("handler_position")).agg(F.count("*").alias("n"))


@query(
    "pipeline_nested",
    "select c_custkey as run_id, upper(c_mktsegment) || '!' as loud, c_mktsegment || '>' || upper(c_mktsegment) || '!' as trail from customer",
)
def pipeline_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow in a flow, in the same rows; its run has an id and events of its own."""
    registry = Registry()
    text = {"type": "str"}
    registry.add(
        load.step({"transform": {}, "reads": {"segment": text}, "output_schema": {"upper": text}}, "say.upper"),
        load.step({"transform": {}, "reads": {"upper": text}, "output_schema": {"loud": text}}, "say.loud"),
        load.step({"transform": {}, "reads": {"segment": text, "loud": text}, "output_schema": {"trail": text}}, "say.trail"),
    )
    registry.columns("say.upper")(lambda segment: {"upper": F.upper(segment)})
    registry.columns("say.loud")(lambda upper: {"loud": F.concat(upper, F.lit("!"))})
    registry.columns("say.trail")(lambda segment, loud: {"trail": F.concat(segment, F.lit(">"), loud)})
    steps = [{"kind": "handler", "name": n} for n in ("say.upper", "say.loud")]
    inner = load.composition({"meta": {"kind": "pipeline", "name": "inner"}, "nodes": steps, "inputs": {"segment": text}, "outputs": {"loud": text}})
    outer = {"meta": {"name": "outer"}, "nodes": [{"kind": "composition", "name": "inner"}, {"kind": "handler", "name": "say.trail"}], "inputs": {"segment": text}, "outputs": {"trail": text}}
    plan = compile_flow(load.flow(outer), registry.add(inner))
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("segment"))
    return transform(plan, runs, registry).state()


@query("pipeline_rows", "select p_partkey as run_id, reverse(p_name) as back, cast(length(p_name) as bigint) as size from part where p_size <> 7")
def pipeline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body in Python, which raises for some rows; only these fail."""
    registry = Registry()
    registry.add(load.step({"transform": {}, "reads": {"name": {"type": "str"}, "size_in": {"type": "int"}}, "output_schema": {"back": {"type": "str"}, "size": {"type": "int"}}}, "py.turn"))

    @registry.rows("py.turn")
    def turn(name: str, size_in: int) -> dict:
        if size_in == 7:
            raise ValueError("seven")
        return {"back": name[::-1], "size": len(name)}

    inputs = {"name": {"type": "str"}, "size_in": {"type": "int"}}
    plan = compile_flow(load.flow({"meta": {"name": "rows"}, "nodes": [{"kind": "handler", "name": "py.turn"}], "inputs": inputs}), registry)
    runs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run_id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size_in"))
    return transform(plan, runs, registry).state()


def trainable_flow(form: str = "json_schema", streamable: bool = False) -> tuple[Plan, Registry]:
    """A composition with a preparing step and a model call, answered offline."""
    registry = Registry()
    registry.add(
        load.service_type({"name": "fake.chat", "identity_schema": {"model": {"type": "str"}}, "transport_schema": {"endpoint": {"type": "str"}}, "config_schema": {"temperature": {"type": "float", "default": 1.0}}}),
        load.step({"transform": {}, "reads": {"said": {"type": "str"}}, "output_schema": {"prompt": {"type": "str"}}, "bindings": {"config": {"head": {"type": "str"}}}}, "chat.prompt"),
    )
    registry.columns("chat.prompt")(lambda said, config: {"prompt": F.concat(F.lit(config["head"]), said)})
    registry.backends["fake.chat"] = Fake(form)
    composition = {
        "meta": {"kind": "trainable", "name": "answer"}, "inputs": {"said": {"type": "str"}}, "outputs": {"mood": {"type": "str", "enum": ["calm", "loud"]}},
        "preprocessors": [{"kind": "handler", "name": "chat.prompt", "id": "make", "writes_map": {"prompt": "full"}, "bindings": {"config": {"head": "Q: "}}}],
        "service_bindings": {"llm": {"type": "fake.chat", "model": "m"}},
        "trainable": {"streamable": streamable, "config": {}, "service_bindings": {"llm": {"type": "fake.chat"}}, "reads": {"full": {"type": "str"}}, "output_schema": {"mood": {"type": "str", "enum": ["calm", "loud"]}}},
    }
    flow = {"meta": {"name": "chat"}, "nodes": [{"kind": "composition", "name": "answer"}], "inputs": {"said": {"type": "str"}}, "outputs": {"mood": {"type": "str", "enum": ["calm", "loud"]}}}
    registry.add(load.composition(composition))
    return compile_flow(load.flow(flow), registry), registry


_PROMPT = "to_json('Q: ' || text)"
_MOOD = """case when instr('02468ace', right(sha256('[(''model'', ''m'')][(''temperature'', 1.0)]Q: ' || text || '/mood'), 1)) > 0 then 'calm' else 'loud' end"""


@query(
    "pipeline_trainable",
    f"""select conv_id || ':' || turn as pipeline_run_id, cast(1 as integer) as handler_position, '{{"full":' || {_PROMPT} || '}}' as reads_snapshot,
  '{{"mood":"' || {_MOOD} || '"}}' as writes_snapshot from conversations where role = 'user'""",
)
def pipeline_trainable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training pairs from the log of a flow with a model call."""
    plan, registry = trainable_flow()
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    runs = turns.select(F.concat_ws(":", "conv_id", "turn").alias("run_id"), F.col("text").alias("said"))
    pairs = eventlog.pairs(transform(plan, runs, registry).events())
    return pairs.select("pipeline_run_id", "handler_position", "reads_snapshot", "writes_snapshot")
