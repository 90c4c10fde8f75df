"""Secrets in texts: three patterns, and strings of high entropy.

Patterns
    Leftmost non-overlapping matches of an assignment to a secret's name, of an access key id and
    of a long hexadecimal run, each under a least length (see ``op6_secret_scan``).

Entropy
    Candidates are the maximal runs of 20 or more characters of ``A-Za-z0-9+/_=-`` that hold a
    digit.  A run of hexadecimal digits of one case is of class ``hex``, any other of class
    ``mixed``.  A window of 20 characters slides over the candidate.  Its Shannon entropy comes
    from counts that are updated by the character that enters and the one that leaves.  The span
    from the start of the first to the end of the last window at or over the class's threshold
    is reported, unless a pattern of the allow-list matches the candidate.

Built-in functions only, on each row alone: one pass without a shuffle, whatever the skew.
Positions are code points.  Texts without a hit stop at the regular expressions, which are linear in
the text.  What follows is not: each character of a candidate makes the 128 counters anew, and the
place of each hit is summed over its group of 128 and over the groups, so h hits cost some
128 h + (h / 128)^2 steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# a failing match of these two hides no other, so the least length stands in the pattern
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: class -> least entropy in bits of a window of 20 characters
THRESHOLDS = {"hex": 3.1, "mixed": 3.8}
#: Candidates that are no secrets: UUIDs, paths and URLs' parts, words joined by - or _, placeholders.
ALLOW = (
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"^([A-Za-z]*[0-9]*[/_-])+([A-Za-z]+[0-9]*|[0-9]+)=?$",
    r"^[A-Z]?[a-z]+[0-9]{1,4}$",
    r"(?i)example|placeholder|changeme|your_?(key|token|secret)",
    r"(?i)abcdefghij|0123456789|1234567890",
)
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")
_GROUP = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: inside a lambda an expression would be computed each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts(lengths: Column) -> Column:
    """Sums of all before: [a, b, c] -> [0, a, a+b].

    In groups of 128, so that the cost grows by far less than the square of the count.
    """
    return let(lengths, lambda x: let(_groups(x), _starts))


def _groups(lengths: Column) -> Column:
    """The array in groups of 128; one empty group for an empty array."""
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / _GROUP).cast("int") - 1, F.lit(0))),
        lambda k: F.slice(lengths, k * _GROUP + 1, F.lit(_GROUP)),
    )


def _starts(groups: Column) -> Column:
    none = F.array().cast("array<int>")
    running = F.aggregate(
        groups,
        F.struct(F.lit(0).alias("s"), none.alias("o")),
        lambda acc, g: F.struct(
            (acc.s + F.aggregate(g, F.lit(0), lambda a, x: a + x)).alias("s"), F.concat(acc.o, F.array(acc.s)).alias("o")
        ),
        lambda acc: acc.o,
    )
    within = F.zip_with(
        groups, running, lambda g, b: F.transform(g, lambda _, i: b + F.aggregate(F.slice(g, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    )
    return F.flatten(within)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, hit, part); part is the group."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.transform(hits, lambda _: F.lit(None).cast("string"))

    def placed(x: Column) -> Column:
        before = F.transform(F.slice(x.gaps, F.lit(1), F.size(x.hits)), F.length)
        at = F.zip_with(starts(F.zip_with(before, x.hits, lambda b, h: b + F.length(h))), before, lambda s, b: s + b)
        return F.transform(
            F.arrays_zip(at.alias("start"), x.hits.alias("hit"), x.parts.alias("part")),
            lambda m: F.struct(m.start.alias("start"), (m.start + F.length(m.hit)).alias("end"), m.hit.alias("hit"), m.part.alias("part")),
        )

    found = let(F.struct(hits.alias("hits"), parts.alias("parts"), F.split(text, pattern, -1).alias("gaps")), placed)
    empty = F.array().cast("array<struct<start:int,end:int,hit:string,part:string>>")
    return F.when(text.rlike(pattern), found).otherwise(empty)


def _gain(count: Column) -> Column:
    """count * log2(count), from a table of the counts that a window can have."""
    table = F.array(*(F.lit(0.0 if c == 0 else c * math.log2(c)) for c in range(WINDOW + 2)))
    return F.get(table, count)


def hot_range(candidate: Column, least: Column) -> Column:
    """(first, last): the range over the windows of ``WINDOW`` characters with enough entropy; first -1 if none."""
    # an empty last piece of the split would be no character
    codes = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return let(codes, lambda x: _hot_range(x, least))


def _hot_range(codes: Column, least: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        come = F.get(codes, i)
        go = F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(-1))
        c_in = F.get(acc.n, come)
        # a character that leaves as it enters changes nothing
        c_out = F.when((go >= 0) & (go != come), F.get(acc.n, go))
        same = go == come
        total = (
            acc.total
            + F.when(same, 0.0).otherwise(_gain(c_in + 1) - _gain(c_in))
            - F.coalesce(_gain(c_out) - _gain(c_out - 1), F.lit(0.0))
        )
        counts = F.when(same, acc.n).otherwise(
            F.transform(acc.n, lambda c, k: c + F.when(k == come, 1).when(k == go, -1).otherwise(0))
        )
        bits = F.lit(math.log2(WINDOW)) - total / WINDOW
        hot = (i >= WINDOW - 1) & (bits >= least)
        return F.struct(
            counts.alias("n"),
            total.alias("total"),
            F.when(hot & (acc["first"] < 0), i - (WINDOW - 1)).otherwise(acc["first"]).alias("first"),
            F.when(hot, i + 1).otherwise(acc["last"]).alias("last"),
        )

    zero = F.struct(
        F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0.0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last")
    )
    return F.aggregate(
        F.sequence(F.lit(0), F.size(codes) - 1), zero, step,
        lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")),
    )


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))


def _all_spans(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: _span(kind, x.start, x.end))


def entropy_spans(text: Column, thresholds: dict[str, float] | None = None, allow: Sequence[str] = ALLOW) -> Column:
    thresholds = thresholds or THRESHOLDS

    def allowed(x: Column) -> Column:
        return reduce(lambda a, b: a | b, (x.hit.rlike(p) for p in allow), F.lit(False))

    runs = F.filter(matches(text, CANDIDATE), lambda x: x.hit.rlike("[0-9]") & ~allowed(x))

    def judged(x: Column) -> Column:
        is_hex = x.hit.rlike("^([0-9a-f]+|[0-9A-F]+)$")
        hot = hot_range(x.hit, F.when(is_hex, thresholds["hex"]).otherwise(thresholds["mixed"]))
        return F.struct(x.start.alias("start"), is_hex.alias("is_hex"), hot.alias("hot"))

    hot = F.filter(F.transform(runs, judged), lambda x: x.hot["first"] >= 0)
    return F.transform(
        hot,
        lambda x: F.struct(
            (x.start + x.hot["first"]).alias("start"),
            F.when(x.is_hex, KINDS.index("entropy_hex")).otherwise(KINDS.index("entropy_mixed")).alias("kind"),
            (x.start + x.hot["last"]).alias("end"),
        ),
    )


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    thresholds: dict[str, float] | None = None, allow: Sequence[str] = ALLOW,
) -> DataFrame:
    """One row a document: id_col, base and spans, sorted arrays of (start, kind, end).

    base has the patterns' spans, spans those and the entropy spans; kind is an index into
    ``KINDS``.  A null text counts as empty and has no spans.  Ids may be null or repeat; every
    row gives one row.  Other columns are not read.  An empty table gives no rows.
    """
    held = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    text = F.col("__text")
    assign = _all_spans("assign", F.filter(matches(text, ASSIGN, 2), lambda x: F.length(x.part) >= 8))
    base = [assign, _all_spans("access", matches(text, ACCESS)), _all_spans("hex", matches(text, HEX))]
    found = held.select(F.col(id_col), F.array_sort(F.concat(*base)).alias("base"), entropy_spans(text, thresholds, allow).alias("more"))
    return found.select(F.col(id_col), "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.kind), x.start.cast("string"), x.end.cast("string"))), ","
    )


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x.kind == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(kind) for kind in range(3)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_KNOWN = " union all ".join(
    f"select doc_id, {kind} as k, regexp_extract_all(t, {_quoted(p)}) as hits, regexp_extract_all(t, {_quoted(p)}, {group}) as parts, "
    f"string_split_regex(t, {_quoted(p)}) as gaps from d where regexp_matches(t, {_quoted(p)})"
    for kind, p, group in ((0, ASSIGN, 2), (1, ACCESS, 0), (2, HEX, 0), (9, CANDIDATE, 0))
)
SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
known as ({_KNOWN}),
placed as (
  select doc_id, k, unnest(hits) as hit, unnest(parts) as part, unnest(list_transform(range(1, len(hits) + 1), lambda i:
    coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))) as s
  from known
), base as (
  select doc_id, k, cast(s as bigint) as s, cast(s + length(hit) as bigint) as e from placed where k < 9 and (k > 0 or length(part) >= 8)
), candidate as (
  select doc_id, s, hit, regexp_full_match(hit, '[0-9a-f]+|[0-9A-F]+') as is_hex from placed
  where k = 9 and regexp_matches(hit, '[0-9]') and not ({" or ".join(f"regexp_matches(hit, {_quoted(p)})" for p in ALLOW)})
), seen as (
  select doc_id, s, is_hex, hit, unnest(range(1, length(hit) - {WINDOW - 2})) as i from candidate
), hot as (
  select doc_id, s, is_hex, min(i) as lo, max(i) as hi from seen
  where list_aggregate(string_split(hit[i:i + {WINDOW - 1}], ''), 'entropy') >= case when is_hex then {THRESHOLDS["hex"]} else {THRESHOLDS["mixed"]} end
  group by doc_id, s, is_hex
), spans as (
  select * from base union all
  select doc_id, case when is_hex then 3 else 4 end, cast(s + lo - 1 as bigint), cast(s + hi - 1 + {WINDOW} as bigint) from hot
), said as (
  select doc_id, k, s, e, ([{", ".join(map(_quoted, KINDS))}])[k + 1] || ':' || s || ':' || e as x from spans
)
select d.doc_id, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex,
  sha256(coalesce(string_agg(x, ',' order by s, k, e) filter (where k < 3), '')) as base_sha256, coalesce(string_agg(x, ',' order by s, k, e), '') as spans
from d left join said on said.doc_id = d.doc_id group by d.doc_id
"""
