"""Seven ordered folds of a wire's contributions, in three forms.

* wide: over the columns of a row, in contribution order;
* long: an aggregate over rows (run, position, port, value);
* so far: a running window over the same rows, in which a reader at a position sees the fold of the
  positions strictly before it.

Contributions are ordered by (position, port); a seed has position -1.  Values aren't null.  The
result of a list or text fold holds all of a run's contributions, so a run's rows meet in one task
whatever is done; the other folds are partial aggregations.  Sets keep each item where it first
stands; maps of maps are merged by the paths of their keys, and what meets in one row is a result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.canonical import canonical_text

STRATEGIES = ("last_wins", "first_wins", "last_present_wins", "append_list", "union_set", "deep_merge_dict", "concat_str")


def accepts(strategy: str, kind: T.DataType) -> bool:
    """Whether the strategy folds values of the type."""
    match strategy:
        case "append_list" | "union_set":
            return isinstance(kind, T.ArrayType)
        case "deep_merge_dict":
            return isinstance(kind, (T.MapType, T.StructType))
        case "concat_str":
            return isinstance(kind, T.StringType)
    return strategy in STRATEGIES


def present(value: Column, kind: T.DataType) -> Column:
    """Whether a value counts as present: sized values if not empty, all others always."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.length(value) > 0
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.size(value) > 0
    return F.lit(True)


def has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(has_map(f.dataType) for f in kind.fields)


def comparable(value: Column, kind: T.DataType) -> Column:
    """The value with every map as its entries in key order, so that equal values compare equal."""
    if not has_map(kind):
        return value
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e.key.alias("key"), comparable(e.value, kind.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: comparable(x, kind.elementType))
    return F.struct(*(comparable(value[f.name], f.dataType).alias(f.name) for f in kind.fields))


def distinct_items(value: Column, kind: T.ArrayType) -> Column:
    """The items without repeats, first occurrences in order."""
    item = kind.elementType
    if not has_map(item):
        return F.array_distinct(value)
    # maps don't compare: number the items, keep the first of each comparable form
    forms = F.transform(value, lambda x: comparable(x, item))
    return F.filter(value, lambda x, i: F.array_position(forms, comparable(x, item)) == i + 1)


def deep_merge(a: Column, b: Column, kind: T.DataType) -> Column:
    """b over a; where both are objects, key by key."""
    if isinstance(kind, T.MapType):
        value = kind.valueType

        def pick(k: Column, x: Column, y: Column) -> Column:
            both = deep_merge(x, y, value)
            return F.when(~F.map_contains_key(b, k), x).when(F.map_contains_key(a, k) & x.isNotNull() & y.isNotNull(), both).otherwise(y)

        return F.map_zip_with(a, b, pick)
    if isinstance(kind, T.StructType):
        return F.struct(*(deep_merge(a[f.name], b[f.name], f.dataType).alias(f.name) for f in kind.fields))
    return b


def start(strategy: str, value: Column, kind: T.DataType) -> Column:
    """The fold of one contribution."""
    return distinct_items(value, kind) if strategy == "union_set" else value


def step(strategy: str, so_far: Column, value: Column, kind: T.DataType) -> Column:
    """The fold of what is so far and one more contribution."""
    match strategy:
        case "last_wins":
            return value
        case "first_wins":
            return so_far
        case "last_present_wins":
            return F.when(present(value, kind), value).when(present(so_far, kind), so_far).otherwise(value)
        case "append_list" | "concat_str":
            return F.concat(so_far, value)
        case "union_set":
            return distinct_items(F.concat(so_far, value), kind)
        case "deep_merge_dict":
            return deep_merge(so_far, value, kind)
    raise ValueError(f"no strategy {strategy!r}")


def fold_wide(strategy: str, values: Sequence[Column], kind: T.DataType) -> Column:
    """The fold of columns in contribution order."""
    return reduce(lambda a, b: step(strategy, a, b, kind), values[1:], start(strategy, values[0], kind))


def _of_list(strategy: str, values: Column, kind: T.DataType) -> Column:
    """The fold of an array of contributions, in order; null if there are none."""
    match strategy:
        case "append_list":
            return F.when(F.size(values) > 0, F.flatten(values))
        case "union_set":
            return F.when(F.size(values) > 0, distinct_items(F.flatten(values), kind))
        case "concat_str":
            return F.when(F.size(values) > 0, F.array_join(values, ""))
        case "deep_merge_dict":
            rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
            return F.when(F.size(values) > 0, F.aggregate(rest, F.get(values, F.lit(0)), lambda a, x: deep_merge(a, x, kind)))
    raise ValueError(f"{strategy!r} isn't folded from a list")


def fold_long(rows: DataFrame, run: Sequence[str], order: Sequence[str], value: str, strategy: str, out: str = "value") -> DataFrame:
    """One row a run: its columns and the fold of its values.  order must be unique in a run."""
    kind = rows.schema[value].dataType
    v, at = F.col(value), F.struct(*order)
    if strategy == "last_wins":
        folded = F.max_by(v, at)
    elif strategy == "first_wins":
        folded = F.min_by(v, at)
    elif strategy == "last_present_wins":
        # a key that is null for what isn't present makes max_by pass over it
        folded = F.coalesce(F.max_by(v, F.when(present(v, kind), at)), F.max_by(v, at))
    elif strategy == "union_set":
        return _in_order(_first_items(rows, run, order, value, True), run, out)
    elif strategy == "deep_merge_dict" and _by_paths(kind):
        found = _paths(rows, run, order, value).groupBy(*run, *_keys(kind)).agg(*_latest())
        return _nested(found, rows.select(*run).distinct(), run, kind, out)
    else:
        if has_map(kind):  # such structs don't sort: entries instead, in the order they come
            listed = F.collect_list(F.struct(at.alias("at"), _entries(v, kind).alias("v")))
            ordered = F.transform(F.array_sort(listed), lambda x: _from_entries(x.v, kind))
        else:
            listed = F.collect_list(F.struct(at.alias("at"), v.alias("v")))
            ordered = F.transform(F.array_sort(listed), lambda x: x.v)
        folded = _of_list(strategy, ordered, kind)
    return rows.groupBy(*run).agg(folded.alias(out))


def _entries(value: Column, kind: T.DataType) -> Column:
    if not has_map(kind):
        return value
    if isinstance(kind, T.MapType):
        return F.transform(F.map_entries(value), lambda e: F.struct(e.key.alias("key"), _entries(e.value, kind.valueType).alias("value")))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _entries(x, kind.elementType))
    return F.struct(*(_entries(value[f.name], f.dataType).alias(f.name) for f in kind.fields))


def _from_entries(value: Column, kind: T.DataType) -> Column:
    if not has_map(kind):
        return value
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(value, lambda e: F.struct(e.key.alias("key"), _from_entries(e.value, kind.valueType).alias("value"))))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _from_entries(x, kind.elementType))
    return F.struct(*(_from_entries(value[f.name], f.dataType).alias(f.name) for f in kind.fields))


def _over(strategy: str, value: str, kind: T.DataType, window) -> Column:
    v = F.col(value)
    if strategy == "last_wins":
        return F.last(v, ignorenulls=True).over(window)
    if strategy == "first_wins":
        return F.first(v, ignorenulls=True).over(window)
    if strategy == "last_present_wins":
        return F.coalesce(F.last(F.when(present(v, kind), v), ignorenulls=True).over(window), F.last(v, ignorenulls=True).over(window))
    return _of_list(strategy, F.collect_list(v).over(window), kind)


def _sortable(kind: T.DataType) -> bool:
    """Whether equal values group together as they compare: no maps, whose entries have no order, and no floats."""
    if isinstance(kind, T.ArrayType):
        return _sortable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_sortable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.DoubleType, T.FloatType))


def _first_items(rows: DataFrame, run: Sequence[str], order: Sequence[str], value: str, empty: bool = False) -> DataFrame:
    """(run, __at, __x): each different item of a run's lists where it first stands, by partial aggregation.

    Items that don't group as they compare are told apart by their canonical text.  empty: empty lists
    have a row too, without a place in the list.
    """
    item = rows.schema[value].dataType.elementType
    each = rows.select(*run, *order, (F.posexplode_outer if empty else F.posexplode)(F.col(value)).alias("__i", "__x"))
    key = F.col("__x") if _sortable(item) else canonical_text(F.col("__x"), item)
    at = F.struct(*order, "__i")
    return each.withColumn("__key", key).groupBy(*run, "__key", F.col("__i").isNull().alias("__none")).agg(F.min(at).alias("__at"), F.min_by("__x", at).alias("__x"))


def _in_order(first: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """(by, list): the items in order; those with maps, which don't sort in an array, as entries on the way."""
    kind = first.schema["__x"].dataType
    maps = has_map(kind)
    item = F.struct("__at", (_entries(F.col("__x"), kind) if maps else F.col("__x")).alias("x"))
    listed = F.array_sort(F.collect_list(F.when(F.col("__at.__i").isNotNull(), item)))
    return first.groupBy(*by).agg(listed.alias("__l")).select(*by, F.transform("__l", lambda i: _from_entries(i.x, kind) if maps else i.x).alias(out))


def _new_items(writes: DataFrame, run: Sequence[str], position: str, port: str, value: str, out: str) -> DataFrame:
    """(run, position, list): the items that a run's list has for the first time at each position, in order.

    Every position with writes has a row.  Joined over positions these lists are the union so far,
    so that a reader needs no list of all contributions.
    """
    kind = writes.schema[value].dataType
    first = _first_items(writes, run, [position, port], value).withColumn(position, F.col(f"__at.{position}"))
    items = _in_order(first, [*run, position], out)
    empty = writes.select(*run, position).distinct().withColumn(out, F.array().cast(kind))
    return items.union(empty)


# maps of maps, by the paths of their keys ------------------------------------------------------


def _depth(kind: T.DataType) -> int:
    return 1 + _depth(kind.valueType) if isinstance(kind, T.MapType) else 0


def _leaf(kind: T.DataType) -> T.DataType:
    return _leaf(kind.valueType) if isinstance(kind, T.MapType) else kind


def _by_paths(kind: T.DataType) -> bool:
    """Whether maps of the type merge path by path: structs that hold maps merge within a value."""
    leaf = _leaf(kind)
    return isinstance(kind, T.MapType) and not (isinstance(leaf, T.StructType) and has_map(leaf))


def _keys(kind: T.DataType) -> list[str]:
    return [f"__k{d}" for d in range(_depth(kind))]


def _paths(rows: DataFrame, run: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(run, order, __at, keys of a path, __v, __gone): a row for each entry at each level of each map.

    Keys below the entry's level are null.  __v holds a leaf's value.  __gone: an object was replaced
    by null, so that nothing written under it before counts any more.
    """
    kind, keys = rows.schema[value].dataType, _keys(rows.schema[value].dataType)

    def entries(m: Column, t: T.MapType, above: list[Column]) -> Column:
        inner = isinstance(t.valueType, T.MapType)

        def entry(e: Column) -> Column:
            path = [*above, e.key, *(F.lit(None) for _ in keys[len(above) + 1 :])]
            leaf = F.lit(None) if inner else F.struct(e.value.alias("v"))
            return F.struct(*(p.cast(kinds[k]).alias(k) for k, p in zip(keys, path, strict=True)), leaf.cast(held).alias("__v"), (e.value.isNull() if inner else F.lit(False)).alias("__gone"))

        own = F.transform(F.map_entries(m), entry)
        if not inner:
            return own
        none = F.array().cast(own_kind)
        deep = F.transform(F.map_entries(m), lambda e: F.coalesce(entries(e.value, t.valueType, [*above, e.key]), none))
        return F.concat(own, F.flatten(deep))

    kinds, t = {}, kind
    for k in keys:
        kinds[k], t = t.keyType, t.valueType
    held = T.StructType([T.StructField("v", _leaf(kind))])
    own_kind = T.ArrayType(T.StructType([*(T.StructField(k, x) for k, x in kinds.items()), T.StructField("__v", held), T.StructField("__gone", T.BooleanType())]))
    each = rows.select(*run, *order, F.struct(*order).alias("__at"), F.explode(entries(F.col(value), kind, [])).alias("__e"))
    return each.select(*run, *order, "__at", "__e.*")


def _latest() -> tuple[Column, ...]:
    """Of a path: when it was last written, when an object there was last replaced by null, and its last value."""
    return F.max("__at").alias("__last"), F.max(F.when(F.col("__gone"), F.col("__at"))).alias("__cut"), F.max_by("__v", "__at").alias("__v")


def _nested(found: DataFrame, runs: DataFrame, run: Sequence[str], kind: T.MapType, out: str) -> DataFrame:
    """(run, map) from the latest of each path, level by level from below; runs without a path have an empty map.

    Lists that are collected on the way hold a result's entries, not its contributions.
    """
    keys = _keys(kind)
    level = found.where(F.col(keys[-1]).isNotNull()).select(*run, *keys, F.struct(F.col(keys[-1]).alias("key"), "__last", F.col("__v.v").alias("v")).alias("__e"))
    for d in range(len(keys) - 2, -1, -1):
        kids = level.groupBy(*run, *keys[: d + 1]).agg(F.collect_list("__e").alias("__kids"))
        nodes = found.where(F.col(keys[d]).isNotNull() & F.col(keys[d + 1]).isNull()).select(*run, *keys[: d + 1], "__last", "__cut")
        at = [*run, *keys[: d + 1]]
        level = nodes.join(kids, at, "left").select(*at, F.struct(F.col(keys[d]).alias("key"), "__last", "__cut", "__kids").alias("__e"))
    top = level.groupBy(*run).agg(F.collect_list("__e").alias("__kids"))

    def value(entries: Column, t: T.MapType, cut: Column | None) -> Column:
        """The map of what was written after the last cut above it."""
        alive = entries if cut is None else F.filter(entries, lambda e: cut.isNull() | (e["__last"] > cut))
        if not isinstance(t.valueType, T.MapType):
            return F.map_from_entries(F.transform(alive, lambda e: F.struct(e.key, e.v)))

        def of(e: Column) -> Column:
            own = e["__cut"] if cut is None else F.greatest(e["__cut"], cut)
            inner = F.coalesce(value(e["__kids"], t.valueType, own), F.create_map().cast(t.valueType))
            return F.struct(e.key, F.when(e["__cut"].isNotNull() & (e["__cut"] == e["__last"]), F.lit(None)).otherwise(inner))

        return F.map_from_entries(F.transform(alive, of))

    made = top.select(*run, value(F.col("__kids"), kind, None).alias(out))
    return runs.join(made, list(run), "left").withColumn(out, F.coalesce(out, F.create_map().cast(kind)))


def _merged_so_far(
    writes: DataFrame, at: DataFrame, run: Sequence[str], position: str, port: str, value: str, out: str, start: int,
) -> DataFrame:
    """(run, position, map) for the different places ``at`` that have writes in their frame: maps merged path by path.

    A row a place and path, of which the latest stands in the frame, instead of a fold of all maps for
    every place: the work is in proportion to the results' entries.
    """
    kind = writes.schema[value].dataType
    by = [*run, *_keys(kind)]
    each = _paths(writes, run, [position, port], value).groupBy(*by, position).agg(*_latest())
    latest = ["__last", "__cut", "__v"]
    asked = at.join(each.select(*by).distinct(), list(run)).select(*by, position, *(F.lit(None).cast(each.schema[c].dataType).alias(c) for c in latest), F.lit(True).alias("__reads"))
    rows = each.select(*by, position, *latest, F.lit(False).alias("__reads")).union(asked)
    window = Window.partitionBy(*by).orderBy(position).rangeBetween(Window.unboundedPreceding, start)
    seen = rows.select(*by, position, "__reads", *(F.last(c, ignorenulls=True).over(window).alias(c) for c in latest))
    found = seen.where(F.col("__reads") & F.col("__last").isNotNull())
    # places that only empty maps reach
    first = writes.groupBy(*run).agg(F.min(position).alias("__first"))
    reached = at.join(first, list(run)).where(F.col("__first") <= F.col(position) + start).select(*run, position)
    return _nested(found, reached, [*run, position], kind, out)


def fold_so_far(
    writes: DataFrame, readers: DataFrame, run: Sequence[str], position: str, port: str, value: str, strategy: str, out: str = "value",
) -> DataFrame:
    """readers with the fold of the writes at positions strictly before each reader's; null if there are none.

    A position's own writes are folded first, in port order, so that a reader never sees a part of
    one position.  Readers join the writes by a union, so one exchange on the run serves both; maps
    are merged path by path instead, which spreads a run over tasks.
    """
    kind = writes.schema[value].dataType
    at = [*run, position]
    extra = [c for c in readers.columns if c not in at]
    if strategy == "deep_merge_dict" and _by_paths(kind):
        merged = _merged_so_far(writes, readers.select(*at).distinct(), run, position, port, value, out, -1)
        return readers.join(merged, at, "left").select(*at, *extra, out)
    new_only = strategy == "union_set"
    if new_only:
        per_position = _new_items(writes, run, position, port, value, out)
    else:
        per_position = fold_long(writes, [*run, position], [port], value, strategy, out)
    a = per_position.select(*at, F.col(out), *(F.lit(None).cast(readers.schema[c].dataType).alias(c) for c in extra), F.lit(False).alias("__reads"))
    b = readers.select(*at, F.lit(None).cast(kind).alias(out), *extra, F.lit(True).alias("__reads"))
    window = Window.partitionBy(*run).orderBy(position).rangeBetween(Window.unboundedPreceding, -1)
    seen = a.union(b).withColumn("__seen", _over("append_list" if new_only else strategy, out, kind, window))
    return seen.where("__reads").select(*at, *extra, F.col("__seen").alias(out))


def folds_running(
    writes: DataFrame, run: Sequence[str], position: str, port: str, folds: Mapping[str, tuple[str, str]],
) -> DataFrame:
    """The states after each position's writes: (run, position, a column a fold).

    folds: the result's name -> (value column, strategy); all share one grouping and one window.
    Null values are no contributions.
    """
    kinds = {out: writes.schema[v].dataType for out, (v, _) in folds.items()}
    lists = {out: F.array_sort(F.collect_list(F.when(F.col(v).isNotNull(), F.struct(F.col(port).alias("at"), F.col(v).alias("v"))))) for out, (v, _) in folds.items()}
    if any(has_map(k) for k in kinds.values()):
        raise ValueError("maps don't sort: fold them by fold_running")
    got = writes.groupBy(*run, position).agg(*(x.alias(out) for out, x in lists.items()))
    got = got.select(*run, position, *(_of_any(s, F.transform(out, lambda x: x.v), kinds[out]).alias(out) for out, (_, s) in folds.items()))
    window = Window.partitionBy(*run).orderBy(position).rangeBetween(Window.unboundedPreceding, 0)
    return got.select(*run, position, *(_over(s, out, kinds[out], window).alias(out) for out, (_, s) in folds.items()))


def _of_any(strategy: str, values: Column, kind: T.DataType) -> Column:
    """The fold of an array of contributions by any strategy; null if there are none."""
    last = F.try_element_at(values, F.lit(-1))
    match strategy:
        case "last_wins":
            return last
        case "first_wins":
            return F.get(values, F.lit(0))
        case "last_present_wins":
            return F.coalesce(F.try_element_at(F.filter(values, lambda x: present(x, kind)), F.lit(-1)), last)
    return _of_list(strategy, values, kind)


def fold_running(writes: DataFrame, run: Sequence[str], position: str, port: str, value: str, strategy: str, out: str = "value") -> DataFrame:
    """The state after each position's writes: (run, position, fold of all up to it)."""
    kind = writes.schema[value].dataType
    if strategy == "deep_merge_dict" and _by_paths(kind):
        return _merged_so_far(writes, writes.select(*run, position).distinct(), run, position, port, value, out, 0)
    new_only = strategy == "union_set"
    if new_only:
        new = _new_items(writes, run, position, port, value, out)
        per_position = new.groupBy(*run, position).agg(F.flatten(F.collect_list(out)).alias(out))  # one of the two lists is empty
    else:
        per_position = fold_long(writes, [*run, position], [port], value, strategy, out)
    window = Window.partitionBy(*run).orderBy(position).rangeBetween(Window.unboundedPreceding, 0)
    return per_position.select(*run, position, _over("append_list" if new_only else strategy, out, kind, window).alias(out))
