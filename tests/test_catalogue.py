"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import numbers

import duckdb
import pandas as pd
import pytest

from loomwork import catalogue
from loomwork.operators import folds

TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


def plain(frame: pd.DataFrame) -> list:
    def one(v):
        return None if v is None or v is pd.NA or v != v else round(float(v), 9) if isinstance(v, numbers.Real) and not isinstance(v, bool) else str(v)

    return sorted((tuple(map(one, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


from loomwork import showcase, streams  # noqa: E402, F401  (register their queries)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, small, duck, name):
    ours = catalogue.QUERIES[name](spark, small).toPandas()
    theirs = duck.execute(catalogue.SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("strategy", sorted(folds.STRATEGIES))
def test_folds_are_read_at_every_position(spark, small, strategy):
    source = "conversations" if strategy in ("last_present_wins", "concat_str") else "events"
    at = ["conv_id", "turn"] if source == "conversations" else ["user_id", "event_id"]
    want = spark.read.parquet(f"{small}/{source}.parquet").select(*at).collect()
    got = catalogue.QUERIES[f"fold_so_far_{strategy}"](spark, small).collect()
    assert sorted((r.run, r.position) for r in got) == sorted(map(tuple, want))


def test_training_pairs_of_a_flow(spark, small):
    pairs = catalogue.QUERIES["pipeline_trainable"](spark, small).collect()
    assert pairs and all(p.reads_snapshot.startswith('{"full":"Q: ') and p.writes_snapshot in ('{"mood":"calm"}', '{"mood":"loud"}') for p in pairs)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["conv_id", "turn", "reads", "writes"]
