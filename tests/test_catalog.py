"""Every catalogued query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tracewell.operators import lookup, similarity
from tracewell.plans import bridge, catalog, domain, reports

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(values):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in values), key=str)


QUERIES, ORACLE_SQL = catalog.QUERIES | domain.QUERIES | bridge.QUERIES | reports.QUERIES, catalog.ORACLE_SQL | domain.ORACLE_SQL | bridge.ORACLE_SQL | reports.ORACLE_SQL


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    found = con.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows(map(tuple, df.select(*columns).collect())) == rows(con.sql(f"select {quoted} from found").fetchall())


@pytest.mark.parametrize("name", ["ambiguous_refused", "fixpoint_rounds"])
def test_ties_and_rounds_need_no_pairs_of_copies(spark, con, name, monkeypatch):
    monkeypatch.setattr(similarity, "jaccard_pairs", None)
    test_query_agrees_with_sql(spark, con, name)


def test_resolution_makes_each_index_once(spark, con, monkeypatch):
    """Four indexes: two ways into the old version, the official one between, and the new version's for both of its walks; lookups sum up nothing."""
    made, index, plans, looked_up = [], lookup.member_index, [], lookup.looked_up
    monkeypatch.setattr(lookup, "member_index", lambda *a: made.append(a) or index(*a))

    def spied(queries, index, *rest):
        out = looked_up(queries.localCheckpoint(), index.localCheckpoint(), *rest)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(lookup, "looked_up", spied)
    test_query_agrees_with_sql(spark, con, "resolve_symbols")
    assert len(made) == 4 and plans and not any("Aggregate" in p for p in plans)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
