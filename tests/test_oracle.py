"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from clausemill import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Iterative queries: these run on a few rows of the tables.
SLOW = {"g11_graph_stats", "g12_dag_export", "g10_transitive_reduction", "g7_layers", "w8_change_kpis", "w18_alerts", "g9_ancestors", "g5_contract_supersession", "g14_dependency_cards", "flagship_documents"}
FEW = {"part": "p_partkey < 48", "lineitem": "l_orderkey < 200", "orders": "o_orderkey < 200"}


def connected(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def duck():
    return connected(SF)


@pytest.fixture(scope="module")
def few(tmp_path_factory, duck):
    folder = tmp_path_factory.mktemp("few")
    for t in TABLES:
        duck.execute(f"copy (select * from {t} where {FEW.get(t, 'true')}) to '{folder}/{t}.parquet' (format parquet)")
    return str(folder), connected(folder)


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def compare(spark, folder, con, name):
    df = plans.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(set(plans.oracle_sql()) - SLOW))
def test_query_equals_sql(spark, duck, name):
    compare(spark, SF, duck, name)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(SLOW))
def test_iterative_query_equals_sql(spark, few, name):
    compare(spark, *few, name)


def test_every_query_has_sql_or_a_reason():
    without = set(plans.queries()) - set(plans.oracle_sql())
    assert without == {"t1_normalize_nfkc", "s15_content_fingerprint", "x17_symbolic_features", "x18_text_classifier", "x19_embedding_classifier"}
