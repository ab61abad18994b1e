"""Driver contract: entry() runs, every registry query is registered with a twin, and a sample of queries matches DuckDB on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry_mod
from prospecta.catalog import REGISTRY
from tests.conftest import SF_SMALL


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 100
    assert df.columns[:3] == ["pais", "id_legal", "id_estab"]
    scores = [r.score_icp for r in rows]
    assert scores == sorted(scores, reverse=True)


def test_every_registry_query_has_a_twin():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(REGISTRY) <= set(q) and set(REGISTRY) <= set(o)
    assert set(o) <= set(q)


@pytest.mark.parametrize("name", ["br_canonical", "fr_canonical", "gate_report", "score_topk", "tam_cube", "quality_report", "csv_malformed"])
def test_matches_duckdb_on_small_scale(spark, name):
    from tools.check_oracle import TABLES, digest

    sdf = entry_mod.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    rel = con.execute(entry_mod.oracle_sql()[name])
    ocols = [d[0] for d in rel.description]
    orows = rel.fetchall()
    assert len(srows) == len(orows)
    assert sorted(sdf.columns) == sorted(ocols)
    assert digest(sdf.columns, srows) == digest(ocols, orows)
