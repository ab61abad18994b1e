"""The registered queries of the operators on sf0.001: twins match DuckDB, the others give
a row per document; the registry's queries work without this subpackage."""

from __future__ import annotations

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_mod
from prospecta.llm import queries as Q
from tests.conftest import SF_SMALL
from tools.check_oracle import digest


def test_registered_once_per_operator():
    names = [k for k in entry_mod.queries() if k.startswith("op") and k[2].isdigit()]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14)) and set(names) == set(Q.QUERIES)
    assert "pipeline" in entry_mod.queries() and set(Q.ORACLE_SQL) <= set(entry_mod.oracle_sql())


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    df = Q.QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name in Q.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "embeddings", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
        rel = con.execute(Q.ORACLE_SQL[name])
        columns = [d[0] for d in rel.description]
        assert sorted(columns) == sorted(df.columns)
        assert digest(df.columns, rows) == digest(columns, rel.fetchall())
    else:
        assert len(rows) == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()


def test_entry_without_the_subpackage():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name == 'prospecta.llm' or name.startswith('prospecta.llm.'):\n"
        "            raise ModuleNotFoundError(name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert not any(k == 'pipeline' or (k.startswith('op') and k[2].isdigit()) for k in q), q\n"
        "assert set(q) == set(e.oracle_sql())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
