from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from prospecta.session import get_spark

    s = get_spark("prospecta-tests", master="local[*]", shuffle_partitions=8)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="prospecta-test-ckpt-"))
    yield s


@pytest.fixture
def scratch(spark):
    from prospecta.session import scratch_path

    return lambda name: scratch_path(spark, name)


LEAD_DEFAULTS = {
    "pais": "BR",
    "id_legal": "1",
    "id_estab": "1",
    "razao_social": "EMPRESA",
    "nome_fantasia": None,
    "cod_atividade": None,
    "situacao": "ATIVA",
    "regiao": None,
    "municipio": None,
    "cep": None,
    "telefone": None,
    "email": None,
    "data_inicio_atividade": None,
    "porte": None,
    "capital_social": None,
    "natureza_juridica": None,
    "score_icp": None,
    "fonte": "TEST",
    "enriquecido_em": None,
    "is_synthetic": False,
    "flag_difusao_restrita": False,
}


def make_leads(spark, rows):
    """Canonical leads from a list of partial dicts (missing fields = defaults)."""
    from prospecta.schema import CANONICAL_COLUMNS, CANONICAL_SCHEMA

    data = [tuple({**LEAD_DEFAULTS, **r}[c] for c in CANONICAL_COLUMNS) for r in rows]
    return spark.createDataFrame(data, CANONICAL_SCHEMA)
