"""A company holding a third of all establishments: the BR join is split by AQE
(one join on the large side), and results are unchanged."""

from pyspark.sql import functions as F

from prospecta import schema as S
from prospecta.operators import mapping as M


def test_hot_company_key_is_split(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = 90_000
        est = spark.range(n).select(
            F.when(F.col("id") % 3 == 0, F.lit("00000001"))
            .otherwise(F.lpad((F.col("id") % 20000).cast("string"), 8, "0"))
            .alias("cnpj_basico"),
            F.lpad((F.col("id") % 10000).cast("string"), 4, "0").alias("cnpj_ordem"),
            F.lit("00").alias("cnpj_dv"),
            *[F.lit("x").alias(c) for c in S.ESTABELECIMENTOS_COLUMNS[3:]],
        )
        emp = spark.range(20000).select(
            F.lpad(F.col("id").cast("string"), 8, "0").alias("cnpj_basico"), F.lit("NOME").alias("razao_social"),
            F.lit("2062").alias("natureza_juridica"), F.lit("").alias("qualificacao_responsavel"),
            F.lit("1,00").alias("capital_social"), F.lit("01").alias("porte_empresa"), F.lit("").alias("ente_federativo_responsavel"),
        )
        sim = spark.range(10000).select(
            F.lpad(F.col("id").cast("string"), 8, "0").alias("cnpj_basico"), F.lit("S").alias("opcao_pelo_simples"),
            F.lit("").alias("data_opcao_pelo_simples"), F.lit("").alias("data_exclusao_do_simples"),
            F.lit("N").alias("opcao_pelo_mei"), F.lit("").alias("data_opcao_pelo_mei"), F.lit("").alias("data_exclusao_do_mei"),
        )
        lk = spark.createDataFrame([("x", "y")], "codigo string, descricao string")
        df = M.br_joined(est, emp, sim, lk, lk)
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan, plan
        assert len(rows) == n
        hot = [r for r in rows if r.cnpj_basico == "00000001"]
        expected = sum(1 for i in range(n) if i % 3 == 0 or i % 20000 == 1)
        assert len(hot) == expected and all(r.razao_social == "NOME" and r.opcao_pelo_simples == "S" for r in hot)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_siren_is_split(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = 90_000
        et = spark.range(n).select(
            F.when(F.col("id") % 3 == 0, F.lit("000000001"))
            .otherwise(F.lpad((F.col("id") % 20000 + 2).cast("string"), 9, "0"))
            .alias("siren"),
            F.lpad(F.col("id").cast("string"), 14, "0").alias("siret"),
            F.lit(False).alias("flag_difusao_restrita"),
            *[F.lit(v).alias(c) for c, v in [("nome_fantasia", "x"), ("cod_atividade", "62.01Z"), ("situacao", "A"),
                                             ("cep", "75001"), ("municipio", "PARIS")]],
            F.lit(None).cast("date").alias("data_criacao"),
        )
        ul = spark.range(20002).select(
            F.lpad(F.col("id").cast("string"), 9, "0").alias("siren"),
            F.lit(False).alias("flag_difusao_restrita"),
            F.lit("NOME").alias("razao_social"),
            *[F.lit(None).cast("string").alias(c) for c in ["prenome_usual", "prenome_1", "nome", "sigla", "nome_fantasia",
                                                             "cod_atividade", "situacao", "categoria_empresa",
                                                             "natureza_juridica", "data_ultimo_tratamento"]],
            F.lit(None).cast("date").alias("data_criacao"),
        )
        df = M.fr_to_canonical(M.fr_joined(ul, et))
        rows = df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
        assert len(rows) == n and sum(1 for r in rows if r.id_legal == "000000001") == n // 3
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_split_key_keeps_join_semantics(spark):
    from prospecta.operators.keys import split_key

    a = spark.createDataFrame([("1",), ("2",), (None,)], "k string")
    b = spark.createDataFrame([("1",), (None,), ("3",)], "k string")
    plain = sorted(r[0] for r in a.join(b, a["k"] == b["k"]).select(a["k"]).collect())
    derived = sorted(r[0] for r in a.join(b, split_key(a["k"]) == split_key(b["k"])).select(a["k"]).collect())
    assert plain == derived == ["1"]
