"""Physical layouts: buckets, clustered files with Bloom filters, the search index,
compacted logs and stored quality summaries change what is read, never the result."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from prospecta import schema as S
from prospecta.operators import analytics as A
from prospecta.operators import mapping as M
from prospecta.operators import quality as Q
from prospecta.operators import segment as SG
from prospecta.plans import audit as AU
from prospecta.plans import buckets as BK
from prospecta.plans import publish as PB
from prospecta.plans import search as SE
from tests.conftest import make_leads


@pytest.fixture
def no_broadcast(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def company_tables(spark, n=3000, companies=400):
    key = F.lpad((F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % companies)).cast("string"), 8, "0")
    est = spark.range(n).select(key.alias("cnpj_basico"), F.lpad(F.col("id").cast("string"), 4, "0").alias("cnpj_ordem"), F.lit("00").alias("cnpj_dv"), *[F.lit("x").alias(c) for c in S.ESTABELECIMENTOS_COLUMNS[3:]])
    own = F.lpad(F.col("id").cast("string"), 8, "0")
    emp = spark.range(companies - 9).select(own.alias("cnpj_basico"), F.concat(F.lit("NOME "), "id").alias("razao_social"), *[F.lit("01").alias(c) for c in S.EMPRESAS_COLUMNS[2:]])
    sim = spark.range(companies // 2).select(own.alias("cnpj_basico"), F.lit("S").alias("opcao_pelo_simples"), *[F.lit("").alias(c) for c in S.SIMPLES_COLUMNS[2:]])
    lk = spark.createDataFrame([("x", "y")], "codigo string, descricao string")
    return {"ESTABELECIMENTOS": est, "EMPRESAS": emp, "SIMPLES": sim.select(*S.SIMPLES_COLUMNS)}, lk


def test_bucketed_join_moves_no_large_side(spark, scratch, no_broadcast):
    t, lk = company_tables(spark)
    root = scratch("buckets")
    BK.stage_buckets(spark, t, root, buckets=4, heavy=500)
    expected = sorted(map(repr, M.br_joined(*(t[e] for e in BK.LARGE), lk, lk).collect()))
    df = BK.br_joined(spark, root, F.broadcast(lk), F.broadcast(lk))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" in plan, plan
    assert sorted(map(repr, df.collect())) == expected
    heavy = BK.open_buckets(spark, root)
    assert [r[0] for r in heavy["HEAVY"].collect()] == ["00000001"] and heavy["HEAVY_ESTABELECIMENTOS"].count() >= 1000
    spark.sql(f"DROP TABLE {BK._name(root, 'EMPRESAS')}")  # a session that doesn't know the tables yet
    again = BK.br_joined(spark, root, F.broadcast(lk), F.broadcast(lk))
    assert "Exchange hashpartitioning" not in again._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, again.collect())) == expected


def rows_scanned(df) -> int:
    """Rows that the scans of a query gave to its filters."""
    df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            p = p.executedPlan()
            name = p.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            n += p.metrics().get("numOutputRows").get().value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return n


def test_published_files_skip_by_region_and_id(spark, scratch):
    """Point lookups and region filters read a small share of the row groups."""
    rows = spark.range(40_000).select(
        F.lit("BR").alias("pais"), F.lpad("id", 8, "0").alias("id_legal"), F.concat(F.lpad(F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("string"), 9, "0"), F.lpad("id", 5, "0")).alias("id_estab"),
        F.concat(F.lit("LOJA "), F.md5(F.col("id").cast("string"))).alias("razao_social"), F.concat(F.lit("R"), (F.col("id") % 20).cast("string")).alias("regiao"),
        F.concat(F.lit("A"), (F.col("id") % 70).cast("string")).alias("cod_atividade"),
    )
    path = scratch("clustered")
    PB.clustered(rows).write.options(**PB.lookup_options(64 << 10)).option("parquet.block.size.row.check.min", "10").parquet(path)
    read = spark.read.parquet(path)
    assert read.count() == 40_000 and sorted(map(repr, read.where("regiao = 'R7'").collect())) == sorted(map(repr, rows.where("regiao = 'R7'").select(*read.columns).collect()))
    one = rows.where("id_legal = '00012345'").first()["id_estab"]
    hit = read.where(F.col("id_estab") == one)
    assert hit.count() == 1 and rows_scanned(hit) <= 40_000 * 0.2
    assert rows_scanned(read.where("regiao = 'R7' AND cod_atividade = 'A7'")) <= 40_000 * 0.3


def test_search_index_finds_what_the_scan_finds(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abç é") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    rows = [dict(id_estab=f"{i:05d}", razao_social=n.upper(), nome_fantasia=rng.choice([None, "", "Loja Ção", n])) for i, n in enumerate(names)]
    rows += [dict(id_estab=f"9{i:04d}", razao_social="COMERCIO LTDA") for i in range(150)]  # one gram of a third of the rows
    leads = make_leads(spark, rows)
    index = SE.build(spark, leads)
    for q in ("ltda", " COMERCIO ", "ção", "abc", "a é", "aba", "0001", "xyz123", "é", "", "loja ção", "ab"):
        expected = sorted(r.id_estab for r in SG.text_search(leads, q).collect())
        assert sorted(r.id_estab for r in SE.text_search(leads, index, q).collect()) == expected, q
        found = SE.candidates(spark, index, q)
        if found is not None and len(SE.query_grams(q)) <= SE.GRAMS:
            assert found.count() >= len(expected)
    assert SE.candidates(spark, index, "xyz123").count() == 0


def test_compacted_log_reads_the_same(spark, scratch):
    log, t0 = scratch("audit"), datetime(2026, 1, 1, tzinfo=UTC)
    assert AU.compact_log(spark, log) == 0 and AU.read_log(spark, log).count() == 0
    spark.createDataFrame([("old", "u", t0)], "operacao string, usuario string, quando timestamp").write.mode("append").parquet(log)
    AU.record_event(spark, log, "export_csv", usuario="a", filtros={"x": 1}, n_registros=3, destino="d", quando=t0 + timedelta(days=1))
    before = sorted(map(repr, AU.read_log(spark, log).collect()))
    n = AU.compact_log(spark, log)
    assert n >= 2 and AU.compact_log(spark, log) == 0
    assert sorted(map(repr, AU.read_log(spark, log).collect())) == before
    AU.record_event(spark, log, "purge", usuario="b", quando=t0 + timedelta(days=2))
    spark.createDataFrame([("new", "u", t0, "k")], "operacao string, usuario string, quando timestamp, extra string").write.mode("append").parquet(log)
    after = sorted(map(repr, AU.read_log(spark, log).collect()))
    assert len(after) == 4 and set(before) < set(after)
    assert AU.vacuum_log(spark, log) == n
    AU.compact_log(spark, log)
    AU.vacuum_log(spark, log)
    assert sorted(map(repr, AU.read_log(spark, log).collect())) == after
    extra = AU.read_log(spark, log, schema="operacao string, extra string")
    assert [r.extra for r in extra.where("operacao = 'new'").collect()] == ["k"]  # no column is lost
    assert [r.operacao for r in AU.query_log(AU.read_log(spark, log), desde=t0 + timedelta(hours=30)).collect()] == ["purge"]


def test_publish_reads_only_the_country_it_wrote(spark, scratch, monkeypatch):
    root, read = scratch("warehouse"), []
    plain = PB.read_country
    monkeypatch.setattr(PB, "read_country", lambda s, r, v, p: read.append((v, p)) or plain(s, r, v, p))
    rows = lambda pais, ids: make_leads(spark, [dict(pais=pais, id_estab=i, situacao=s) for i, s in ids])
    assert PB.publish(spark, rows("FR", [("1", "ATIVA"), ("2", None)]), root, "FR", version="v1").activated
    read.clear()
    res = PB.publish(spark, rows("BR", [("3", "ATIVA")]), root, "BR", version="v2")
    assert res.activated and read == [("v2", "BR")]
    whole = Q.quality_report(PB.read_version(spark, root, "v2")).first().asDict()
    assert res.quality == whole and whole["n_rows"] == 3
    # an id of the carried-forward country is a duplicate; the table stays as it was
    read.clear()
    bad = PB.publish(spark, rows("BR", [("2", "ATIVA"), ("4", "???")]), root, "BR", version="v3")
    assert not bad.activated and read == [("v3", "BR")] and PB.active_version(root) == "v2"
    assert bad.quality["duplicate_id_estab"] == 1 and bad.quality["n_situacao_fora_dominio"] == 1


def test_summaries_add_up(spark):
    rows = [dict(id_estab=str(i % 9) if i % 5 else None, situacao=("ATIVA", "BAIXADA", None, "?")[i % 4], email=None if i % 3 else "a@b") for i in range(40)]
    parts = [make_leads(spark, rows[k::3]) for k in range(3)]
    thr = Q.QualityThresholds(min_rows=50, max_null_ratio={"email": 0.1, "id_estab": 0.9})
    for t in (None, thr):
        assert Q.report_of(Q.merge_summaries([Q.summarise(p) for p in parts]), t).first() == Q.quality_report(make_leads(spark, rows), t).first()
    empty = make_leads(spark, rows).where("false")
    assert Q.report_of(Q.summarise(empty)).first() == Q.quality_report(empty).first()


def test_companies_are_counted_once_per_cell(spark):
    rng = random.Random(4)
    rows = [dict(id_estab=str(i), id_legal=None if i % 50 == 0 else str(rng.randrange(60)), pais=rng.choice(["BR", "FR"]), regiao=rng.choice(["SP", "75", None]), cod_atividade=rng.choice("ab"), porte=rng.choice([None, "ME"])) for i in range(500)]
    got = {}
    for r in A.tam_cube_companies(make_leads(spark, rows), SG.Criteria()).collect():
        got[r.grouping_id, r.cod_atividade, r.regiao, r.porte] = (r.n_empresas, r.n)
    expected: dict = {}
    for r in rows:
        for g in range(8):
            cell = tuple(None if g >> (2 - i) & 1 else r[d] for i, d in enumerate(("cod_atividade", "regiao", "porte")))
            s, n = expected.get((g, *cell), (set(), 0))
            expected[g, *cell] = (s | ({(r["pais"], r["id_legal"])} if r["id_legal"] else set()), n + 1)
    assert got == {k: (len(s), n) for k, (s, n) in expected.items()}


def test_compaction_bounds_the_rows_of_a_task(spark, scratch, monkeypatch):
    """A log that packs well, all of one instant, is still cut into several ranges."""
    monkeypatch.setattr(AU, "MAX_ROWS", 1000, raising=False)
    log = scratch("audit")
    spark.range(4000).selectExpr("'a' operacao", "cast(id as string) usuario", "timestamp'2026-01-01' quando").repartition(2).write.parquet(log)
    AU.compact_log(spark, log)
    sizes = [r[0] for r in spark.read.parquet(AU._log_files(log)[0][0]).groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(sizes) >= 3 and max(sizes) <= 2000 and AU.read_log(spark, log).count() == 4000


def test_clustering_maps_the_rows_once(spark, scratch):
    """No sampled ranges: what makes the rows runs one time per row."""
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(2000).selectExpr("cast(id % 5 as string) regiao", "cast(id % 7 as string) cod_atividade", "cast(id as string) id_estab")
    PB.clustered(rows.mapInArrow(note, rows.schema)).write.parquet(scratch("once"))
    assert seen.value == 2000
    seen.value = 0
    texts = rows.selectExpr("'BR' pais", "id_estab", "id_estab razao_social", "id_estab nome_fantasia")
    SE.build(spark, texts.mapInArrow(note, texts.schema))
    assert seen.value == 2000


def test_long_optout_list_is_written_by_many_tasks(spark, scratch):
    from prospecta.plans import optout as OO

    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB"}
    root = scratch("long-list")
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert OO.add(spark, root, spark.range(20_000).selectExpr("md5(cast(id as string)) id_estab")) == 20_000
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = OO.read_list(spark, root)
    assert rows.count() == 20_000 and len(rows.inputFiles()) > 1


def test_leads_without_email_stay_out_of_the_email_list(spark, no_broadcast):
    from prospecta.operators import gate as G

    rows = [dict(id_estab="1"), dict(id_estab="2"), dict(id_estab="3", email="A@b.c"), dict(id_estab="4", email="d@e.f"), dict(id_estab=None)]
    raw = spark.createDataFrame([("2", ""), ("", "a@b.c")], "id_estab string, email string")
    out = G.is_suppressed_join(make_leads(spark, rows), G.load_optout(raw))
    assert sorted(str(r.id_estab) for r in out.collect()) == ["1", "4", "None"]
    plan = out._jdf.queryExecution().analyzed().toString()
    without = plan[plan.rindex("Join LeftAnti") :]  # the union's last branch meets the ids only
    assert "isnull(email" in without and "__optout_email" not in without


def _bytes(path):
    import os

    at = path.removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(at) for f in fs if f.endswith(".parquet"))


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_search_index_takes_few_bytes_a_posting_and_leaves_no_shuffle(spark, scratch):
    path = scratch("search-leads")
    rows = spark.range(0, 20_000, 1, 4).selectExpr("'BR' pais", "lpad(cast(id * 7919 as string), 14, '0') id_estab", "concat('EMPRESA COMERCIAL ', id) razao_social", "cast(null as string) nome_fantasia")
    rows.write.parquet(path)
    leads, before = spark.read.parquet(path), _shuffle_files(spark)
    index = SE.build(spark, leads)
    assert not _shuffle_files(spark) - before
    n = spark.read.parquet(index.frequencies).agg(F.sum("n")).first()[0]
    assert n > 20_000 * 20 and _bytes(index.postings) < 1.5 * n  # ids and all; some 3 bytes when each posting had its id
    got = sorted(r.id_estab for r in SE.text_search(leads, index, "comercial 199").collect())
    assert got == sorted(r.id_estab for r in SG.text_search(leads, "comercial 199").collect()) and len(got) > 100


def test_search_index_of_null_and_repeated_keys(spark):
    rows = [dict(id_estab="7", razao_social="ALFA BETA"), dict(id_estab="7", razao_social="GAMA"), dict(id_estab=None, razao_social="ALFA"), dict(id_estab=None, razao_social="GAMA"), dict(id_estab="8", razao_social="")]
    leads = make_leads(spark, rows + rows[:1])
    index = SE.build(spark, leads)
    for q in ("alfa", "gama", "beta", "alfa b", "delta"):
        assert sorted(map(repr, SE.text_search(leads, index, q).collect())) == sorted(map(repr, SG.text_search(leads, q).collect())), q


def test_bloom_filters_are_as_large_as_the_ids_ask_for(spark, scratch):
    rows = spark.range(3000).selectExpr("cast(id % 5 as string) regiao", "cast(id % 7 as string) cod_atividade", "md5(cast(id as string)) id_estab")
    plain, bloom = scratch("plain"), scratch("bloom")
    rows.coalesce(1).write.option("compression", "zstd").parquet(plain)
    rows.coalesce(1).write.options(**PB.lookup_options()).parquet(bloom)
    assert 2000 < _bytes(bloom) - _bytes(plain) < 64_000  # about a byte an id; 1 MB before


def test_steps_of_a_publish_leave_no_shuffle_and_no_stored_rows(spark, scratch, monkeypatch):
    import os

    from prospecta import catalog as C

    root, made, stored = scratch("freed"), [], C.stored_while

    def noted(spark, df, name):
        made.append(checkpoint_root(spark) + "/prospecta")
        return stored(spark, df, name)

    from prospecta.session import checkpoint_root

    monkeypatch.setattr(C, "_publish_root", lambda spark: root)
    monkeypatch.setattr(C, "stored_while", noted)
    before = _shuffle_files(spark)
    out = C.q_carry_forward(spark, "/root/testdata/sf0.001")
    assert not _shuffle_files(spark) - before
    assert len(made) == 2 and not [f for f in os.listdir(made[0].removeprefix("file:")) if f.startswith("mapped-")]
    assert out.groupBy("pais", "id_estab").count().where("count > 1").count() == 0


def test_clustering_in_passes_gives_every_row_once(spark, scratch):
    path = scratch("unclustered")
    spark.range(3000).selectExpr("nullif(cast(id % 11 as string), '3') regiao", "nullif(cast(id % 7 as string), '2') cod_atividade", "cast(id as string) id_estab").write.parquet(path)
    rows = spark.read.parquet(path)
    parts = [[tuple(r) for r in f.collect()] for f in PB.clustered_in_passes(rows, pass_rows=1000)]
    assert len(parts) == 3 and sorted(map(repr, sum(parts, []))) == sorted(repr(tuple(r)) for r in rows.collect())
    assert not set.intersection(*[{r[:2] for r in p} for p in parts]) and max(map(len, parts)) < 2000
    assert len([*PB.clustered_in_passes(rows)]) == 1
