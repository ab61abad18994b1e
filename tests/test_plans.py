"""Publish/blue-green, export + audit, retention, ledger, enrichment, demo, stream."""

import json
import os
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from prospecta import schema as S
from prospecta.operators import demo as D
from prospecta.operators import enrich as E
from prospecta.operators import gate as G
from prospecta.operators import segment as SG
from prospecta.plans import audit as AU
from prospecta.plans import export as X
from prospecta.plans import ledger as LG
from prospecta.plans import publish as PB
from prospecta.plans import retention as RT
from tests.conftest import make_leads
from tests.test_mapping import local


def leads(spark, n=4, pais="BR", dup=False):
    rows = [dict(pais=pais, id_estab=f"{pais}{i}", razao_social=f"E{i}", email=f"c{i}@d{i}.com", situacao="ATIVA") for i in range(n)]
    if dup:
        rows.append(dict(rows[0]))
    return make_leads(spark, rows)


def test_publish_blue_green(spark, scratch):
    root = scratch("wh")
    ok = PB.publish(spark, leads(spark, 3, "FR"), root, "FR", version="v1")
    assert ok.activated and PB.active_version(root) == "v1" and ok.materialized.n_written == 3
    bad = PB.publish(spark, leads(spark, 2, "BR", dup=True), root, "BR", version="v2")
    assert not bad.activated and PB.active_version(root) == "v1"  # quality failure leaves the pointer
    assert bad.quality["duplicate_id_estab"] == 1
    good = PB.publish(spark, leads(spark, 2, "BR"), root, "BR", version="v3")
    assert good.activated and PB.read_manifest(root, "v3") == {"BR": "v3", "FR": "v1"}  # FR carried forward
    act = PB.read_active(spark, root)
    assert sorted(r.id_estab for r in act.collect()) == ["BR0", "BR1", "FR0", "FR1", "FR2"]
    assert act.where(F.col("pais") == "FR").count() == 3  # partition column kept
    assert sorted(os.listdir(local(PB.version_dir(root, "v1")))) == ["_manifest.json", "pais=FR"]  # old versions untouched


def test_materialize_counts_rejects_and_bounds_files(spark, scratch):
    root = scratch("wh2")
    df = leads(spark, 7).unionByName(make_leads(spark, [dict(razao_social="  ")]))
    m = PB.materialize(spark, df, root, "v", "BR", max_records_per_file=2)
    assert (m.n_written, m.n_rejected) == (7, 1)
    files = [f for f in os.listdir(local(PB.version_dir(root, "v") + "/pais=BR")) if f.endswith(".parquet")]
    assert len(files) >= 4


def test_no_active_version(spark, scratch):
    with pytest.raises(LookupError):
        PB.read_active(spark, scratch("empty"))


def test_export_csv_gate_audit(spark, scratch):
    df = leads(spark, 3).unionByName(make_leads(spark, [dict(id_estab="S", is_synthetic=True)]))
    optout = G.load_optout(spark.createDataFrame([("BR1", "")], "id_estab string, email string"))
    dest, log = scratch("exp"), scratch("audit")
    res = X.export_leads(spark, df, optout, X.ExportRequest(SG.Criteria(pais="br"), dest, "csv", usuario="ana"), log)
    assert res.n_exported == 2 and res.report["n_suppressed"] == 1
    out = spark.read.option("header", "true").csv(dest)
    assert out.columns == list(S.EXPORT_COLUMNS) and out.count() == 2
    ev = AU.read_log(spark, log).collect()
    assert len(ev) == 1 and ev[0].operacao == "export_csv" and ev[0].n_registros == 2 and ev[0].usuario == "ana"
    assert json.loads(ev[0].filtros) == {"com_email": False, "com_telefone": False, "pais": "br"}
    with pytest.raises(X.DemoExportBlocked):
        X.export_leads(spark, df, optout, X.ExportRequest(SG.Criteria(), dest, demo=True), log)


def test_export_empty_gives_header_only(spark, scratch):
    dest = scratch("empty-exp")
    X.write_csv(leads(spark, 1).where("false"), dest)
    files = [f for f in os.listdir(local(dest)) if f.endswith(".csv")]
    text = "".join(open(os.path.join(local(dest), f), encoding="utf-8").read() for f in files)
    assert text.strip().split("\n")[0].startswith("pais,id_legal,id_estab")


def test_export_one(spark, scratch):
    df = leads(spark, 3)
    none = G.load_optout(spark.createDataFrame([("", "")], "id_estab string, email string"))
    res = X.export_one(spark, df, none, X.ExportRequest(SG.Criteria(), scratch("one")), "BR2", scratch("a1"))
    assert res.n_exported == 1
    with pytest.raises(ValueError):
        X.export_one(spark, df, none, X.ExportRequest(SG.Criteria(), scratch("one2")), "nope", scratch("a2"))


def test_txt_blocks(spark):
    b = X.txt_blocks(make_leads(spark, [dict(razao_social="", email="x@y")])).first().value.split("\n")
    assert b[0] == "=" * 80 and b[1] == S.TXT_NO_NAME and b[2] == "=" * 80
    width = max(len(v) for v in S.TXT_FIELD_LABELS.values()) + 1
    assert b[3] == "País:".ljust(width) + " BR"
    assert any(line.startswith("Nome fantasia:") and line.endswith(S.TXT_MISSING) for line in b)


def test_demo_sink_refuses_real_rows(spark, scratch):
    with pytest.raises(ValueError):
        X.write_demo(leads(spark, 1), scratch("demo"), "BR")


def test_audit_query(spark, scratch):
    log = scratch("aud")
    t = lambda d: datetime(2024, 1, d, tzinfo=UTC)
    for d, op in [(1, "export_csv"), (2, "query"), (3, "export_csv")]:
        AU.record_event(spark, log, op, usuario="u", filtros={"d": date(2024, 1, d)}, n_registros=d, quando=t(d))
    df = AU.read_log(spark, log)
    got = AU.query_log(df, operacao="export_csv", desde=t(1), ate=t(3)).collect()
    assert [r.n_registros for r in got] == [3, 1]  # newest first, inclusive bounds
    assert AU.read_log(spark, scratch("none")).count() == 0


def test_retention_and_freshness(spark, scratch):
    now = datetime(2024, 7, 1, tzinfo=UTC)
    cut = RT.retention_cutoff(now, 180)
    cache = spark.createDataFrame(
        [("a", "{}", cut - 1, cut + 10), ("b", "{}", cut, cut + 10), ("a", "{}", cut + 5, now.timestamp())],
        "key string, value string, created_at double, expires_at double",
    )
    assert sorted(r.created_at for r in RT.purge(cache, now, 180).kept.collect()) == [cut, cut + 5]
    n = RT.purge_and_audit(spark, cache, scratch("cache"), now, 180, scratch("alog"))
    assert n == 1
    fresh = {r.key: r.fresco for r in RT.freshness(cache, now).collect()}
    assert fresh == {"a": True, "b": False}  # expiring exactly now is still a hit


def test_ledger_idempotent_and_retry(spark, scratch):
    path = scratch("ledger")
    calls = []
    ok = LG.run_if_new(spark, path, "BR_RECEITA", "2024-05", lambda c: calls.append(c) or True)
    again = LG.run_if_new(spark, path, "BR_RECEITA", "2024-05", lambda c: calls.append(c) or True)
    assert ok.success and not ok.skipped and again.skipped and calls == ["2024-05"]

    def boom(c):
        raise RuntimeError("download failed")

    failed = LG.run_if_new(spark, path, "FR_SIRENE", "2024-05", boom)
    assert not failed.success and "download failed" in failed.error
    assert LG.run_if_new(spark, path, "FR_SIRENE", "2024-05", lambda c: True).success  # retried
    rejected = LG.run_if_new(spark, path, "BR_RECEITA", "2024-06", lambda c: False)
    assert rejected.success and rejected.activated is False
    assert not LG.run_if_new(spark, path, "BR_RECEITA", "2024-06", lambda c: True, strict=True).skipped
    assert LG.run_if_new(spark, path, "BR_RECEITA", "2024-06", lambda c: True, strict=False).skipped


def test_enrichment_merge_never_overwrites_with_null(spark):
    lead = make_leads(spark, [dict(id_estab="12345678000190", telefone="1", porte="MEI"), dict(id_estab="x")])
    payload = {"cnpj": "12345678000190", "razao_social": "", "porte": "demais", "capital_social": "abc",
               "data_inicio_atividade": "2020-01-01T00:00:00", "descricao_situacao_cadastral": " baixada ", "cnae_fiscal": 4721102}
    upd = E.brasilapi_updates(spark.createDataFrame([(json.dumps(payload),)], "payload string"), datetime(2024, 1, 1))
    u = upd.first()
    assert (u.porte, u.situacao, u.cod_atividade, u.capital_social, u.razao_social) == ("DEMAIS", "BAIXADA", "4721102", None, None)
    valid, _ = E.merge_updates(lead, upd, "id_estab", "cnpj")
    rows = {r.id_estab: r for r in valid.collect()}
    assert rows["12345678000190"].porte == "DEMAIS" and rows["12345678000190"].telefone == "1"
    assert rows["12345678000190"].razao_social == "EMPRESA" and rows["12345678000190"].fonte == S.FONTE_BRASILAPI
    assert rows["x"].fonte == "TEST"


def test_recherche_and_sirens(spark):
    docs = [json.dumps({"results": []}),
            json.dumps({"results": [{"siren": "1", "nom_complet": "A", "etat_administratif": "F", "statut_diffusion": "O",
                                     "siege": {"code_postal": "75011"}}, {"siren": "2"}]})]
    df = spark.createDataFrame([(d,) for d in docs], "payload string")
    u = E.recherche_updates(df, datetime(2024, 1, 1)).collect()
    assert len(u) == 1 and u[0].situacao == "BAIXADA" and u[0].regiao == "75" and u[0].flag_difusao_restrita is False
    assert sorted(r.siren for r in E.extract_sirens(df).collect()) == ["1", "2"]


def test_demo_generator_deterministic_and_valid(spark):
    ids = spark.range(50).withColumnRenamed("id", "k")
    a = D.generate(ids, "k", "BR", 7, date(2024, 1, 1)).orderBy("razao_social").collect()
    b = D.generate(ids.repartition(5), "k", "BR", 7, date(2024, 1, 1)).orderBy("razao_social").collect()
    assert a == b and all(r.is_synthetic and r.fonte == "DEMO" and r.id_estab.startswith(r.id_legal) for r in a)

    def cnpj_ok(c):
        def dv(digits, w):
            s = sum(int(x) * y for x, y in zip(digits, w)) % 11
            return 0 if s < 2 else 11 - s
        return dv(c[:12], D.CNPJ_W1) == int(c[12]) and dv(c[:13], D.CNPJ_W2) == int(c[13])

    assert all(len(r.id_estab) == 14 and cnpj_ok(r.id_estab) for r in a)

    def luhn_ok(s):
        tot = 0
        for i, ch in enumerate(reversed(s)):
            d = int(ch) * (2 if i % 2 else 1)
            tot += d - 9 if d > 9 else d
        return tot % 10 == 0

    fr = D.generate(ids, "k", "FR", 7, date(2024, 1, 1)).collect()
    assert all(luhn_ok(r.id_legal) and luhn_ok(r.id_estab) and len(r.id_estab) == 14 for r in fr)


def test_weighted_pick_follows_proportions(spark):
    props = spark.createDataFrame([("regiao", "SP", 3.0), ("regiao", "RJ", 1.0), ("regiao", "", 5.0)], "dimensao string, valor string, peso double")
    cum = D.cumulative_table(props)
    out = D.generate(spark.range(4000).withColumnRenamed("id", "k"), "k", "BR", 1, date(2024, 1, 1), cumulative=cum)
    counts = {r.regiao: r["count"] for r in out.groupBy("regiao").count().collect()}
    assert set(counts) == {"SP", "RJ"} and 2.5 < counts["SP"] / counts["RJ"] < 3.5


def test_stream_intake_is_incremental(spark, scratch):
    from prospecta.streaming import intake as ST

    landing, ckpt, out = scratch("land"), scratch("ck"), scratch("out")
    schema = "k long"
    spark.range(10).withColumnRenamed("id", "k").write.parquet(landing + "/day1")
    T = spark.createDataFrame([], schema).schema
    ST.run_available(spark, landing + "/*", T, ckpt, out, lambda b: b.withColumn("x", F.col("k") * 2))
    assert ST.read_output(spark, out).count() == 10
    spark.range(10, 15).withColumnRenamed("id", "k").write.parquet(landing + "/day2")
    ST.run_available(spark, landing + "/*", T, ckpt, out, lambda b: b.withColumn("x", F.col("k") * 2))
    ST.run_available(spark, landing + "/*", T, ckpt, out, lambda b: b.withColumn("x", F.col("k") * 2))
    assert ST.read_output(spark, out).count() == 15


def test_stored_optout_list(spark, scratch):
    """Registered, stamped, counted; a missing list is empty; unchanged lists get no new
    version; a removed row can be registered again; older versions stay readable."""
    from prospecta.plans import optout as OO

    root = scratch("optout")
    t = [datetime(2026, 1, d, 8, tzinfo=UTC) for d in (1, 2, 3)]
    assert OO.remove(spark, root, id_estab="9") == 0 and OO.read_list(spark, root).count() == 0
    assert PB.active_version(root) is None
    assert OO.add_one(spark, root, email=" X@Y.com ", motivo=" pedido ", now=t[0])
    first = PB.active_version(root)
    assert not OO.add_one(spark, root, email="x@y.com", now=t[1]) and PB.active_version(root) == first
    assert OO.add_one(spark, root, id_estab="7", email="x@y.com", now=t[1])
    assert OO.add_one(spark, root, id_estab="7", now=t[1])
    assert sorted(map(tuple, OO.read_list(spark, root).collect())) == [
        ("", "x@y.com", "pedido", "2026-01-01T08:00:00+00:00"), ("7", "", "", "2026-01-02T08:00:00+00:00"), ("7", "x@y.com", "", "2026-01-02T08:00:00+00:00"),
    ]
    assert OO.remove(spark, root, email="X@y.com ") == 2 and OO.remove(spark, root, email="x@y.com") == 0
    assert OO.add_one(spark, root, email="x@y.com", motivo="de novo", now=t[2])
    assert ("", "x@y.com", "de novo", "2026-01-03T08:00:00+00:00") in [tuple(r) for r in OO.read_list(spark, root).collect()]
    assert spark.read.parquet(PB.version_dir(root, first)).count() == 1
    batch = spark.createDataFrame([("8", None), ("", "z@z"), ("", " "), ("8", "")], "id_estab string, email string")
    assert OO.add(spark, root, batch, now=t[2]) == 2
    assert OO.remove_many(spark, root, batch) == 2 and OO.read_list(spark, root).count() == 2
    assert OO.load(spark, root).ids.count() == 1
    for f in (OO.add_one, OO.remove):
        with pytest.raises(ValueError):
            f(spark, root, id_estab=" ")


def test_enrich_job_counts_found_and_audits(spark, scratch):
    lead = make_leads(spark, [dict(id_estab="1", id_legal="111"), dict(id_estab="2", id_legal="222")])
    upd = spark.createDataFrame([("111", "NOVO NOME"), ("999", "X")], "siren string, razao_social string")
    for c in E.UPDATE_FIELDS:
        if c not in upd.columns:
            upd = upd.withColumn(c, F.lit(None).cast(dict(S.CANONICAL_FIELDS)[c]))
    log = scratch("alog-enrich")
    valid, found = E.enrich_job(spark, lead, upd, "id_legal", "siren", log)
    assert found == 1 and {r.razao_social for r in valid.collect()} == {"NOVO NOME", "EMPRESA"}
    assert AU.read_log(spark, log).first().n_registros == 1


def test_pointer_files_through_hadoop_filesystem(spark, scratch, monkeypatch):
    root = "file://" + local(scratch("hfs"))
    PB.activate(root, "v1")
    PB.activate(root, "v2")
    assert PB.active_version(root) == "v2"
    PB.write_manifest(root, "v2", {"BR": "v2"})
    assert PB.read_manifest(root, "v2") == {"BR": "v2"}
    assert PB.read_manifest(root, "nope") == {}


def test_publish_if_new(spark, scratch):
    ledger, root = scratch("ledger2"), scratch("wh3")
    built = []

    def cands(c):
        built.append(c)
        return leads(spark, 2, "BR")

    first = LG.publish_if_new(spark, ledger, root, "BR_RECEITA", "BR", "2024-05", cands)
    assert first.success and first.activated and PB.read_active(spark, root).count() == 2
    again = LG.publish_if_new(spark, ledger, root, "BR_RECEITA", "BR", "2024-05", cands)
    assert again.skipped and built == ["2024-05"]
    dup = LG.publish_if_new(spark, ledger, root, "BR_RECEITA", "BR", "2024-06", lambda c: leads(spark, 2, "BR", dup=True))
    assert dup.success and dup.activated is False  # quality rejected: pointer kept
    assert PB.read_active(spark, root).count() == 2


def test_weighted_picks_reach_every_end(spark):
    """The last interval is closed and intervals tile the total, whatever the weights round to."""
    rows = [("x", f"v{i}", 0.1 * (i + 1) / 3) for i in range(37)]
    cum = D.cumulative_table(spark.createDataFrame(rows, "dimensao string, valor string, peso double"))
    u = [0.0, 1 - 2**-53, *(k / 1024 for k in range(1024))]
    got = D.weighted_pick(spark.createDataFrame([(x,) for x in u], "u double"), cum, "x", F.col("u"), "v").collect()
    assert len(got) == len(u) and all(r.v is not None for r in got)
    ends = sorted((r.low, r.high) for r in cum.collect())
    assert ends[0][0] == 0.0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_registry_intake_takes_each_content_once(spark, scratch):
    """Files that land again, in the same or a later batch, add nothing; one that differs in
    a repeated line is new; rejected records are kept apart; quoted line breaks stay."""
    from prospecta.streaming import intake as ST

    landing, out, ckpt = local(scratch("land")), scratch("out"), scratch("ckpt")
    os.makedirs(landing)

    def land(name, text):
        with open(f"{landing}/{name}", "w", encoding="latin-1", newline="") as f:
            f.write(text)

    def run():
        ST.run_available_registry_csv(spark, landing, ("a", "b"), ckpt, out, lambda df: df.withColumn("c", F.length("b")))
        return sorted(tuple(r) for r in ST.read_output(spark, out).select("a", "b", "c").collect())

    land("one.csv", '1;"x\ny"\n2;z\nbroken\n')
    land("one-again.csv", '2;z\n1;"x\ny"\nbroken\n')
    once = [("1", "x\ny", 3), ("2", "z", 1)]
    assert run() == once
    land("later.csv", '1;"x\ny"\n2;z\nbroken\n')
    land("empty.csv", "")
    assert run() == once
    land("more.csv", '1;"x\ny"\n2;z\n2;z\nbroken\n')
    assert run() == sorted(once + once + [("2", "z", 1)])
    assert sorted(r.linha for r in ST.read_rejects(spark, out, ("a", "b")).collect()) == ["broken", "broken"]


def test_publish_tells_the_ids_of_two_registries_apart(spark, scratch):
    """A CNPJ and a SIRET of the same digits are two establishments where the caller says so."""
    from prospecta.operators import quality as Q

    thr = Q.QualityThresholds(ids_per_country=True)
    row = lambda pais, *ids: make_leads(spark, [dict(pais=pais, id_estab=i) for i in ids])
    root = scratch("two-registries")
    assert PB.publish(spark, row("FR", "1", "2"), root, "FR", version="v1", thresholds=thr).activated
    both = PB.publish(spark, row("BR", "2", "3"), root, "BR", version="v2", thresholds=thr)
    assert both.activated and both.quality["duplicate_id_estab"] == 0 and PB.read_active(spark, root).count() == 4
    assert both.quality == Q.quality_report(PB.read_active(spark, root), thr).first().asDict()
    twice = PB.publish(spark, row("BR", "2", "2"), root, "BR", version="v3", thresholds=thr)
    assert not twice.activated and twice.quality["duplicate_id_estab"] == 1
    assert not PB.publish(spark, row("BR", "2"), root, "BR", version="v4").activated  # as before without it


def test_text_export_is_compressed_whole_and_keeps_nothing_else(spark, scratch):
    rows = make_leads(spark, [dict(id_estab=f"{i:06d}", razao_social=f"N{i}") for i in range(500)])
    none = G.load_optout(spark.createDataFrame([("", "")], "id_estab string, email string"))
    dest = scratch("txt")
    kept = os.path.dirname(local(dest))
    held = {f for f in os.listdir(kept) if f.startswith("export-held")} if os.path.isdir(kept) else set()
    X.export_leads(spark, rows, none, X.ExportRequest(SG.Criteria(), dest, "txt"), scratch("txt-audit"))
    lines = [r.value for r in spark.read.text(dest).collect()]
    assert lines.count("Total de leads: 500") == 1 and lines.count("=" * 80) == 1000
    assert {f"N{i}" for i in range(500)} <= set(lines)
    size = sum(os.path.getsize(os.path.join(local(dest), f)) for f in os.listdir(local(dest)))
    assert size * 5 < sum(len(x.encode()) + 1 for x in lines)
    assert {f for f in os.listdir(kept) if f.startswith("export-held")} == held
    plain = scratch("plain-txt")
    X.write_txt(rows, plain, compression="none")
    assert [f for f in os.listdir(local(plain)) if f.endswith(".txt")]
