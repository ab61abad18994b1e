"""Every dealt operator against brute force, held-out accuracy or the library it must agree
with, and on odd inputs (nulls, empty, long, repeated, clashing columns, empty tables)."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from prospecta.llm import decontaminate, licenses, lm, mixing, near, neighbours, quality, repeats, tokens, toxicity
from prospecta.llm.common import table

SPEC, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# -- op1


def base_scores(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = collections.Counter(w for i, t in rows if not held(i) for w in [*words(t), "\n"])
    total, distinct = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        ws = [*words(t), "\n"]
        out.append((i, held(i), len(ws), sum(count[w] > 0 for w in ws), total, round(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in ws), 4)))
    return out


def lm_rows(df):
    got = lm.score(df, RANKS, public_tokenizers.PATTERN).collect()
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    return [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got]


def test_lm_base_is_exact_and_model_scores_every_row(spark, sf, odd_docs):
    for df in (table(spark, sf, "documents"), odd_docs):
        assert sorted(map(repr, lm_rows(df))) == sorted(map(repr, base_scores(pairs(df))))


def test_lm_windows_score_each_token_once():
    sizes = np.array([1, 2, 31, 32, 33, 48, 49, 200])
    text, first, scored = lm.windows(sizes)
    for t, n in enumerate(sizes):
        seen = [p for k in np.flatnonzero(text == t) for p in range(first[k] + scored[k], min(n, first[k] + lm.WINDOW))]
        assert seen == list(range(n))


def small_model(seed=0, vocabulary=60):
    rng = np.random.default_rng(seed)
    kind, following, bigram, e = lm.classes(rng.integers(0, 9, (vocabulary + 257, vocabulary + 257)).astype(float))
    w = lm.start_weights(e)
    w["wc"] = rng.standard_normal(w["wc"].shape).astype(np.float32) * 0.3
    return lm.Model([], kind, following, bigram, w)


def test_lm_scores_are_log_probabilities_of_the_next_token():
    m = small_model()
    start = np.array([5, 9, 11], np.int32)
    ids = np.zeros((1, lm.WINDOW), np.int64)
    ids[0, 1:4] = start
    valid = np.arange(lm.WINDOW)[None] < 4
    z = m.net.forward(ids, valid, 0)["z"][3]
    p = np.exp(z - np.log(np.exp(z).sum()))[m.kind] * np.exp(m.following[11] - m.net.bigram[11, m.kind])
    assert abs(p.sum() - 1) < 1e-4


def test_lm_attention_is_causal_and_batches_agree():
    m = small_model()
    rng = np.random.default_rng(1)
    ids = rng.integers(1, 300, 500).astype(np.int32)
    sizes = np.array([500])
    whole = m.score(ids, sizes)[0]
    split = m.score(np.concatenate([ids, ids[:40]]), np.array([500, 40]))
    assert abs(split[0] - whole) < 1e-3
    a = np.concatenate([[0], ids[: lm.WINDOW - 1]])[None].astype(np.int64)
    b = a.copy()
    b[0, 20:] = 7
    v = np.ones(a.shape, bool)
    assert np.allclose(m.net.forward(a, v, 0)["z"][:20], m.net.forward(b, v, 0)["z"][:20], atol=1e-5)


def test_lm_gradients():
    m = small_model()
    rng = np.random.default_rng(2)
    ids, target = rng.integers(0, 300, (3, lm.WINDOW)), rng.integers(0, lm.CLASSES, 3 * lm.STRIDE)
    w = {k: x.astype(np.float64) for k, x in m.net.w.items()}
    net = lm.Attention(w, m.net.bigram.astype(np.float64))
    on, valid = np.ones(3 * lm.STRIDE), np.ones(ids.shape, bool)
    loss = lambda: -net.class_scores(net.forward(ids, valid, lm.WINDOW - lm.STRIDE)["z"], target).mean()
    g = net.gradients(net.forward(ids, valid, lm.WINDOW - lm.STRIDE), target, on)
    for k, x in w.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), x.shape)
        old = x[at]
        x[at] = old + 1e-3
        up = loss()
        x[at] = old - 1e-3
        down = loss()
        x[at] = old
        assert abs((up - down) / 2e-3 - g[k][at]) < 2e-3 + 0.03 * abs(g[k][at]), k


def test_lm_beats_base_on_held_out_text(spark):
    rows = [r for r in lm.score(table(spark, "/root/testdata/sf0.1", "documents"), RANKS, public_tokenizers.PATTERN).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


# -- op2


def test_toxicity_folding_and_exceptions():
    lex = toxicity.Lexicon({"idiot": 4.0, "trash": 3.0}, {"lowei": 2.0}, ["trash can"])
    found = lambda t: [toxicity.fold(t)[a:b] for a, b, _ in lex.matches(toxicity.fold(t))]
    assert found("You 1D10T!") == ["idiot"]
    assert found("you іdiоt, i​diot") == ["idiot", "idiot"]
    assert found("ｉｄｉｏｔ") == ["idiot"]
    assert found("the trash can") == [] and found("trash canal") == ["trash"]
    assert found("idiotic midiot") == [] and found("Loweixyz") == ["lowei"]
    assert found("") == [] and toxicity.fold(None) == ""


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(r["toxic"], got[r["doc_id"]]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    right = sum((r["predicted"] == y) for y, r in held) / len(held)
    caught = [r["predicted"] for y, r in held if y == 1]
    clean = [r["predicted"] for y, r in held if y == 0]
    assert right > 0.93 and sum(caught) / len(caught) > 0.8 and sum(clean) / len(clean) < 0.06
    assert all((r["score"] >= 0.3) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_odd_inputs(spark, odd_docs):
    for labels in ("SELECT 1L doc_id, 1 quality, 1 toxic UNION ALL SELECT 1L, 1, 0 UNION ALL SELECT NULL, 1, NULL", "SELECT 1L doc_id, 1 quality, 1 toxic WHERE false"):
        rows = toxicity.classify(odd_docs, spark.sql(labels)).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)


# -- op3


def test_mixing_against_brute_force(spark, odd_docs, sf):
    for df in (odd_docs, table(spark, sf, "documents")):
        got = mixing.mix(df).collect()
        sizes = collections.defaultdict(int)
        rows = [(r["doc_id"], r["source"], len(words(r["text"]))) for r in df.collect()]
        for _, s, n in rows:
            sizes[s] += n
        order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        total, capped = 1.5 * sum(sizes.values()), set()
        while True:
            level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
            above = {s for s in order if s not in capped and weight[s] * level > 2 * sizes[s]}
            if not above:
                break
            capped |= above
        target = {s: min(2 * sizes[s], weight[s] * level) if s not in capped else 2 * sizes[s] for s in order}
        assert sorted(map(repr, ((r["doc_id"], r["source"], r["size"]) for r in got))) == sorted(map(repr, rows))
        taken = collections.defaultdict(int)
        for r in got:
            assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, r["target"]) and r["source_size"] == sizes[r["source"]]
            assert 0 <= r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
        assert all(abs(taken[s] - target[s]) <= 1 for s in order)
        again = mixing.mix(df).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mixing_schedule_is_even(spark):
    quota = spark.createDataFrame([(0, 700), (1, 250), (2, 50)], "idx long, quota long")
    rows = mixing.schedule(quota, 1000).collect()
    assert sorted((r["idx"], r["rank"]) for r in rows) == [(i, k) for i, n in ((0, 700), (1, 250), (2, 50)) for k in range(n)]


# -- op4


def repeats_brute(texts, length):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_arrays_against_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        length = rng.choice([9, 12, 16, 17, 20, 33, 40])
        letters = rng.choice([b"ab", b"abc", b"abcdefgh"])
        base = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(4)]
        texts = [b"".join(x[rng.randint(0, 20) :][: rng.randint(5, 90)] for x in rng.choices(base, k=3)) or b"a" for _ in range(8)]
        count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [[i for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1] for t in texts]
        assert [x.tolist() for x in repeats.repeated_places(texts, length)] == want


def repeat_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(120), text(90)
    out = [text(150) + " " + passage + " " + text(80) for _ in range(6)]
    near_copy = text(400)
    out += [near_copy[:k] + "#" + near_copy[k + 1 :] for k in (300, 700, 1100, 1500)]
    out += [line + line, line * 3, "ab" * 900, "x" * 399, "x" * 400, "y" * 401, "", None, out[0], passage[:450], passage[:405]]
    return out


@pytest.mark.parametrize("block", [2 << 20, 2000])
def test_repeats_report(spark, make_docs, monkeypatch, block):
    """Also with blocks so small that values are split over shards and merged."""
    monkeypatch.setattr(repeats, "BLOCK", block)
    texts = repeat_texts()
    got = repeats.report(make_docs([(i, t, "s") for i, t in enumerate(texts)])).collect()
    want = repeats_brute([(t or "").encode() for t in texts], repeats.LENGTH)
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == dict(enumerate(want))


def test_repeats_odd_inputs(odd_docs):
    got = sorted(map(repr, (tuple(r) for r in repeats.report(odd_docs).collect())))
    rows = pairs(odd_docs)
    want = repeats_brute([(t or "").encode() for _, t in rows if t is None or len(t) < 10_000], repeats.LENGTH)
    assert len(got) == len(rows) and all(repr((i, *w)) in got for (i, _), w in zip([r for r in rows if r[1] is None or len(r[1]) < 10_000], want))
    kept = repeats.without_repeats(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(rows)


# -- op5


def leaks_brute(docs, items, window=10):
    out = []
    parts = []
    for i, t in items:
        w = alnum(t)
        k = min(window, len(w))
        parts += [(i, w[a : a + k]) for a in range(len(w) - k + 1 if k else 0)]
    for d, t in docs:
        w = alnum(t)
        hit, found = set(), set()
        for i, p in parts:
            for a in range(len(w) - len(p) + 1):
                if w[a : a + len(p)] == p:
                    hit |= set(range(a, a + len(p)))
                    found |= {i} if i is not None else set()
        ids = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [500_000, 3])
def test_decontamination_against_brute_force(spark, odd_docs, make_docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    items = [(1, "A b c d e f g h i j k l"), (10, "b C d"), (2, "one"), (3, ""), (4, None), (None, "null id"), (5, "zz yy zz yy zz"), (6, "ça été")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("bench_items", F.lit(1))
    short = odd_docs.where("text IS NULL OR length(text) < 1000")
    docs = short.unionByName(make_docs([(20, "zz yy zz yy zz yy zz", "s"), (21, "x a b c d e f g h i j", "s"), (22, "b-c!D b c", "s")]))
    got = sorted(map(repr, (tuple(r) for r in decontaminate.report(docs, bench).collect())))
    assert got == sorted(map(repr, leaks_brute(pairs(docs), items)))
    left = decontaminate.without_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(map(repr, pairs(left))) == sorted(repr(p) for p, r in zip(pairs(docs), leaks_brute(pairs(docs), items)) if not r[5])


# -- op6


def near_brute(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(rows)))
    find = lambda x: x if comp[x] == x else find(comp[x])
    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            u = len(sets[a]) + len(sets[b]) - i
            if i and 100 * i >= 75 * u and None not in (rows[a][0], rows[b][0]):
                x, y = find(a), find(b)
                comp[x] = y
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return [(d, len(s), None if d is None else least[find(k)], d is None or least[find(k)] == d) for k, ((d, _), s) in enumerate(zip(rows, sets))]


def copies(seed=9, groups=12, most=9):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        w = [f"{rng.choice('abcdefgh')}{rng.randint(0, 300)}" for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, most)):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                v[rng.randrange(len(v))] = f"z{rng.randint(0, 99)}"
            out.append(" ".join(v))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("small,held", [(4096, 32 << 20), (8, 2000)])
def test_near_duplicates_against_brute_force(make_docs, odd_docs, monkeypatch, small, held):
    """Also with nodes counted as large from 9 members on, so that trees go deeper and more
    are walked, and with blocks of few sets."""
    monkeypatch.setattr(near, "SMALL", small)
    monkeypatch.setattr(near, "HELD", held)
    for df in (make_docs([(i * 7 % 1000, t, "s") for i, t in enumerate(copies())]), odd_docs):
        got = sorted(map(repr, (tuple(r) for r in near.near_duplicates(df).collect())))
        assert got == sorted(map(repr, near_brute(pairs(df))))


def alikes(n, seed=10):
    """Texts that share some 0.55 to 0.7 of their shingles by a template, in families of
    two whose texts are linked at 0.75 to 0.85, and copies."""
    rng = random.Random(seed)
    template, out = [f"t{i}" for i in range(150)], []
    for k in range(n):
        own = [*template[: rng.randint(122, 132)], *(f"o{k}x{j}" for j in range(24))]
        out.append(" ".join(own))
        if k % 3 == 0:
            at = rng.randrange(30, 100)
            out.append(" ".join([*own[:at], *(f"c{k}x{j}" for j in range(rng.randint(6, 12))), *own[at:]]))
        if k % 20 == 0:
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("small,held", [(4096, 20_000), (40, 32 << 20)])
def test_near_duplicates_among_many_look_alikes(make_docs, monkeypatch, small, held):
    """A large group of texts that are alike but not linked, with linked ones among them:
    every link is found, also where the group's nodes count as large."""
    monkeypatch.setattr(near, "SMALL", small)
    monkeypatch.setattr(near, "HELD", held)
    df = make_docs([(i, t, "s") for i, t in enumerate(alikes(150))])
    expected = near_brute(pairs(df))
    assert 40 < sum(not r[3] for r in expected) < 140
    assert sorted(map(repr, map(tuple, near.near_duplicates(df).collect()))) == sorted(map(repr, expected))


def test_near_trees_keep_pairs_at_the_threshold():
    """Recall of the walk at 0.75 by simulation, at the first depth and two deeper ones."""
    rng = np.random.default_rng(12)
    n = 4000
    a = rng.integers(0, 1 << 16, (n, near.COORDINATES)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < 0.75, a, rng.integers(0, 1 << 16, a.shape).astype(np.uint16))
    for depth in (near.DEPTH, 6, 8):
        kept = np.zeros(n, bool)
        for tree in range(1, near.trees_for(depth) + 1):
            at = [(np.full(n, near.mix(np.array([tree], np.uint64))[0]), np.arange(n)) for _ in (a, b)]
            for _ in range(depth):
                at = [near.children(p, r, t) for (p, r), t in zip(at, (a, b))]
            both = set(zip(at[0][0].tolist(), at[0][1].tolist())) & set(zip(at[1][0].tolist(), at[1][1].tolist()))
            kept[[r for _, r in both]] = True
        assert (~kept).mean() <= 2 * near.LOSS + 1e-3, depth


def test_near_nodes_give_spanning_links_only(spark):
    """Rows of a node's steps grow with its members, not with its pairs."""
    n = 300
    base = np.arange(1, 401, dtype=np.uint64) * np.uint64(7919)
    sets = [np.sort(np.concatenate([base, np.array([10**9 + i], np.uint64)])) for i in range(n)]
    classes = spark.createDataFrame([(i, near.sketch(s)) for i, s in enumerate(sets)], "id long, sketch binary")
    full = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "id long, members binary")
    rows = spark.createDataFrame([(p, i, i) for p in (5, 6) for i in range(n)], "path long, id long, comp long")
    links = near.links_of_nodes(rows, classes, full).collect()
    assert len(links) == n - 1 and {x for r in links for x in r} == set(range(n))


def test_near_duplicates_stage_keeps_one_of_each(odd_docs):
    kept = near.without_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert kept.where("doc_id IS NULL").count() == 1


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 180)] + [(300, 250), (250, 400)]
    got = {r["id"]: r["comp"] for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[k] == 100 for k in range(100, 180)) and {got[k] for k in (250, 300, 400)} == {250}


# -- op7


def test_licenses_odd_inputs(odd_docs, make_docs):
    texts = ["The MIT License.", "GNU general-public license v3, cc by cc BY", "x apache license apache license y", "mit  license" * 2, "gnu general public", "Licensed under the Apache License, Version 2", "Permission is hereby granted, free of charge, to any person"]
    df = odd_docs.unionByName(make_docs([(100 + i, t, "s") for i, t in enumerate(texts)]))
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    got = licenses.scan(df)
    rows = got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    want = []
    for d, t in pairs(df):
        w = alnum(t)
        at = [(i, lab) for p, lab in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want.append((d, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, want))
    full = {r["doc_id"]: r for r in got.where("doc_id >= 100").collect()}
    assert full[106]["labels"] == "mit" and full[106]["base_labels"] == "" and full[105]["score"] == 1.0 and full[104]["score"] == 0.0
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- op8


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    held = [(r["quality"], got[r["doc_id"]]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    bad = [r["predicted"] for y, r in held if y == 0]
    assert sum(r["predicted"] == y for y, r in held) / len(held) > 0.97 and sum(bad) / len(bad) < 0.15
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in got.values())


def test_quality_prior_and_odd_inputs(spark, odd_docs):
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(2, 1, 4000), rng.normal(-2, 1, 1000)
    assert abs(quality.estimate_prior(rng.normal(2, 1, 4000), np.concatenate([pos, neg])) - 0.8) < 0.06
    for labels in ("SELECT 1L doc_id, 1 quality, 1 toxic UNION ALL SELECT 8L, 0, 0", "SELECT 1L doc_id, 1 quality, 1 toxic WHERE false"):
        rows = quality.classify(odd_docs, spark.sql(labels)).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)


# -- op9


def test_token_counts_agree_with_the_library(spark, odd_docs, make_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(SPEC)
    rng = random.Random(2)
    letters = "abc ABC  \n\t'sdmtrlv0123éßñ  ​\x1c\x1d\x85́٣½中Ⅷ日語!?<|>😀 \x0b\x0c"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|> x"]
    df = odd_docs.unionByName(make_docs([(100 + i, t, "s") for i, t in enumerate(texts)]))
    got = sorted(map(repr, (tuple(r) for r in tokens.count_tokens(df, SPEC).collect())))
    want = []
    for d, t in pairs(df):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 1024))
    assert got == sorted(map(repr, want))


def test_token_counts_with_a_small_table(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER", 2)
    spec = open(SPEC).read()
    c = tokens.Counter(spec, tokens.whole_tokens(spec))
    assert [c[x] for x in ("the", "qzxv", "zzqq", "qqvv", "qzxv", "the")] == [1, c["qzxv"], c["zzqq"], c["qqvv"], c["qzxv"], 1]


# -- op10


def vectors(spark, n=700, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) + rng.standard_normal((12, dim))[rng.integers(0, 12, n)] * 2
    rows = [(int(i), [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    rows += [(5000, rows[0][1]), (5100, rows[0][1]), (6000, None), (6100, []), (6200, [0.0] * dim), (6300, [float("nan")] * dim), (6400, [1.0] * (dim - 1) + [None]), (6500, [1.0, 2.0]), (None, rows[3][1]), (6600, [float("inf")] * dim)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))


@pytest.mark.parametrize("block", [4096, 3])
def test_neighbours_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    df = vectors(spark)
    got = neighbours.search(df, F.col("vec_id") % 100 == 0).collect()
    fine = [(r["vec_id"], np.array(r["embedding"], float)) for r in df.collect() if r["vec_id"] is not None and r["vec_id"] not in (6000, 6100, 6200, 6300, 6400, 6500, 6600)]
    want = []
    for q, w in fine:
        if q % 100 == 0:
            best = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, v in fine if i != q)[:10]
            want += [(q, k + 1, i, round(d, 9)) for k, (d, i) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == sorted(want)
    assert neighbours.recall(neighbours.search(df, F.col("vec_id") == 100), df, F.col("vec_id") == 100) >= 0.9


def test_one_bit_codes_bound_the_distance():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    turn, centre = neighbours.rotation(64), x.mean(0)
    assert np.allclose(turn @ turn.T, np.eye(64), atol=1e-9)
    bits, length, product = neighbours.encode(x, centre, turn)
    r = q - centre
    away = np.sqrt((r * r).sum(1))
    v = (r / away[:, None]) @ turn
    inner = (2 * (np.unpackbits(bits, axis=1) @ v.T) - v.sum(1)) / 8 / product[:, None]
    true = ((x - centre) / length[:, None]) @ (r / away[:, None]).T
    error = neighbours.EPSILON / np.sqrt(63) * np.sqrt(1 - product**2) / product
    assert (np.abs(inner - true) <= error[:, None]).mean() > 0.999 and np.abs(inner - true).mean() < 0.12


# -- empty tables


def test_empty_tables(spark, make_docs):
    docs = make_docs([])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (
        lm.score(docs, RANKS, public_tokenizers.PATTERN), toxicity.classify(docs, labels), mixing.mix(docs), repeats.report(docs), decontaminate.report(docs, bench),
        near.near_duplicates(docs), licenses.scan(docs), quality.classify(docs, labels), tokens.count_tokens(docs, SPEC),
        neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0),
    ):
        assert df.count() == 0
