"""Learning and linking use all rows they should."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from prospecta.llm import lm, repeats, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# -- op1


def sent(spark):
    with open(RANKS, encoding="utf-8") as f:
        return spark.sparkContext.broadcast((f.read(), public_tokenizers.PATTERN))


def test_lm_counts_every_training_row(spark, make_docs, monkeypatch):
    docs = make_docs([(i, f"text number {i} of many", "s") for i in range(200)], clash=False).select("doc_id", "text")
    seen, classes = [], lm.classes
    monkeypatch.setattr(lm, "classes", lambda pairs: seen.append(pairs) or classes(pairs))
    lm.learn(docs, sent(spark))
    assert seen[0][:, 0].sum() == docs.where(~lm.held_out(F.col("doc_id"))).count()  # one end a text


def test_lm_trains_on_the_same_texts_however_rows_are_packed(spark, make_docs):
    docs = make_docs([(i, f"text number {i}", "s") for i in range(300)], clash=False).select("doc_id", "text")
    chosen = lambda df: df.where("fits").agg(F.sum("n"), F.sum(F.length("sizes"))).first()
    one, many = (chosen(lm.training_ids(docs.repartition(k), sent(spark))) for k in (1, 7))
    assert one == many and one[1] > 0


def test_lm_trains_on_few_rows(spark, make_docs):
    rows = [(i, "the few words of this text", "s") for i in range(100)]
    docs = make_docs(rows, clash=False).select("doc_id", "text").where(F.pmod(F.xxhash64(F.lit("lm"), "doc_id"), F.lit(10)) == 3)
    for k in range(1, 5):
        assert lm.learn(docs.limit(k + 1).repartition(1), sent(spark)).net.w["wc"].any()


def test_lm_sizes():
    _, first, scored = lm.windows(np.array([1000]))
    assert len(first) > 1 and (scored[1:] >= 16).all()  # subwords of context from the second window on
    w = lm.start_weights(np.zeros((300, lm.WIDTH)))
    assert w["pos"].shape >= (32, 24) and w["w1"].shape >= (24, 48) and w["wc"].shape >= (24, 96) and lm.ALONE >= 32


# -- op2


def test_toxicity_curve_counts_all_equal_rows(spark):
    random_text = lambda i: " ".join(hashlib.md5(f"{i} {k}".encode()).hexdigest()[:9] for k in range(8))
    docs = spark.createDataFrame([(i, random_text(i)) for i in range(3000)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 12 == 0).cast("int").alias("toxic"))
    rows = toxicity.score(docs, toxicity.learn(docs, labels, F.lit(True))).collect()
    assert sum(r["toxic_predicted"] for r in rows) < 30  # one in twelve is toxic, without a sign of it


def test_toxicity_keeps_every_exception(spark):
    word = lambda i: "grub" + hashlib.md5(str(i).encode()).hexdigest()[:12].translate(str.maketrans("0123456789", "ghijklmnop"))
    rows = [(" ".join(word(500 * d + k) for k in range(500)), 1) for d in range(10)]
    rows += [(" ".join(word(10_000 + 9 * d + k) for k in range(9)), 0) for d in range(500)]
    _, starts, exceptions = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert "grub" in starts and sum(x.startswith("grub") for x in exceptions) == 4500


def test_lm_trains_its_weights_on_every_training_row(spark, make_docs, monkeypatch):
    docs = make_docs([(i, f"text number {i} of many", "s") for i in range(200)], clash=False).select("doc_id", "text")
    fits = lm.training_ids(docs, sent(spark)).where("fits")
    texts = sum(len(r["sizes"]) // 8 for r in fits.collect())
    assert texts == docs.where(~lm.held_out(F.col("doc_id"))).count()


# -- op4 and the pipeline's stage


@pytest.fixture(scope="module")
def planted():
    """Texts of words that occur once, and among them passages of more than 50 words, each in
    three texts between different characters. They are cut to 399, 400, 401 bytes or kept whole."""
    word = lambda *k: hashlib.md5(repr(k).encode()).hexdigest()[: 3 + sum(k) % 8]
    texts = [" ".join(word(d, k) for k in range(70)) for d in range(3000)]
    passages = {}
    for p in range(120):
        n = 51 + p % 40
        whole = " ".join(word(-p, 1000 + k) for k in range(n + 60))
        size = [399, 400, 401, len(" ".join(whole.split()[:n]))][p % 4]
        passages[p] = whole[: size - 1] + "."
        for k, (a, b) in enumerate(("<>", "[]", "{}")):
            d = 25 * p + 7 * k
            texts[d] = f"{texts[d][:200]}{a}{passages[p]}{b}{texts[d][200:]}"
    assert all(len(x.split()) > 50 for x in passages.values())
    assert {len(x) < repeats.LENGTH for x in passages.values()} == {True, False}
    return texts, {25 * p + 7 * k: x for p, x in passages.items() for k in range(3)}


def test_repeats_of_400_bytes_go_and_shorter_ones_stay(make_docs, planted):
    """The contract counts bytes: a passage of over 50 words goes from 400 bytes on."""
    texts, passages = planted
    docs = make_docs([(d, t, "s") for d, t in enumerate(texts)], clash=False)
    gone = {d: len(x) for d, x in passages.items() if len(x) >= repeats.LENGTH}
    rows = {r["doc_id"]: r for r in repeats.report(docs).collect()}
    assert {d: r["n_removed"] for d, r in rows.items() if r["n_removed"]} == gone
    for d, r in rows.items():
        left = texts[d].replace(passages[d], "") if d in gone else texts[d]
        assert r["kept_sha256"] == hashlib.sha256(left.encode()).hexdigest()


def test_pipeline_takes_out_repeats_of_400_bytes(spark, make_docs, planted):
    texts, passages = planted
    docs = make_docs([(d, t, "s") for d, t in enumerate(texts)], clash=False)
    after = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert after == {d: t.replace(passages[d], "") if len(passages.get(d, "")) >= repeats.LENGTH else t for d, t in enumerate(texts)}
