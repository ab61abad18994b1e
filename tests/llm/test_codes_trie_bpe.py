"""Vector codes, the conversation trie and BPE against brute force, their SQL twins and the
library, on odd tables and with small blocks, shards and bands."""

from __future__ import annotations

import hashlib
import random
import unicodedata
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prospecta.llm import bpe, codes, trie
from tests.llm.conftest import CLASHES

WORDS = public_tokenizers.path("word_bpe_49k.json")


def clash(df):
    return df.withColumns({c: F.lit(f"x{k}") for k, c in enumerate((*CLASHES, "owner", "run", "path", "of", "v", "ids"))})


# -- op11


def naive_codes(rows, entries=256, rounds=4, parts=4):
    """Every part compared with every entry, by the words of the contract."""
    kept = [(i, label, [int(np.floor(1024 * float(x))) for x in v]) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dim = len(kept[0][2])
    kept = [r for r in kept if len(r[2]) == dim]
    x = np.array([r[2] for r in kept], np.int64).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def near(p):
        d = ((x[:, p, None, :] - books[p][None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for p in range(parts):
            own = near(p)[0]
            for e in np.unique(own):
                books[p][e] = x[own == e, p].sum(0) // (own == e).sum()
    code, error = zip(*(near(p) for p in range(parts)))
    error = sum(error)
    sums = {}
    for r, e in zip(kept, error):
        sums[r[1]] = sums.get(r[1], 0) + int(e)
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1))).encode()).hexdigest()
    return [(r[0], "".join(f"{c[k]:02x}" for c in code), int(error[k]), sums[r[1]], sha) for k, r in enumerate(kept)]


def code_rows(df):
    return sorted(map(repr, [tuple(r) for r in codes.report(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]))


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("leaf,block", [(64, 8192), (1, 50), (4, 700)])
def test_codes_equal_comparing_everything(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(codes, "LEAF", leaf)
    monkeypatch.setattr(codes, "BLOCK", block)
    rng = np.random.default_rng(leaf)
    rows = [(i, (rng.integers(-3, 3, 8) / 7).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(400)]
    rows += [(1000 + i, [0.25] * 8, 1) for i in range(300)]  # one vector that holds a third of the rows
    assert code_rows(spark.createDataFrame(rows, VECTORS)) == sorted(map(repr, naive_codes(rows)))


def test_codes_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [0.1, 0.2, -0.3, 0.4], None), (5, [0.1, 0.2, -0.3, 0.4], None), (5, [9.5, 0.2, -0.3, 0.4], 2), (None, [1.0, 2.0, 3.0, 4.0], 1)]
    rows += [(1, None, 1), (2, [nan, 0.0, 0.0, 0.0], 1), (3, [0.0, inf, 0.0, 0.0], 1), (4, [0.0, None, 0.0, 0.0], 1), (6, [1.0, 2.0], 1), (7, [], 1)]
    assert code_rows(clash(spark.createDataFrame(rows, VECTORS))) == sorted(map(repr, naive_codes(rows)))
    assert codes.report(spark.createDataFrame([], VECTORS)).collect() == []
    assert codes.report(spark.createDataFrame(rows[4:8], VECTORS)).collect() == []
    with pytest.raises(ValueError, match="cut into"):
        codes.report(spark.createDataFrame([(1, [1.0, 2.0], 1)], VECTORS))
    with pytest.raises(ValueError, match="too large"):
        codes.report(spark.createDataFrame([(1, [1e9] * 4, 1)], VECTORS))


def test_codes_trees_hold_every_point_once():
    rng = np.random.default_rng(3)
    for x in (rng.integers(-50, 50, (3000, 4)), np.zeros((40, 4), np.int64), rng.integers(0, 2, (500, 3))):
        t = codes.tree(x)
        assert (t["points"][t["place"]] == x).all() and t["count"][0] == len(x) and t["weight"].sum() == len(x)
        for i in range(len(t["low"])):
            part = t["points"][t["low"][i] : t["high"][i]]
            assert (np.sqrt(((part - t["centre"][i]) ** 2).sum(1)) <= t["radius"][i] + 1e-9).all()
            assert ((part * t["weight"][t["low"][i] : t["high"][i], None]).sum(0) == t["total"][i]).all()


@pytest.mark.parametrize("most", [40, 1 << 28])
def test_codes_assignment_is_exact_in_either_arithmetic(most):
    rng = np.random.default_rng(most)
    for leaf in (1, 8, 64):
        x = rng.integers(-most, most, (700, 4))
        x[::3] = x[0]
        entries = np.concatenate([x[::9], x[5:9], x[5:9] + 1])
        t = codes.tree(x)
        owner, sums, counts = codes.assign(t, entries)
        d = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)) for e in entries] for p in t["points"]], object)
        assert [list(r).index(min(r)) for r in d] == owner.tolist()
        assert counts.sum() == 700 and (sums.sum(0) == x.sum(0)).all()


def test_codes_owned_balls_are_not_opened(monkeypatch):
    """Far clusters, one entry each: the cached sums do, no point is compared."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-9, 9, (500, 4)) + 100_000 * k for k in range(6)])
    monkeypatch.setattr(codes, "nearest", lambda *a: pytest.fail("a leaf was opened"))
    owner, sums, counts = codes.assign(codes.tree(x), np.array([[100_000 * k] * 4 for k in range(6)]))
    assert (counts == 500).all() and (sums == x.reshape(6, 500, 4).sum(1)).all()


# -- op12

TURNS = "conv_id long, turn long, role string, text string"


def naive_trie(rows):
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            key = hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest()
            by.setdefault(c, []).append(((t is not None, t or 0, key), (r, x)))
    by = {c: [x for _, x in sorted(v)] for c, v in by.items()}
    full = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(by.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + own[h:])
    members = {}
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for seq, cs in members.items():
        below = [s for s in members if s[: len(seq)] == seq]
        ends = ",".join(map(str, sorted(c for c in cs if full[c] == seq)))
        out.append((
            min(cs), len(seq), min(members[seq[:-1]]) if seq else None, len(cs), sum(len(s) == len(seq) + 1 for s in below),
            sum(not any(len(t) == len(s) + 1 and t[: len(s)] == s for t in below) for s in below),
            sum((len(members[s]) - 1) * len(s[-1][1].encode()) for s in below if s), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(map(repr, out))


def trie_rows(df):
    return sorted(map(repr, [tuple(r) for r in trie.trie(df).collect()]))


def random_turns(seed, convs, most, kinds):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "é"]) if kinds > 2 else "user", "wörd " * rng.randrange(kinds)) for c in range(convs) for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("shard,bits,chunk,block", [(1 << 16, 10, 12, 64), (1, 1, 1, 4), (9, 2, 2, 8), (40, 3, 12, 64)])
def test_trie_equals_brute_force(spark, monkeypatch, shard, bits, chunk, block):
    for k, v in (("SHARD", shard), ("BITS", bits), ("CHUNK", chunk), ("BLOCK", block)):
        monkeypatch.setattr(trie, k, v)
    rows = random_turns(shard, 70, 12, 2) + [(200 + i, 0, "s", "common") for i in range(40)] + [(400, t, "u", f"{t % 3}") for t in range(60)]
    assert trie_rows(clash(spark.createDataFrame(rows, TURNS).repartition(3))) == naive_trie(rows)


def test_trie_odd_rows(spark):
    rows = [(None, 0, "a", "b"), (1, None, None, None), (1, None, None, None), (1, 3, "u", ""), (1, 3, "u", "z"), (1, 3, "u", "z"), (-7, 0, "u", "x" * 100_000), (-5, 0, "u", "q"), (2, 5, "", "")]
    df = spark.createDataFrame(rows, TURNS)
    got = trie_rows(df)
    assert got == naive_trie(rows)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    assert sorted(map(repr, con.execute(trie.ORACLE).fetchall())) == got
    assert trie.trie(spark.createDataFrame([], TURNS)).collect() == []


def test_parentheses_findclose():
    rng = random.Random(5)
    for size in (1, 2, 63, 64, 65, 700, 5000):
        opens, depth = [True], 1
        while len(opens) < 2 * size:
            left = 2 * size - len(opens)
            up = depth == 0 or (depth < left and rng.random() < 0.55)
            opens.append(up)
            depth += 1 if up else -1
        stack, close = [], {}
        for i, o in enumerate(opens):
            if o:
                stack.append(i)
            else:
                close[stack.pop()] = i
        p = trie.Parentheses(np.array(opens))
        at = np.array(sorted(close))
        found = p.findclose(at)
        assert [close[i] for i in at] == found.tolist()
        leaves = [sum(opens[j] and not opens[j + 1] for j in range(i, close[i])) for i in at]
        assert leaves == p.pairs_within(at, found).tolist()


# -- op13


def library(texts):
    tok = Tokenizer.from_file(WORDS)
    ids = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    digest = lambda i: hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()
    return [(len(i), digest(i), hashlib.sha256(tok.decode(i, skip_special_tokens=False).encode()).hexdigest()) for i in ids]


SPECIAL = "a<|endoftext|>B <|startoftext|><|startoftext|> x</w> <|ENDOFTEXT|> ΑΣ Σ İ ǅ ﬁ é Å Ᲊ\U0001f9ff 1a2b 'S 'll it's b\u0085c\x1fd"


def test_bpe_equals_the_library(spark, sf, odd_docs, make_docs):
    docs = odd_docs.unionByName(make_docs([(90, SPECIAL, "s"), (91, "ab" * 40_000, "s"), (92, "!" * 5000 + "é" * 5000 + "中" * 3000, "s")]))
    docs = docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    rows = docs.collect()
    got = bpe.encode(docs, WORDS).drop("ids", "n_decoded").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r["doc_id"], *x)) for r, x in zip(rows, library([r["text"] for r in rows])))
    assert bpe.encode(docs.limit(0), WORDS).collect() == []


def test_bpe_decoding_gives_the_library_text(spark, odd_docs, make_docs, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 50)
    tok = Tokenizer.from_file(WORDS)
    docs = make_docs([(90, SPECIAL, "s"), (91, "some words of a text " * 30, "s"), (92, None, "s")])
    got = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, WORDS), WORDS).collect()}
    assert got == {r["doc_id"]: tok.decode(tok.encode(r["text"] or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in docs.collect()}


def test_bpe_cuts_words_as_the_merges_do(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 3000)  # tables that start anew change nothing
    with open(WORDS, encoding="utf-8") as f:
        coder = bpe.encoder_of(f.read())
    tok, words, rng = Tokenizer.from_file(WORDS), bpe.Words(coder), random.Random(6)
    for alphabet in ("ab", "aes", "abcdeinthersoul", "!=.-", "éèñ中ß"):
        for _ in range(3000):
            w = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 18)))
            letters = tok.pre_tokenizer.pre_tokenize_str(w)[0][0] if len(tok.pre_tokenizer.pre_tokenize_str(w)) == 1 else None
            if letters:
                assert np.frombuffer(words[w], "<u4").tolist() == [t.id for t in tok.model.tokenize(letters)], w
    assert all(coder.encode(s) == [i] for s, i in list(coder.ids.items())[::7] if s.endswith(bpe.MARK) and coder.whole[i])


def test_bpe_rules_of_characters_equal_the_library():
    """Normalisation and classes of every character that this Python's tables know."""
    with open(WORDS, encoding="utf-8") as f:
        split = bpe.Splitter(f.read())
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    spaces = regex.compile(r"\s+")
    for k in range(0, len(chars), 2000):
        text = "a".join(chars[k : k + 2000])
        own = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        assert spaces.sub(" ", own) == split.library.normalizer.normalize_str(text)
        letters = {v: c for c, v in split.bytes.items()}
        pieces = [p for p, _ in split.library.pre_tokenizer.pre_tokenize_str(own)]
        assert ["".join(map(chr, (letters[b] for b in w.encode()))) for w in split.words(text)] == pieces
