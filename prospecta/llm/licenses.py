"""Operator 7 (DataFrame functions only): licence scan by a positional rare-token index.

1. The document frequency of every word of the licence templates is counted over all
   files (one pass, map-side combined, one row per licence word).
2. Each template is posted under the highest-IDF word of its mandatory key phrase, with
   that word's offset. Any place of the phrase holds that word at that offset, so looking
   up only these rare words loses no place.
3. In each file the rare words' positions are looked up, position minus offset gives the
   places a template may start at, the mandatory key phrase is verified word by word, and
   the template's remaining words are intersected by relative position for the score.

``score`` is the largest share of a template's words found at their relative positions
over the verified places, 0 without any. Cases: null and empty text have no words, no
places, empty label lists and null first and last word; repeated rows and ties are
answered row by row; only ``doc_id`` and ``text`` are read; an empty table gives an empty
result. Texts are whole: a position is an index into the full word list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.llm.common import ALNUM_WORD


@dataclass(frozen=True)
class Template:
    """``words`` of a licence line; the key phrase is ``size`` words from ``at`` on."""

    label: str
    words: tuple[str, ...]
    at: int
    size: int
    base: bool = False

    @property
    def key(self) -> tuple[str, ...]:
        return self.words[self.at : self.at + self.size]


def template(label: str, line: str, key: str, base: bool = False) -> Template:
    words, k = tuple(line.split()), tuple(key.split())
    at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
    # Unicode lower-casing maps one foreign letter to "k": keep it out of the templates.
    assert not any("k" in w for w in words), line
    return Template(label, words, at, len(k), base)


# The base phrases with their labels, then well-known licence lines.
TEMPLATES = (
    template("gpl", "licensed under the gnu general public license version", "gnu general public license", True),
    template("apache", "licensed under the apache license version", "apache license", True),
    template("cc-by", "licensed under cc by", "cc by", True),
    template("mit", "released under the mit license", "mit license", True),
    template("lgpl", "gnu lesser general public license version", "gnu lesser general public license"),
    template("agpl", "gnu affero general public license version", "gnu affero general public license"),
    template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    template("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use in source and binary forms"),
    template("bsd", "licensed under the bsd license", "bsd license"),
    template("mit", "permission is hereby granted free of charge to any person", "permission is hereby granted free of charge"),
    template("cc-by", "creative commons attribution license", "creative commons attribution"),
    template("cc0", "creative commons zero public domain dedication", "creative commons zero"),
)


def words_of(text: Column) -> Column:
    """Lower-cased words of ``ALNUM_WORD``; null and empty text have none."""
    cut = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(cut, "")


def word_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Number of files with each licence word (at most one row per word is collected)."""
    found = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def rare_index(frequencies: dict[str, int], templates=TEMPLATES) -> list[tuple[str, int, int]]:
    """(rare word, template number, the word's offset in the template)."""
    posts = []
    for t, x in enumerate(templates):
        at = min(range(x.at, x.at + x.size), key=lambda i: (frequencies.get(x.words[i], 0), x.words[i], i))
        posts.append((x.words[at], t, at))
    return posts


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score and ``places``: array of (label, base, word, share)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary = sorted({w for t in templates for w in t.key})
    posts = rare_index(word_frequencies(docs, vocabulary), templates)
    rare = sorted({w for w, _, _ in posts})

    post = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(t).alias("t"), F.lit(o).alias("at")) for w, t, o in posts])
    info = F.array(*[F.struct(F.lit(x.label).alias("label"), F.lit(x.base).alias("base"), F.lit(x.at).alias("at"), F.array(*map(F.lit, x.key)).alias("key"), F.array(*map(F.lit, x.words)).alias("words")) for x in templates])
    w = F.col("w")

    def candidates(i: Column) -> Column:
        """Templates posted under the word at ``i``, with the place they would start at."""
        here = F.filter(post, lambda p: p["word"] == F.get(w, i))
        return F.transform(here, lambda p: F.struct(p["t"].alias("t"), (i - p["at"]).alias("start")))

    def verified(c: Column) -> Column:
        x = F.get(info, c["t"])
        first = c["start"] + x["at"]
        return F.when(first >= 0, F.slice(w, first + 1, F.size(x["key"])) == x["key"]).otherwise(F.lit(False))

    def place(c: Column) -> Column:
        x = F.get(info, c["t"])
        same = F.filter(F.sequence(F.lit(0), F.size(x["words"]) - 1), lambda j: F.when((c["start"] + j >= 0), F.get(w, c["start"] + j) == F.get(x["words"], j)).otherwise(F.lit(False)))
        return F.struct(x["label"].alias("label"), x["base"].alias("base"), (c["start"] + x["at"]).cast("long").alias("word"), (F.size(same) / F.size(x["words"])).alias("share"))

    held = F.arrays_overlap(w, F.array(*map(F.lit, rare)))
    spots = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(rare))
    places = F.transform(F.filter(F.flatten(F.transform(spots, candidates)), verified), place)
    empty = F.array().cast("array<struct<label:string,base:boolean,word:bigint,share:double>>")
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda p: p["label"]))), ",")

    out = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    out = out.select("doc_id", F.size(w).cast("long").alias("n_words"), F.when(held, places).otherwise(empty).alias("places"))
    out = out.withColumn("base_places", F.filter("places", lambda p: p["base"]))
    at = F.transform("base_places", lambda p: p["word"])
    return out.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        joined(F.col("base_places")).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
        "places",
    )


def oracle_sql(templates=TEMPLATES) -> str:
    """DuckDB twin: every position is compared with every key phrase, without an index."""
    pat = ALNUM_WORD
    q = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    parts = []
    for x in templates:
        k, n = len(x.key), len(x.words)
        hits = f"list_filter(range(0, greatest(len(w) - {k - 1}, 0)), lambda i: w[i + 1 : i + {k}] = {q(x.key)})"
        share = f"list_count(list_filter(range(0, {n}), lambda j: i - {x.at} + j >= 0 AND coalesce(w[i - {x.at} + j + 1] = {q(x.words)}[j + 1], false))) / {n}.0"
        parts.append(f"CASE WHEN len(list_intersect(w, {q(x.key)})) < {len(set(x.key))} THEN [] ELSE list_transform({hits}, lambda i: {{'label': '{x.label}', 'base': {str(x.base).lower()}, 'word': i, 'share': CAST({share} AS DOUBLE)}}) END")
    places = "list_concat(" * (len(parts) - 1) + parts[0] + "".join(f", {p})" for p in parts[1:])
    joined = lambda xs: f"coalesce(array_to_string(list_sort(list_distinct(list_transform({xs}, lambda p: p.label))), ','), '')"
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pat}') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {places} AS places FROM t),
b AS (SELECT *, list_filter(places, lambda p: p.base) AS bp FROM p)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(bp) AS BIGINT) AS n_base,
  CAST(list_min(list_transform(bp, lambda p: p.word)) AS BIGINT) AS first_word,
  CAST(list_max(list_transform(bp, lambda p: p.word)) AS BIGINT) AS last_word,
  {joined('bp')} AS base_labels, {joined('places')} AS labels,
  coalesce(list_max(list_transform(places, lambda p: p.share)), 0.0) AS score FROM b"""
