"""Licence scan with a positional index of rare words (DataFrame operations only).

Each template is a word sequence with a mandatory key phrase. The words of every text
are split once: how many there are, which template words are among them, and, where all
words of some key phrase are there, the words themselves are kept in a table. Document
frequencies are counted from it. The highest-IDF words of a template's key phrase become
its postings (word -> template, position): an occurrence of the rarest proposes a start,
the other rare ones must stand at the same relative position, and then the key phrase is
verified whole. Because of that, no place of a key phrase is missed.

The templates are one table of postings in a single literal, so a plan for hundreds of
templates is as long as for one. Only word counts, as many as the templates have words,
reach the driver; texts stay in their rows.

Defined cases: null text is empty and gives no label; a row is answered by
itself, so repeated rows repeat; nested and overlapping places all count; an empty
table gives an empty result; without templates there are no labels; extra columns are
ignored.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import keep, lower_ascii, text_of

#: What separates words: every ASCII character but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        """Where the key phrase starts within the text."""
        own, key = self.words, self.key.split()
        return next(i for i in range(len(own)) if own[i : i + len(key)] == key)


def _base(phrase: str, label: str) -> Template:
    return Template(label, phrase, phrase, base=True)


# Phrases whose every place counts, and notices of public licences.
BASE = [
    _base("gnu general public license", "gpl"),
    _base("apache license", "apache"),
    _base("cc by", "cc-by"),
    _base("mit license", "mit"),
]
NOTICES = [
    Template("agpl-3.0", "gnu affero general public license version 3", "gnu affero general public license version 3"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("mit-notice", "released under the mit license", "released under the mit license"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
]


def words_of(text: Column) -> Column:
    """Words of a text: lower-cased runs of ASCII letters, digits and all other characters."""
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def _literal(value, kind: str) -> Column:
    """A constant of any shape; Spark reads it once and keeps it as one literal."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"struct<v:{kind}>")["v"]


def split_texts(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """Per document: doc_id, n_words, present (template words among them), and words where a key phrase may be, else null."""
    vocabulary = _literal(sorted({w for t in templates for w in t.words}), "array<string>")
    keys = _literal([sorted(set(k)) for k in sorted({tuple(t.key.split()) for t in templates})], "array<array<string>>")
    own = docs.select("doc_id", words_of(text_of()).alias("words")).select("*", F.array_intersect("words", vocabulary).alias("present"))
    may = F.exists(keys, lambda k: F.size(F.array_except(k, "present")) == 0)
    return own.select("doc_id", F.size("words").alias("n_words"), "present", F.when(may, F.col("words")).alias("words"))


def template_idf(split: DataFrame, templates: list[Template]) -> dict[str, float]:
    """IDF, at least 1, of every template word over all documents; as many rows as the templates have words."""
    # Each document adds 1 per word it has; a null element counts all documents.
    counted = split.select(F.explode(F.concat("present", F.array(F.lit(None).cast("string")))).alias("word")).groupBy("word").count()
    df = {r["word"]: r["count"] for r in counted.collect()}
    n = df.pop(None, 0)
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in sorted({w for t in templates for w in t.words})}


POSTINGS = "map<string,array<struct<label:string,base:boolean,anchor:int,rare:array<struct<at:int,word:string>>,key:array<string>,key_at:int,words:array<string>,weights:array<double>,total:double>>>"


def postings(templates: list[Template], idf: dict[str, float], rare_words: int) -> dict[str, list[dict]]:
    """Templates by the rarest word of their key phrase, with its place, those of the next rare words, and the weights of all words."""
    index = defaultdict(list)
    for t in templates:
        key = t.key.split()
        rare = sorted(range(len(key)), key=lambda i: (-idf[key[i]], i))[:rare_words]
        weights = [idf[w] for w in t.words]
        index[key[rare[0]]].append(
            {"label": t.label, "base": t.base, "anchor": rare[0], "rare": [{"at": i, "word": key[i]} for i in rare[1:]], "key": key, "key_at": t.key_at, "words": t.words, "weights": weights, "total": sum(weights)}
        )
    return dict(index)


def _places(words: Column, index: dict[str, list[dict]]) -> Column:
    """array<struct<label, base, start, share>>: every verified place, with the IDF-weighted share of the template's words that stand there."""
    table, anchors = _literal(index, POSTINGS), _literal(sorted(index), "array<string>")
    hits = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda h: F.array_contains(anchors, h["word"]))
    proposed = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(table, h["word"]), lambda p: F.struct(p.alias("t"), (h["pos"] - p["anchor"]).alias("at")))))

    def verified(c: Column) -> Column:
        aligned = F.forall(c["t"]["rare"], lambda r: F.coalesce(F.get(words, c["at"] + r["at"]) == r["word"], F.lit(False)))
        return (c["at"] >= 0) & aligned & (F.slice(words, F.greatest(c["at"], F.lit(0)) + 1, F.size(c["t"]["key"])) == c["t"]["key"])

    def place(c: Column) -> Column:
        t, start = c["t"], c["at"] - c["t"]["key_at"]
        there = lambda i: F.coalesce((start + i >= 0) & (F.get(words, F.greatest(start + i, F.lit(0))) == F.get(t["words"], i)), F.lit(False))
        matched = F.aggregate(F.sequence(F.lit(0), F.size(t["words"]) - 1), F.lit(0.0), lambda sum_, i: sum_ + F.when(there(i), F.get(t["weights"], i)).otherwise(0.0))
        # Sums of shares in floating point may pass 1 by a last digit.
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), start.alias("start"), F.least(F.lit(1.0), matched / t["total"]).alias("share"))

    return F.transform(F.filter(proposed, verified), place)


def scan(docs: DataFrame, base: list[Template] = BASE, notices: list[Template] = NOTICES, rare_words: int = 3, least_coverage: float = 0.5) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    templates = [*base, *notices]
    split = keep(split_texts(docs, templates), "license-words")
    index = postings(templates, template_idf(split, templates), rare_words)
    none = F.array().cast("array<struct<label:string,base:boolean,start:int,share:double>>")
    found = split.select("doc_id", "n_words", F.when(F.col("words").isNotNull(), _places(F.col("words"), index)).otherwise(none).alias("places"))
    of_base = F.transform(F.filter("places", lambda p: p["base"]), lambda p: p["start"])
    labels = lambda which: F.array_join(F.sort_array(F.array_distinct(F.transform(F.filter("places", which), lambda p: p["label"]))), ",")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(of_base).cast("long").alias("n_base"),
        F.array_min(of_base).cast("long").alias("first_word"),
        F.array_max(of_base).cast("long").alias("last_word"),
        labels(lambda p: p["base"]).alias("base_labels"),
        labels(lambda p: p["base"] | (p["share"] >= least_coverage)).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )
