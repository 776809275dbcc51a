"""Licence labels from a positional index of rare words.

Templates are word sequences with a mandatory phrase. One pass splits every text and keeps where the words of all templates
stand in it, as postings (position, word). From these the words' document frequencies over the whole corpus are counted, and
so their IDF. The templates' postings are indexed by word; of the words that a file has, those that are the rarest (highest
IDF) of some template's mandatory phrase are looked up, which gives the places where the template would have to start. At
each place the file's postings near it, counted from there, are intersected with the template's: a place counts if the whole
mandatory phrase stands there and at least KEEP of the template's words do. A file that has the phrase has its rarest word,
so no place is missed, whatever the frequencies. Everything happens within a row, in built-in expressions: no shuffle but
the count of some hundred words, which is all that the driver gets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm._common import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEEP = 0.6


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: str
    base: bool = False


BASE = (Template("cc-by", "cc by", "cc by", True), Template("gpl", "general public license", "general public license", True), Template("reserved", "all rights reserved", "all rights reserved", True))
#: Wording of public licence notices.
TEMPLATES = (
    *BASE,
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "to the extent possible under law the author has waived all copyright", "waived all copyright"),
)


def folded(text: Column) -> Column:
    """The text with A-Z lower-cased; null counts as empty. lower() is kept from turning the Kelvin sign into an ASCII letter."""
    return F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u01e9")))


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.text.split()})


def postings(docs: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, n_words, hits array<long>) of each row of docs: in order of positions, position * len(words) + number of the word."""
    split = docs.select("doc_id", F.regexp_extract_all(folded(F.col("text")), F.lit(WORD), F.lit(0)).alias("words"))
    listed = F.array(*map(F.lit, words))
    hit = lambda w, i: F.when(w.isin(words), i.cast("long") * len(words) + F.array_position(listed, w) - 1)
    return written(split.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_compact(F.transform("words", hit)).alias("hits")))


def frequencies(rows: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many rows of postings() each word stands."""
    one = rows.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h % len(words)))).alias("w"))
    return {words[r.w]: r["count"] for r in one.groupBy("w").count().collect()}


def _phrase_at(t: Template) -> int:
    words, phrase = t.text.split(), t.phrase.split()
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def _rarest(t: Template, df: dict[str, int]) -> tuple[int, str]:
    """The position in the template, and the word, of the mandatory phrase's rarest word; ties go to the first."""
    at, phrase = _phrase_at(t), t.phrase.split()
    k = min(range(len(phrase)), key=lambda j: (df.get(phrase[j], 0), j))
    return at + k, phrase[k]


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, keep: float = KEEP) -> DataFrame:
    """(doc_id, n_words, found array<struct<label, base, start, share>>) of each row of docs (doc_id, text).

    Null and empty texts have no words and no places; texts of any length are read whole. start counts words from 0; share
    is the part of the template's words that stand in place, and a template that starts before the text has places too.
    Repeated rows and rows with a null doc_id are scanned like others; a table without rows gives none; other columns are
    ignored.
    """
    words = vocabulary(templates)
    n, number = len(words), {w: i for i, w in enumerate(words)}
    rows = postings(docs.select("doc_id", "text"), words)
    df = frequencies(rows, words)
    index: dict[str, list[tuple[Template, int]]] = {}
    for t in templates:
        offset, word = _rarest(t, df)
        index.setdefault(word, []).append((t, offset))
    rare = [number[w] for w in index]
    told = F.transform("hits", lambda h, k: F.when((h % n).isin(rare), F.struct(k.alias("k"), F.floor(h / n).cast("long").alias("at"), (h % n).alias("word"))))
    rows = rows.select("doc_id", "n_words", "hits", F.array_compact(told).alias("rare"))

    def places(t: Template, offset: int, word: int) -> Column:
        text, at = t.text.split(), _phrase_at(t)
        own = [j * n + number[w] for j, w in enumerate(text)]
        whole, must = (F.array(*(F.lit(c).cast("long") for c in codes)) for codes in (own, own[at : at + len(t.phrase.split())]))

        def place(x: Column) -> Column:
            start = x["at"] - offset
            near = F.transform(F.slice("hits", F.greatest(x.k + 1 - offset, F.lit(1)), F.lit(len(text))), lambda h: h - start * n)
            share = F.size(F.array_intersect(near, whole)) / F.lit(float(len(text)))
            return F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), start.cast("int").alias("start"), share.alias("share"), (F.size(F.array_intersect(near, must)) == len(t.phrase.split())).alias("whole"))

        found = F.filter(F.transform(F.filter("rare", lambda x: x.word == word), place), lambda x: x.whole & (x.share >= keep))
        return F.transform(found, lambda x: F.struct(x.label.alias("label"), x.base.alias("base"), x.start.alias("start"), x.share.alias("share")))

    none = F.array().cast("array<struct<label:string,base:boolean,start:int,share:double>>")
    found = [places(t, offset, number[w]) for w, entries in index.items() for t, offset in entries]
    return rows.select("doc_id", "n_words", F.when(F.size("rare") > 0, F.concat(*found)).otherwise(none).alias("found"))
