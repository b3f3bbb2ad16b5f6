"""Operator 12: licence texts in documents, by a positional index of rare licence words."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.llm.common import LOWER, UPPER, ascii_lower, read

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence text, or a phrase that tells one, as words; ``keys`` are phrases of it that must stand in their place.

    ``least`` is the share of its rare-word weight, in percent, that a place must have.
    """

    label: str
    text: str
    keys: tuple[str, ...]
    least: int = 70
    base: bool = False

    def words(self) -> list[str]:
        return self.text.split(" ")

    def key_places(self) -> list[tuple[int, list[str]]]:
        """(word at which a key begins in the text, its words)."""
        words, out = self.words(), []
        for key in self.keys:
            k = key.split(" ")
            out.append((next(i for i in range(len(words)) if words[i : i + len(k)] == k), k))
        return out


#: The phrases that every scan counts, with their labels.
BASE = tuple(Template(label, phrase, (phrase,), 100, True) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")))
#: Opening words and usual notices of public licences, lower-cased, one space between words.
TEMPLATES = (
    *BASE,
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "copy of this software")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms", "with or without modification")),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license either version 3 of the license", ("gnu general public license", "version 3")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc0", "dedicated to the public domain under cc0 1 0", ("public domain",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("copy modify and or distribute", "with or without fee")),
)
#: How far, in words, a key may have moved from its place; how many of a file's rarest words of a template are looked up.
SLACK, LOOK = 2, 3


def words_of(text: Column) -> Column:
    """The words of a text; null has none. Those of ASCII letters are in lower case, others may be or not.

    Full lower-casing is much faster than that of A-Z alone and moves no edge of a word,
    but for the two letters beyond ASCII whose lower case holds an ASCII letter.
    """
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(text.contains("\u0130") | text.contains("\u212a"), ascii_lower(text)).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, _GAP), "")


def rarity(n_docs: int, df: int) -> int:
    """Inverse document frequency in whole thousandths, 1 at least, so that sums are the same in any order."""
    return 1 + math.floor(1000 * math.log((n_docs + 1) / (df + 1)))


def leading_words(t: Template, idf: dict[str, int]) -> list[str]:
    """The template's highest-IDF words one of which a text must hold: all others together weigh less than ``least`` percent."""
    words, out = t.words(), []
    rest = total = sum(idf[w] for w in words)
    for w in sorted(set(words), key=lambda w: (-idf[w], w)):
        if 100 * rest < t.least * total:
            break
        out.append(w)
        rest -= idf[w] * words.count(w)
    return out


def _index(templates: Sequence[Template], idf: dict[str, int]) -> Column:
    """The templates as one constant: per template its words by descending IDF with their places, its words in order, its keys."""
    def array(items) -> str:
        return f"array({', '.join(items)})"

    def struct(**fields) -> str:
        return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"

    def text(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    each = []
    for t in templates:
        words = t.words()
        places = {w: [i for i, x in enumerate(words) if x == w] for w in words}
        each.append(struct(
            label=text(t.label), base=str(t.base), least=t.least, slack=0 if t.base else SLACK, total=f"{sum(idf[w] for w in words)}L",
            postings=array(struct(word=text(w), idf=f"{idf[w]}L", places=array(map(str, places[w]))) for w in sorted(places, key=lambda w: (-idf[w], w))),
            text=array(struct(word=text(w), idf=f"{idf[w]}L") for w in words),
            keys=array(struct(at=at, words=array(map(text, key))) for at, key in t.key_places()),
        ))
    return F.expr(array(each))  # one expression: thousands of calls for its parts would take seconds


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, found): every place of a licence template in each text; ``found`` is a list of (label, base, start, weight, total).

    1. In how many of all documents each licence word stands is counted (partial
       aggregation; the driver gets one number for each word of the templates, which
       bounds it) and gives its IDF. The templates with their words' postings, rarest
       first, become one constant of the plan.
    2. Files without any of the words that a template can't do without (its rarest, by
       weight) are done. Of the others the licence words are told once. A template whose
       words in the file have less than its share of IDF weight can't be there. Of the rest the
       file's ``LOOK`` highest-IDF words of the template are looked up: each place of
       such a word gives the starts that the word's postings would have, and only starts
       on which two words agree (or the only word) go on.
    3. At such a start the template's words are compared position by position, by
       weight, and its key phrases must stand in their places, moved by ``SLACK`` words
       at most. Base phrases must be there word for word.

    All of it is one pass without a shuffle in built-in functions; work in a row is
    linear in the words of the text and the places of rare words. Null and empty texts
    have no word. Every row is judged by itself, repeated ids too; extra columns are
    not looked at; an empty table gives an empty result.
    """
    vocabulary = sorted({w for t in templates for w in t.words()})
    known = F.array(*map(F.lit, vocabulary))
    held = docs.select(F.explode(F.array_intersect(words_of(F.col(text_col)), known)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    df, n_docs = {r.word: r.df for r in held.collect()}, docs.count()
    idf = {w: rarity(n_docs, df.get(w, 0)) for w in vocabulary}
    index = _index(templates, idf)
    rarest = F.array(*map(F.lit, sorted({w for t in templates for w in leading_words(t, idf)})))
    zero, none = F.lit(0).cast("long"), F.array().cast("array<int>")
    total = lambda rows, weight: F.aggregate(rows, zero, lambda sum_, x: sum_ + weight(x))

    rows = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    rows = rows.withColumn("present", F.when(F.arrays_overlap("words", rarest), F.array_intersect("words", known)))
    here = lambda p: F.array_contains(F.col("present"), p["word"])
    likely = F.filter(index, lambda t: 100 * total(t["postings"], lambda p: F.when(here(p), p["idf"] * F.size(p["places"])).otherwise(zero)) >= t["least"] * t["total"])
    rows = rows.withColumn("likely", F.when(F.size("present") > 0, likely))
    numbered = F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    rows = rows.withColumn("occurs", F.when(F.size("likely") > 0, F.filter(numbered, lambda x: F.array_contains(F.col("present"), x["word"]))))

    def starts(p: Column) -> Column:
        at = F.filter(F.col("occurs"), lambda x: x["word"] == p["word"])
        return F.array_distinct(F.flatten(F.transform(at, lambda x: F.transform(p["places"], lambda i: x["at"] - i))))

    def agreed(lists: Column) -> Column:
        of = lambda k: F.coalesce(F.get(lists, k), none)
        two = [F.array_intersect(of(a), of(b)) for a in range(LOOK) for b in range(a)]
        out = two[0]
        for x in two[1:]:
            out = F.array_union(out, x)
        return F.when(F.size(lists) == 1, of(0)).otherwise(out)

    def weight_at(t: Column, s: Column) -> Column:
        same = F.transform(t["text"], lambda x, i: F.when(F.get(F.col("words"), s + i) == x["word"], x["idf"]).otherwise(zero))
        return total(same, lambda x: x)

    def keyed(t: Column, s: Column) -> Column:
        def there(key, moved):
            at = s + key["at"] + moved
            return (at >= 0) & (F.slice(F.col("words"), F.greatest(at, F.lit(0)) + 1, F.size(key["words"])) == key["words"])

        return F.forall(t["keys"], lambda key: F.exists(F.sequence(-t["slack"], t["slack"]), lambda moved: there(key, moved)))

    def places(t: Column) -> Column:
        rare = F.slice(F.filter(t["postings"], here), 1, LOOK)
        candidates = agreed(F.transform(rare, starts))
        weighed = F.transform(candidates, lambda s: F.struct(t["label"].alias("label"), t["base"].alias("base"), s.alias("start"), weight_at(t, s).alias("weight"), t["total"].alias("total")))
        return F.filter(weighed, lambda x: (100 * x["weight"] >= t["least"] * t["total"]) & keyed(t, x["start"]))

    found = F.when(F.size("likely") > 0, F.flatten(F.transform("likely", places)))
    kind = "array<struct<label:string,base:boolean,start:int,weight:bigint,total:bigint>>"
    return rows.select(F.col("id").alias(id_col), F.size("words").cast("long").alias("n_words"), F.coalesce(found.cast(kind), F.array().cast(kind)).alias("found"))


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and licence templates in every document of ``documents``; null and empty texts have none."""
    out = scan_licenses(read(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["base"])
    labels = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda x: x["label"]))), ",")
    share = F.array_max(F.transform("found", lambda x: F.round(x["weight"].cast("double") / x["total"], 6)))
    out = out.withColumn("based", base)
    at = F.transform("based", lambda x: x["start"].cast("long"))
    return out.select(
        "doc_id", "n_words", F.size("based").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        labels(F.col("based")).alias("base_labels"), labels(F.col("found")).alias("labels"), F.coalesce(share, F.lit(0.0)).alias("score"),
    )


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


OP12_SQL = rf"""
with tw(t, i, w) as (values {_values((k, i, w) for k, t in enumerate(TEMPLATES) for i, w in enumerate(t.words()))}),
template(t, label, base, least) as (values {_values((k, t.label, int(t.base), t.least) for k, t in enumerate(TEMPLATES))}),
keyed(t, kid, j, off, w, n) as (values {_values((k, kid, j, at, w, len(words)) for k, t in enumerate(TEMPLATES) for kid, (at, words) in enumerate(t.key_places()) for j, w in enumerate(words))}),
split_docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
word as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as pos from split_docs),
own as (select * from word where w in (select w from tw)),
present as (select distinct doc_id, w from own),
idf as (select w, 1 + floor(1000 * ln(((select count(*) from documents) + 1)::double / (count(distinct p.doc_id) + 1)))::bigint as idf
        from (select distinct w from tw) v left join present p using (w) group by w),
whole as (select t, sum(idf) as total from tw join idf using (w) group by t),
posting as (select t, w, any_value(idf) as idf, count(*) as n from tw join idf using (w) group by t, w),
likely as (select doc_id, t from present join posting using (w) join template using (t) join whole using (t) group by doc_id, t, least, total having 100 * sum(idf * n) >= least * total),
rare as (select doc_id, t, w from likely join posting using (t) join present using (doc_id, w) qualify row_number() over (partition by doc_id, t order by idf desc, w) <= {LOOK}),
asked as (select doc_id, t, count(*) as n from rare group by doc_id, t),
start as (
  select doc_id, t, pos - i as s from rare join own using (doc_id, w) join tw using (t, w) join asked a using (doc_id, t)
  group by doc_id, t, pos - i, a.n having count(distinct w) >= least(2, a.n)),
weighed as (
  select s.doc_id, s.t, s.s, coalesce(sum(idf), 0) as weight from start s join tw using (t) join idf using (w)
  join own o on o.doc_id = s.doc_id and o.pos = s.s + tw.i and o.w = tw.w group by all),
key_hits as (
  select distinct s.doc_id, s.t, s.s, k.kid from start s join keyed k using (t) join template using (t)
  join range(-{SLACK}, {SLACK + 1}) m(d) on d = 0 or base = 0
  join own o on o.doc_id = s.doc_id and o.pos = s.s + k.off + d + k.j and o.w = k.w where s.s + k.off + d >= 0
  group by s.doc_id, s.t, s.s, k.kid, k.n, d having count(*) = k.n),
key_counts as (select doc_id, t, s, count(*) as hits from key_hits group by all),
found as (
  select doc_id, label, base, s, round(weight::double / total, 6) as share
  from weighed join key_counts using (doc_id, t, s) join template using (t) join whole using (t)
  where 100 * weight >= least * total and hits = (select count(distinct kid) from keyed k where k.t = weighed.t)),
summed as (
  select doc_id, count(*) filter (base = 1) as n_base, min(s) filter (base = 1) as first_word, max(s) filter (base = 1) as last_word,
         array_to_string(list_sort(list_distinct(list(label) filter (base = 1))), ',') as base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') as labels, max(share) as score
  from found group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from split_docs d left join summed using (doc_id)
"""
