"""Licence scans against a plain version, and odd rows."""

import math
import random
import re

from pyspark.sql import functions as F

from kinframe.llm.licenses import LOOK, SLACK, TEMPLATES, Template, op12_license_scans, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))


def plain(texts, templates):
    """Every start of every template is looked at, with the two-word rule told by counting."""
    files = [plain_words(t) for t in texts]
    idf = {w: 1 + math.floor(1000 * math.log((len(files) + 1) / (sum(w in set(f) for f in files) + 1))) for t in templates for w in t.words()}
    out = []
    for f in files:
        found = []
        for t in templates:
            tw = t.words()
            total, have = sum(idf[w] for w in tw), set(f)
            rare = sorted({w for w in tw if w in have}, key=lambda w: (-idf[w], w))[:LOOK]
            for s in range(-len(tw), len(f)):
                at = lambda i: f[i] if 0 <= i < len(f) else None
                agreeing = {w for i, w in enumerate(tw) if w in rare and at(s + i) == w}
                weight = sum(idf[w] for i, w in enumerate(tw) if at(s + i) == w)
                slack = 0 if t.base else SLACK
                keyed = all(any(s + k + d >= 0 and f[s + k + d : s + k + d + len(words)] == words for d in range(-slack, slack + 1)) for k, words in t.key_places())
                if rare and len(agreeing) >= min(2, len(rare)) and 100 * weight >= t.least * total and keyed:
                    found.append((t.label, t.base, s, weight, total))
        out.append((len(f), sorted(found)))
    return out


def texts(seed, n=150):
    draw = random.Random(seed)
    noise = ["the", "of", "and", "by", "all", "to", "any", "x1", "Élan", "\n", "-", "CC", "version", "license", "K", "cİ"]
    out = []
    for _ in range(n):
        parts = [" ".join(draw.choice(noise) for _ in range(draw.randrange(12)))]
        for _ in range(draw.randrange(4)):
            w = draw.choice(TEMPLATES).words()
            if draw.random() < 0.5:
                k = draw.randrange(len(w))
                w = w[:k] + draw.choice([[], ["new"], ["some", "more"]]) + w[k + draw.randrange(2) :]
            parts += [draw.choice([" ", "-", ", "]).join(w).title(), " ".join(draw.choice(noise) for _ in range(draw.randrange(6)))]
        out.append(" ".join(parts))
    return out + [None, "", "...", "cc by cc by cc-by", "all rights reserved " * 300, "a " * 20_000 + "General Public License", "CC", "rights reserved", "by cc"]


def check(spark, rows, templates):
    df = spark.createDataFrame([(k, t, "y") for k, t in enumerate(rows)], "doc_id long, text string, words string").repartition(3)
    got = scan_licenses(df, templates).orderBy("doc_id").collect()
    assert [(r.n_words, sorted(map(tuple, r.found))) for r in got] == plain(rows, templates)


def test_equals_plain(spark):
    check(spark, texts(1), TEMPLATES)
    check(spark, texts(2, 60), TEMPLATES[:3])
    check(spark, texts(3, 60), (Template("one", "license", ("license",)), Template("twice", "of all and of all", ("of all",), 60)))


def test_query(spark, tmp_path):
    rows = ["Licensed under CC BY-NC 4.0.", "nothing", None, "All rights reserved. cc by. all rights reserved", "Released under the MIT License."]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)] + [(4, rows[4])], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op12_license_scans(spark, str(tmp_path)).collect()}
    assert (got[0].base_labels, got[0].labels, got[0].score, got[0].first_word) == ("cc-by", "cc-by,cc-by-nc-4.0", 1.0, 2)
    assert (got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (0, None, "", 0.0) and got[2].n_words == 0
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].labels) == (3, 0, 5, "cc-by,reserved")
    assert (got[4].base_labels, got[4].labels) == ("", "mit")
    spark.createDataFrame([], df.schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op12_license_scans(spark, f"{tmp_path}/none").collect() == []
    plan = scan_licenses(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in scan_licenses(df.select(F.col("doc_id"), "text"))._jdf.queryExecution().executedPlan().toString()
