"""Importance resampling against a plain version, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from kinframe.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))


def plain_features(text, most):
    w = plain_words(text)
    return [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, most, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in plain_features(t, most))
    t = Counter(bucket(f) for x in target for f in plain_features(x, most))
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (sum(s.values()) + buckets) / ((s[k] + 1) * (sum(t.values()) + buckets))))
    out = []
    for i, text in docs:
        f = plain_features(text, most)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(plain_words(text)) >= least])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(order[: percent * len(order) // 100], 1)}
    return sorted((str(r[0]), r[1], r[2], r[3], rank.get(id(r))) for r in out)


def test_checksums_of_spans():
    draw = random.Random(1)
    raw = np.frombuffer(draw.randbytes(5000), np.uint8)
    start = np.array([draw.randrange(4000) for _ in range(300)] + [0, 0, 5, 5, 0])
    size = np.array([draw.randrange(1, 900) for _ in range(300)] + [64, 128, 63, 65, 5000])
    assert importance.span_checksums(raw, start, size).tolist() == [zlib.crc32(raw[a : a + n].tobytes()) for a, n in zip(start, size)]
    assert importance.span_checksums(raw, start[:0], size[:0]).tolist() == []


def texts(draw, n, words):
    return [" ".join(draw.choice(words) for _ in range(draw.randrange(0, 60))) for _ in range(n)]


def test_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 500)  # many blocks
    draw = random.Random(2)
    words = ["The", "of", "élan", "x9", "ÉTÉ", "a-b", "\n", "naïve", "word" * 40, "日本語", "\x00", "~", "Zz"]
    docs = [(k, t) for k, t in enumerate(texts(draw, 80, words))] + [(80, None), (81, ""), (None, "one two " * 30), (5, "twice the id " * 9), (82, "q" * 5000 + " " + "r s " * 30)]
    target = texts(draw, 6, words) + [None, ""]
    frame = spark.createDataFrame([(i, t, 1, 2.0) for i, t in docs], "doc_id long, text string, weight int, score double").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for most, buckets, percent in ((1, 10_000, 10), (3, 50, 37)):
        got = importance.resample(frame, goal, most=most, buckets=buckets, percent=percent)
        assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
        rows = sorted((str(r.doc_id), r.n_features, r.weight, r.score, r["rank"]) for r in got.collect())
        assert rows == plain(docs, target, most, buckets, percent, 20)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    none = docs.limit(0)
    assert importance.resample(none, none).collect() == []
    assert [(r.n_features, r["rank"]) for r in importance.resample(docs, none, percent=100).collect()] == [(30, 1)]
    same = spark.createDataFrame([(1, "a " * 25)] * 10, "doc_id long, text string")
    assert sorted(r["rank"] or 0 for r in importance.resample(same, same, percent=50).collect()) == [0] * 5 + [1, 2, 3, 4, 5]
