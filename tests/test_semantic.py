"""Vector search by tiles against plain sums, with copies, zero vectors, nulls and two lengths."""

import math

import pytest

from kinframe.operators import search


def plain(rows, queries, k):
    out = {}
    for query, q in queries:
        if q is None or None in q:
            continue
        scored = []
        for i, v in rows:
            if v is None or None in v or len(v) != len(q):
                continue
            dot = a = b = 0.0
            for x, y in zip(q, v):
                dot, a, b = dot + x * y, a + x * x, b + y * y
            c = max(-1.0, min(1.0, dot / math.sqrt(a * b))) if a and b else math.nan
            scored.append((-math.inf if math.isnan(c) else -c, i, c))
        out[query] = [i for _, i, _ in sorted(scored)[:k]]
    return {q: ids for q, ids in out.items() if ids}


@pytest.mark.parametrize("block, stripe", [(8192, 16_384), (7, 40)])
def test_topk_by_tiles(spark, block, stripe):
    rows = [(i, [math.sin(i * 7 + d) for d in range(6)]) for i in range(150)] + [(1000 - i, [0.1, 0.2, 0.7, 0.3, 0.5, 0.9]) for i in range(60)]
    rows += [(2000, [0.0] * 6), (2001, None), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [1.0, 2.0]), (2004, [0.2, 0.4, 1.4, 0.6, 1.0, 1.8])]
    queries = [r for r in rows if r[0] % 5 == 0 or r[0] > 1000]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame(queries, "query_id long, vector array<double>")
    got = {}
    out = search.semantic_topk(frame, asked, 4, block=block, stripe=stripe)
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r.place)):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == plain(rows, queries, 4)
