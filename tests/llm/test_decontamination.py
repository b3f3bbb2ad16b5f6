"""Items that share an id, and several blocks of items."""

import random

from kinframe.llm import common, decontamination

DRAW = random.Random(8)
WORDS = ["".join(DRAW.choice("abcdefghij") for _ in range(DRAW.randrange(3, 8))) for _ in range(900)]


def text(n):
    return " ".join(DRAW.choice(WORDS) for _ in range(n))


def found(spark, docs, items, **kw):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    rows = decontamination.mark_contaminated(df, spark.createDataFrame(items, "item_id long, text string"), sample_docs=50, **kw).collect()
    return {r.doc_id: sorted(x["item"] for x in r.contaminated_by) for r in rows}


def loose(passage):
    w = passage.split(" ")
    return " ".join(x for k, x in enumerate(w) if k % 10)  # nine words of ten


def test_texts_of_one_item_are_told_apart(spark):
    long, short = text(250), text(20)
    docs = [text(60) + " " + loose(" ".join(long.split(" ")[:41])) + " " + text(60), text(40) + " " + long + " " + text(10), text(50) + " " + short, text(80)] + [text(100) for _ in range(30)]
    alone, both = found(spark, docs, [(7, long)]), found(spark, docs, [(7, long), (7, short)])
    assert alone[0] == [] and both[0] == []  # one loose passage of six is not the item, whatever else has its id
    assert both[1] == [7] == both[2] and alone[2] == [] and both[3] == []
    assert found(spark, docs, [(7, long), (7, short), (7, short)], block_items=1) == both


def test_blocks_find_what_one_block_finds(spark):
    items = [(k, text(DRAW.choice([15, 30, 90, 160]))) for k in range(24)]
    docs = [text(30) + " " + t + " " + text(30) for _, t in items[:12]] + [items[3][1] + " " + items[20][1], None, ""] + [text(120) for _ in range(30)]
    want = {k: [k] for k in range(12)} | {12: [3, 20]}
    for blocks in (1000, 5):
        got = found(spark, docs, items, block_items=blocks)
        assert {k: v for k, v in got.items() if v} == want


def test_sizes_of_settings(spark):
    assert [common._bytes(x) for x in ("8m", "64kb", "4096", "10b", "-1", "1g")] == [8 << 20, 64 << 10, 4096, 10, -1, 1 << 30]
    key, was = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.set(key, "8m")
        common.python_batches(spark)
        assert spark.conf.get(key) in ("8m", str(8 << 20), f"{8 << 20}b")
        spark.conf.set(key, "1g")
        common.python_batches(spark)
        assert common._bytes(spark.conf.get(key)) == common.ARROW_BYTES
    finally:
        spark.conf.set(key, was)
