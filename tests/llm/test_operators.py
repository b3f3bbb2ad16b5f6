"""Small cases and brute force for the operators of kinframe.llm."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinframe.llm import bpe, chat_format, common, decontamination, embedding_dedup, jaccard_join, language_id, line_dedup, quality, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (7, 7), (21, 22), (22, 23), (23, 20)], "a long, b long")
    got = {r.node: r.component for r in common.connected_components(edges).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20, 22: 20, 23: 20}
    assert common.connected_components(edges.limit(0)).count() == 0


def test_line_dedup(spark):
    rows = [(1, "A long Line here\nshort\n  a LONG line here\t"), (2, "a long line here\nown line of two\nshort"), (3, None), (4, ""), (None, "a long line here"), (5, "a long line here\n\nÉcole longue ligne"), (6, "école longue ligne")]
    got = {r.doc_id: (r.lines, r.dropped, r.text) for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert got[1] == (3, 0, rows[0][1])
    assert got[2] == (3, 1, "own line of two\nshort")
    assert got[3] == got[4] == (1, 0, "")
    assert got[None] == (1, 0, "a long line here")
    assert got[5] == (3, 1, "\nÉcole longue ligne") and got[6][1] == 0
    again = line_dedup.dedup_lines(docs_of(spark, [(1, "same line twice"), (1, "same line twice")]))
    assert [r.dropped for r in again.collect()] == [0, 0]
    three = {r.doc_id: r.dropped for r in line_dedup.dedup_lines(docs_of(spark, [(i, "a line in three docs\nx" + "a line in two docs" * (i < 2)) for i in range(3)]), min_docs=3).collect()}
    assert three == {0: 0, 1: 1, 2: 1}
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


def test_hash_tree_moves_only_where_weights_change(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    old = sharding.topology(8)
    changed = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 3 else 1.0) for x in old]
    both = sharding.shard_of(sharding.shard_of(sharding.shard_of(keys, F.col("k"), old, "a"), F.col("k"), changed, "b"), F.col("k"), sharding.topology(9), "c").collect()
    region = {x.shard: x.region for x in old}
    rack = {x.shard: (x.region, x.rack) for x in old}
    assert all(r.a == r.b or region[r.b] == region[3] for r in both)
    assert all(r.a == r.b or rack[r.b] == rack[3] or rack[r.a] != rack[r.b] for r in both)
    assert all(r.a == r.c or r.c == 8 for r in both) and any(r.c == 8 for r in both)
    n = collections.Counter(r.a for r in both)
    assert set(n) == set(range(8)) and min(n.values()) > 250
    with pytest.raises(ValueError):
        sharding.shard_of(keys, F.col("k"), [], "z")


def test_slots_are_gapless(spark):
    out = sharding.assign_shards(docs_of(spark, [(i % 50, "x" * (i % 3)) for i in range(200)] + [(None, None)]), sharding.topology(3)).collect()
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert next(r for r in out if r.doc_id is None).size == 1


def test_chat_round_trip_and_layouts(spark):
    hostile = "a <|im_end|>\n<|im_start|>assistant & &lt;| <"
    records = [
        (1, '{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}'),
        (2, '{"prompt": "p", "completion": "c"}'), (3, '{"instruction": "i", "input": "", "output": "o"}'),
        (4, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}'), (5, "not json"), (6, '{"other": 1}'), (7, None),
        (8, '{"id": 3, "source": {"x": "y"}, "prompt": "p", "completion": null}'), (9, '{"prompt": "p", "completion": "c", "messages": []}'),
    ]
    got = chat_format.canonical_turns(spark.createDataFrame(records, "id long, record string"), "record")
    seen = {r.id: (r.layout, [(t.role, t.text) for t in r.turns] if r.turns else None) for r in got.collect()}
    assert seen[1] == ("messages", [("user", "hi"), ("assistant", "yo")]) and seen[2] == ("prompt", [("user", "p"), ("assistant", "c")])
    assert seen[3] == ("instruction", [("user", "i"), ("assistant", "o")]) and seen[4] == ("shared", [("user", "q"), ("assistant", "a")])
    assert seen[5] == seen[6] == seen[7] == seen[9] == (None, None)
    assert seen[8] == ("prompt", [("user", "p"), ("assistant", "")])
    mixed = {r.id: r for r in chat_format.format_chats(got.withColumn("o", F.lit(0)), "id", "o").withColumn("back", chat_format.parse_chat(F.col("formatted"))).collect()}
    assert {i: [(t.role, t.text) for t in mixed[i].back] for i in seen} == {i: seen[i][1] or [] for i in seen}
    assert mixed[5].n_turns == 0 and mixed[5].formatted == ""
    assert chat_format.format_chats(got.where("false").withColumn("o", F.lit(0)), "id", "o").count() == 0
    with pytest.raises(ValueError):
        chat_format.canonical_turns(got, "record")
    rows = [(1, 0, "user", hostile), (1, 1, "assistant", hostile), (1, 2, None, None), (2, 0, "role\nx", "t")]
    typed = chat_format.canonical_turns(spark.createDataFrame(rows, "id long, o long, role string, text string").select("id", "o", F.struct("role", "text").alias("r")), "r")
    chats = chat_format.format_chats(typed, "id", "o").withColumn("back", chat_format.parse_chat(F.col("formatted")))
    out = {r.id: r for r in chats.collect()}
    assert [(t.role, t.text) for t in out[1].back] == [("user", hostile), ("assistant", hostile), ("", "")]
    assert [(t.role, t.text) for t in out[2].back] == [("role\nx", "t")]
    assert "".join(s.piece for s in out[1].segments) == out[1].formatted and [s.piece for s in out[1].segments if s.loss] == [hostile.replace("&", "&amp;").replace("<|", "&lt;|")]


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    import tiktoken

    tokens = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    r = random.Random(4)
    texts = [None, "", " ", "a" * 3000, "é中\U0001f600" * 30] + ["".join(r.choice("ab éñthe  \n\t'sll12|") for _ in range(r.choice((3, 60, 500)))) for _ in range(60)]
    df = docs_of(spark, list(enumerate(texts)) + [(None, "x"), (1, "y")])
    rows = bpe.encode_documents(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    for i, t in enumerate(texts):
        row = next(x for x in rows if x.doc_id == i and bytes(x.decoded) != b"y")
        assert list(row.ids) == own.encode_ordinary(t or "") and bytes(row.decoded) == (t or "").encode()
    assert len(rows) == len(texts) + 2


def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, n, percent):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, base = [], [[word() for _ in range(k)] for k in (4, 11, 40, 120, 300)]
    for b in base:
        for edits in (0, 0, 1, 1, 2, 3, 5, 8) * 3:
            w = list(b)
            for _ in range(edits):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "two words"), (906, "É e"), (907, "é e")]
    df = docs_of(spark, rows).withColumn("n", F.lit(1)).withColumn("key", F.lit(2))
    for block, rounds in ((500, 1), (3, 0)):
        got = {x.doc_id: (x.n_shingles, x.component) for x in jaccard_join.similar_components(df, n, percent, block=block, leader_rounds=rounds).collect()}
        assert got == brute_components(rows, n, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_enough_keys(percent):
    r = np.random.default_rng(1)
    for _ in range(1500):
        small = int(np.exp(r.uniform(0, 7.5)))
        large = int(small * r.uniform(1, 100 / percent))
        both = -(-percent * (small + large) // (100 + percent))  # the least that makes the two similar
        if both <= small:
            h = jaccard_join._scramble(r.integers(1, 2**63, size=small + large - both).astype(np.uint64))
            a, b = np.sort(h[:small]), np.sort(np.concatenate((h[:both], h[small:])))
            shared = np.intersect1d(jaccard_join.join_keys(a, percent), jaccard_join.join_keys(b, percent))
            assert jaccard_join.similar(a, b, percent)
            assert len(shared) >= jaccard_join.shape(jaccard_join.band(len(a), percent), percent)[1]


def test_short_sketches_bound_the_difference():
    r = np.random.default_rng(2)
    h = r.integers(1, 2**63, size=4000).astype(np.uint64)
    long, other, small = h[:3000], h[100:3050], h[:2400]
    bits = [np.array(jaccard_join.short_sketch(x)).view(np.uint64) for x in (long, other, small)]
    assert [len(x) for x in bits] == [512, 512, 32]
    assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= 150
    assert np.bitwise_count(jaccard_join.folded(bits[0]) ^ jaccard_join.folded(bits[2])).sum() <= 600
    assert (jaccard_join.folded(np.stack(bits[:2]))[0] == jaccard_join.folded(bits[0])).all()


def test_words_have_hashes_of_their_own():
    r, seen = random.Random(5), {}
    texts = ["".join(r.choice("abA é\x00\t\x0b\x1c\u2003") for _ in range(r.choice((1, 5, 40, 200)))) for _ in range(1000)] + ["z" * k + " y" for k in range(1, 200)] + ["", " ", "\n\t"]
    for text in texts:
        words, hashes = text.encode().lower().split(), jaccard_join.word_hashes(text.encode().lower()).tolist()
        assert len(words) == len(hashes)
        assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes))
    assert len(seen) == len(set(seen.values()))


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.similar_components(docs_of(spark, [])).count() == 0
    got = {x.doc_id: (x.n_shingles, x.component) for x in jaccard_join.similar_components(docs_of(spark, [(None, "a b c"), (1, None)])).collect()}
    assert got == {None: (1, None), 1: (0, 1)}


def test_jaccard_join_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (7, a + " more"), (2, b + " more"), (9, c), (9, c), (4, None), (4, c + " x"), (None, a)]
    got = collections.defaultdict(set)
    for x in jaccard_join.similar_components(docs_of(spark, rows)).collect():
        got[x.doc_id].add((x.n_shingles, x.component))
    assert got == {5: {(36, 2)}, 7: {(37, 2)}, 2: {(37, 2)}, 9: {(36, 4)}, 4: {(0, 4), (37, 4)}, None: {(36, None)}}


def test_jaccard_join_of_long_texts_and_keys_that_many_hold(spark, monkeypatch):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(5))
    rows = []
    for size in (2480, 2600, 5000):  # about the limit beyond which short sketches are larger
        base = [word() for _ in range(size)]
        for edits in (0, 10, 30, 60, 90):
            w = list(base)
            for k in r.sample(range(size), edits):
                w[k] = word()
            rows.append((len(rows), " ".join(w)))
    crowd = [word() for _ in range(30)]
    for k in range(60):  # near copies of one text, in groups that are not alike
        w = crowd[:22] + [word() for _ in range(8)] if k % 3 else list(crowd)
        w[r.randrange(len(w))] = word()
        rows.append((len(rows), " ".join(w)))
    monkeypatch.setattr(jaccard_join, "HEAVY", 5)
    monkeypatch.setattr(jaccard_join, "FIRST_KEYS", 3)  # many pairs share none of these
    got = {x.doc_id: (x.n_shingles, x.component) for x in jaccard_join.similar_components(docs_of(spark, rows), 5, 80).collect()}
    assert got == brute_components(rows, 5, 80)


def test_embedding_links(spark):
    r = np.random.default_rng(3)
    rows, base = [], r.normal(size=(12, 16))
    for k in range(400):
        v = base[k % 12] + r.normal(size=16) * (0.02 if k % 5 else 0.12)
        rows.append((k, [float(x) for x in v], k % 3))
    rows += [(1000 + k, rows[0][1], 0) for k in range(30)] + [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, rows[0][1], None), (2004, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: x for x in embedding_dedup.near_duplicates(df, leaf=40, block=25).collect()}
    links, up = collections.Counter(), {i: i for i in got}
    sound = [(i, np.array(v), g) for i, v, g in rows if i < 2000]

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, v, g) in enumerate(sound):
        for j, w, q in sound[a + 1 :]:
            if g == q and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links.update((i, j))
                k, m = root(i), root(j)
                up[max(k, m)] = min(k, m)
    assert sum(x.n_links for x in got.values()) >= 0.97 * sum(links.values())
    assert all(got[i].n_links <= links[i] for i in got)
    assert all(got[i].n_links == 0 and got[i].component == i for i in range(2000, 2005))
    assert {i: got[i].component for i in got} == {i: root(i) for i in got}
    assert all(x.kept == (x.component == i) for i, x in got.items())
    assert got[1005].component == 0 and not got[1005].kept and got[0].kept
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_sample_is_bounded_over_all_labels(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = []
    for g in range(30):
        centre = r.normal(size=12) * (g % 2)
        for k in range(60):
            v = centre + r.normal(size=12) if k % 2 == 0 else v + r.normal(size=12) * 0.03
            rows.append((g * 60 + k, [float(x) for x in v], f"label {g}"))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {x.vec_id: x.n_links for x in embedding_dedup.near_duplicates(df, leaf=20, block=15, sample_rows=50, most_sample_rows=60).collect()}
    monkeypatch.setattr(embedding_dedup, "FEW_GROUPS", 3)  # the table of groups is joined
    assert got == {x.vec_id: x.n_links for x in embedding_dedup.near_duplicates(df, leaf=20, block=15, sample_rows=50, most_sample_rows=60).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    alike = (x @ x.T >= 0.98) & (np.arange(1800)[:, None] // 60 == np.arange(1800) // 60)
    want = alike.sum(axis=1) - 1
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.97 * want.sum() > 0


def test_decontamination(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(k)) + ". " + " ".join(word() for _ in range(6)) + ".") for i, k in enumerate((12, 25, 35, 110))] + [(50, None), (51, "")]
    noise = lambda k: " ".join(word() for _ in range(k))
    rows = [(i, noise(30) + " " + items[i][1].upper() + " " + noise(90)) for i in range(4)]
    near = items[2][1].split()
    for k in range(0, len(near) - 8, 5):
        near[k] = word()
    rows += [(10, noise(50) + " " + " ".join(near)), (11, noise(300)), (12, None), (13, ""), (14, " ".join(items[1][1].split()[:8]) + noise(80))]
    docs = docs_of(spark, rows).withColumn("extra", F.lit(1))
    out = decontamination.mark_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: [h.item for h in r.contaminated_by] for r in out.collect()} == {0: [0], 1: [1], 2: [2], 3: [3], 10: [2], 11: [], 12: [], 13: [], 14: []}
    assert out.columns == ["doc_id", "text", "extra", "contaminated_by"]
    none = decontamination.mark_contaminated(docs, spark.createDataFrame([], "item_id long, text string"))
    assert all(not r.contaminated_by for r in none.collect())
    with pytest.raises(ValueError):
        decontamination.mark_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), out_col="extra")


def contaminated_by_brute_force(items, text):
    """Every window against every passage, without the latent space; plain LCS."""
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    words, found = decontamination.words(text or ""), set()
    for item, body, weight in items:
        parts = decontamination.passages(decontamination.words(body))
        best = {}
        for k, p in enumerate(parts):
            answer = decontamination.answer_words(body) if len(parts) == 1 else frozenset(p)
            size = decontamination.span(len(p)) * decontamination.STRIDE
            for at in range(0, max(1, len(words)), decontamination.STRIDE):
                window = words[at : at + size]
                share = lcs(p, window) / len(p)
                got = sum(weight(w) for w in answer & set(window)) / sum(map(weight, sorted(answer)))
                if share >= 0.8 or (share >= 0.55 and got >= 0.5):
                    best[k] = max(best.get(k, 0), share)
        if best and (2 * len(best) >= len(parts) or max(best.values()) >= 0.95):
            found.add(item)
    return found


def test_decontamination_judges_each_window(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    body, answer = [word() for _ in range(24)], [word() for _ in range(6)]
    item = " ".join(body) + ". " + " ".join(answer) + "."
    noise = lambda k: [word() for _ in range(k)]
    loose = body[:20] + noise(10)  # two thirds of the item, nothing of its answer
    close = body[:12] + noise(12) + answer  # six tenths, and all of the answer
    docs = docs_of(spark, [(0, " ".join(close)), (1, " ".join(loose)), (2, " ".join(loose + noise(100) + close)), *((k, " ".join(noise(60))) for k in range(3, 200))])
    out = decontamination.mark_contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert {r.doc_id: [h.item for h in r.contaminated_by] for r in out.collect() if r.doc_id < 3 or r.contaminated_by} == {0: [7], 1: [], 2: [7]}


def test_decontamination_finds_what_every_window_shows(spark):
    d, r = "/root/testdata/sf0.01", random.Random(3)
    benchmark = spark.read.parquet(f"{d}/benchmark.parquet").where("text is not null").select(F.col("item_id").cast("long"), "text")
    items = [tuple(x) for x in benchmark.collect()]
    texts = [x.text for x in spark.read.parquet(f"{d}/documents.parquet").where("length(text) < 3000").orderBy("doc_id").limit(60).collect()]
    rows = []
    for k in range(120):  # items with words changed, moved into other texts
        w = items[k * 7 % len(items)][1].split()
        for _ in range(r.randrange(len(w) // 2)):
            w[r.randrange(len(w))] = r.choice(texts[k % len(texts)].split() or ["x"])
        rows.append((k, f"{texts[k % len(texts)][:1500]} {' '.join(w)} {texts[(k + 1) % len(texts)][:500]}"))
    docs = docs_of(spark, rows + [(900, None), (901, "")])
    seen = collections.Counter(w for _, t in rows for w in set(decontamination.words(t)))
    weight = lambda w: np.log((len(rows) + 3) / (seen[w] + 1.0)) ** 1.5 + 1e-3
    want = {(i, x) for i, t in rows for x in contaminated_by_brute_force([(n, b, weight) for n, b in items], t)}
    for block in (1000, len(items) // 2):  # one block, and several that meet the texts by hash
        marked = decontamination.mark_contaminated(docs.withColumn("hits", F.lit(1)), benchmark, block_items=block)
        assert marked.columns == ["doc_id", "text", "hits", "contaminated_by"] and marked.count() == len(rows) + 2
        got = {(x.doc_id, h.item) for x in marked.collect() for h in x.contaminated_by}
        assert got <= want and len(got) >= 0.95 * len(want) > 60, (block, len(got), len(want), len(got & want))


def test_svd_finds_the_leading_space(spark):
    r = np.random.default_rng(1)
    a = r.normal(size=(60, 3)) @ r.normal(size=(3, 40)) + 0.01 * r.normal(size=(60, 40))
    rows = spark.createDataFrame([(list(range(40)), row.tolist()) for row in a], "terms array<int>, weights array<double>")
    v, s = decontamination.randomised_svd(rows, 40, 3)
    assert np.allclose(s, np.linalg.svd(a)[1][:3], rtol=1e-3)


def table(spark, sf="sf0.01"):
    d = f"/root/testdata/{sf}"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), d


def test_language_accuracy_held_out(spark):
    docs, _, d = table(spark)
    out = language_id.op2_language_id(spark, d).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    model = language_id.train(docs.limit(0))
    assert model is None
    odd = language_id.predict_languages(docs_of(spark, [(1, None), (2, "12 !"), (3, "")]), None).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in odd)


def test_toxicity_finds_planted_sentences(spark):
    clean = [(i, f"a calm day in town number{i % 7}. Nothing else to say here. The end of it") for i in range(200)]
    bad = [(1000 + i, f"a calm day in town number{i % 7}. You {('vilebad', 'vilebadly')[i % 2]} thing. The end of it") for i in range(60)]
    docs = docs_of(spark, clean + bad)
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _ in clean + bad], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs_of(spark, [(1, "A calm day. You vilebaddest one. The end"), (2, "a calm day"), (3, None), (4, "!!")]), model).collect()}
    assert out[1].score >= 0.5 and out[2].score < 0.5 and out[3].score == out[4].score == 0
    s = out[1].sentences[0]
    assert len(out[1].sentences) == 1 and "vilebaddest" in "A calm day. You vilebaddest one. The end"[s.start : s.end]
    assert toxicity.train(docs, labels.where("toxic = 0")) is None


def test_quality_orders_grades(spark):
    rows = [(i, ("good plain words of prose here " * 3 if i % 3 == 2 else "good plain BUT!! words|| of " * 3 if i % 3 == 1 else "THE!! OF!! AND!! | || " * 5) + f"w{i}") for i in range(150)]
    docs, grades = docs_of(spark, rows), spark.createDataFrame([(i, i % 3) for i in range(150)], "doc_id long, grade int")
    model = quality.train(docs, grades, 3)
    out = {r.doc_id: r.expected_grade for r in quality.score_quality(docs, model, 3).collect()}
    mean = [np.mean([v for k, v in out.items() if k % 3 == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2] and model.thresholds[0] < model.thresholds[1]
    assert quality.score_quality(docs_of(spark, [(1, None), (2, " ")]), model, 3).agg(F.sum("expected_grade")).first()[0] == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs, _, d = table(spark, "sf0.001")
    odd = spark.createDataFrame([(90001, None, None, None, None), (90002, "123", "en", "s", 3)], DOCS)
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        docs = spark.createDataFrame(out.collect(), out.schema)
    ids = {r.doc_id for r in docs.collect()}
    assert not ids & {90001, 90002} and len(ids) > 150
    last = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in last)


def test_languages_by_a_plain_convolution(spark):
    docs, _, _ = table(spark)
    model = language_id.train(docs)
    texts = [x.text for x in docs.where("length(text) < 1500").orderBy("doc_id").limit(12).collect()] + ["É", "x" * 700, "word " * 3000]
    got = {x.doc_id: x for x in language_id.predict_languages(docs_of(spark, [*enumerate(texts), (3, texts[3]), (50, "é 12"), (51, None)]), model).collect()}
    for i, t in enumerate(texts):
        raw, total = t.lower().encode(), np.zeros(len(model.langs))
        for at in range(0, len(raw), language_id.WINDOW):
            piece = raw[at : at + language_id.WINDOW]
            e = model.embed[np.frombuffer(piece.ljust(language_id.WINDOW, b"\0"), np.uint8)]
            pooled = [max(float(e[j : j + k].ravel() @ w[:, f]) for j in range(len(e) - k + 1)) for k, w in zip(language_id.WIDTHS, model.filters) for f in range(language_id.FILTERS)] if len(raw) < 1500 else None
            if pooled is None:
                break
            z = np.maximum(pooled, 0) @ model.out + model.bias
            total += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * len(piece)
        else:
            assert got[i].lang_pred == model.langs[int(total.argmax())] and abs(got[i].score - total.max() / len(raw)) < 1e-3
    assert got[51].lang_pred == "und" and 0 <= got[len(texts) - 1].score <= 1


def test_toxicity_by_a_plain_noisy_or(spark):
    docs, labels, _ = table(spark)
    model = toxicity.train(docs, labels)
    texts = [x.text for x in docs.where("length(text) < 4000").orderBy("doc_id").limit(30).collect()] + ["One. Two! Three\nfour", "a" * 50_000, "x. " * 5000]
    got = {x.doc_id: x for x in toxicity.score_toxicity(docs_of(spark, [*enumerate(texts), (0, texts[0])]), model).collect()}
    for i, t in enumerate(texts):
        clean = 1.0
        for sentence in __import__("re").split(r"[.!?\n]", t):
            found = {w for w in toxicity._word(sentence.lower())}
            if found:
                z = model.bias + sum(float(model.weights.astype(np.float32)[b]) for w in found for b in toxicity.grams(w))
                clean *= 1 - 1 / (1 + np.exp(-z))
        assert abs(got[i].score - (1 - clean)) < 1e-4
    assert toxicity.score_toxicity(docs_of(spark, []), model).count() == 0


def test_quality_by_plain_tails(spark):
    docs, labels, _ = table(spark)
    model = quality.train(docs, labels.select("doc_id", F.col("quality").alias("grade")), 2)
    texts = [x.text for x in docs.where("length(text) < 4000").orderBy("doc_id").limit(30).collect()] + ["again again again", "B" * 30_000]
    got = {x.doc_id: x for x in quality.score_quality(docs_of(spark, [*enumerate(texts), (0, texts[0])]), model, 2).collect()}
    weights = model.weights.astype(np.float32)
    for i, t in enumerate(texts):
        words = t.split()
        both = [quality.buckets(w) for w in words]
        counts, shapes = collections.Counter(b >> 32 for b in both), collections.Counter(b & 0xFFFFFFFF for b in both)
        a, b = np.sqrt(sum(np.log1p(n) ** 2 for n in counts.values())), np.sqrt(sum((n / len(words)) ** 2 for n in shapes.values()))
        z = sum(float(weights[k]) * 0.5 * np.log1p(n) / a for k, n in counts.items()) + sum(float(weights[k]) * n / len(words) / b for k, n in shapes.items())
        equal = sum(x >> 32 == y >> 32 for x, y in zip(both, both[1:])) / max(1, len(words) - 1)
        z += float(weights[0]) * min(1.0, 4 * equal) + float(weights[1]) * len(counts) / len(words)
        assert abs(got[i].tails[0] - 1 / (1 + np.exp(model.thresholds[0] - z))) < 1e-3 and abs(got[i].expected_grade - got[i].tails[0]) < 1e-9
    assert quality.score_quality(docs_of(spark, []), model, 2).count() == 0


def test_kept_columns_that_clash_are_refused(spark):
    docs = docs_of(spark, [(1, "x")]).withColumns({c: F.lit(1) for c in ("score", "sentences", "tails", "lang_pred", "lines")})
    for call in (
        lambda k: line_dedup.dedup_lines(docs, keep=(k,)), lambda k: language_id.predict_languages(docs, None, keep=(k,)),
        lambda k: toxicity.score_toxicity(docs, None, keep=(k,)), lambda k: quality.score_quality(docs, None, 2, keep=(k,)),
    ):
        refused = 0
        for k in ("score", "sentences", "tails", "lang_pred", "lines"):
            try:
                call(k)
            except ValueError:
                refused += 1
        assert refused in (1, 2)
        with pytest.raises(ValueError):
            call("absent")


def test_empty_tables(spark):
    import public_tokenizers

    none = docs_of(spark, [])
    assert language_id.predict_languages(none, None).count() == 0
    assert sharding.assign_shards(none, sharding.topology(2)).count() == 0
    assert bpe.encode_documents(none, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    assert decontamination.mark_contaminated(none, spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")).count() == 0


def test_pipeline_run_and_what_its_first_stage_rejects(spark, tmp_path):
    import corpus_pipeline

    docs, _, d = table(spark, "sf0.001")
    of = lambda lang: docs.where(F.col("lang") == lang).orderBy("doc_id").limit(6).collect()
    mixture = " ".join(x.text[:256].ljust(256) for k in range(6) for x in (of("en")[k], of("de")[k], of("es")[k], of("fr")[k]))
    odd = spark.createDataFrame([(90001, mixture, "en", "s", 1), (90002, None, None, None, None), (None, docs.first().text, None, "s", 3), (1, docs.first().text, "en", "s", 2)], DOCS)
    more = docs.unionByName(odd).withColumn("extra", F.lit(1))
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, more, d).collect()}
    model = language_id.train(more.where(language_id.fold("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    told = {r.doc_id: r for r in language_id.predict_languages(more, model).collect()}
    assert kept == {i for i, r in told.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    assert 90001 not in kept and 0 < told[90001].score < corpus_pipeline.LEAST_SCORE and None in kept and len(kept) > 190
    for name, stage in corpus_pipeline.STAGES:  # of nothing comes nothing
        assert stage(spark, more.limit(0), d).count() == 0, name
    for name in ("benchmark", "documents"):
        spark.read.parquet(f"{d}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 150


def test_toxicity_sample_stays_small_in_the_driver(spark, monkeypatch):
    import tracemalloc

    sentence = F.concat_ws(" ", *(F.concat(F.lit(f"word{i}x"), ((F.col("doc_id") + i) % 9).cast("string")) for i in range(25)))
    docs = spark.range(1200).withColumnRenamed("id", "doc_id").select("doc_id", F.repeat(F.concat(sentence, F.lit(". ")), 35).alias("text")).localCheckpoint()
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    fitted = {}
    monkeypatch.setattr(toxicity.NoisyOr, "fit", lambda self, words, coded, y: fitted.update(words=words, coded=coded, y=y) or self)
    tracemalloc.start()
    toxicity.train(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(fitted["coded"]) == 1200 and sum(len(i) for i, _ in fitted["coded"]) == 1200 * 35 * 25 and fitted["y"].sum() == 300
    assert len(fitted["words"]) == 225 and fitted["words"] == sorted(fitted["words"])
    assert peak < 40 << 20
