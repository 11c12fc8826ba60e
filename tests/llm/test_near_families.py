"""Families of edited texts in the near-copy stage: whole results, without a row for each pair."""

import random

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf

from tessera.llm import nearcopies, simhash
from tessera.session import durable


def families(sizes, edits, words=120):
    rnd = random.Random(5)
    out = []
    for f, size in enumerate(sizes):
        base = [f"f{f}w{i}" for i in range(words)]
        for _ in range(size):
            text = list(base)
            for at in rnd.sample(range(words), rnd.randint(*edits)):
                text[at] = f"x{rnd.randrange(10**9)}"
            out.append(" ".join(text))
    return out


def brute(texts):
    sets = {nearcopies.node_of(nearcopies.words_of(t)): nearcopies.shingle_set(t) for t in texts}
    nodes, root = sorted(sets), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if 9 * nearcopies.overlap(sets[a], sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                a_root, b_root = sorted((find(a), find(b)))
                root[b_root] = a_root
    return {x: find(x) for x in nodes}


def roots_and_most_rows(spark, texts, monkeypatch):
    counts, durable = [], nearcopies.durable

    def counting(df):
        out = durable(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(nearcopies, "durable", counting)
    found = {r["node"]: r["root"] for r in nearcopies.near_copy_roots(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    return found, max(counts)


def test_a_family_is_joined_without_a_row_a_pair(spark, monkeypatch):
    # two of the first differ in 8 words and share shingles, but not 0.8 of them; two of the others differ in 4
    texts = families([400], (4, 4), 240) + families([12], (2, 2), 240)
    found, most = roots_and_most_rows(spark, texts, monkeypatch)
    want = brute(texts)
    assert {x: found.get(x, x) for x in want} == want and 12 <= len(found) < len(want)
    assert most <= 40 * len(texts), most


def test_families_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 1500)  # a dozen texts
    texts = families([60, 25, 2, 1], (0, 5), 100) + families([30], (0, 4), 40) + ["", "one", "one two"]
    texts += [" ".join(f"long{i}" for i in range(n)) for n in (700, 840, 1000)]
    found, _ = roots_and_most_rows(spark, texts, monkeypatch)
    want = brute([t for t in texts if t])
    assert {x: found.get(x, x) for x in want} == want
    assert len(set(want.values())) < len(want)


def test_cells_are_dealt_in_turns(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 1500)
    monkeypatch.setattr(nearcopies, "ROOM", 1 << 15, raising=False)
    monkeypatch.setattr(nearcopies, "TURNS", 1 << 20, raising=False)
    moved, durable = [], nearcopies.durable
    now = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()

    def weighing(df):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        before, out = now(), durable(df)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        moved.append(now() - before)
        return out

    monkeypatch.setattr(nearcopies, "durable", weighing)
    texts = families([150], (3, 4), 170)
    found = {r["node"]: r["root"] for r in nearcopies.near_copy_roots(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    want = brute(texts)
    assert {x: found.get(x, x) for x in want} == want
    whole = sum(8 * len(nearcopies.shingle_set(t)) for t in texts)
    assert max(moved) < whole / 2, (whole, moved)


def test_cells_on_hand_made_sizes():
    n = np.array([10, 12, 13, 100, 125, 126])
    reach = {i: after.tolist() for i, after in nearcopies.windows(n, np.zeros(6, dtype=np.int64), 1, 1)}
    assert reach == {0: [1], 1: [2], 3: [4], 4: [5]}
    reach = {i: after.tolist() for i, after in nearcopies.windows(n, np.array([1, 2, 2, 1, 1, 2]), 1, 2)}
    assert reach == {0: [1], 4: [5]}


def test_meeting_postings(monkeypatch):
    rng = np.random.default_rng(3)
    key = np.sort(rng.integers(0, 150, 600))
    n, part = rng.integers(5, 60, 600), rng.integers(0, 40, 600)
    pos = rng.integers(0, 12, 600) % n

    def fits(i, j):
        return part[i] != part[j] and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]) and 9 * min(n[i] - pos[i], n[j] - pos[j]) >= 4 * (n[i] + n[j])

    want = np.array([any(key[i] == key[j] and fits(i, j) for j in range(600)) for i in range(600)])
    got = nearcopies.meeting(key, n, pos, part)
    assert want.any() and not want.all() and (got == want).all()
    monkeypatch.setattr(nearcopies, "CROWD", 4)
    assert (nearcopies.meeting(key, n, pos, part) >= want).all()


def test_a_pass_over_the_texts_makes_each_node_once(spark):
    texts = [f"text {i // 2}" for i in range(40)]
    made = spark.sparkContext.accumulator(0)

    @pandas_udf("long")
    def node(column: pd.Series) -> pd.Series:
        made.add(len(column))
        return column.str.len() * 100 + column.str.split().str[1].astype("int64")

    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    nodes = [(100 * len(t) + int(t.split()[1]),) * 2 for t in sorted(set(texts))]
    roots = durable(spark.createDataFrame([(node, nodes[0][1]) if node < 608 else (node, node) for node, _ in nodes], "node long, root long"))
    made.value = 0
    found = simhash.one_of_each(docs, node("text"), roots, "doc_id", "text").collect()
    assert sorted(r.doc_id for r in found) == [0, *range(16, 40, 2)]
    assert made.value == 2 * len(texts)  # once for the order of the rows and once for the rows themselves
