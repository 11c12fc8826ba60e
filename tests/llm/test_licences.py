"""Licence scans: labels and scores against a scan of every template at every place."""

import math
import re

import numpy as np

from tessera.llm import licences


def words_of(text):
    return re.findall(licences.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, base=licences.BASE, notices=licences.NOTICES, coverage=licences.COVERAGE):
    docs = [words_of(t) for t in texts]
    weight = {w: math.log(1 + (1 + len(docs)) / (1 + sum(w in d for d in docs))) for t in (*base, *notices) for w in t.words}
    out = []
    for d in docs:
        labels, score = set(), 0.0
        for t in base:
            if any(d[i : i + len(t.words)] == t.words for i in range(len(d))):
                labels.add(t.label)
                score = max(score, 0.5)
        for t in notices:
            whole = sum(weight[w] for w in t.words)
            for i in range(len(d) - len(t.words) + 1):
                part = d[i : i + len(t.words)]
                share = round(sum(weight[w] / whole for w, x in zip(t.words, part) if w == x), 6)
                if share >= coverage and all(f" {k} " in f" {' '.join(part)} " for k in t.keys):
                    labels.add(t.label)
                    score = max(score, share)
        out.append((",".join(sorted(labels)), score))
    return out


def test_labels_and_scores_equal_brute_force(spark):
    """Notices with any words altered, the rarest ones too, at any place of the text and more than once."""
    rng = np.random.default_rng(5)
    filler = ["the", "of", "software", "license", "copy", "under", "mit", "wow", "tea", "public"]
    texts = ["", None, "mit license", "the"]
    for t in licences.NOTICES * 6:
        words = list(t.words)
        for j in rng.choice(len(words), int(rng.integers(0, len(words) // 3 + 1)), replace=False):
            words[j] = "changed"
        around = [list(rng.choice(filler, int(rng.integers(0, 30)))) for _ in range(3)]
        texts.append(" ".join(around[0] + words + around[1] + (words if rng.random() < 0.3 else []) + around[2]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licences.scan_licences(df).collect()}
    want = brute(texts)
    assert sum(s > 0.5 for _, s in want) > 40 and sum(0.5 < s < 1 for _, s in want) > 15
    for i, (labels, score) in enumerate(want):
        assert got[i][0] == labels and abs(got[i][1] - score) < 2e-6


def test_a_notice_may_lack_its_rarest_words(spark):
    long = next(t for t in licences.NOTICES if len(t.words) > 25)
    gone = [w for w in long.words if w in ("redistribute", "modify", "published", "foundation", "program")][:4]
    text = " ".join("x" if w in gone and w not in "foundation" else w for w in long.words)
    row = licences.scan_licences(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.labels, row.score) == brute([text])[0] or abs(row.score - brute([text])[0][1]) < 2e-6
