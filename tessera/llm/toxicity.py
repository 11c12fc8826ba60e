"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and itself, hashed into a table of embeddings, so a misspelt or newly derived
word shares vectors with the words it comes from: a word's vector is the mean of its bag's. A text is the average of the
vectors of all its distinct words, and a linear softmax over that average gives its score. The average is weighted: each
bag entry has one more trained number, and the mean of a word's, raised to e, is the word's weight. So one insult in a
long text can outweigh its thousand plain words. Embeddings, weights and softmax get their gradients from the same loss.
As the softmax is linear, the model is for scoring two numbers a bucket: its logit and its weight's logarithm.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.llm.memo import claim
from tessera.session import durable, ship

#: Rows of each class that training uses at most, taken by hash of the id: the documented bound of the sample.
SAMPLE_ROWS = 3000
#: Characters of text that the driver holds for training at most; rows beyond it are left out in hash order.
SAMPLE_CHARS = 16_000_000
BUCKETS, DIM, NGRAMS = 1 << 16, 8, (3, 4, 5)
#: A word's weight is e to GATE times its bag's mean, between these powers. Words that a training step takes of a text:
#: those that weigh most just now and others at random, which stand for all the rest.
GATE, LEAST, MOST, TOP_WORDS, OTHER_WORDS = 4.0, -6.0, 12.0, 24, 40
#: Distinct words whose scores a worker remembers.
MEMO_WORDS = 120_000
#: Words of the driver's vocabulary whose n-grams are made in one pass.
RUN_WORDS = 8192


def words_of(text: str | None) -> list[str]:
    """Distinct lower-case words without the punctuation around them, in order of first occurrence.

    A word that is repeated a thousand times says no more than once.
    """
    return list(dict.fromkeys((x.strip(".,;:!?\"'()[]{}<>|*#&%$") or x) for x in (text or "").lower().split()))


def subwords(words: list[str], buckets: int = BUCKETS, ngrams: tuple[int, ...] = NGRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all n-grams of <word> and of the word itself, and where each word's ids start; all in one pass.

    The words stand in one array of code points; a rolling hash gives the n-grams at every place, and those that would
    cross a word's end are left out.
    """
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    joined = "".join([f"<{w}>" for w in words])
    a = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    start = np.cumsum(size) - size
    left = np.repeat(start + size, size) - np.arange(len(a))  # places to the word's end
    word = np.repeat(np.arange(len(words)), size)
    prime, mix = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    where, ids = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(a), dtype=np.uint64)
        for n in range(1, max(ngrams) + 1):
            h[: len(a) - n + 1] = h[: len(a) - n + 1] * prime + a[n - 1 :] + np.uint64(1)
            if n in ngrams:
                ok = left >= n
                where.append(word[ok])
                ids.append(h[ok] * mix + np.uint64(n))
        powers = np.cumprod(np.full(int(size.max()), prime, dtype=np.uint64))
        whole = np.add.reduceat(a * powers[np.arange(len(a)) - np.repeat(start, size)], start)
    where.append(np.arange(len(words)))
    ids.append(whole * mix)
    at = np.concatenate(where)
    order = np.argsort(at, kind="stable")
    flat = np.concatenate(ids)[order]
    flat = ((flat ^ (flat >> np.uint64(31))) * mix >> np.uint64(40)) % np.uint64(buckets)
    counts = np.bincount(at, minlength=len(words))
    return flat.astype(np.int64), np.cumsum(counts) - counts


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """subwords() of any number of words, RUN_WORDS at a time: a pass takes many times the memory of its result."""
    runs = []
    for i in range(0, max(1, len(words)), RUN_WORDS):
        ids, start = subwords(words[i : i + RUN_WORDS])
        runs.append((ids.astype(np.int32), np.diff(np.append(start, len(ids)))))
    size = np.concatenate([x for _, x in runs])
    return np.concatenate([x for x, _ in runs]), np.cumsum(size) - size


def means(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of the rows of x in each run that starts at start."""
    return np.add.reduceat(x, start, axis=0) / size[:, None] if len(start) else np.zeros((0, x.shape[1]))


@dataclass
class Model:
    """Logit and weight's logarithm of each bucket, and the bias."""

    buckets: np.ndarray
    bias: float

    def words(self, words: list[str]) -> np.ndarray:
        """Logit and weight of each word."""
        ids, start = subwords(words, len(self.buckets))
        out = means(self.buckets[ids].astype(np.float64), start, np.diff(np.append(start, len(ids))))
        out[:, 1] = np.exp(np.clip(out[:, 1], LEAST, MOST))
        return out

    def score(self, words: np.ndarray) -> float:
        """Of a text's words."""
        z = self.bias + (float(words[:, 0] @ words[:, 1] / words[:, 1].sum()) if len(words) else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def train(texts: list[str], labels: np.ndarray, epochs: int = 8, steps: int = 600, averaged: int = 4, rate: float = 0.5, seed: int = 0, batch: int = 32) -> Model:
    """Fit embeddings, weights and softmax jointly by Adagrad on the log loss of whole texts.

    A step takes the average of a text from its TOP_WORDS words of largest weight or logit so far and OTHER_WORDS random
    ones, which count for all others. There are epochs passes at least, and steps batches at least; the model is the mean
    of those after the last passes.
    """
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)), dtype=np.int64) for t in texts]
    ids, start = bags(list(vocabulary))
    size = np.diff(np.append(start, len(ids)))
    emb = rng.uniform(-1, 1, (BUCKETS, DIM + 1)) / DIM  # the last column makes the weight
    emb[:, DIM] = 0
    out, bias = rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
    g_emb, g_gate, g_out, g_bias = np.full(BUCKETS, 1e-6), np.full(BUCKETS, 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    labels = np.asarray(labels, dtype=np.int64)
    weight = (len(labels) / (2.0 * np.maximum(1, np.where(labels == 1, labels.sum(), (1 - labels).sum())))) ** 0.75

    def projected() -> np.ndarray:
        return np.stack([emb[:, :DIM] @ (out[:, 1] - out[:, 0]), emb[:, DIM] * GATE], axis=1)

    def pick(words: np.ndarray, salience: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Words of a text for a step, and how many words each stands for."""
        n = len(words)
        if n <= TOP_WORDS + OTHER_WORDS:
            return words, np.ones(n)
        if salience is None:
            return rng.choice(words, TOP_WORDS + OTHER_WORDS, replace=False), np.full(TOP_WORDS + OTHER_WORDS, n / (TOP_WORDS + OTHER_WORDS))
        order = np.argpartition(-salience[words], TOP_WORDS)
        taken = np.concatenate([words[order[:TOP_WORDS]], rng.choice(words[order[TOP_WORDS:]], OTHER_WORDS, replace=False)])
        return taken, np.repeat([1.0, (n - TOP_WORDS) / OTHER_WORDS], [TOP_WORDS, OTHER_WORDS])

    def step(parts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, importance: np.ndarray) -> None:
        nonlocal out, bias
        n = len(parts)
        word, stands = (np.concatenate(c) for c in zip(*parts))
        part = np.repeat(np.arange(n), [len(w) for w, _ in parts])
        of = size[word]
        first = np.cumsum(of) - of
        b = ids[np.repeat(start[word] - first, of) + np.arange(int(of.sum()))]
        v = means(emb[b], first, of)
        a = stands * np.exp(np.clip(v[:, DIM] * GATE, LEAST, MOST))
        share = a / np.bincount(part, a, minlength=n)[part]
        x = np.stack([np.bincount(part, share * v[:, k], minlength=n) for k in range(DIM)], axis=1)
        z = x @ out + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p *= importance[:, None]
        dx = (p @ out.T)[part]
        dv = np.concatenate([share[:, None] * dx, (GATE * share * ((v[:, :DIM] - x[part]) * dx).sum(axis=1))[:, None]], axis=1) / of[:, None]
        touched, inverse = np.unique(b, return_inverse=True)
        each = np.repeat(np.arange(len(word)), of)
        grad = np.stack([np.bincount(inverse, dv[each, k], minlength=len(touched)) for k in range(DIM + 1)], axis=1)
        g_emb[touched] += (grad[:, :DIM] ** 2).mean(axis=1)
        g_gate[touched] += grad[:, DIM] ** 2
        emb[touched, :DIM] -= rate * grad[:, :DIM] / np.sqrt(g_emb[touched])[:, None]
        emb[touched, DIM] -= 0.3 * rate * grad[:, DIM] / np.sqrt(g_gate[touched])
        d_out, d_bias = x.T @ p, p.sum(axis=0)
        np.add(g_out, d_out**2, out=g_out)
        np.add(g_bias, d_bias**2, out=g_bias)
        out = out - 0.3 * rate * d_out / np.sqrt(g_out)
        bias = bias - 0.3 * rate * d_bias / np.sqrt(g_bias)

    filled = [i for i, d in enumerate(docs) if len(d)]
    epochs = max(epochs, -(-steps * batch // max(1, len(filled))))
    found, shift = np.zeros((BUCKETS, 2)), 0.0
    for epoch in range(epochs):
        salience = None
        if epoch:
            table = projected()
            per_word = np.concatenate([means(table[ids[start[i] : start[i] + int(size[i : i + 5000].sum())]], start[i : i + 5000] - start[i], size[i : i + 5000]) for i in range(0, len(start), 5000)])
            salience = per_word[:, 1] + np.maximum(per_word[:, 0], 0)
        order = rng.permutation(filled)
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            step([pick(docs[i], salience) for i in rows], labels[rows], weight[rows])
        if epoch >= epochs - averaged:
            found += projected() / averaged
            shift += float(bias[1] - bias[0]) / averaged
    return Model(found.astype(np.float32), shift)


def held_out(ident: Column, folds: int = 5) -> Column:
    """True on the fold that no label is learnt from: crc32 of the id as text, remainder 0. A null id: false."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows that are not held out: at most SAMPLE_ROWS of each class and SAMPLE_CHARS, by hash of the id.

    Labels that are null or neither 0 nor 1, null ids and null texts teach nothing; an id with several labels takes its
    largest. With no labelled rows of both classes the model scores everything alike, by the share of label 1.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("tox_id")).agg(F.max(label_col).cast("int").alias("tox_label"))
    rank = F.xxhash64("tox_id")
    picked = known.where("tox_label = 1").orderBy(rank).limit(SAMPLE_ROWS).unionByName(known.where("tox_label = 0").orderBy(rank).limit(SAMPLE_ROWS))
    rows = (
        documents.select(F.col(id_col).alias("doc_key"), F.col(text_col).alias("doc_text"))
        .where(F.col("doc_text").isNotNull())
        .join(F.broadcast(picked), F.col("doc_key") == F.col("tox_id"))  # 2 x SAMPLE_ROWS rows at most
        .select("doc_key", "doc_text", "tox_label")
    )
    rows = durable(rows)  # the table is read once for the fit
    texts, ys, held = [], [], 0
    sizes = rows.select("doc_key", F.length("doc_text").alias("n")).toPandas()
    sizes = sizes.assign(h=sizes.doc_key.astype("int64") * 2654435761 % (1 << 32)).sort_values(["h", "doc_key", "n"])
    allowed = set(sizes.doc_key[sizes.n.cumsum() <= SAMPLE_CHARS].tolist())
    for r in rows.toLocalIterator():
        if r.doc_key in allowed and held < 2 * SAMPLE_CHARS:
            texts.append((r.doc_key, r.doc_text, r.tox_label))
            held += len(r.doc_text)
    texts.sort()
    ys = np.array([y for _, _, y in texts], dtype=np.int64)
    if not len(ys) or ys.min() == ys.max():
        share = min(max(float(ys.mean()) if len(ys) else 0.0, 0.01), 0.99)
        return Model(np.zeros((BUCKETS, 2), dtype=np.float32), float(np.log(share / (1 - share))))
    return train([t for _, t, _ in texts], ys)


_memo: dict[str, dict[str, complex]] = {}  # logit and weight in one number, which takes a third of a pair's memory


def score_texts(model: Model, token: str, texts: list[str | None]) -> np.ndarray:
    """Scores of whole texts. Words' logits and weights are remembered in the worker, MEMO_WORDS of them at most, under token."""
    claim("toxicity", _memo.clear)
    if token not in _memo:
        _memo.clear()
        _memo[token] = {}
    memo, out = _memo[token], np.empty(len(texts))
    for at in range(0, len(texts), 256):
        split = [words_of(t) for t in texts[at : at + 256]]
        fresh = list({w for ws in split for w in ws if w not in memo})
        if len(memo) + len(fresh) > MEMO_WORDS:
            memo.clear()
            fresh = list({w for ws in split for w in ws})
        for i in range(0, len(fresh), 4096):
            part = fresh[i : i + 4096]
            memo.update(zip(part, model.words(part).view(np.complex128)[:, 0].tolist()))
        for i, ws in enumerate(split):
            out[at + i] = model.score(np.fromiter(map(memo.__getitem__, ws), dtype=np.complex128, count=len(ws)).view(np.float64).reshape(-1, 2))
    return out


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """Score from 0 to 1 of each whole text; null and empty texts and those without words score by the bias alone."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x 8 bytes
    token = uuid.uuid4().hex

    @pandas_udf("double")
    def kernel(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(shared.value, token, [t if isinstance(t, str) else None for t in texts]))

    return kernel(text)


def toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, held_out, score and predicted of every row of documents; labels, lang, source and id enter no score.

    A text scores as a whole, whatever its length; null texts and texts without words score by the model's bias alone.
    Repeated rows get equal scores; a null id is not held out; an empty table gives an empty result; other columns do not
    matter, whatever their names.
    """
    spark = documents.sparkSession
    model = fit(documents, labels, id_col, text_col, label_col)
    scored = documents.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score_column(spark, model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def remove_toxic(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """documents without the rows that toxicity() predicts as label 1; all columns stay as they are, repeated rows too."""
    model = fit(documents, labels, id_col, text_col, label_col)
    return documents.where(score_column(documents.sparkSession, model, F.col(text_col)) < 0.5)
