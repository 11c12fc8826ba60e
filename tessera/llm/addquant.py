"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one full-dimensional codeword of each codebook. Codebooks are fitted on a bounded
sample (residual k-means, then rounds of beam-search encoding and least squares); every vector is encoded by beam search
and keeps its codes, the ratio of its norm to that of its approximation, and the norm of what the approximation leaves.
A query scores the codes by lookup tables of inner products. Vectors whose score can still reach the best list, by the
error that the sample shows for the norm they leave, are reranked exactly in double precision at once. So the shortlist
has no fixed size: it follows the error, and recall does not fall as the table grows.

Equal vectors are searched once, as query and as candidate. Queries come in blocks, codes in slices; the codes of a slice
stream past a block with a running best list, so a task holds a block of queries and one batch of codes, whatever the
number of vectors. Every query meets every code: the work grows with queries x vectors, the index is sent once a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import durable, ship

#: Vectors that the codebooks are fitted on at most, by hash of the id: the documented bound of the sample.
SAMPLE_ROWS = 8192
BOOKS, WORDS, BEAM, ROUNDS = 32, 64, 4, 2
#: Share of a sample's true neighbours whose error the rerank allows for, with this factor on top.
ERROR_QUANTILE, ERROR_FACTOR = 0.995, 1.1
#: Queries in a block, vectors in a packed row, and queries and vectors that are scored together; slices of codes at most.
QUERY_BLOCK, CODE_BLOCK, TOGETHER, SLICES = 4096, 64, (256, 2048), 64
#: Shares that rows of one vector are split into before the first of them are taken.
SALTS = 64


@dataclass
class Codebooks:
    words: np.ndarray  # books x words x dims, float32

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes of each row of x: a beam of partial sums through the books, each kept by its squared error."""
        books, words, _ = self.words.shape
        flat = self.words.reshape(books * words, -1)
        cross = flat @ flat.T
        norms = np.einsum("ij,ij->i", flat, flat).reshape(books, words)
        out = np.empty((len(x), books), dtype=np.uint8)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            n = len(part)
            dots = (part @ flat.T).reshape(n, books, words)
            codes = np.zeros((n, 1, 0), dtype=np.int64)
            error = np.zeros((n, 1), dtype=np.float32)
            for m in range(books):
                # |x - s - c|^2 - |x - s|^2 = |c|^2 - 2 x.c + 2 s.c
                gain = (norms[m] - 2 * dots[:, m])[:, None, :] + np.zeros((1, codes.shape[1], 1), dtype=np.float32)
                for k in range(m):
                    gain += 2 * cross[codes[:, :, k] + k * words, m * words : (m + 1) * words]
                total = (error[:, :, None] + gain).reshape(n, -1)
                keep = min(beam, total.shape[1])
                best = np.argpartition(total, keep - 1, axis=1)[:, :keep]
                error = np.take_along_axis(total, best, axis=1)
                codes = np.concatenate([np.take_along_axis(codes, (best // words)[:, :, None], axis=1), (best % words)[:, :, None]], axis=2)
            out[at : at + n] = codes[np.arange(n), error.argmin(axis=1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m, codes[:, m]] for m in range(len(self.words)))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (np.einsum("ij,ij->i", centers, centers) - 2 * (x @ centers.T)).argmin(axis=1)
        count = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            centers[:, d] = np.bincount(near, x[:, d], minlength=k) / np.maximum(count, 1)
        empty = count == 0
        centers[empty] = x[rng.choice(len(x), int(empty.sum()))]
    return centers


def fit_codebooks(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 0) -> Codebooks:
    """Residual k-means, then rounds that encode the sample and solve for all codewords together."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    rest, found = x.copy(), []
    for _ in range(books):
        c = _kmeans(rest, words, rng)
        near = (np.einsum("ij,ij->i", c, c) - 2 * (rest @ c.T)).argmin(axis=1)
        rest -= c[near]
        found.append(c)
    out = Codebooks(np.stack(found).astype(np.float32))
    for _ in range(rounds):
        codes = out.encode(x)
        onehot = np.zeros((len(x), books * words), dtype=np.float32)
        for m in range(books):
            onehot[np.arange(len(x)), codes[:, m].astype(np.int64) + m * words] = 1
        normal = onehot.T @ onehot + 1e-2 * np.eye(books * words, dtype=np.float32)
        solved = np.linalg.solve(normal.astype(np.float64), (onehot.T @ x + 1e-2 * out.words.reshape(books * words, -1)).astype(np.float64))
        out = Codebooks(solved.reshape(books, words, -1).astype(np.float32))
    return out


def usable(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def encoded(books: Codebooks, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of x, ratio of each norm to its approximation's, and the norm of what the scaled approximation leaves."""
    x = x.astype(np.float32)
    codes = books.encode(x)
    near = books.decode(codes)
    norm = np.linalg.norm(near, axis=1)
    ratio = (np.linalg.norm(x, axis=1) / np.where(norm > 0, norm, 1)).astype(np.float32)
    return codes, ratio, np.linalg.norm(x - near * ratio[:, None], axis=1).astype(np.float32)


def allowance(books: Codebooks, x: np.ndarray, k: int) -> float:
    """How far scores of true neighbours fall short, as a share of the norms of query and remainder, by the sample x."""
    codes, ratio, left = encoded(books, x)
    near = books.decode(codes) * ratio[:, None]
    short = []
    for i in range(0, len(x), max(1, len(x) // 256)):
        exact = x @ x[i]
        exact[i] = -np.inf
        best = np.argsort(-exact)[:k]
        best = best[np.isfinite(exact[best])]
        short.append((exact[best] - near[best] @ x[i]) / np.maximum(left[best] * np.linalg.norm(x[i]), 1e-12))
    return float(max(0.0, np.quantile(np.concatenate(short), ERROR_QUANTILE)) * ERROR_FACTOR) if any(map(len, short)) else 1.0


class Block:
    """A block of queries with their running best lists of k exact scores, by score and then by smaller id."""

    def __init__(self, books: Codebooks, queries: np.ndarray, k: int, error: float) -> None:
        self.k, self.error, self.queries = k, error, queries.astype(np.float64)
        self.norms = np.linalg.norm(self.queries, axis=1).astype(np.float32)
        self.tables = np.einsum("qd,mwd->mqw", queries.astype(np.float32), books.words, optimize=True)
        n = len(queries)
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.keys = np.zeros((n, k, 2), dtype=np.int64)

    def add(self, keys: np.ndarray, ids: np.ndarray, codes: np.ndarray, ratio: np.ndarray, left: np.ndarray, x: np.ndarray) -> None:
        step = TOGETHER[0]
        for lo in range(0, len(self.queries), step):
            part = slice(lo, lo + step)
            found = np.take(self.tables[0, part], codes[:, 0], axis=1)
            for m in range(1, codes.shape[1]):
                found += np.take(self.tables[m, part], codes[:, m], axis=1)
            found *= ratio
            found += np.float32(self.error) * self.norms[part, None] * left
            q, c = np.nonzero(found >= (self.scores[part, -1:] - 1e-5 * self.norms[part, None]).astype(np.float32))
            for at in range(0, len(q), 1 << 16):
                self.rerank(lo + q[at : at + (1 << 16)], c[at : at + (1 << 16)], keys, ids, x)

    def rerank(self, q: np.ndarray, c: np.ndarray, keys: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Take vectors c into the lists of queries q (sorted), by exact scores."""
        exact = (self.queries[q] * x[c].astype(np.float64)).sum(axis=1)
        keep = (exact > self.scores[q, -1]) | ((exact == self.scores[q, -1]) & (ids[c] < self.ids[q, -1]))
        q, c, exact = q[keep], c[keep], exact[keep]
        who, counts = np.unique(q, return_counts=True)
        if not len(who):
            return
        row = np.repeat(np.arange(len(who)), counts)
        all_row = np.concatenate([np.repeat(np.arange(len(who)), self.k), row])
        score = np.concatenate([self.scores[who].ravel(), exact])
        ident = np.concatenate([self.ids[who].ravel(), ids[c]])
        key = np.concatenate([self.keys[who].reshape(-1, 2), keys[c]])
        order = np.lexsort((ident, -score, all_row))
        starts = np.cumsum(counts + self.k) - (counts + self.k)
        best = order[starts[:, None] + np.arange(self.k)]
        self.scores[who], self.ids[who], self.keys[who] = score[best], ident[best], key[best]


def search(
    df: DataFrame,
    query_every: int = 20,
    k: int = 20,
    books: int = BOOKS,
    words: int = WORDS,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, id and score: the k nearest of each row whose id is divisible by query_every, by inner product.

    Null, empty and zero vectors and those with null or non-finite components take no part, nor do rows of a null id.
    Every other row does: vectors of unequal lengths count as filled up with zeros, rows that share an id are rows of
    their own, and a query leaves out one row only, its own. Ties go to smaller ids. Fewer candidates than k give as many
    rows. An empty table gives an empty result; other columns do not matter. Scores are double-precision inner products
    of the original vectors.
    """
    spark = df.sparkSession
    ship(spark)
    single = dict(df.dtypes)[vector_col] == "array<float>"
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("v_id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    filled = F.when(F.size("v") < dims, F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("v")))).otherwise(F.col("v"))
    rows = rows.select("v_id", filled.alias("v")).select("v_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    # of equal vectors k + 1 rows can matter at most: the first of each of SALTS shares, then of them all
    share = Window.partitionBy("h1", "h2", F.pmod(F.xxhash64("v_id"), F.lit(SALTS))).orderBy("v_id")
    first_rows = rows.withColumn("r", F.row_number().over(share)).where(F.col("r") <= k + 1)
    groups = durable(first_rows.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.slice(F.array_sort(F.collect_list("v_id")), 1, k + 1).alias("v_ids")))
    asked = durable(rows.where(F.pmod("v_id", F.lit(query_every)) == 0).select("v_id", "h1", "h2"))
    queries = durable(groups.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "v"))
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], schema)

    sample = groups.orderBy("h1", "h2").select("v").limit(sample_rows).toPandas()
    sample = np.stack(sample.v.to_numpy()).astype(np.float32)
    fitted = fit_codebooks(sample, books, words)
    shared = spark.sparkContext.broadcast((fitted, allowance(fitted, sample, k)))
    blocks = -(-n_queries // QUERY_BLOCK)
    slices = min(SLICES, max(1, 2 * spark.sparkContext.defaultParallelism // blocks))
    kind = "<f4" if single else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = b.column("v").flatten().to_numpy().reshape(n, -1)
            codes, ratio, left = encoded(shared.value[0], x)
            heads = np.stack([b.column(c).to_numpy() for c in ("h1", "h2", "m")], axis=1).astype("<i8")
            for at in range(0, n, CODE_BLOCK):
                cut = slice(at, at + CODE_BLOCK)
                cells = [heads[cut], codes[cut], np.stack([ratio[cut], left[cut]], axis=1).astype("<f4"), x[cut].astype(kind)]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], names=["c_heads", "c_codes", "c_norms", "c_x"])

    parts = "c_heads binary, c_codes binary, c_norms binary, c_x binary"
    index = durable(groups.select("h1", "h2", F.col("v_ids")[0].alias("m"), "v").mapInArrow(pack, parts))
    none = [F.lit(None).cast("binary").alias(c) for c in ("c_heads", "c_codes", "c_norms", "c_x")]
    of_query = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.pmod(F.col("h1"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "h1", "h2", "v", *none
    )
    of_codes = index.select(
        F.pmod(F.xxhash64("c_heads"), F.lit(slices)).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"),
        F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), F.lit(None).cast("array<double>").alias("v"), "c_heads", "c_codes", "c_norms", "c_x",
    )
    dealt = of_query.unionByName(of_codes).repartition(blocks * slices, "block", "slice").sortWithinPartitions("block", "slice", "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads, vectors, block, held, n_held = None, [], [], None, [], 0

        def take() -> None:
            nonlocal block, held, n_held
            if held and heads:
                if block is None:
                    block = Block(shared.value[0], np.array(vectors), k + 1, shared.value[1])
                head, codes, norms, x = (b"".join(c) for c in zip(*held))
                head = np.frombuffer(head, dtype="<i8").reshape(-1, 3)
                norms = np.frombuffer(norms, dtype="<f4").reshape(-1, 2)
                block.add(head[:, :2], head[:, 2], np.frombuffer(codes, dtype=np.uint8).reshape(len(head), -1), norms[:, 0], norms[:, 1], np.frombuffer(x, dtype=kind).reshape(len(head), -1))
            held, n_held = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            take()
            if block is not None:
                own = np.repeat(np.array(heads, dtype=np.int64), k + 1, axis=0)
                ok = np.isfinite(block.scores.ravel())
                cells = [own[:, 0], own[:, 1], block.scores.ravel(), block.ids.ravel(), block.keys[:, :, 0].ravel(), block.keys[:, :, 1].ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in cells], names=["h1", "h2", "score", "m", "c1", "c2"])

        for b in batches:
            columns = {n: b.column(n) for n in b.schema.names}
            cells = list(zip(columns["block"].to_pylist(), columns["slice"].to_pylist(), columns["kind"].to_pylist()))
            for r, (at, piece, kind_of) in enumerate(cells):
                if (at, piece) != now:
                    yield from out()
                    now, heads, vectors, block = (at, piece), [], [], None
                if kind_of == 0:
                    heads.append((columns["h1"][r].as_py(), columns["h2"][r].as_py()))
                    vectors.append(columns["v"][r].values.to_numpy())
                elif heads:
                    held.append(tuple(columns[c][r].as_py() for c in ("c_heads", "c_codes", "c_norms", "c_x")))
                    n_held += CODE_BLOCK
                    if n_held >= TOGETHER[1]:
                        take()
        yield from out()

    found = durable(dealt.mapInArrow(scan, "h1 long, h2 long, score double, m long, c1 long, c2 long"))
    if slices > 1:  # the best of the slices' lists, slices x (k + 1) entries a query at most
        lists = found.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "m", "c1", "c2"))).alias("a"))
        found = lists.select("h1", "h2", F.explode(F.slice("a", 1, k + 1)).alias("e")).select("h1", "h2", (-F.col("e.minus")).alias("score"), "e.c1", "e.c2")
    members = groups.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "v_ids")
    each = found.join(members, ["c1", "c2"]).select("h1", "h2", F.explode("v_ids").alias("id"), "score", "c1", "c2")  # (k + 1)^2 rows a query at most
    lists = each.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id", "c1", "c2"))).alias("a"))
    lists = durable(lists.select("h1", "h2", F.slice("a", 1, k + 1).alias("a")))
    own = F.array_position(F.transform("a", lambda x: F.struct(x["id"].alias("id"), x["c1"].alias("c1"), x["c2"].alias("c2"))), F.struct(F.col("v_id").alias("id"), F.col("h1").alias("c1"), F.col("h2").alias("c2")))
    best = asked.join(lists, ["h1", "h2"]).select("v_id", F.slice(F.filter("a", lambda x, i: i + 1 != own), 1, k).alias("a"))
    ranked = best.select(F.col("v_id").alias("query_id"), F.posexplode("a").alias("rank", "e"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.minus")).alias("score"))
