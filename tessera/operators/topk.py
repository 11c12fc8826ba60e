"""Best matches of weighted token vectors: a grid of blocks of asked records and of the pool, scored in Arrow passes.

A block is one row: its records' tokens as codes into the block's own list of tokens. Blocks are cut by hash, and a block
of very many tokens again, so that a country that holds most records has most blocks. Records are exchanged once, to make
blocks; weights are looked up once for each token of a block; cells of the grid read both blocks from the shared table
(a Cartesian product), so that neither tokens nor pairs nor copies of blocks are exchanged. Memory of a cell is that of its
two blocks. Only the best lists of a cell leave it.

Tokens that many records of a pool block bear are summed as a matrix product in single precision, the others by postings.
Sums only choose what can be in a list, by a bound on their error: scores are made again in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import discard, release, ship, written

#: Records of a block at most: asked ones, and those of the pool. Tokens of a block at most, but one record's.
ASKED_BLOCK, POOL_BLOCK, BLOCK_TOKENS = 4096, 8192, 3 << 19
#: Asked records of a block at least, where more blocks would only keep cores busy.
LEAST_BLOCK = 128
#: Asked records of one pass of a cell, and products that one sum over postings takes.
CHUNK, PRODUCTS = 256, 1 << 17
#: Share of a pool block's records from which a token goes to the matrix product, and such tokens at most.
DENSE, DENSE_TOKENS = 0.05, 1024
#: Groups whose sizes set their own numbers of blocks; beyond that the largest sets all.
GROUPS = 1000

#: Weights of a block's entries from their records, codes, counts and the block's token weights, whether it is asked, and
#: its group; entries of weight 0 do not count.
Weigh = Callable[["Block", bool, tuple], np.ndarray]


@dataclass
class Block:
    """Entries (record, code, count) of a block in order of the record; token hashes and weights by code."""

    n: int
    starts: np.ndarray
    code: np.ndarray
    count: np.ndarray
    tok: np.ndarray
    idf: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.starts))


def block_numbers(sizes: dict[tuple, int], group: list[Column], most: int, least: int = 1) -> Column:
    """How many blocks a record's group has, by the sizes of groups."""
    of = lambda n: max(1, -(-n // most), min(least, n // LEAST_BLOCK))
    if len(sizes) > GROUPS:
        return F.lit(of(max(sizes.values())))
    known = {"\x00".join(map(str, key)): of(n) for key, n in sizes.items() if of(n) > 1}
    if not known:
        return F.lit(1)
    entries = [F.lit(x) for item in known.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*entries), F.concat_ws("\x00", *group)), F.lit(1))


def packed(bags: DataFrame, group: list[str], blocks: Column, name: str = "blocks", whole: bool = True) -> DataFrame:
    """bags (*group, id, bare, h, x) as a written table of blocks; blocks: how many a record's group has.

    h: token hashes; x: their weights, or null: then repeats of a token in a record, and in rows of the same id, count.
    whole=False: rows of an id stay apart.
    """
    ship(bags.sparkSession)
    kinds = dict(bags.dtypes)
    weighed = "x" in bags.columns
    rows = bags.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))

    def kernel(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, lists = table.column("id").combine_chunks(), table.column("h").combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        bare = table.column("bare").to_numpy(zero_copy_only=False).astype(bool)
        h = lists.flatten().to_numpy(zero_copy_only=False)
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False) if weighed else None
        at = np.arange(len(ids))
        if whole and len(ids) > 1:
            new = np.concatenate([[True], pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)])
            at = np.cumsum(new) - 1
            ids = ids.take(pa.array(np.flatnonzero(new)))
            bare = np.bincount(at, bare) > 0
        row = np.repeat(at, sizes)
        ends = np.cumsum(np.bincount(row, minlength=len(ids)))
        out = []
        low, done = 0, 0
        each = -(-len(row) // max(1, -(-len(row) // BLOCK_TOKENS)))  # parts of like size
        while low < len(ids):
            high = max(low + 1, int(np.searchsorted(ends, done + each, "right")))
            part = slice(done, int(ends[high - 1]))
            out.append(one(row[part] - low, h[part], x[part] if weighed else None, high - low) | {"part": len(out), "ids": ids.slice(low, high - low).to_pylist(), "bare": bare[low:high].astype(np.uint8).tobytes()})
            low, done = high, int(ends[high - 1])
        return pa.Table.from_pylist([{g: key[i].as_py() for i, g in enumerate([*group, "block"])} | o for o in out], pa.schema([*[table.schema.field(g) for g in [*group, "block"]], *FIELDS[:1], pa.field("ids", pa.list_(table.schema.field("id").type)), *FIELDS[1:]]))

    def one(row: np.ndarray, h: np.ndarray, x: np.ndarray | None, n: int) -> dict:
        tok, code = np.unique(h, return_inverse=True)
        if x is None:
            entry, count = np.unique(row * max(1, len(tok)) + code, return_counts=True)
            row, code = np.divmod(entry, max(1, len(tok)))
        else:
            count = x
        df = np.bincount(code, minlength=len(tok))
        order = np.argsort(-df, kind="stable")  # small codes for frequent tokens: they compress
        place = np.empty(len(tok), dtype=np.int64)
        place[order] = np.arange(len(tok))
        starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
        counts = count.astype(np.float64 if x is not None else np.int32)
        packs = {"tok": tok[order].astype(np.int64), "df": df[order].astype(np.int32), "starts": starts.astype(np.int32), "code": place[code].astype(np.int32), "count": counts if x is not None or (counts > 1).any() else counts[:0]}
        return {k: v.tobytes() for k, v in packs.items()}

    schema = ", ".join(f"{g} {kinds[g]}" for g in group) + f", block int, part int, ids array<{kinds['id']}>, bare binary, tok binary, df binary, starts binary, code binary, count binary"
    made = rows.select(*group, "block", "id", "bare", "h", *["x"] * weighed).groupBy(*group, "block").applyInArrow(kernel, schema)
    table = written(made, name, maxRecordsPerFile=1)
    release(bags.sparkSession)
    return table


FIELDS = [pa.field("part", pa.int32()), *[pa.field(c, pa.binary()) for c in ("bare", "tok", "df", "starts", "code", "count")]]


def block_tokens(blocks: DataFrame, group: list[str]) -> DataFrame:
    """(*group, block, part, at, h, df) of the tokens of blocks, at being the code."""
    kinds = dict(blocks.dtypes)
    keys = [*group, "block", "part"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h = np.frombuffer(batch.column("tok")[i].as_py(), dtype=np.int64)
                same = {k: pa.repeat(batch.column(k)[i], len(h)) for k in keys}
                yield pa.RecordBatch.from_pydict(same | {"at": pa.array(np.arange(len(h), dtype=np.int32)), "h": pa.array(h), "df": pa.array(np.frombuffer(batch.column("df")[i].as_py(), dtype=np.int32))})

    return blocks.select(*keys, "tok", "df").mapInArrow(kernel, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", at int, h long, df int")


def read_block(batch: pa.RecordBatch, i: int, side: str, weighed: bool) -> Block:
    of = lambda c, kind: np.frombuffer(batch.column(f"{side}_{c}")[i].as_buffer(), dtype=kind)
    tok, starts, code = of("tok", np.int64), of("starts", np.int32).astype(np.int64), of("code", np.int32)
    idf = np.zeros(len(tok))
    if weighed:
        count = of("count", np.float64)
    else:
        count = of("count", np.int32)
        w = batch.column(f"{side}_w")[i].values
        idf[w.field("at").to_numpy(zero_copy_only=False)] = w.field("idf").to_numpy(zero_copy_only=False)
    return Block(len(starts) - 1, starts, code, count, tok, idf)


class Side:
    """A block with the weights of its entries, without those of weight 0."""

    def __init__(self, block: Block, w: np.ndarray):
        row, keep = block.row, w != 0
        self.n, self.tok = block.n, block.tok
        self.row, self.code, self.w = row[keep].astype(np.int32), block.code[keep], w[keep]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.row, minlength=self.n))]).astype(np.int64)
        self.norm = np.sqrt(np.bincount(self.row, self.w * self.w, minlength=self.n).max(initial=0.0))

    def by_token(self, k: int) -> Side:
        """As the pool's side: postings by token, columns of frequent tokens, tokens in order of their hash."""
        self.sorted = np.argsort(self.tok, kind="stable")
        self.group = max(1, min(64, self.n // (4 * max(1, k))))
        self.width = -(-self.n // self.group) * self.group
        self.df = np.bincount(self.code, minlength=len(self.tok))
        order = np.argsort(self.code, kind="stable")
        self.owner, self.post = self.row[order], self.w[order]
        self.first = np.concatenate([[0], np.cumsum(self.df)])[:-1]
        often = np.argsort(-self.df, kind="stable")[:DENSE_TOKENS]
        often = often[self.df[often] >= max(2, DENSE * self.n)]
        self.column = np.full(len(self.tok), -1)
        self.column[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.width), dtype=np.float32)
        at = self.column[self.code]
        self.dense[at[at >= 0], self.row[at >= 0]] = self.w[at >= 0]
        return self


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of first[i], ..., first[i] + size[i] - 1 in turn."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _leading(group: np.ndarray, score: np.ndarray, tie: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best of each group, of equal scores those of the smaller tie."""
    order = np.lexsort((tie, -score, group))
    new = np.concatenate([[True], group[order][1:] != group[order][:-1]]) if len(order) else np.zeros(0, dtype=bool)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - begin < n]


def cell_lists(asked: Side, pool: Side, bare: np.ndarray, k: int, reverse_k: int, bare_k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of asked, rows of pool and scores (six decimals) of the pairs that are in any list of the cell.

    Both blocks are in order of id, so that of equal scores the first row wins.
    """
    at = np.searchsorted(pool.tok, asked.tok, sorter=pool.sorted) if len(pool.tok) else np.zeros(len(asked.tok), dtype=np.int64)
    place = pool.sorted[np.minimum(at, len(pool.tok) - 1)] if len(pool.tok) else at
    place = np.where((pool.tok[place] == asked.tok) & (pool.df[place] > 0), place, -1) if len(pool.tok) else np.full(len(asked.tok), -1)
    code = place[asked.code]
    lists = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    if not (code >= 0).any():
        return lists
    column = np.where(code >= 0, pool.column[code], -1)
    few = (code >= 0) & (column < 0)
    size = np.where(few, pool.df[code], 0)
    # twice the error of a sum in single precision, and half a unit of the sixth decimal on both sides
    slack = 2 * (len(pool.dense) + 8) * 2.0**-24 * asked.norm * pool.norm + 1.1e-6
    least = np.float32(max(threshold - slack, 1e-30))
    lone = np.flatnonzero(bare) if bare_k else np.zeros(0, dtype=np.int64)
    seen = np.full((reverse_k, pool.n), -np.inf, dtype=np.float32)
    late = lists
    out = []
    weights = np.zeros(len(pool.tok))
    for low in range(0, asked.n, CHUNK):
        high = min(asked.n, low + CHUNK)
        part = slice(asked.starts[low], asked.starts[high])
        dense = np.zeros((high - low, len(pool.dense)), dtype=np.float32)
        is_dense = column[part] >= 0
        dense[asked.row[part][is_dense] - low, column[part][is_dense]] = asked.w[part][is_dense]
        score = dense @ pool.dense if len(pool.dense) else np.zeros((high - low, pool.width), dtype=np.float32)
        done = np.concatenate([[0], np.cumsum(size[part])])[asked.starts[low : high + 1] - asked.starts[low]]
        row = 0
        while row < high - low:
            end = max(row + 1, int(np.searchsorted(done, done[row] + PRODUCTS, "right")) - 1)
            if done[end] > done[row]:
                some = np.arange(asked.starts[low + row], asked.starts[low + end])
                some = some[few[some]]
                each = size[some]
                places = _ranges(pool.first[code[some]], each)
                cells = pool.owner[places] + np.repeat((asked.row[some].astype(np.int64) - low - row) * pool.width, each)
                score[row:end] += np.bincount(cells, pool.post[places] * np.repeat(asked.w[some], each), minlength=(end - row) * pool.width).reshape(end - row, pool.width)
            row = end
        tops = score.reshape(high - low, -1, pool.group).max(axis=2)
        floor = np.full(high - low, least)
        if tops.shape[1] >= k > 0:
            floor = np.maximum(least, np.partition(tops, tops.shape[1] - k, axis=1)[:, -k] - np.float32(slack))
        elif not k:
            floor = np.full(high - low, np.inf, dtype=np.float32)
        score = score[:, : pool.n]
        if reverse_k:
            best = np.stack([x.max(axis=0) for x in np.array_split(score, min(reverse_k, high - low))])
            seen = np.partition(np.concatenate([seen, best]), len(best), axis=0)[len(best) :]
            limit = np.maximum(least, seen[0] - np.float32(slack))
            hit = np.flatnonzero(score >= np.minimum(floor[:, None], limit[None, :]))
        else:
            hit = np.flatnonzero(score >= floor[:, None])
        if len(lone):
            sub = score[:, lone]
            edge = np.full(high - low, least)
            if len(lone) > bare_k:
                edge = np.maximum(least, np.partition(sub, len(lone) - bare_k, axis=1)[:, -bare_k] - np.float32(slack))
            r, c = np.nonzero(sub >= edge[:, None])
            hit = np.unique(np.concatenate([hit, r * pool.n + lone[c]]))
        r, c = np.divmod(hit, pool.n)
        exact = np.zeros(len(hit))
        begin = np.searchsorted(r, np.arange(high - low + 1))
        for i in np.flatnonzero(np.diff(begin)):
            own = slice(asked.starts[low + i], asked.starts[low + i + 1])
            own_code, own_w = code[own], asked.w[own]
            own_code, own_w = own_code[own_code >= 0], own_w[own_code >= 0]
            weights[own_code] = own_w
            for some in range(begin[i], begin[i + 1], 4096):
                which = c[some : min(some + 4096, begin[i + 1])]
                sizes = pool.starts[which + 1] - pool.starts[which]
                places = _ranges(pool.starts[which], sizes)
                exact[some : some + len(which)] = np.bincount(np.repeat(np.arange(len(which)), sizes), weights[pool.code[places]] * pool.w[places], minlength=len(which))
            weights[own_code] = 0
        exact = np.round(exact, 6)
        keep = exact > threshold
        r, c, exact = r[keep] + low, c[keep], exact[keep]
        mine = [_leading(r, exact, c, k)]
        if len(lone):
            of = np.flatnonzero(bare[c])
            mine.append(of[_leading(r[of], exact[of], c[of], bare_k)])
        mine = np.unique(np.concatenate(mine))
        out.append((r[mine], c[mine], exact[mine]))
        if reverse_k:
            late = tuple(np.concatenate(x) for x in zip(late, (r, c, exact)))
            winners = _leading(late[1], late[2], late[0], reverse_k)
            late = tuple(x[winners] for x in late)
    row, col, score = (np.concatenate(x) for x in zip(late, *out))
    _, once = np.unique(row * max(1, pool.n) + col, return_index=True)
    return row[once], col[once], score[once]


def grid_pairs(asked: DataFrame, pool: DataFrame, group: list[str], weigh: Weigh, k: int, reverse_k: int, bare_k: int, threshold: float, weighed: bool = False, name: str = "pairs") -> DataFrame:
    """The lists of all cells of blocks of equal group, as a written table (s1, cand, *group, score).

    asked, pool: blocks; besides, unless weighed, w: list of (at, idf), weights of their tokens.
    """
    spark = asked.sparkSession
    ship(spark)
    kinds = dict(asked.dtypes)
    used = ["ids", "bare", "tok", "starts", "code", "count", *["w"] * (not weighed)]
    side = lambda df, p: df.select(*group, *[F.col(c).alias(f"{p}_{c}") for c in used], F.xxhash64(*group, "block", "part", F.lit(p)).alias(f"{p}_key"))
    cells = side(pool, "p").join(side(asked, "a").drop("a_bare").hint("shuffle_replicate_nl"), group)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept = None, None  # the pool's block, which stays for some cells
        for batch in batches:
            for i in range(batch.num_rows):
                of = tuple(batch.column(g)[i].as_py() for g in group)
                key = batch.column("p_key")[i].as_py()
                if key != known:
                    kept = None
                    block = read_block(batch, i, "p", weighed)
                    known, kept = key, Side(block, weigh(block, False, of)).by_token(k)
                    bare = np.frombuffer(batch.column("p_bare")[i].as_py(), dtype=np.uint8) > 0
                block = read_block(batch, i, "a", weighed)
                row, col, score = cell_lists(Side(block, weigh(block, True, of)), kept, bare, k, reverse_k, bare_k, threshold)
                ids = [batch.column(f"{p}_ids")[i].values.take(pa.array(x)) for p, x in (("a", row), ("p", col))]
                yield pa.RecordBatch.from_pydict({"s1": ids[0], "cand": ids[1]} | {g: pa.repeat(batch.column(g)[i], len(row)) for g in group} | {"score": pa.array(score, pa.float64())})

    element = kinds["ids"][len("array<") : -1]
    schema = f"s1 {element}, cand {element}, " + ", ".join(f"{g} {kinds[g]}" for g in group) + ", score double"
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "1")  # a row holds two blocks
    try:
        return written(cells.mapInArrow(kernel, schema), name)
    finally:
        spark.conf.set(size, before)


def as_given(block: Block, asked: bool, group: tuple) -> np.ndarray:
    return block.count


def best_pairs(vectors: DataFrame, group: list[str], k: int = 10, reverse_k: int = 1, bare_k: int = 0, threshold: float = 0.0, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(s1, cand, *group, score) of the pairs with a score above threshold that are among the k best of their asked record,
    the reverse_k best of their pool record or the bare_k best of their asked record with a bare one; and of some that are
    so within a block only. Ties go to smaller ids. Rank the result for the lists themselves: it holds all their pairs.

    vectors: *group, id, v, asks (whether it is an asked record) and bare. v is a list of (h, w), the hash and weight of each
    distinct token. sizes: the most asked and pool records of a group, where known; they only set the number of blocks.
    """
    spark = vectors.sparkSession
    if sizes is None:
        counts = vectors.groupBy(*group, "asks").agg(F.count(F.lit(1)).alias("c"))
        sizes = tuple(n or 0 for n in counts.agg(F.max(F.when(F.col("asks"), F.col("c"))), F.max(F.when(~F.col("asks"), F.col("c")))).first())
    number = lambda n, most, least: max(1, -(-n // most), min(least, n // LEAST_BLOCK))
    blocks = F.when(F.col("asks"), F.lit(number(sizes[0], ASKED_BLOCK, spark.sparkContext.defaultParallelism))).otherwise(F.lit(number(sizes[1], POOL_BLOCK, 1)))
    table = packed(vectors.select(*group, "asks", "id", "bare", F.col("v.h").alias("h"), F.col("v.w").alias("x")), [*group, "asks"], blocks, whole=False)
    found = grid_pairs(table.where("asks"), table.where("not asks"), group, as_given, k, reverse_k, bare_k, threshold, weighed=True)
    discard(table)
    return found


def bag_pairs(blocks: DataFrame, idf: DataFrame, weigh: Weigh, k: int = 10, reverse_k: int = 1, bare_k: int = 0, threshold: float = 0.0) -> DataFrame:
    """As best_pairs(), (s1, cand, country, source, score), of blocks by country and source that packed() made; those of S1
    ask. idf: (country, pool, h, idf) of tokens by pool; other tokens do not count. The blocks are discarded."""
    spark = blocks.sparkSession
    keys = ["country", "source", "block", "part"]
    tokens = block_tokens(blocks, ["country", "source"]).drop("df")
    weights = tokens.join(idf, ["country", "h"]).where("source = 'S1' or source = pool").groupBy(*keys, "pool").agg(F.collect_list(F.struct("at", "idf")).alias("w"))
    table = written(blocks.join(weights, keys).withColumn("asks", F.col("source") == "S1").drop("source", "df").withColumnRenamed("pool", "source"), "weighed", maxRecordsPerFile=1)
    discard(blocks)
    release(spark)
    found = grid_pairs(table.where("asks"), table.where("not asks"), ["country", "source"], weigh, k, reverse_k, bare_k, threshold)
    discard(table)
    release(spark)
    return found
