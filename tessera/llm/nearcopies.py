"""Near copies by word shingles: all pairs of texts whose sets of five-word shingles have a Jaccard of at least 0.8.

Every text is hashed once; its sorted shingle hashes are a written table that all later steps read. Cheap links come
first: texts that share a SimHash group or one of a few minimum hashes are compared with the least of them, which joins a
large group at one comparison a member and key. Then a prefix filter finds every other pair that can reach the bound: in
one global order of shingles, two such sets share one of their first n - ceil(0.8 n) + 1. The order puts shingles last
that are common in a sample, which only saves work: any order finds all pairs. Only pairs of parts not yet joined are
formed; those whose overlap is bounded below 0.8 by the counts of their hashes in 256 ranges are left out, and every
link is checked on the whole sets, so nothing rests on the chance of a minimum hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from tessera.llm.memo import claim
from tessera.llm.simhash import components, fingerprint_of, near_links, one_of_each
from tessera.session import discard, durable, release, ship, written

WIDTH = 5
#: Minimum hashes a text is linked by first.
MINIMA = 8
#: Texts that common shingles are counted on, by hash of the text, and shingles that stand last at most.
SAMPLE_TEXTS, COMMON = 4000, 1 << 17
#: Words whose hashes a worker remembers, and hashes in a batch of sets that it hands on.
MEMO_WORDS, BATCH = 100_000, 1 << 18
#: Hashes of the sets of a block, about: four megabytes.
BLOCK = 1 << 19
#: Rows of postings looked at together, and texts of one key beyond which all of them are kept for the cells.
POSTINGS, CROWD = 1 << 15, 256
#: Turns in which the postings are dealt by key, cells of texts by cell: one moves a TURNS-th of the bytes of all sets, or ROOM.
KEY_TURNS, TURNS, ROOM = 2, 8, 1 << 26
#: Bits of a mask of nodes: two megabytes.
MASK_BITS = 24
ODD = np.random.default_rng(7).integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PRIME, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


_words = _Words()


def least_common(n):
    """The least overlap of a set of n with an equal or larger one at 0.8; a pair of n and m needs 4 (n + m) / 9."""
    return (4 * n + 4) // 5


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only


def node_of(words: list[bytes]) -> int:
    """Equal for texts of equal words, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(words))).view(np.int64))


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """One hash of each run of WIDTH words, of the whole sequence if there are fewer; repeats included."""
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(WIDTH, len(h))
    if not width:
        return h
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out ^ (out >> np.uint64(32))) * PRIME + h[i : len(h) - width + 1 + i]
        out = (out ^ (out >> np.uint64(31))) * MIX
    return out ^ (out >> np.uint64(29))


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(words_of(text)))


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Of two sorted sets."""
    return len(np.intersect1d(x, y, assume_unique=True))


def node_column(text: Column) -> Column:
    @pandas_udf("long")
    def kernel(texts: pd.Series) -> pd.Series:
        return pd.Series([node_of(words_of(t)) for t in texts], dtype="int64")

    return kernel(text)


def sketches(texts: DataFrame) -> DataFrame:
    """node, n, fp, least (minimum hashes) and shingles (sorted, 8 bytes each) of every text that has words."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["node", "n", "fp", "least", "shingles"])

        claim("nearcopies", _words.clear)
        seen = set()  # copies within a task's part of the table leave one row
        for b in batches:
            rows, held = [], 0
            for t in b.column("text"):
                words = words_of(t.as_py())
                if not words or (node := node_of(words)) in seen:
                    continue
                seen.add(node)
                hashes = shingle_hashes(words)
                h = np.unique(hashes)
                with np.errstate(over="ignore"):
                    least = [int((((h * m) ^ ((h * m) >> np.uint64(29))) * m).min().view(np.int64)) for m in ODD]
                rows.append((node, len(h), int(np.uint64(fingerprint_of(hashes)).view(np.int64)), least, h.astype("<u8").tobytes()))
                held += len(h)
                if held > BATCH:
                    yield out()
                    rows, held = [], 0
            if rows:
                yield out()

    return texts.mapInArrow(kernel, "node long, n int, fp long, least array<long>, shingles binary")


def ranges_of(shingles: pa.Array) -> pa.Array:
    """How many of the hashes of each set lie in each of 256 equal ranges, one byte each; 255 stands for as many or more."""
    counts = (np.bincount(np.frombuffer(s.as_buffer(), dtype="<u8") >> np.uint64(56), minlength=256) for s in shingles)
    return pa.array([np.minimum(c, 255).astype(np.uint8).tobytes() for c in counts], pa.binary())


@pandas_udf(BooleanType())
def _may_reach(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=bool)
    x, y = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(-1, 256) for s in (a, b))
    both = np.minimum(x, y)
    return pd.Series((both.max(axis=1) == 255) | (9 * both.sum(axis=1, dtype=np.int64) >= 4 * (n.to_numpy(np.int64) + m.to_numpy(np.int64))))


@pandas_udf(BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for s, t in zip(a, b):
        x, y = np.frombuffer(s, dtype="<u8"), np.frombuffer(t, dtype="<u8")
        out.append(9 * overlap(x, y) >= 4 * (len(x) + len(y)))
    return pd.Series(out, dtype=bool)


def mask_of(keys: DataFrame, column: str) -> np.ndarray:
    """2**MASK_BITS bits that tell which uniformly hashed keys may be among these: one by their first bits is set for each.

    Whatever the number of keys, 2**(MASK_BITS - 6) sums come to the driver. Filled up, the mask holds nothing back.
    """
    word, bit = F.shiftrightunsigned(column, 70 - MASK_BITS), F.shiftrightunsigned(column, 64 - MASK_BITS).bitwiseAND(F.lit(63))
    rows = keys.groupBy(word.cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))).alias("bits")).toPandas()
    out = np.zeros(1 << (MASK_BITS - 6), dtype=np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def passes(mask: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = keys.view(np.uint64)
    word, bit = (k >> np.uint64(70 - MASK_BITS)).astype(np.int64), (k >> np.uint64(64 - MASK_BITS)) & np.uint64(63)
    return (mask[word] >> bit & np.uint64(1)).astype(bool)


def found_in(wanted: DataFrame, sets: DataFrame, name: str, make: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """(node, n, name) of the distinct wanted nodes: name is what make() gives for their sets."""
    mask = wanted.sparkSession.sparkContext.broadcast(mask_of(wanted, "node"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(passes(mask.value, b.column("node").to_numpy())))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), make(b.column("shingles"))], names=["node", "n", name])

    some = sets.select("node", "n", "shingles").mapInArrow(kernel, f"node long, n int, {name} binary")
    return durable(some.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first(name).alias(name)))


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (u, v) of nodes with a Jaccard of at least 0.8."""

    def sides(of: DataFrame, name: str, make: Callable[[pa.Array], pa.Array]) -> DataFrame:
        found = found_in(of.select(F.explode(F.array("u", "v")).alias("node")).distinct(), sets, name, make)
        side = lambda n: found.select(F.col("node").alias(n), F.col("n").alias(f"{n}_n"), F.col(name).alias(f"{n}_{name}"))
        return of.join(side("u"), "u").join(side("v"), "v")

    release(pairs.sparkSession)
    hopeful = durable(sides(pairs, "ranges", ranges_of).where(_may_reach("u_ranges", "v_ranges", "u_n", "v_n")).select("u", "v"))
    release(pairs.sparkSession)
    return durable(sides(hopeful, "shingles", lambda x: x).where(_near("u_shingles", "v_shingles")).select("u", "v"))


def meeting(key: np.ndarray, n: np.ndarray, pos: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which postings, in order of their keys, have one of another part at their key that they may reach 0.8 with.

    If texts of n and m have their first shared key at i and j, n - i and m - j are at least 4 (n + m) / 9. Beyond CROWD texts
    of a key, all are kept.
    """
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    mixed = np.minimum.reduceat(part, starts) != np.maximum.reduceat(part, starts)
    keep = np.repeat(mixed & (sizes > CROWD), sizes)
    left = np.repeat(np.where(mixed & (sizes <= CROWD), starts + sizes, 0), sizes)  # ends of the keys to look at
    i, room, d = np.flatnonzero(left), n - pos, 1
    while len(i := i[i + d < left[i]]):
        j = i + d
        both = n[i] + n[j]
        ok = (part[i] != part[j]) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])) & (9 * np.minimum(room[i], room[j]) >= 4 * both)
        keep[i[ok]] = True
        keep[j[ok]] = True
        d += 1
    return keep


def partnered(rows: DataFrame) -> DataFrame:
    """The distinct postings (key, node, n, pos, part) that meeting() keeps."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept(columns: list[np.ndarray]) -> pa.RecordBatch:
            key, node = columns[:2]
            once = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
            key, node, n, pos, part = (c[once] for c in columns)
            keep = meeting(key, n.astype(np.int64), pos.astype(np.int64), part)
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (key, node, n, pos, part)], names=names)

        names, held, size = ["key", "node", "n", "pos", "part"], [], 0
        for b in batches:
            held.append([b.column(c).to_numpy() for c in names])
            size += b.num_rows
            if size >= POSTINGS:
                columns = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last key may go on
                if cut:
                    yield kept([c[:cut] for c in columns])
                held = [[c[cut:] for c in columns]]
                size = 0
        if held and any(len(h[0]) for h in held):
            yield kept([np.concatenate(c) for c in zip(*held)])

    return rows.select("key", "node", "n", "pos", "part").repartition("key").sortWithinPartitions("key", "node").mapInArrow(kernel, "key long, node long, n int, pos int, part long")


def cells_of(shared: DataFrame) -> DataFrame:
    """Distinct (lo, hi, node, home, part): the texts of every cell, of shared (key, node, n, pos, part).

    A text's home is the most frequent of its keys, and a block of that. For each key, a text enters the cells of its own
    block and those blocks where some text may reach 0.8 with it by size and place.
    """
    rows = shared.withColumn("most", F.floor((9 * (F.col("n") - F.col("pos")) - 4 * F.col("n")) / 4))  # the other's size
    sizes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    homes = durable(shared.join(sizes, "key").groupBy("node").agg(F.max(F.struct("c", F.col("key").alias("at")))["at"].alias("at"), F.first("n").alias("n")))
    release(shared.sparkSession)
    blocks = homes.groupBy("at").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    homes = homes.join(blocks, "at").select("node", F.xxhash64("at", F.pmod(F.xxhash64("node"), "blocks")).alias("home"))
    rows = durable(rows.join(homes, "node").select("key", "node", "n", "most", "part", "home"))
    sides = rows.groupBy("key", "home").agg(*[f(c).alias(f"o_{f.__name__}_{c}") for f, c in ((F.min, "n"), (F.max, "n"), (F.max, "most"), (F.min, "part"), (F.max, "part"))])
    near = (F.col("o_min_n") <= F.col("most")) & (F.col("n") <= F.col("o_max_most")) & (5 * F.col("o_max_n") >= 4 * F.col("n")) & (5 * F.col("n") >= 4 * F.col("o_min_n"))
    other = (F.col("o_min_part") != F.col("part")) | (F.col("o_max_part") != F.col("part"))
    met = rows.join(sides.withColumnRenamed("home", "o_home"), "key").where(near & other)
    return met.select(F.least("home", "o_home").alias("lo"), F.greatest("home", "o_home").alias("hi"), "node", "home", "part").distinct()


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell (lo, hi), of batches sorted by cell."""
    held, now = [], None
    for b in batches:
        if not b.num_rows:
            continue
        lo, hi = b.column("lo").to_numpy(), b.column("hi").to_numpy()
        starts = [0, *(np.flatnonzero((lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1).tolist(), len(lo)]
        for i, j in zip(starts, starts[1:]):
            if held and now != (lo[i], hi[i]):
                yield pa.Table.from_batches(held)
                held = []
            now = (lo[i], hi[i])
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def windows(n: np.ndarray, home: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
    """For a cell's texts, of sizes n in ascending order: each text with those after it in its reach by size and, where the
    cell has two blocks, of the other block."""
    ends = np.searchsorted(4 * n, 5 * n, side="right")
    for i, end in enumerate(ends.tolist()):
        after = np.arange(i + 1, end)
        if lo != hi and len(after):
            after = after[home[i + 1 : end] != home[i]]
        if len(after):
            yield i, after


def _cell(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, int, int]:
    table = table.sort_by("n")
    return table, table.column("n").to_numpy().astype(np.int64), table.column("home").to_numpy(), table.column("lo")[0].as_py(), table.column("hi")[0].as_py()


def hopeful_in(table: pa.Table) -> np.ndarray:
    """Nodes of a cell (with their ranges) that may reach 0.8 with some other part's."""
    table, n, home, lo, hi = _cell(table)
    part = table.column("part").to_numpy()
    ranges = np.frombuffer(b"".join(table.column("ranges").to_pylist()), dtype=np.uint8).reshape(-1, 256)
    keep = np.zeros(len(n), dtype=bool)
    for i, after in windows(n, home, lo, hi):
        after = after[part[after] != part[i]]
        for at in range(0, len(after), 4096):
            some = after[at : at + 4096]
            both = np.minimum(ranges[i], ranges[some])
            may = some[(9 * both.sum(axis=1, dtype=np.int64) >= 4 * (n[i] + n[some])) | (both.max(axis=1) == 255)]
            keep[may] = True
            keep[i] |= bool(len(may))
    return table.column("node").to_numpy()[keep]


def links_in(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the parts of a cell (with their shingles) over all pairs that reach 0.8."""
    table, n, home, lo, hi = _cell(table)
    sets = [np.frombuffer(x.as_buffer(), dtype="<u8") for x in chain.from_iterable(table.column("shingles").chunks)]
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(n)])
    label = np.unique(table.column("part").to_numpy(), return_inverse=True)[1]
    mark = np.zeros(len(code) and int(code.max()) + 1, dtype=np.int32)
    us, vs = [], []
    for i, after in windows(n, home, lo, hi):
        after = after[label[after] != label[i]]
        if not len(after):
            continue
        own = code[starts[i] : starts[i + 1]]
        mark[own] = 1
        at = 0
        while at < len(after):
            end = max(at + 1, int(np.searchsorted(np.cumsum(n[after[at:]]), BLOCK)) + at)
            some = after[at:end]
            common = np.add.reduceat(mark[np.concatenate([code[starts[j] : starts[j + 1]] for j in some])], np.concatenate([[0], np.cumsum(n[some])[:-1]]))
            for j in some[9 * common.astype(np.int64) >= 4 * (n[i] + n[some])]:
                if label[j] != label[i]:
                    us.append(i)
                    vs.append(j)
                    label[label == label[j]] = label[i]
            at = end
        mark[own] = 0
    node = table.column("node").to_numpy()
    return node[us], node[vs]


def in_turns(turns: int, make: Callable[[int], DataFrame]) -> DataFrame:
    """The rows of make(0) to make(turns - 1), each cut off before the next one's exchanges are written."""
    out = []
    for turn in range(turns):
        out.append(durable(make(turn)))
        release(out[0].sparkSession)
    return reduce(DataFrame.unionByName, out)


def linked(shared: DataFrame, sets: DataFrame, room: int) -> DataFrame:
    """Links (u, v) that join all parts of shared (key, node, n, pos, part) between which some pair reaches 0.8.

    room: bytes of sets that are dealt to cells at once, about.
    """
    spark = shared.sparkSession

    def dealt(cells: DataFrame, name: str, make: Callable[[pa.Array], pa.Array], kernel: Callable, schema: str) -> DataFrame:
        release(spark)
        data = found_in(cells.select("node").distinct(), sets, name, make)
        held = cells.join(data.select("node", F.length(name).alias("bytes")), "node").agg(F.sum("bytes")).first()[0] or 0
        turns = max(1, -(-held // room))
        release(spark)

        def turn(t: int) -> DataFrame:
            own = cells.where(F.pmod(F.xxhash64("lo", "hi"), F.lit(turns)) == t)
            return own.join(data, "node").repartition("lo", "hi").sortWithinPartitions("lo", "hi").mapInArrow(kernel, schema)

        return in_turns(turns, turn)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in by_cell(batches):
            nodes = hopeful_in(cell)
            if len(nodes):
                some = cell.select(["lo", "hi", "node", "home", "part"]).filter(pa.array(np.isin(cell.column("node").to_numpy(), nodes)))
                yield from some.combine_chunks().to_batches()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in by_cell(batches):
            u, v = links_in(cell)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    cells = durable(cells_of(shared))
    hopeful = dealt(cells, "ranges", ranges_of, kept, "lo long, hi long, node long, home long, part long")
    return dealt(hopeful, "shingles", lambda x: x, joined, "u long, v long")


def near_copy_roots(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(node, root) of every node (node_column()) that has a near copy other than itself."""
    spark = df.sparkSession
    ship(spark)
    sets = written(sketches(df.select(F.col(text_col).alias("text"))), "shingles")
    nodes = durable(sets.groupBy("node").agg(F.max("n").alias("n"), F.min("fp").alias("fp"), F.max("least").alias("least")))
    prints = durable(nodes.select("fp").distinct())
    alike = durable(components(near_links(prints, "fp", 2)))
    by_print = nodes.join(alike.select(F.col("node").alias("fp"), "root"), "fp", "left").select("node", F.lit(-1).alias("at"), F.coalesce("root", "fp").alias("key"))
    keys = durable(by_print.unionByName(nodes.select("node", F.posexplode("least").alias("at", "key"))))
    first = keys.groupBy("at", "key").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u < v").select("at", "key", "u")
    stars = durable(keys.join(first, ["at", "key"]).where("node > u").select("u", F.col("node").alias("v")).distinct())
    links = checked(stars, sets)
    roots = durable(components(links))
    release(spark)

    texts, hashes = nodes.agg(F.count(F.lit(1)), F.sum("n")).first()
    every = max(1, texts // SAMPLE_TEXTS)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column("shingles"):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(s.as_buffer(), dtype="<i8"))], names=["key"])

    sampled = sets.where(F.pmod("node", F.lit(every)) == 0).groupBy("node").agg(F.first("shingles").alias("shingles"))
    counted = sampled.mapInArrow(spread, "key long").groupBy("key").count().where("count > 2").orderBy(F.desc("count"), "key").limit(COMMON).toPandas()
    known, counts = counted["key"].to_numpy(dtype=np.int64).view(np.uint64), counted["count"].to_numpy(dtype=np.int64)
    order = np.argsort(known)
    common = spark.sparkContext.broadcast((known[order], counts[order]))

    def prefixes(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        known, counts = common.value
        for b in batches:
            found = []
            for node, s in zip(b.column("node"), b.column("shingles")):
                h = np.frombuffer(s.as_buffer(), dtype="<u8")
                rank = np.zeros(len(h), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[at] == h, counts[at], 0)
                n = len(h)
                took = h[np.lexsort((h, rank))][: n - least_common(n) + 1]
                place = np.flatnonzero(took % np.uint64(KEY_TURNS) == turn).astype(np.int32)  # by low bits: a prefix holds small hashes
                took = took[place]
                found.append((took.view(np.int64), np.full(len(took), node.as_py()), np.full(len(took), n, dtype=np.int32), place))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["key", "node", "n", "pos"])

    # the postings are made once a turn rather than kept, and a turn's keys have all of their postings in it
    posts = lambda t: sets.select("node", "shingles").mapInArrow(lambda batches: prefixes(batches, t), "key long, node long, n int, pos int")
    release(spark)
    shared = in_turns(KEY_TURNS, lambda t: partnered(posts(t).withColumn("part", F.col("node"))))
    shared = durable(partnered(shared.join(roots, "node", "left").withColumn("part", F.coalesce("root", "node"))))
    release(spark)
    links = links.unionByName(linked(shared, sets, max(ROOM, 8 * (hashes or 0) // TURNS)))
    discard(sets)
    out = durable(components(links))
    release(spark)
    return out


def near_copy_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of near copies: that of the smallest id, rows without an id last.

    Texts of equal words are copies, those without words too. Repeated ids are rows of their own texts' groups.
    """
    ship(df.sparkSession)
    return one_of_each(df, node_column(F.col(text_col)), durable(near_copy_roots(df, text_col)), id_col, text_col)
