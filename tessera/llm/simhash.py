"""SimHash near-duplicates: fingerprints in Python, links by a self-join of the binary trie of fingerprints.

The trie's top levels are cut into nodes of one prefix. A pair of nodes whose prefixes differ in more bits than the
budget is never formed; each remaining pair is one group, in which both subtrees are traversed together, differing bits
are added up and branches beyond the budget are dropped. Only distinct fingerprints enter the join, and a group gives
the edges of a spanning forest, so thousands of copies cost no more than one row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.session import durable, ship

SEED = 42
#: A node of the trie's top holds at most about this many distinct fingerprints (8 bytes each), if 16 levels allow it.
NODE_ROWS = 1 << 20
LEAST_LEVELS, MOST_LEVELS = 6, 16
#: Node pairs looked at together, and links kept before they are folded into a forest.
FRONTIER, LINKS = 1 << 20, 1 << 21


def shingle_hashes(text: str | None, width: int = 3, seed: int = SEED) -> list[int]:
    """XXH64 of each run of width words, repeats included; of the whole sequence if there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    digest = xxhash.xxh64_intdigest
    starts = [0]
    starts += [e + 1 for e in ends[: len(words) - width]]
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :])]


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """64 majority bits of the shingles' hashes; 0 for a text without words."""
    return fingerprint_of(shingle_hashes(text, width, seed))


def fingerprint_of(hashes: list[int] | np.ndarray) -> int:
    if not len(hashes):
        return 0
    h = np.array(hashes, dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded for very long texts
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint_column(text: Column, width: int = 3, seed: int = SEED) -> Column:
    @pandas_udf("long")
    def kernel(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t if isinstance(t, str) else None, width, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return kernel(text)


def trie_links(a: np.ndarray, b: np.ndarray, depth: int, spent: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into sorted distinct a and b) within budget bits, by traversing both subtries together.

    a and b each share their first depth bits, which differ in spent bits between them; b may be a itself. A trie node
    is a range of the sorted array, its children are split off by binary search for the next bit.
    """
    same = a is b
    one = np.uint64(1)
    zero = np.zeros(1, dtype=np.int64)
    work = [(depth, zero, zero + len(a), zero, zero + len(b), zero.astype(np.int8) + np.int8(spent))]
    while work:
        d, al, ah, bl, bh, err = work.pop()
        if len(al) > FRONTIER:
            cut = len(al) // 2
            work += [(d, *(x[:cut] for x in (al, ah, bl, bh, err))), (d, *(x[cut:] for x in (al, ah, bl, bh, err)))]
            continue
        small = (ah - al) * (bh - bl) <= 4 if d < 64 else np.ones(len(al), dtype=bool)
        if small.any():
            for i in range(4):
                for j in range(4):
                    at = small & (al + i < ah) & (bl + j < bh)
                    if not at.any():
                        continue
                    u, v = al[at] + i, bl[at] + j
                    near = np.bitwise_count(a[u] ^ b[v]) <= budget
                    if same:
                        near &= u < v
                    if near.any():
                        yield u[near], v[near]
            keep = ~small
            al, ah, bl, bh, err = (x[keep] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        shift = np.uint64(63 - d)
        am = np.clip(np.searchsorted(a, ((a[al] >> shift) | one) << shift), al, ah)
        bm = np.clip(np.searchsorted(b, ((b[bl] >> shift) | one) << shift), bl, bh)
        own = same & (al == bl)
        found = []
        for l1, h1, l2, h2, more, ok in ((al, am, bl, bm, 0, None), (am, ah, bm, bh, 0, None), (al, am, bm, bh, 1, None), (am, ah, bl, bm, 1, ~own)):
            at = (h1 > l1) & (h2 > l2) & (err + more <= budget)
            if ok is not None:
                at &= ok
            found.append((l1[at], h1[at], l2[at], h2[at], (err[at] + more).astype(np.int8)))
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*found))
        if len(al):
            work.append((d + 1, al, ah, bl, bh, err))


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index in the component of each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        label = label[label]
        if (label[u] == label[v]).all() and (label[label] == label).all():
            return label


def link_forest(a: np.ndarray, b: np.ndarray, depth: int, spent: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of all links between a and b (or within a, if b is a)."""
    same = a is b
    nodes = a if same else np.concatenate([a, b])
    us, vs, held = [], [], 0
    for u, v in trie_links(a, b, depth, spent, budget):
        us.append(u)
        vs.append(v if same else v + len(a))
        held += len(u)
        if held > LINKS:  # bounded memory in dense groups
            label = forest(len(nodes), np.concatenate(us), np.concatenate(vs))
            x = np.flatnonzero(label != np.arange(len(nodes)))
            us, vs, held = [x], [label[x]], 0
    if not us:
        return nodes[:0], nodes[:0]
    label = forest(len(nodes), np.concatenate(us), np.concatenate(vs))
    x = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[x], nodes[label[x]]


def near_links(prints: DataFrame, col: str, budget: int) -> DataFrame:
    """Spanning edges (u, v) of all pairs of distinct 64-bit values within budget bits. prints: distinct values of col."""
    ship(prints.sparkSession)
    tops = prints.groupBy(F.shiftrightunsigned(F.col(col), 64 - MOST_LEVELS).alias("top")).count().collect()  # at most 2**16 rows
    counts = np.zeros(1 << MOST_LEVELS, dtype=np.int64)
    for r in tops:
        counts[r["top"]] = r["count"]
    levels = next((p for p in range(LEAST_LEVELS, MOST_LEVELS) if counts.reshape(1 << p, -1).sum(axis=1).max() <= NODE_ROWS), MOST_LEVELS)
    masks = [sum(1 << i for i in bits) for k in range(budget + 1) for bits in combinations(range(levels), k)]
    top = F.shiftrightunsigned(F.col(col), 64 - levels)
    paired = prints.select(F.col(col).alias("fp"), top.alias("own"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask")).select(
        F.least("own", F.col("own").bitwiseXOR(F.col("mask"))).alias("lo"), F.greatest("own", F.col("own").bitwiseXOR(F.col("mask"))).alias("hi"), "fp"
    )

    def kernel(group: pa.Table) -> pa.Table:
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        fp = np.sort(group.column("fp").to_numpy().view(np.uint64))
        if lo == hi:
            u, v = link_forest(fp, fp, levels, 0, budget)
        else:
            cut = int(np.searchsorted(fp, np.uint64(hi << (64 - levels))))
            u, v = link_forest(fp[:cut], fp[cut:], levels, (lo ^ hi).bit_count(), budget)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return paired.groupBy("lo", "hi").applyInArrow(kernel, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (u, v): root is the smallest node of its component.

    Large-star and small-star rounds as aggregates and joins; a hub's edges are split by the join, not gathered. Each
    round is cut off durably, and the rounds end when one changes nothing.
    """
    ordered = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = durable(ordered(edges))
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = ordered(large)
        least = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("n")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = durable(ordered(small))
        if (mark_now := mark(now)) == seen:
            break
        seen = mark_now
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def simhash_groups(df: DataFrame, budget: int = 2, width: int = 3, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (signed long) and component_id: the smallest id reachable over links of at most budget differing bits.

    Null and empty texts have fingerprint 0 and link like any other. A null id takes part in its group; the group's id
    is its smallest non-null id, or null if it has none. Repeated rows stay rows. An empty table gives an empty result;
    other columns of df do not matter, whatever their names.
    """
    ship(df.sparkSession)
    prints = durable(df.select(F.col(id_col).alias("sh_id"), fingerprint_column(F.col(text_col), width, seed).alias("fp")))
    nodes = durable(prints.groupBy("fp").agg(F.min("sh_id").alias("sh_min")))
    roots = components(near_links(nodes, "fp", budget))
    linked = roots.join(nodes, F.col("node") == F.col("fp")).select("node", "root", "sh_min")
    least = linked.groupBy(F.col("root").alias("r")).agg(F.min("sh_min").alias("sh_least"))
    named = linked.join(least, F.col("root") == F.col("r")).select("node", "sh_least")
    ids = nodes.join(named, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("n_fp"), F.coalesce("sh_least", "sh_min").alias("component_id"))
    ids = durable(ids)  # both sides of the join are then plain exchanges, so that Spark can split a fingerprint of many copies
    return prints.join(ids, F.col("fp") == F.col("n_fp")).select(F.col("sh_id").alias(id_col), "fp", "component_id")


def simhash_dedup(df: DataFrame, budget: int = 2, width: int = 3, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group: that of the smallest id; of rows that share it, the one of least text hash.

    Rows without an id come last in their group, so groups without any id keep one row as well. All columns of df stay
    as they are.
    """
    ship(df.sparkSession)
    print_of = fingerprint_column(F.col(text_col), width, seed)
    nodes = durable(df.select(print_of.alias("fp")).distinct())
    return one_of_each(df, print_of, durable(components(near_links(nodes, "fp", budget))), id_col, text_col)


def one_of_each(df: DataFrame, node: Column, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first row of each group of df: rows of equal node, and of nodes of equal root in roots (node, root).

    First is the smallest id (null last), then the least hash of the text, then of the row.
    """
    plain = [c for c, kind in df.dtypes if "map<" not in kind]
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"), F.xxhash64(*plain).alias("all"))
    rows = df.select(node.alias("sh_node"), order.alias("sh_order"), F.struct(*[F.col(c) for c in df.columns]).alias("sh_row"))
    linked = roots.select(F.col("node").alias("sh_node"), F.col("root").alias("sh_root"))
    # the join's filter for nulls would make node a second time below it, with a second Python worker a task
    ordered = durable(rows.select("sh_node", "sh_order"))
    firsts = durable(ordered.join(linked, "sh_node").groupBy("sh_root", "sh_node").agg(F.min("sh_order").alias("sh_order")))
    best = firsts.groupBy("sh_root").agg(F.min(F.struct("sh_order", "sh_node")).alias("sh_best")).select("sh_root", F.col("sh_best.sh_node").alias("sh_first"))
    losers = firsts.join(best, "sh_root").where("sh_node != sh_first").select("sh_node")
    return rows.groupBy("sh_node").agg(F.min_by("sh_row", "sh_order").alias("sh_row")).join(losers, "sh_node", "left_anti").select("sh_row.*")
