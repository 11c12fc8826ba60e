"""Token ids in shards, each one compressed file image that holds a wavelet matrix.

A shard maps its distinct ids to ranks and stores the ranks' bits plane by plane, from the most significant one: behind
each plane the tokens are dealt stably, zeros first. Planes with running counts of ones give rank and select, and so
access to any token, counts of an id up to a place, and all its places, from the file alone. Planes and counts are
compressed; a table of documents closes the image. Spark writes the images as rows of a Parquet dataset, so that they
reach any shared store and a lost executor's shards are written anew.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.memo import claim
from tessera.session import checkpoint_dir, ship

MAGIC, END_ID = b"WMSHARD1", 2
#: Tokens at which a shard is closed; documents stay whole.
SHARD_TOKENS = 1 << 20
#: Bits between two stored counts of ones.
BLOCK = 512
#: Parts of texts in each of the two generations that a worker remembers; longer ones than MEMO_CHARS are not kept.
MEMO, MEMO_CHARS = 700_000, 48
#: Marks that end a part, none a letter, digit or apostrophe; letters that every version of Unicode takes for such, behind
#: which the pre-tokenizer cuts before a mark; different runs of marks that are remembered.
END_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS = frozenset(c for c in map(chr, range(0x250)) if c.isalpha())
MARKS = 10_000


def pack_shard(tokens: np.ndarray, doc_ids: list[int | None], doc_tokens: list[int]) -> bytes:
    """File image of tokens (unsigned) with its documents in order."""
    high = int(tokens.max()) + 1 if len(tokens) else 1
    present = np.flatnonzero(np.bincount(tokens, minlength=high)) if len(tokens) else np.zeros(0, dtype=np.int64)
    ranks = np.zeros(high, dtype=np.uint16 if len(present) <= 1 << 16 else np.uint32)
    ranks[present] = np.arange(len(present))
    x = ranks[tokens] if len(tokens) else ranks[:0]
    levels = max(1, int(max(1, len(present)) - 1).bit_length())
    squeeze = zstandard.ZstdCompressor(level=1).compress
    parts, zeros = [], []
    for level in range(levels - 1, -1, -1):
        ones = (x & ranks.dtype.type(1 << level)) != 0
        packed = np.packbits(ones)
        counts = np.bitwise_count(packed.view()).astype(np.uint16)
        step = BLOCK // 8
        sums = np.add.reduceat(counts, np.arange(0, len(counts), step), dtype=np.uint32) if len(counts) else np.zeros(0, dtype=np.uint32)
        before = (np.cumsum(sums, dtype=np.uint32) - sums).astype("<u4")
        parts += [squeeze(packed.tobytes()), squeeze(before.tobytes())]
        low = np.flatnonzero(~ones)  # places and take(): several times faster than a mask here
        zeros.append(len(low))
        x = np.concatenate([x.take(low), x.take(np.flatnonzero(ones))])
    known = np.array([d is not None for d in doc_ids], dtype=bool)
    parts += [
        squeeze(present.astype("<u4").tobytes()),
        squeeze(np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes()),
        squeeze(np.packbits(known).tobytes()),
        squeeze(np.array(doc_tokens, dtype="<u8").tobytes()),
    ]
    head = json.dumps({"n": len(tokens), "docs": len(doc_ids), "levels": levels, "zeros": zeros, "sizes": [len(p) for p in parts]}).encode()
    body = struct.pack("<I", len(head)) + head + b"".join(parts)
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


@dataclass
class Shard:
    """A file image, opened. Places count from 0; rank(c, i) is how often id c stands before place i."""

    n: int
    planes: list[np.ndarray]
    before: list[np.ndarray]
    zeros: list[int]
    present: np.ndarray
    doc_ids: list[int | None]
    doc_tokens: np.ndarray

    @staticmethod
    def open(image: bytes) -> Shard:
        if image[:8] != MAGIC or zlib.crc32(image[12:]) != struct.unpack("<I", image[8:12])[0]:
            raise ValueError("no shard, or a damaged one")
        size = struct.unpack("<I", image[12:16])[0]
        head = json.loads(image[16 : 16 + size])
        at, parts = 16 + size, []
        expand = zstandard.ZstdDecompressor().decompress
        for n in head["sizes"]:
            parts.append(expand(image[at : at + n]))
            at += n
        levels = head["levels"]
        known = np.unpackbits(np.frombuffer(parts[-2], dtype=np.uint8), count=head["docs"]).astype(bool) if head["docs"] else []
        ids = np.frombuffer(parts[-3], dtype="<i8")
        return Shard(
            head["n"],
            [np.frombuffer(parts[2 * k], dtype=np.uint8) for k in range(levels)],
            [np.frombuffer(parts[2 * k + 1], dtype="<u4") for k in range(levels)],
            head["zeros"],
            np.frombuffer(parts[2 * levels], dtype="<u4"),
            [int(i) if k else None for i, k in zip(ids, known)],
            np.frombuffer(parts[-1], dtype="<u8").astype(np.int64),
        )

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before place i."""
        if i >= self.n:
            return self.n - self.zeros[k]
        block = i // BLOCK
        byte = i // 8
        inside = int(np.bitwise_count(self.planes[k][block * BLOCK // 8 : byte]).sum())
        return int(self.before[k][block]) + inside + (int(self.planes[k][byte]) >> (8 - i % 8)).bit_count()

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(len(self.planes)):
            bit = int(self.planes[k][i // 8]) >> (7 - i % 8) & 1
            ones = self._ones(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return int(self.present[value])

    def _rank_of(self, c: int) -> int | None:
        at = int(np.searchsorted(self.present, c))
        return at if at < len(self.present) and self.present[at] == c else None

    def _range(self, c: int, i: int) -> tuple[int, int]:
        """Where behind the last plane the occurrences of c before place i stand."""
        r, lo, hi = self._rank_of(c), 0, min(i, self.n)
        if r is None:
            return 0, 0
        for k in range(len(self.planes)):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if r >> (len(self.planes) - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, c: int, i: int) -> int:
        lo, hi = self._range(c, i)
        return hi - lo

    def count(self, c: int) -> int:
        return self.rank(c, self.n)

    def _select(self, k: int, bit: int, nth: int) -> int:
        """Place of the nth (from 0) bit of plane k, by binary search over the counts of blocks."""
        blocks = np.arange(len(self.before[k])) * BLOCK
        seen = self.before[k].astype(np.int64) if bit else blocks - self.before[k]
        block = int(np.searchsorted(seen, nth, side="right")) - 1
        bits = np.unpackbits(self.planes[k][block * BLOCK // 8 : (block + 1) * BLOCK // 8])[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[nth - int(seen[block])])

    def select(self, c: int, nth: int) -> int:
        """Place of the nth occurrence (from 0) of id c."""
        lo, hi = self._range(c, self.n)
        if not 0 <= nth < hi - lo:
            raise IndexError(nth)
        r, at = self._rank_of(c), lo + nth
        for k in range(len(self.planes) - 1, -1, -1):
            bit = r >> (len(self.planes) - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros[k] if bit else at)
        return at

    def places(self, c: int) -> list[int]:
        return [self.select(c, k) for k in range(self.count(c))]

    def tokens(self) -> np.ndarray:
        """All ids in order, by undoing the planes' deals from the last one."""
        kind = np.uint16 if len(self.present) <= 1 << 16 else np.uint32
        x = np.zeros(self.n, dtype=kind)
        for k in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[k], count=self.n).view(bool)
            y = np.empty_like(x)
            y[np.flatnonzero(~ones)] = x[: self.zeros[k]]
            y[np.flatnonzero(ones)] = x[self.zeros[k] :] | kind(1 << (len(self.planes) - 1 - k))
            x = y
        return self.present[x] if self.n else self.present[:0]


class Encoder:
    """Ids of whole texts by a byte-level BPE tokenizer, with a memory of recurring parts.

    The pre-tokenizer always starts a token at a space or line feed between two characters that are no white space, so a
    text may be cut there and each part encoded by itself; a line feed stays with the part behind it. It also cuts between
    a letter and the marks that end a part, so the word is remembered without them and the marks by themselves. New parts
    are encoded in runs and told apart by their tokens' bytes.
    """

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the executor's other cores have tasks of their own
        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        alphabet = {c: b for b, c in enumerate(_byte_characters())}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for piece, i in vocabulary.items():
            self.sizes[i] = len(piece) if all(c in alphabet for c in piece) else 0
        self.kind = np.dtype("<u2") if len(self.sizes) <= 1 << 16 else np.dtype("<u4")
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of a space and each part, or of the part alone if it starts with a line feed; parts have no other white space
        at their ends and are more than that."""
        found = {}
        for mark in " \n":
            some = [p for p in parts if (p[0] == "\n") == (mark == "\n")]
            for at in range(0, len(some), 8192):
                runs = [some[i : i + 256] for i in range(at, min(at + 8192, len(some)), 256)]
                joined = [" " + " ".join(r) if mark == " " else "".join(r) for r in runs]
                for run, text, ids in zip(runs, joined, self.plain(joined)):
                    raw = np.frombuffer((text + mark).encode("utf-8"), dtype=np.uint8)
                    cuts = np.searchsorted(np.cumsum(self.sizes[ids]), np.flatnonzero(raw == ord(mark))[1:]) + 1  # a part has no mark within
                    ends = (cuts * self.kind.itemsize).tolist()
                    data = ids.tobytes()
                    found.update(zip(run, [data[a:b] for a, b in zip([0, *ends], ends)]))
        return found

    def end(self, marks: str) -> bytes:
        """Ids of marks behind a letter."""
        found = self.ends.get(marks)
        if found is None:
            found = self.plain([marks])[0].tobytes()
            if len(self.ends) < MARKS:
                self.ends[marks] = found
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text: one look-up a part, then the batch's new parts are encoded and filled in."""
        get, older = self.memo.get, self.older
        split, rows, gaps, slow, fresh, marked = [], [], [], set(), {}, {}
        for i, t in enumerate(texts):
            parts = t.replace("\n", " \n").split(" ")
            row = list(map(get, parts))
            row[0] = b""
            gap = []
            for k in [k for k, ids in enumerate(row) if ids is None]:
                p = parts[k]
                ids = older.get(p)
                if ids is None:
                    word = p.rstrip(END_MARKS)
                    split_off = len(word) < len(p) and word and word[-1] in LETTERS
                    known = (get(word) or older.get(word)) if split_off else None
                    if known is None:
                        bare = p[1:] if p[:1] == "\n" else p
                        if not bare or bare != bare.strip():
                            slow.add(i)  # white space beside a space: no safe place to cut
                            break
                        if split_off:
                            fresh[word] = None
                            marked[p] = word
                        else:
                            fresh[p] = None
                        gap.append(k)
                        continue
                    ids = known + self.end(p[len(word) :])
                row[k] = ids
                if len(p) <= MEMO_CHARS:
                    self.memo[p] = ids
            if parts[0] != parts[0].rstrip():
                slow.add(i)
            split.append(parts)
            rows.append(row)
            gaps.append(gap)
        new = self.learn(list(fresh))
        new.update([(p, new[word] + self.end(p[len(word) :])) for p, word in marked.items()])
        self.memo.update(new if max(map(len, new), default=0) <= MEMO_CHARS else {p: ids for p, ids in new.items() if len(p) <= MEMO_CHARS})
        whole = iter(self.plain([t if i in slow else split[i][0] for i, t in enumerate(texts)]))
        out = []
        for i, (parts, row, gap) in enumerate(zip(split, rows, gaps)):
            ids = next(whole)
            if i not in slow:
                row[0] = ids.tobytes()
                for k in gap:
                    row[k] = new[parts[k]]
                ids = np.frombuffer(b"".join(row), dtype=self.kind)
            out.append(ids)
        if len(self.memo) > MEMO:
            self.older, self.memo = self.memo, {}
        return out


def _byte_characters() -> str:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next free from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return "".join(out)


_encoders: dict[int, Encoder] = {}


def encoder(file: str) -> Encoder:
    claim("wavelet", _encoders.clear)
    key = zlib.crc32(file.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(file)
    return _encoders[key]


SHARDS = "part int, seq int, n_docs long, n_tokens long, image binary"
DOCS = "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(columns)], names=[n for n, _ in columns])


def range_of(value: Column, cuts: list[int], or_equal: bool = False) -> Column:
    """How many of the sorted cuts are below value (or equal to it), by binary search; 0 for null. Unlike a range exchange
    this takes no sampling pass over the texts."""
    if not cuts:
        return F.lit(0)
    steps = len(cuts).bit_length()
    padded = F.array(*[F.lit(c).cast("long") for c in cuts + [(1 << 63) - 1] * ((1 << steps) - 1 - len(cuts))])
    found = F.aggregate(F.array(*[F.lit(1 << s) for s in range(steps - 1, -1, -1)]), F.lit(0), lambda at, step: F.when(F.get(padded, at + step - 1) <= value if or_equal else F.get(padded, at + step - 1) < value, at + step).otherwise(at))
    return F.coalesce(F.when(value.isNotNull(), found), F.lit(0))


def write_shards(df: DataFrame, target: str, file: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, end_id behind each, in ascending order of id, and write the shards to the dataset target.

    Documents' bounds are kept beside the bit-planes: end_id may stand within a text as well, so it marks no bound.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(file)  # the tokenizer's file: some two megabytes

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(shared.value), TaskContext.get().partitionId(), 0
        held, ids, sizes, total = [], [], [], 0
        for b in batches:
            names, texts = b.column("w_id").to_pylist(), b.column("w_text")
            for at in range(0, len(names), 128):
                part_ids = enc.encode([t or "" for t in texts[at : at + 128].to_pylist()])
                for name, x in zip(names[at : at + 128], part_ids):
                    held += [x, np.array([end_id], dtype=enc.kind)]
                    ids.append(name)
                    sizes.append(len(x) + 1)
                    total += len(x) + 1
                    if total >= shard_tokens:
                        yield _batch(SHARDS, [(part, seq, len(ids), total, pack_shard(np.concatenate(held), ids, sizes))])
                        held, ids, sizes, total, seq = [], [], [], 0, seq + 1
        if ids:
            yield _batch(SHARDS, [(part, seq, len(ids), total, pack_shard(np.concatenate(held), ids, sizes))])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ident = F.col(id_col).cast("long")
    cuts = F.percentile_approx(ident, [i / n for i in range(1, n)], 10_000) if n > 1 else F.array().cast("array<long>")
    stats = df.agg(cuts.alias("q"), F.count(F.lit(1)).alias("all"), F.count(ident).alias("known")).first()
    cuts, lone = list(stats["q"] or []), stats["all"] - stats["known"]
    lone_parts = max(1, round(n * lone / stats["all"])) if lone else 0
    # rows without an id come first, in parts by the hash of their text; so do those of an id that spans several cuts
    share = lambda parts: F.floor(F.col("w_hash") / F.lit(float(1 << 62)) * parts).cast("int")
    low, high = range_of(F.col("w_id"), cuts), range_of(F.col("w_id"), cuts, True)
    part = F.when(F.col("w_id").isNull(), F.least(share(F.lit(lone_parts)), F.lit(max(0, lone_parts - 1)))).otherwise(F.lit(lone_parts) + F.when(high - low > 1, F.least(low + share(high - low), high - 1)).otherwise(low))
    rows = df.select(ident.alias("w_id"), F.col(text_col).alias("w_text"), F.shiftrightunsigned(F.xxhash64(text_col), 2).alias("w_hash"))
    dealt = rows.repartitionById(max(1, lone_parts + len(cuts) + 1), part)
    dealt.sortWithinPartitions("w_id", "w_hash").select("w_id", "w_text").mapInArrow(kernel, SHARDS).write.option("compression", "none").parquet(target)


def read_shards(spark, source: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the shards in the dataset source."""
    ship(spark)
    shards = spark.read.parquet(source)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, seq, image = b.column("part").to_pylist(), b.column("seq").to_pylist(), b.column("image")
            for r in range(b.num_rows):
                shard = Shard.open(image[r].as_py())
                tokens, at, rows = shard.tokens().astype("<u4", copy=False), 0, []
                for name, n in zip(shard.doc_ids, shard.doc_tokens.tolist()):
                    rows.append((part[r], seq[r], name, at, n, zlib.crc32(tokens[at : at + n])))
                    at += n
                yield _batch(DOCS, rows)

    docs = shards.select("part", "seq", "image").mapInArrow(kernel, DOCS)
    past = lambda *by: Window.partitionBy(*by).orderBy("part" if not by else "seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("part_start", F.coalesce(F.sum("n").over(past()), F.lit(0)))
    starts = (
        shards.select("part", "seq", "n_tokens")
        .join(parts.select("part", "part_start"), "part")
        .select(F.col("part").alias("s_part"), F.col("seq").alias("s_seq"), (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(past("part")), F.lit(0))).alias("s_start"))
    )
    joined = docs.join(starts, (F.col("part") == F.col("s_part")) & (F.col("seq") == F.col("s_seq")))
    return joined.select("doc_id", (F.col("s_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_shards(df: DataFrame, path: str | None = None, target: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write df's shards to target (by default a new folder beside the checkpoints) and read every document back.

    Null and empty texts have the end id alone. Null ids come first; rows of one id are ordered by the hash of their
    text and stay rows. An empty table gives an empty result; other columns do not matter.
    """
    spark = df.sparkSession
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        file = f.read()
    target = target or f"{checkpoint_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    write_shards(df, target, file, end_id, shard_tokens, id_col, text_col)
    return read_shards(spark, target)
