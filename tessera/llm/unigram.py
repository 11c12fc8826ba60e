"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces and scores come from a public model file and are never trained. A text gets its white-space marker (U+2581
for each space, one in front), and the best-scoring split into pieces is found by Viterbi over a double-array trie;
a character that no piece covers falls back to its UTF-8 bytes. No piece of the model continues over a marker that
follows another character, so the text falls apart before such markers, and every stretch is decoded on its own: the
result is that of the whole text, and recurring stretches are looked up. New stretches of a batch go through the trie
together, one numpy step a character.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.llm.memo import claim
from tessera.session import ship

MARK = "▁"
#: Stretches in each of the two generations that a worker remembers; longer stretches than MEMO_CHARS are not kept.
MEMO, MEMO_CHARS = 60_000, 64
#: Characters that one batch of Viterbi holds in its tables at most (padding included).
BATCH_CHARS = 1 << 16
#: How far below the lowest score of any piece an unknown character scores (fixed value of the format).
UNKNOWN_PENALTY = 10.0


def read_model(data: bytes) -> tuple[list[tuple[str, float, int]], int]:
    """(piece, score, type) of a serialized model, and its kind.

    Field 1, repeated, holds piece 1, score 2 and type 3 (1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6
    byte); field 2 holds the kind in 3 (1 unigram, 2 merges).
    """

    def fields(buf: bytes):
        at = 0
        while at < len(buf):
            key, at = _varint(buf, at)
            if key & 7 == 2:
                n, at = _varint(buf, at)
                yield key >> 3, buf[at : at + n]
                at += n
            elif key & 7 == 5:
                yield key >> 3, buf[at : at + 4]
                at += 4
            elif key & 7 == 1:
                yield key >> 3, buf[at : at + 8]
                at += 8
            else:
                value, at = _varint(buf, at)
                yield key >> 3, value

    out, model_kind = [], 1
    for number, value in fields(data):
        if number == 2:
            model_kind = next((v for n, v in fields(value) if n == 3), 1)
        if number == 1:
            piece, score, kind = "", 0.0, 1
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out.append((piece, score, kind))
    return out, model_kind


def log_scores(scores: np.ndarray, model_kind: int) -> np.ndarray:
    """Log probabilities: a unigram model's scores as they are; of a merge model, whose scores only rank the pieces, by
    Zipf's law on the rank."""
    if model_kind == 1 or not len(scores):
        return scores
    rank = np.empty(len(scores))
    rank[np.argsort(-scores, kind="stable")] = np.arange(1, len(scores) + 1)
    return -np.log(rank) - np.log((1 / np.arange(1, len(scores) + 1)).sum())


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = buf[at]
        at += 1
        value |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return value, at


@dataclass
class DoubleArray:
    """Trie over code points: node s goes by symbol c to base[s] + c if check there is s; leaf holds the piece or -1."""

    symbols: dict[str, int]
    base: np.ndarray
    check: np.ndarray
    leaf: np.ndarray
    depth: int
    by_code: np.ndarray = field(default_factory=lambda: np.zeros(0x110000, dtype=np.int32))

    def __post_init__(self) -> None:
        self.by_code[[ord(c) for c in self.symbols]] = list(self.symbols.values())

    def symbols_of(self, text: str) -> np.ndarray:
        """Symbol of each code point, 0 for those in no piece."""
        return self.by_code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]

    @staticmethod
    def build(pieces: list[str], ids: list[int]) -> DoubleArray:
        symbols = {c: i + 1 for i, c in enumerate(sorted({c for p in pieces for c in p}))}
        tree: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for p, i in zip(pieces, ids):
            at = 0
            for c in p:
                nxt = tree[at].get(symbols[c])
                if nxt is None:
                    nxt = tree[at][symbols[c]] = len(tree)
                    tree.append({})
                    ends.append(-1)
                at = nxt
            ends[at] = i
        room = 2 * len(tree) + 4 * len(symbols) + 16
        base = np.zeros(room, dtype=np.int32)
        check = np.full(room, -1, dtype=np.int32)
        leaf = np.full(room, -1, dtype=np.int32)
        free = np.ones(room, dtype=bool)
        check[0], free[0] = 0, False
        since = [1] * 64  # by size class of a node: where free room is looked for
        queue = [(0, 0)]
        for node, slot in queue:
            kids = sorted(tree[node].items())
            if not kids:
                continue
            keys = np.array([c for c, _ in kids])
            low, size = since[len(keys).bit_length()], 256
            while True:
                if low + size + len(symbols) + 2 >= len(free):
                    more = len(free)
                    base, check, leaf = (np.concatenate([x, np.full(more, v, dtype=np.int32)]) for x, v in ((base, 0), (check, -1), (leaf, -1)))
                    free = np.concatenate([free, np.ones(more, dtype=bool)])
                places = np.flatnonzero(free[low : low + size]) + low - keys[0]
                places = places[places > 0]
                fits = np.flatnonzero(free[places[:, None] + keys].all(axis=1)) if len(places) else places
                if len(fits):
                    b = int(places[fits[0]])
                    break
                low += size
            since[len(keys).bit_length()] = low
            base[slot] = b
            free[b + keys] = False
            for c, kid in kids:
                check[b + c] = slot
                leaf[b + c] = ends[kid]
                queue.append((kid, b + c))
        return DoubleArray(symbols, base, check, leaf, max(map(len, pieces), default=0))

    def step(self, slots: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Slots after one symbol each; -1 where the trie has no way. Slot -1 and symbol 0 have none."""
        to = self.base[slots] + symbols
        ok = (slots >= 0) & (symbols > 0) & (to < len(self.check))
        to = np.where(ok, to, 0)
        return np.where(ok & (self.check[to] == slots) & (to > 0), to, -1)


@dataclass
class Unigram:
    pieces: list[str]
    scores: np.ndarray
    trie: DoubleArray
    byte_ids: np.ndarray  # id of each byte's piece, or of unknown
    unknown: int
    unknown_score: float
    memo: dict[str, bytes] = field(default_factory=dict)
    older: dict[str, bytes] = field(default_factory=dict)

    @staticmethod
    def load(data: bytes) -> Unigram:
        model, model_kind = read_model(data)
        normal = [i for i, (p, _, kind) in enumerate(model) if kind in (1, 4) and p]
        scores = np.array([s for _, s, _ in model], dtype=np.float64)
        scores[normal] = log_scores(scores[normal], model_kind)
        unknown = next((i for i, (_, _, kind) in enumerate(model) if kind == 2), 0)
        byte_ids = np.full(256, unknown, dtype=np.int32)
        for i, (p, _, kind) in enumerate(model):
            if kind == 6:
                byte_ids[int(p[1:-1], 16)] = i
        if any(MARK in model[i][0].lstrip(MARK) for i in normal):
            raise ValueError("a piece has a white-space marker behind another character")
        trie = DoubleArray.build([model[i][0] for i in normal], normal)
        return Unigram([p for p, _, _ in model], scores, trie, byte_ids, unknown, float(scores[normal].min()) - UNKNOWN_PENALTY)

    def viterbi(self, stretches: list[str]) -> list[bytes]:
        """Best pieces' ids of each stretch, as unsigned 32-bit little-endian bytes; all stretches together.

        Of equal scores the split found from the earlier start wins, so the last piece is the longest.
        """
        n, length = len(stretches), np.array([len(s) for s in stretches])
        most = int(length.max())
        text = np.zeros((n, most + 1), dtype=np.int32)
        text[np.arange(most + 1) < length[:, None]] = self.trie.symbols_of("".join(stretches))
        best = np.full((most + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((most + 1, n), dtype=np.int32)
        piece = np.full((most + 1, n), -1, dtype=np.int32)
        for at in range(most):
            rows = np.flatnonzero(length > at)
            slots = np.zeros(len(rows), dtype=np.int32)
            one = np.full(len(rows), -1, dtype=np.int32)
            for k in range(min(self.trie.depth, most - at)):
                slots = self.trie.step(slots, text[rows, at + k])
                alive = slots >= 0
                if k == 0:
                    one = np.where(alive, self.trie.leaf[np.maximum(slots, 0)], -1)
                    lone = rows[one < 0]
                    value = best[at, lone] + self.unknown_score
                    better = value > best[at + 1, lone]
                    lone = lone[better]
                    best[at + 1, lone], back[at + 1, lone], piece[at + 1, lone] = value[better], at, -1
                if not alive.any():
                    break
                rows, slots = rows[alive], slots[alive]
                leaf = self.trie.leaf[slots]
                ends = leaf >= 0
                r, p = rows[ends], leaf[ends]
                value = best[at, r] + self.scores[p]
                better = value > best[at + k + 1, r]
                r = r[better]
                best[at + k + 1, r], back[at + k + 1, r], piece[at + k + 1, r] = value[better], at, p[better]
        at, who = length.copy(), np.arange(n)
        taken = np.full((most, n), -2, dtype=np.int32)
        starts = np.zeros((most, n), dtype=np.int32)
        for k in range(most):
            live = at > 0
            if not live.any():
                break
            taken[k, live], starts[k, live] = piece[at[live], who[live]], back[at[live], who[live]]
            at = np.where(live, starts[k], 0)
        odd = (taken == -1).any(axis=0)
        flat = taken[::-1].T
        kept = flat >= 0
        ids = flat[kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        out = [ids[a:b] for a, b in zip([0, *ends], ends)]
        for i in np.flatnonzero(odd):  # byte fallback
            row: list[int] = []
            for p, start, end in zip(taken[::-1, i], starts[::-1, i], [*starts[-2::-1, i], length[i]]):
                if p >= 0:
                    row.append(p)
                elif p == -1:
                    row += [self.byte_ids[b] for b in stretches[i][start:end].encode("utf-8", "surrogatepass")]
            out[i] = np.array(row, dtype="<u4").tobytes()
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text, unsigned 32-bit; none for an empty one."""
        split = [stretches_of(t) for t in texts]
        memo, older, now = self.memo, self.older, {}
        fresh = []
        for s in {s for ws in split for s in ws}:
            if s not in memo:
                if s in older:
                    memo[s] = older[s]
                else:
                    fresh.append(s)
        fresh.sort(key=len)
        at = 0
        while at < len(fresh):
            end = at + 1
            while end < len(fresh) and (end - at + 1) * (len(fresh[end]) + 1) <= BATCH_CHARS:
                end += 1
            for s, ids in zip(fresh[at:end], self.viterbi(fresh[at:end])):
                (memo if len(s) <= MEMO_CHARS else now)[s] = ids
            at = end
        look = memo.__getitem__ if not now else lambda s: memo[s] if s in memo else now[s]
        out = [np.frombuffer(b"".join(map(look, ws)), dtype="<u4") for ws in split]
        if len(memo) > MEMO:  # the last two generations stay
            self.older, self.memo = memo, {}
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces, with runs of byte pieces as UTF-8, markers as spaces, the first one dropped."""
        text = b"".join(map(self.as_bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    @property
    def as_bytes(self) -> list[bytes]:
        if not hasattr(self, "_as_bytes"):
            out = [p.replace(MARK, " ").encode("utf-8") for p in self.pieces]
            for b in range(256):
                if self.byte_ids[b] != self.unknown:
                    out[self.byte_ids[b]] = bytes([b])
            self._as_bytes = out
        return self._as_bytes


_STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def stretches_of(text: str) -> list[str]:
    """The marked text, cut before every run of markers."""
    return _STRETCH.findall(MARK + text.replace(" ", MARK)) if text else []


_loaded: dict[int, Unigram] = {}

RESULT = "n_pieces long, n_bytes long, ids_crc32 long, decoded_crc32 long, round_trip boolean"


def digest_texts(model: bytes, texts: list[str | None], keep_ids: bool = False) -> pd.DataFrame:
    """RESULT of each text: pieces, how many are bytes, crc32 of the ids (unsigned 32-bit little-endian), of the decoded text."""
    unigram = loaded(model)
    is_byte = np.zeros(len(unigram.pieces), dtype=bool)
    is_byte[unigram.byte_ids[unigram.byte_ids != unigram.unknown]] = True
    rows, kept = [], []
    for at in range(0, len(texts), 64):
        part = [t or "" for t in texts[at : at + 64]]
        for text, ids in zip(part, unigram.encode_batch(part)):
            back = unigram.decode(ids.tolist())
            if keep_ids:
                kept.append(ids.astype(np.int32))
            # a marker in the text itself comes back as a space
            rows.append((len(ids), int(is_byte[ids].sum()), zlib.crc32(ids.tobytes()), zlib.crc32(back.encode("utf-8", "surrogatepass")), back == text.replace(MARK, " ")))
    out = pd.DataFrame(rows, columns=[f.split()[0] for f in RESULT.split(", ")])
    return out.assign(ids=pd.Series(kept, dtype=object)) if keep_ids else out


def model_file(path: str | None) -> bytes:
    """The model's bytes, read on the driver; by default the public model with byte fallback."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode_column(spark: SparkSession, text: Column, model: bytes) -> Column:
    """Ids of each whole text as array<int>; an empty array for null and empty texts."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("array<int>")
    def kernel(texts: pd.Series) -> pd.Series:
        return pd.Series(encode_texts(shared.value, [t if isinstance(t, str) else None for t in texts]), dtype=object)

    return kernel(text)


def decode_column(spark: SparkSession, ids: Column, model: bytes) -> Column:
    """Text of each array of ids; empty for null."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("string")
    def kernel(rows: pd.Series) -> pd.Series:
        unigram = loaded(shared.value)
        return pd.Series([unigram.decode(list(r)) if r is not None else "" for r in rows], dtype=object)

    return kernel(ids)


def loaded(model: bytes) -> Unigram:
    claim("unigram", _loaded.clear)
    key = zlib.crc32(model)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Unigram.load(model)
    return _loaded[key]


def encode_texts(model: bytes, texts: list[str | None]) -> list[np.ndarray]:
    unigram, out = loaded(model), []
    for at in range(0, len(texts), 64):
        out += unigram.encode_batch([t or "" for t in texts[at : at + 64]])
    return [x.astype(np.int32) for x in out]


def sentencepiece_digest(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, also: Sequence[str] = ()) -> DataFrame:
    """id, the columns named in also, RESULT of every row's whole text, encoded and decoded again, and with keep_ids ids.

    Null and empty texts have no pieces and decode to the empty text. A literal U+2581 counts as a space. Repeated rows
    stay rows; an empty table gives an empty result; other columns do not matter.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model_file(path))  # the file's size: half a megabyte

    @pandas_udf(RESULT + ", ids array<int>" * keep_ids)
    def kernel(texts: pd.Series) -> pd.DataFrame:
        return digest_texts(shared.value, [t if isinstance(t, str) else None for t in texts], keep_ids)

    return df.select(F.col(id_col), *also, kernel(F.col(text_col)).alias("r")).select(F.col(id_col), *also, "r.*")
