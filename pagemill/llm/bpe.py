"""Byte-level BPE encoding and decoding by a rank file.

A text is cut into pieces by a pattern. Each piece starts as single bytes; the adjacent pair whose
joined bytes have the lowest rank is merged, the leftmost first among equals, until no pair has a
rank. A segment tree over the byte positions of a piece holds ``rank * size + position`` of each
live pair at its leaf and the least key below at each inner node: its root is the leftmost minimum.
A merge changes three leaves (the merged pair, the pair before it, the swallowed one), so it costs
three paths of logarithmic length. Short pieces are run through their trees in batches by numpy,
all pieces of one batch one merge at a time; long ones have a tree of their own.

Null texts are encoded as the empty text: no ids, empty bytes. Rows are kept as they are, repeated
ones too; other columns are not looked at.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import ship, trimmed

#: White space as the pattern's \s sees it (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A chunk starts where a match of the pattern must start, whatever stands before it.
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Pieces of more bytes get a tree of their own.
LONG = 256
#: Chunks kept with their ids by a worker, and the longest of them.
KEPT, KEPT_CHARS = 100_000, 64
#: Rows handed back at once; texts are worked on in slices of so many characters.
PART = 1024
SLICE = 1_500_000
NONE = np.int64(1) << 60


class Ranks:
    """A rank file: lines of base64 bytes and a rank."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.letters = r" ?\p{L}+|" in pattern
        self.bytes_of = {r: t for t, r in self.rank.items()}
        self.single = np.array([self.rank[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.rank.items():
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank
        self.table(pairs)
        self.of_bytes = self.of_pairs(self.single.repeat(256), np.tile(self.single, 256))
        self.kept: dict[str, bytes] = {}
        self.met: set[str] = set()

    def table(self, pairs: dict[int, int]) -> None:
        """An open-addressed table of pairs, at most a quarter full; ``probes`` steps find any that is there."""
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        self.bits = max(4, (4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1), np.full(size, NONE)
        at, left, self.probes = self.place(keys), np.arange(len(keys)), 0
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            done = self.keys[at[left]] == keys[left]
            self.values[at[left[done]]] = values[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & (size - 1)
            self.probes += 1

    @functools.cached_property
    def pairs(self) -> dict[int, int]:
        """The table as a dictionary, for the first long piece."""
        on = self.keys >= 0
        return dict(zip(self.keys[on].tolist(), self.values[on].tolist(), strict=True))

    def place(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = self.place(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], NONE)
        more = np.nonzero((found != key) & (found >= 0))
        for _ in range(self.probes - 1):
            if not len(more[0]):
                break
            at_more = (at[more] + 1) & (len(self.keys) - 1)
            at[more] = at_more
            found = self.keys[at_more]
            out[more] = np.where(found == key[more], self.values[at_more], NONE)
            more = tuple(m[(found != key[more]) & (found >= 0)] for m in more)
        return out


def merge_batch(ranks: Ranks, pieces: list[bytes], size: int) -> list[bytes]:
    """The ids of pieces of 2 to ``size`` bytes; size is a power of two."""
    n, depth = len(pieces), size.bit_length() - 1
    lengths = np.fromiter(map(len, pieces), np.int64, n)
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
    ids = np.zeros((n, size + 1), np.int64)
    ids[:, :size] = ranks.single[raw]
    after = np.minimum(np.arange(1, size + 2), size)[None, :].repeat(n, 0)
    after[np.arange(n), lengths - 1] = size
    before = np.arange(-1, size)[None, :].repeat(n, 0)
    position = np.arange(size)
    live = position[None, :] < lengths[:, None]
    tree = np.full((n, 2 * size), NONE)
    rank = ranks.of_bytes[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]]
    paired = (position[None, 1:] < lengths[:, None]) & (rank < NONE)
    tree[:, size : 2 * size - 1] = np.where(paired, rank * size + position[:-1], NONE)
    for level in range(depth - 1, -1, -1):
        low = 1 << level
        tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
    flat_tree, flat_ids, flat_after, flat_before, flat_live = (x.reshape(-1) for x in (tree, ids, after, before, live))
    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        t, w, root = rows * (2 * size), rows * (size + 1), flat_tree[rows * (2 * size) + 1]
        at, new = root & (size - 1), root >> depth
        gone = flat_after[w + at]
        then = flat_after[w + gone]
        prior = flat_before[w + at]
        flat_ids[w + at] = new
        flat_after[w + at] = then
        flat_before[w + then] = at
        flat_live[rows * size + gone] = False
        flat_tree[t + size + gone] = NONE
        right = ranks.of_pairs(new, flat_ids[w + then])
        flat_tree[t + size + at] = np.where((then < size) & (right < NONE), right * size + at, NONE)
        has = prior >= 0
        p = np.maximum(prior, 0)
        left = ranks.of_pairs(flat_ids[w + p], new)
        p = np.where(has, p, at)
        flat_tree[t + size + p] = np.where(has, np.where(left < NONE, left * size + p, NONE), flat_tree[t + size + p])
        for leaf in (gone, at, p):
            node = (size + leaf) >> 1
            for _ in range(depth):
                flat_tree[t + node] = np.minimum(flat_tree[t + 2 * node], flat_tree[t + 2 * node + 1])
                node >>= 1
        rows = rows[flat_tree[t + 1] < NONE]
    out = ids[:, :size][live].astype("<u4").tobytes()
    ends = np.cumsum(live.sum(1)) * 4
    return [out[a:b] for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True)]


def merge_long(ranks: Ranks, piece: bytes) -> bytes:
    """The ids of one piece of any length, by a segment tree in lists."""
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    none, pairs = int(NONE), ranks.pairs
    ids = ranks.single[np.frombuffer(piece, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    live = bytearray(b"\1") * n
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = pairs.get((ids[i] << 32) | ids[i + 1])
        if r is not None:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, key: int) -> None:
        k = size + i
        tree[k] = key
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while tree[1] != none:
        new, at = divmod(tree[1], size)
        gone = after[at]
        then, prior = after[gone], before[at]
        ids[at], after[at], live[gone] = new, then, 0
        put(gone, none)
        r = None
        if then < n:
            before[then] = at
            r = pairs.get((new << 32) | ids[then])
        put(at, none if r is None else r * size + at)
        if prior >= 0:
            r = pairs.get((ids[prior] << 32) | new)
            put(prior, none if r is None else r * size + prior)
    return np.array([x for x, on in zip(ids, live, strict=True) if on], dtype="<u4").tobytes()


def merge_pieces(ranks: Ranks, pieces: Iterable[bytes]) -> dict[bytes, bytes]:
    """Ids, as little-endian unsigned 32-bit integers, of each distinct piece."""
    out: dict[bytes, bytes] = {}
    by_size: dict[int, list[bytes]] = {}
    for p in set(pieces):
        whole = ranks.rank.get(p)
        if whole is not None:
            out[p] = whole.to_bytes(4, "little")
        elif len(p) > LONG:
            out[p] = merge_long(ranks, p)
        else:
            by_size.setdefault(1 << max(1, (len(p) - 1).bit_length()), []).append(p)
    for size, some in by_size.items():
        step = max(1, (1 << 17) // size)
        for i in range(0, len(some), step):
            part = some[i : i + step]
            out.update(zip(part, merge_batch(ranks, part, size), strict=True))
    return out


def encode_texts(ranks: Ranks, texts: list[str | None]) -> list[bytes]:
    """The ids of whole texts. A worker remembers the ids of chunks that it met in two slices of its texts."""
    out: list[bytes] = []
    start = 0
    known = ranks.kept
    while start < len(texts):
        stop, chars = start, 0
        while stop < len(texts) and (stop == start or chars < SLICE):
            chars += len(texts[stop] or "")
            stop += 1
        cut = [CHUNK.findall(t) if t else [] for t in texts[start:stop]]
        fresh = list(set().union(*cut).difference(known))
        find = ranks.pattern.findall
        # Letters alone, or after a space, are one match of the pattern.
        pieces = [[c.encode()] if ranks.letters and c.lstrip(" ").isalpha() and c[1:].isalpha() else [m.encode() for m in find(c)] for c in fresh]
        get = merge_pieces(ranks, (p for ps in pieces for p in ps)).__getitem__
        known.update(zip(fresh, (b"".join(map(get, ps)) for ps in pieces), strict=True))
        get = known.__getitem__
        out += [b"".join(map(get, cs)) for cs in cut]
        room = KEPT - len(known) + len(fresh)
        once = [c for c in fresh if len(c) > KEPT_CHARS or c not in ranks.met]
        for c in once if room > len(fresh) - len(once) else fresh:
            del known[c]
        if len(ranks.met) > KEPT:
            ranks.met.clear()
        ranks.met.update(c for c in once if len(c) <= KEPT_CHARS)
        start = stop
    return out


def forgetting(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """batches; when they end, a worker keeps the ranks for its next task and gives up the chunks it remembered."""
    try:
        yield from batches
    finally:
        ranks = loaded(path, pattern)
        ranks.kept, ranks.met = {}, set()


def decode_ids(ranks: Ranks, ids: bytes) -> bytes:
    return b"".join(map(ranks.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], Ranks] = {}


def loaded(path: str, pattern: str) -> Ranks:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Ranks(path, pattern)
    return _LOADED[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens long, ids binary: little-endian unsigned 32-bit ids of every whole text.

    path: the rank file, which every node must have. No special tokens. A null or empty text gives 0
    tokens and empty ids. Rows with a null key, repeated rows and keys stay as they are.
    """
    ship(df.sparkSession)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = loaded(path, pattern)
        for b in batches:
            ids = encode_texts(ranks, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[key, "n_tokens", "ids"])

    schema = f"`{key}` {kind.simpleString()}, n_tokens long, ids binary"
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(lambda b: trimmed(forgetting(run(b), path, pattern)), schema)


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, n_tokens, ids, decoded binary: the bytes of the ids that ``encode`` returned."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = loaded(path, pattern)
        for b in batches:
            out = [decode_ids(ranks, x or b"") for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], names=[key, "n_tokens", "ids", "decoded"])

    schema = f"`{key}` {kind.simpleString()}, n_tokens long, ids binary, decoded binary"
    return df.select(F.col(key), F.col("n_tokens"), F.col(ids).alias("ids")).mapInArrow(lambda b: trimmed(forgetting(run(b), path, pattern)), schema)


def round_trips(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 (and ids): what encode gives and decode gives back, as digests.

    Both run in one worker, so that ids and bytes don't cross to the JVM and back. Rows as encode's.
    """
    ship(docs.sparkSession)
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = loaded(path, pattern)
        for b in batches:
            for start in range(0, b.num_rows, PART):
                part = b.slice(start, PART)
                found = encode_texts(ranks, part.column(1).to_pylist())
                back = [hashlib.sha256(decode_ids(ranks, x)).hexdigest() for x in found]
                columns = [part.column(0), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())] if with_ids else columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(lambda b: trimmed(forgetting(run(b), path, pattern)), schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, encoded and then decoded."""
    return round_trips(docs, path, pattern)
