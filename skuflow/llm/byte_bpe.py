"""Byte-level BPE encoding and decoding in two tiers.

A text is cut into pre-tokens by the classes of its code points, for a whole piece of the table at once. Equal
pre-tokens of a piece are looked up once: a minimal perfect hash finds those that are in the vocabulary as they
stand; for the others a heap of neighbouring pairs over linked bytes applies the merges in rank order, and a bounded
memory keeps the results for later pieces.

Defined cases: a null text is an empty one and has no ids; special tokens are ordinary text; repeated rows get the
same ids; decoding ids that the vocabulary lacks is an error. Other columns are passed through; the new column must
have a free name.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from skuflow.llm.text_arrays import Texts, mix, pieces, span_hash

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Results of merges that a Python worker keeps; ids that it looks up and bytes that it decodes at a time.
MEMORY, LOOKED_UP, DECODED = 200_000, 1 << 18, 4 << 20
_CODE_POINTS = 0x110000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token to rank, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def class_table() -> np.ndarray:
    """Class of every code point, as the tokenizer library's own expressions see it."""
    table = np.full(_CODE_POINTS, OTHER, np.uint8)
    points = [*range(0xD800), *range(0xE000, _CODE_POINTS)]
    text = "".join(map(chr, points))
    ranks = {bytes([b]): b for b in range(256)}
    for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        found = bytes(tiktoken.Encoding(str(kind), pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text))
        table[np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)] = kind
    return table


class PerfectHash(NamedTuple):
    """Minimal perfect hash by displacement: each key has a slot of its own, and every slot has a key."""

    shifts: np.ndarray
    size: int

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        n = len(hashes)
        buckets = max(1, n // 2)
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        shifts, taken = np.zeros(buckets, np.int64), np.zeros(n, bool)
        sizes = np.diff(edges)
        for b in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())]:
            keys = hashes[order[edges[b] : edges[b + 1]]]
            tried = 1
            while True:  # sixteen shifts at a time
                slots = np.sort(_slots(keys, np.arange(tried, tried + 16)[:, None], n), axis=1)
                good = np.flatnonzero(~taken[slots].any(1) & (slots[:, 1:] != slots[:, :-1]).all(1))
                if len(good):
                    break
                tried += 16
            shifts[b], taken[slots[good[0]]] = tried + good[0], True
        alone = np.flatnonzero(sizes == 1)
        # What is left over goes to single keys, addressed directly by a negative shift.
        for b, slot in zip(alone, np.flatnonzero(~taken), strict=True):
            shifts[b] = -slot - 1
        return cls(shifts, n)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        shift = self.shifts[(hashes % np.uint64(len(self.shifts))).astype(np.int64)]
        return np.where(shift < 0, -shift - 1, _slots(hashes, shift, self.size))


def _slots(hashes: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    return (mix(hashes + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def _hash_keys(keys: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(k) for k in keys])
    return span_hash(np.frombuffer(b"".join(keys), np.uint8), ends - [len(k) for k in keys], ends)


class Vocabulary:
    """Ranks, classes and the perfect hash of a vocabulary; made on the driver, sent to the tasks (a few MB, by its size)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.classes = ranks, class_table()
        keys = sorted(ranks)
        hashes = _hash_keys(keys)
        if len(np.unique(hashes)) < len(keys):
            raise ValueError("two tokens share a hash")
        self.perfect = PerfectHash.build(hashes)
        self.tokens: list[bytes] = [b""] * len(keys)
        for key, slot in zip(keys, self.perfect.slots(hashes), strict=True):
            self.tokens[slot] = key
        self.ids = [ranks[t] for t in self.tokens]
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.token_ends = np.cumsum([len(t) for t in by_id])
        self.token_sizes = np.array([len(t) for t in by_id])
        self.token_bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self._memory: dict[bytes, list[int]] = {}

    def encode_token(self, token: bytes, slot: int) -> list[int]:
        if self.tokens[slot] == token:
            return [self.ids[slot]]
        found = self._memory.get(token)
        if found is None:
            if len(self._memory) >= MEMORY:
                self._memory.clear()
            found = self._memory[token] = merge(token, self.ranks)
        return found


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Joins the neighbouring parts of lowest rank, the leftmost first, until no pair is in the vocabulary."""
    n = len(token)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n + [False]
    heap = [(rank, at, at + 2) for at in range(n - 1) if (rank := ranks.get(token[at : at + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, at, end = heapq.heappop(heap)
        middle = after[at]
        if not alive[at] or middle >= n or after[middle] != end:
            continue  # one of the two parts has changed meanwhile
        after[at], alive[middle] = end, False
        if end < n:
            before[end] = at
            if (rank := ranks.get(token[at : after[end]])) is not None:
                heapq.heappush(heap, (rank, at, after[end]))
        if at > 0:
            left = before[at]
            if (rank := ranks.get(token[left:end])) is not None:
                heapq.heappush(heap, (rank, left, end))
    out, at = [], 0
    while at < n:
        out.append(ranks[token[at : after[at]]])
        at = after[at]
    return out


def pre_tokens(texts: Texts, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all pre-tokens, and the number of pre-tokens that start before each text's end (with a leading 0).

    A pre-token is a run of letters, of numbers or of other marks, with a single space before it if there is one; an
    apostrophe alone takes the ending of an English contraction; the rest of a run of blanks is one.
    """
    data, bounds = texts.data, texts.bounds
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    places = np.flatnonzero((data & 0xC0) != 0x80)
    edges = np.searchsorted(places, bounds)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    kind = classes[points]
    opens = np.zeros(n + 1, bool)
    opens[edges] = True
    opens = opens[:n]
    start = opens.copy()
    start[1:] |= kind[1:] != kind[:-1]
    follows = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~opens[1:]) + 1
    start[follows - 1] = True
    attached = points[follows - 1] == 32
    start[follows[attached]] = False
    mark = np.flatnonzero(points == 39)
    mark = mark[mark + 1 < n]
    mark = mark[start[mark] & (kind[mark + 1] == LETTER) & ~opens[mark + 1]]
    first = points[mark + 1]
    second = np.where(mark + 2 < n, points[np.minimum(mark + 2, n - 1)], 0)
    second = np.where((mark + 2 < n) & ~opens[np.minimum(mark + 2, n - 1)], second, 0)
    one = (first == ord("s")) | (first == ord("t")) | (first == ord("m")) | (first == ord("d"))
    two = ((second == ord("e")) & ((first == ord("r")) | (first == ord("v")))) | ((first == ord("l")) & (second == ord("l")))
    taken = np.where(one, 1, np.where(two, 2, 0))
    mark, taken = mark[taken > 0], taken[taken > 0]
    start[mark + 1] = False
    beyond = mark + 1 + taken
    start[beyond[beyond < n]] = True
    at = np.flatnonzero(start)
    return places[at], np.searchsorted(at, edges)


def _spread(values: np.ndarray, ends: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The ranges ``values[ends - sizes:ends]`` of the chosen entries behind one another."""
    n = sizes[chosen]
    shift = ends[chosen] - np.cumsum(n)
    return values[np.repeat(shift, n) + np.arange(int(n.sum()))]


def encode_texts(texts: Texts, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and the bounds of each text's ids."""
    starts, edges = pre_tokens(texts, vocabulary.classes)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    data = texts.data
    ends = np.append(starts[1:], len(data))
    hashes, check = span_hash(data, starts, ends), span_hash(data, starts, ends, 1)
    keys, where, which = np.unique(hashes, return_index=True, return_inverse=True)
    if (check != check[where][which]).any():  # two pre-tokens share a hash: tell them apart by place
        where, which = np.arange(len(starts)), np.arange(len(starts))
        keys = hashes
    raw = data.tobytes()
    slots = vocabulary.perfect.slots(keys).tolist()
    lists = [vocabulary.encode_token(raw[a:b], slot) for a, b, slot in zip(starts[where].tolist(), ends[where].tolist(), slots, strict=True)]
    sizes = np.array([len(x) for x in lists])
    flat = np.array([i for x in lists for i in x], np.int32)
    ids = _spread(flat, np.cumsum(sizes), sizes, which)
    through = np.zeros(len(which) + 1, np.int64)
    np.cumsum(sizes[which], out=through[1:])
    return ids, through[edges]


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text instead of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col):
            ids, bounds = encode_texts(Texts.of(piece.column(text_col)), shared.value)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in kept), lists], [*kept, ids_col])

    kept = [c for c in docs.columns if c != text_col]
    columns = "".join(f"`{n}` {docs.schema[n].dataType.simpleString()}, " for n in kept)
    return docs.mapInArrow(run, f"{columns}`{ids_col}` array<int>")


def decode_rows(batch: pa.RecordBatch, v: Vocabulary, ids_col: str, bytes_col: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch with the bytes of their ids, so many rows at a time that working arrays stay small."""
    given = batch.column(ids_col)
    lists = given.fill_null([]) if given.null_count else given
    every = lists.flatten().to_numpy(zero_copy_only=False)
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    at = 0
    while at < batch.num_rows:  # some ids and some bytes at a time, one row at least
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + LOOKED_UP, "right")) - 1)
        ids = every[ends[at] : ends[upto]]
        if len(ids) and (ids.min() < 0 or ids.max() >= len(v.token_sizes) or not v.token_sizes[ids].all()):
            raise ValueError("an id that the vocabulary lacks")
        through = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(v.token_sizes[ids], out=through[1:])
        bounds = through[ends[at : upto + 1] - ends[at]]
        upto = min(upto, at + max(1, int(np.searchsorted(bounds, DECODED, "right")) - 1))
        own = bounds[: upto - at + 1]
        if own[-1] >= 1 << 31:
            raise ValueError("a row of more than 2 GiB")
        raw = _spread(v.token_bytes, v.token_ends, v.token_sizes, ids[: ends[upto] - ends[at]])
        out = pa.Array.from_buffers(pa.binary(), upto - at, [None, pa.py_buffer(own.astype(np.int32)), pa.py_buffer(raw.tobytes())])
        yield pa.RecordBatch.from_arrays([*batch.slice(at, upto - at).columns, out], [*batch.schema.names, bytes_col])
        at = upto


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that each row's ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from decode_rows(batch, shared.value, ids_col, bytes_col)

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{columns}, `{bytes_col}` binary")
