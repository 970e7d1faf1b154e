"""Alignment of two tokenizers over a corpus: which tokens of one cover the bytes of which tokens of the other.

Each text is encoded by a byte-level vocabulary (A) and a piece vocabulary (B). Byte offsets where tokens of both end cut them
into groups; an A and a B token of one group are linked, and a pair of ids counts in each document that links it.

Neither vocabulary has a token that goes on behind a space, so the words of a chunk are encoded once each; a vocabulary that
has one makes whole texts the words. The work on tokens is Arrow's: lists are flattened with the indices of their documents, segmented cumulative sums of token sizes
give the ends, an Acero hash join on (document, end) finds the common ones, ``Table.group_by`` counts. Spark merges
the partial counts. Texts are encoded once: a row per document with its distinct pairs is written. Documents go in chunks
of some MB of text; a pair is counted per chunk, its corpus-wide count goes back to the chunks that hold it,
not to every document, and each chunk meets its counts in one task.

Defined cases: a text that is null or empty, or that either tokenizer does not give back byte for byte (with one space
before it), has no tokens; its figures are 0 and its groups are the empty text. Special tokens in texts are plain text.
Repeated rows are documents of their own. An empty table gives no rows. Only the id and text columns are read, so that others may
have any name. The distinct pairs of one document are held by one task.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.llm.tables import checkpointed
from skuflow.llm.text_arrays import Texts, group_sums, pieces, ranges, span_hash

#: Bytes of text in a chunk, in a piece that is aligned at a time, encoded at a time; links expanded at a time.
CHUNK, PIECE, ENCODED, LINKS = 8 << 20, 1 << 19, 1 << 18, 1 << 20
#: Distinct words that a worker remembers.
REMEMBERED = 250_000
#: Links of a group from which its equal ids are counted before they are paired.
LARGE = 64


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 for itself, the rest in order from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Side(NamedTuple):
    """One tokenizer: how it encodes texts that begin with a space, and the bytes of its tokens by id.

    ``apart`` says that no token goes on behind the end of a word, so that texts may be encoded word by word.
    """

    encode: Callable[[list[str]], list[list[int]]]
    tokens: pa.Array
    sizes: pa.Array
    apart: bool


def _side(encode: Callable[[list[str]], list[list[int]]], tokens: list[bytes]) -> Side:
    joined = Texts(np.frombuffer(b"".join(tokens), np.uint8), np.append(0, np.cumsum([len(t) for t in tokens])))
    apart = len(words_of(joined, True)[0]) == sum(map(bool, tokens))
    return Side(encode, pa.array(tokens, pa.large_binary()), pa.array([len(t) for t in tokens], pa.int64()), apart)


@lru_cache(maxsize=4)
def byte_side(path: str) -> Side:
    """A byte-level vocabulary in the file of the tokenizers library.

    Where its merges are in the order of their ids, as ranks are, tiktoken gives the same ids faster.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    alphabet = byte_alphabet()
    tokens = [b""] * (max(tokenizer.get_vocab().values()) + 1)
    for token, number in tokenizer.get_vocab().items():
        tokens[number] = bytes(alphabet[c] for c in token)
    ranks = _ranks(path, alphabet)
    if ranks is None:
        return _side(lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)], tokens)
    fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _side(lambda texts: [fast.encode_ordinary(t) for t in texts], tokens)


def _ranks(path: str, alphabet: dict[str, int]) -> dict[bytes, int] | None:
    """Token bytes to ids, if the file is plain byte-level BPE whose merges make the ids in their order."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    cut, model, special = given["pre_tokenizer"] or {}, given["model"], {t["content"] for t in given["added_tokens"]}
    if given["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or model["type"] != "BPE":
        return None
    made = [model["vocab"]["".join(pair.split(" ") if isinstance(pair, str) else pair)] for pair in model["merges"]]
    plain = {token: number for token, number in model["vocab"].items() if token not in special}
    if made != sorted(made) or min(made) < 256 or model.get("ignore_merges") or len(plain) != 256 + len(made):
        return None
    return {bytes(alphabet[c] for c in token): number for token, number in plain.items()}


@lru_cache(maxsize=4)
def piece_side(path: str) -> Side:
    """A model of the sentencepiece library, which adds the first space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    tokens = [bytes([int(name[3:-1], 16)]) if model.is_byte(k) else name.replace("▁", " ").encode() for k, name in enumerate(names)]
    return _side(lambda texts: model.encode([t[1:] for t in texts], num_threads=1), tokens)


def spaced(texts: Texts) -> Texts:
    """The texts that are not empty with a space before each."""
    sizes = np.diff(texts.bounds)
    bounds = np.append(0, np.cumsum(sizes + (sizes > 0)))
    data = np.full(int(bounds[-1]), 32, np.uint8)
    data[np.arange(len(texts.data)) + np.repeat(np.cumsum(sizes > 0), sizes)] = texts.data
    return Texts(data, bounds)


#: Bytes that can't end a blank: visible ASCII, and what follows a lead byte with which no blank begins.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
#: Lead bytes of the blanks beyond ASCII.
_BLANK_LEADS = np.zeros(256, bool)
_BLANK_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _sure_ends(data: np.ndarray) -> np.ndarray:
    """Whether a blank surely does not end at each byte."""
    beyond = (data >= 0x80) & (data < 0xC0)
    lead_1, lead_2 = np.roll(data, 1), np.roll(data, 2)
    sure = _VISIBLE[data] | (beyond & ~_BLANK_LEADS[lead_1] & ~_BLANK_LEADS[lead_2])
    sure[:2] &= data[:2] < 0x80
    return sure


def words_of(texts: Texts, apart: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts that can be encoded on their own: the texts, cut at each space that follows no blank.

    A space after a character that shares its first byte with a blank stays uncut; that only makes a part longer.
    """
    data = texts.data
    starts = np.zeros(len(data) + 1, bool)
    starts[texts.bounds] = True
    if apart:
        starts[1:-1] |= (data[1:] == 32) & _sure_ends(data)[:-1]
        last = texts.bounds[1:] - 1  # a last space alone would be no word that can be encoded
        starts[last[(last >= 0) & ~np.isin(last, texts.bounds)]] = False
    at = np.flatnonzero(starts)
    return at[:-1], at[1:]


def _encoded_words(side: Side, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words behind one another, and how many each has; some bytes at a time. A word that is not given back has none."""
    ids, sizes, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    through = np.cumsum([len(w) for w in words])
    while at < len(words):
        upto = max(at + 1, int(np.searchsorted(through, (through[at - 1] if at else 0) + ENCODED, "right")))
        found = side.encode([w.decode() for w in words[at:upto]])
        size = np.array([len(x) for x in found], np.int64)
        ids.append(np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())))
        sizes.append(size)
        at = upto
    flat, size = np.concatenate(ids), np.concatenate(sizes)
    joined = side.tokens.take(pa.array(flat))
    if not len(joined):
        return flat, size
    edges = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1][np.append(0, np.cumsum(size))].tolist()
    data = memoryview(joined.buffers()[2]).cast("B")
    same = np.array([data[x:y] == word for x, y, word in zip(edges, edges[1:], words, strict=False)], bool)
    return flat[np.repeat(same, size)], size * same


class Memory:
    """Encoded words of a worker: their places, and the ids of both sides behind one another. A full memory starts anew."""

    def __init__(self, sides: tuple[Side, Side]):
        self.sides = sides
        self.clear()

    def clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.ids = [np.zeros(0, np.int32) for _ in self.sides]
        self.sizes = [np.zeros(0, np.int64) for _ in self.sides]

    def find(self, words: list[bytes]) -> np.ndarray:
        """Places of distinct words, of which the new ones are encoded."""
        new = [w for w in words if w not in self.places]
        if len(self.places) + len(new) > REMEMBERED:
            self.clear()
            new = words
        for k, side in enumerate(self.sides):
            ids, sizes = _encoded_words(side, new)
            self.ids[k], self.sizes[k] = np.concatenate([self.ids[k], ids]), np.concatenate([self.sizes[k], sizes])
        self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
        return np.array([self.places[w] for w in words], np.int64)


@lru_cache(maxsize=2)
def _memory(byte_path: str, piece_path: str) -> Memory:
    return Memory((byte_side(byte_path), piece_side(piece_path)))


def encoded(texts: Texts, memory: Memory) -> tuple[pa.LargeListArray, pa.LargeListArray]:
    """The ids of each text by both sides; none for a text that one of them does not give back.

    Equal words of the texts are looked up once.
    """
    data, n = texts.data, len(texts)
    starts, ends = words_of(texts, all(side.apart for side in memory.sides))
    hashes, check = span_hash(data, starts, ends), span_hash(data, starts, ends, 1)
    _, where, which = np.unique(hashes, return_index=True, return_inverse=True)
    if (check != check[where][which]).any():  # two words share a hash: tell them apart by place
        where = which = np.arange(len(starts))
    raw = data.tobytes()
    place = memory.find([raw[x:y] for x, y in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])[which]
    owner = np.searchsorted(texts.bounds, starts, "right") - 1
    bad = np.zeros(n, bool)
    for sizes in memory.sizes:
        bad[owner[sizes[place] == 0]] = True
    kept = ~bad[owner]
    place, owner = place[kept], owner[kept]
    out = []
    for ids, sizes in zip(memory.ids, memory.sizes, strict=True):
        flat = ids[ranges((np.cumsum(sizes) - sizes)[place], sizes[place])]
        counts = np.bincount(owner, sizes[place], n).astype(np.int64)
        out.append(pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts))), pa.array(flat)))
    return tuple(out)


class Tokens(NamedTuple):
    """All tokens of a side in order: ids, documents, whether a group ends with it, and its group."""

    ids: np.ndarray
    docs: np.ndarray
    cuts: np.ndarray
    groups: np.ndarray


def _ends(lists: pa.LargeListArray, side: Side) -> pa.Table:
    """Document, byte offset of the end there, and place of each token."""
    parents = pc.list_parent_indices(lists)
    sizes = side.sizes.take(lists.flatten())
    through = pc.cumulative_sum(sizes)
    total = group_sums(sizes.to_numpy(), lists.offsets.to_numpy())
    base = pa.array(np.append(0, np.cumsum(total)))
    return pa.table({"doc": parents, "end": pc.subtract(through, base.take(parents)), "place": pa.array(np.arange(len(parents)))})


def _tokens(lists: pa.LargeListArray, ends: pa.Table, places: pa.ChunkedArray) -> Tokens:
    cuts = np.zeros(ends.num_rows, bool)
    cuts[places.to_numpy()] = True
    return Tokens(lists.flatten().to_numpy(), ends["doc"].to_numpy(), cuts, np.cumsum(cuts) - cuts)


def grouped(a: pa.LargeListArray, b: pa.LargeListArray, left: Side, right: Side) -> tuple[Tokens, Tokens]:
    """The tokens of both sides with their groups, numbered through all documents."""
    a_ends, b_ends = _ends(a, left), _ends(b, right)
    common = a_ends.join(b_ends, ["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False)
    return _tokens(a, a_ends, common["place"]), _tokens(b, b_ends, common["place_b"])


def _items(tokens: Tokens, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id and number of the tokens, by group; equal ids of large groups are one item."""
    many = large[tokens.groups]
    if not many.any():
        return tokens.groups, tokens.ids.astype(np.int64), np.ones(len(many), np.int64)
    merged = pa.table({"g": tokens.groups[many], "i": tokens.ids[many].astype(np.int64)}).group_by(["g", "i"], use_threads=False).aggregate([([], "count_all")])
    parts = zip((tokens.groups[~many], tokens.ids[~many].astype(np.int64), np.ones(int((~many).sum()), np.int64)), (merged["g"], merged["i"], merged["count_all"]), strict=True)
    group, ids, number = (np.concatenate([own, other.to_numpy()]) for own, other in parts)
    order = np.argsort(group, kind="stable")
    return group[order], ids[order], number[order]


def linked_pairs(a: Tokens, b: Tokens, base: int, docs: int, most: int = LINKS) -> tuple[pa.Array, pa.Array]:
    """Of each document its distinct pairs, ``a * base + b``, and how many links each has, as two lists."""
    groups = int(a.cuts.sum())
    doc_of = a.docs[a.cuts]
    large = np.bincount(a.groups, minlength=groups) * np.bincount(b.groups, minlength=groups) > LARGE
    a_group, a_id, a_n = _items(a, large)
    b_group, b_id, b_n = _items(b, large)
    b_first = np.searchsorted(b_group, np.arange(groups + 1))
    partners = np.diff(b_first)[a_group]
    through = np.cumsum(partners)
    parts, at = [], 0
    while at < len(a_id):
        upto = max(at + 1, int(np.searchsorted(through, (through[at - 1] if at else 0) + most, "right")))
        n = partners[at:upto]
        mine, other = np.repeat(np.arange(at, upto), n), ranges(b_first[a_group[at:upto]], n)
        part = pa.table({"doc": doc_of[a_group[mine]], "pair": a_id[mine] * base + b_id[other], "links": a_n[mine] * b_n[other]})
        parts.append(_summed(part))
        at = upto
    if not parts:
        nothing = pa.array([[]] * docs, pa.list_(pa.int64()))
        return nothing, nothing
    table = parts[0] if len(parts) == 1 else _summed(pa.concat_tables(parts))
    table = table.sort_by([("doc", "ascending"), ("pair", "ascending")])
    offsets = pa.array(np.searchsorted(table["doc"].to_numpy(), np.arange(docs + 1)).astype(np.int32))
    return tuple(pa.ListArray.from_arrays(offsets, table[name].combine_chunks()) for name in ("pair", "links"))


def _summed(table: pa.Table) -> pa.Table:
    found = table.group_by(["doc", "pair"], use_threads=False).aggregate([("links", "sum")])
    return found.rename_columns(["links" if n == "links_sum" else n for n in found.column_names])


@lru_cache(maxsize=4)
def _written_ids(left: int, right: int) -> pa.Array:
    """Each id with what may follow it: of A a comma or a bar, of B a comma, a semicolon or nothing."""
    return pa.array([f"{k}{mark}" for k in range(left) for mark in ",|"] + [f"{k}{mark}" for k in range(right) for mark in (",", ";", "")], pa.large_string())


def group_digests(a: Tokens, b: Tokens, left: int, right: int, docs: int) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each document: its groups in order, ids in decimals; the empty text without tokens."""
    groups = int(a.cuts.sum())
    n_a, n_b = np.bincount(a.groups, minlength=groups), np.bincount(b.groups, minlength=groups)
    starts = np.cumsum(n_a + n_b) - n_a - n_b
    last_of_doc = np.append(a.docs[a.cuts][1:] != a.docs[a.cuts][:-1], True)[:groups]
    code = np.empty(len(a.ids) + len(b.ids), np.int64)
    # A token's place: behind the groups before its own, and the tokens of its group before it.
    code[np.arange(len(a.ids)) + (starts - np.cumsum(n_a) + n_a)[a.groups]] = 2 * a.ids.astype(np.int64) + a.cuts
    ended = b.cuts.astype(np.int64) + (b.cuts & last_of_doc[b.groups])
    code[np.arange(len(b.ids)) + (starts + n_a - np.cumsum(n_b) + n_b)[b.groups]] = 2 * left + 3 * b.ids.astype(np.int64) + ended
    written = _written_ids(left, right).take(pa.array(code))
    counts = np.bincount(a.docs, minlength=docs) + np.bincount(b.docs, minlength=docs)
    edges = np.append(0, np.cumsum(counts))
    if not len(code):
        return [""] * docs
    at = np.frombuffer(written.buffers()[1], np.int64)[edges].tolist()
    data = memoryview(written.buffers()[2])
    return [hashlib.sha256(data[x:y]).hexdigest() if y > x else "" for x, y in zip(at, at[1:], strict=False)]


def align_texts(texts: Texts, memory: Memory) -> dict[str, pa.Array]:
    """The columns of each text, in order."""
    left, right = memory.sides
    a, b = encoded(spaced(texts), memory)
    one, other = grouped(a, b, left, right)
    n = len(texts)
    pairs, links = linked_pairs(one, other, len(right.tokens), n)
    return {
        "n_a": pa.array(np.diff(a.offsets.to_numpy())), "n_b": pa.array(np.diff(b.offsets.to_numpy())),
        "n_groups": pa.array(np.bincount(one.docs[one.cuts], minlength=n)),
        "n_links": pa.array(group_sums(links.flatten().to_numpy(), links.offsets.to_numpy())),
        "groups_sha256": pa.array(group_digests(one, other, len(left.tokens), len(right.tokens), n), pa.string()),
        "pairs": pairs, "links": links,
    }


def aligned(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """A row per document: ``chunk, key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links``.

    ``pairs`` are its distinct linked ids as ``a * (ids of B) + b``, ``links`` how often each is linked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(byte_path, piece_path)
        first = TaskContext.get().partitionId() << 32
        done = 0
        for piece in pieces(batches, "text", min(chunk, PIECE)):
            columns = align_texts(Texts.of(piece.column("text")), memory)
            found = {"chunk": pa.array(np.full(piece.num_rows, first + done // chunk)), "key": piece.column("key"), **columns}
            yield pa.RecordBatch.from_pydict(found)
            done += piece.column("text").nbytes

    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = texts.schema["key"].dataType.simpleString()
    figures = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"
    return texts.mapInArrow(run, f"chunk long, key {kind}, {figures}")


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a batch's documents each pair of a chunk is."""
    for batch in batches:
        lists = batch.column("pairs")
        table = pa.table({"chunk": batch.column("chunk").take(pc.list_parent_indices(lists)), "pair": lists.flatten()})
        found = table.group_by(["chunk", "pair"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["chunk", "pair", "docs"])
        yield from found.to_batches()


def pair_counts(partial: DataFrame, base: int) -> DataFrame:
    """``pair, n, best``: documents that hold each pair, and whether that is the most of its A id's pairs."""
    counts = partial.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.floor(F.col("pair") / base))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _weighed(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over the links of each document of a chunk, from the chunk's counts."""
    docs, counts = docs.combine_chunks(), counts.combine_chunks().sort_by("pair")
    out = docs.select(["key", "n_a", "n_b", "n_groups", "n_links"])
    n_best, count_sum = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
    if counts.num_rows and docs.num_rows:
        pairs, links = (docs[name].combine_chunks() for name in ("pairs", "links"))
        at = np.searchsorted(counts["pair"].to_numpy(), pairs.flatten().to_numpy())
        number, first = links.flatten().to_numpy(), np.append(0, np.cumsum(pc.list_value_length(pairs).to_numpy()))
        n_best = group_sums(number * counts["best"].to_numpy()[at], first)
        count_sum = group_sums(number * counts["n"].to_numpy()[at], first)
    return out.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum)).append_column("groups_sha256", docs["groups_sha256"])


def token_alignment(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per document the id, ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best`` counts the links whose pair is in as many documents as any pair of its A id, ``count_sum`` adds the pair counts up over all links.
    """
    base = len(piece_side(piece_path).tokens)
    rows = checkpointed(aligned(docs, byte_path, piece_path, id_col, text_col, chunk))
    partial = checkpointed(rows.select("chunk", "pairs").mapInArrow(_partial_counts, "chunk long, pair long, docs long"))
    held = partial.select("chunk", "pair").join(pair_counts(partial, base), "pair")
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(_weighed, schema).withColumnRenamed("key", id_col)
