"""SimHash near-duplicates: Golay codes propose fingerprints within two bits of each other, shared centres verify them.

A fingerprint is cut into three segments of at most 22 bits. Two fingerprints at most two bits apart have a segment
without an error whose next segment (in a circle) has one error at most. A segment read as a word of the perfect
Golay code (23, 12) lies within three bits of exactly one codeword; a word at distance three is also at distance
four from five more. Two words one bit apart always share one of these codewords, so the keys (exact segment,
index of a codeword near the next one) bring all such fingerprints together: at most 18 keys each.

Fingerprints that meet another under a key are verified: two are at most two bits apart exactly if both are within one
bit of some centre. A centre has 65 fingerprints near it at most, so a crowded key never forms its pairs, and each
centre links its fingerprints to the smallest one. Components of these links are the classes.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; repeated rows share
their class; rows without id take part, but never name a class (a class of such rows alone has a null id). Only the
id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.llm.components import components
from skuflow.llm.tables import checkpointed, doc_key, free_names
from skuflow.llm.text_arrays import LOWER, Texts, Words, joined_words, pieces, ranges

SHINGLE, MAX_BITS, SEED = 3, 2, 42
_U64 = np.uint64
#: First bit and size of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
_GENERATOR, _LENGTH = 0b101011100011, 23

#: Each bit of a byte in a byte of its own.
_SPREAD = np.array([sum(((v >> j) & 1) << (8 * j) for j in range(8)) for v in range(256)], _U64)


def _remainder(word: int) -> int:
    for bit in range(_LENGTH - 1, 10, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << (bit - 11)
    return word


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the low 12 and high 11 bits of a word, and by remainder up to six error patterns."""
    low = np.array([_remainder(v) for v in range(1 << 12)])
    high = np.array([_remainder(v << 12) for v in range(1 << 11)])
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    units = [(1 << k, _remainder(1 << k)) for k in range(_LENGTH)]
    for size in range(5):
        for chosen in combinations(units, size):
            pattern, syndrome = 0, 0
            for bit, rest in chosen:
                pattern, syndrome = pattern | bit, syndrome ^ rest
            if size < 4 or bin(found[syndrome][0]).count("1") == 3:
                found[syndrome].append(pattern)
    errors = np.array([(patterns + [patterns[0]] * 5)[:6] for patterns in found])
    return np.concatenate([low, high]), errors


_REMAINDERS, _ERRORS = golay_tables()


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """Six indices of codewords near each 23-bit word; words at most one bit apart share one. Fewer are repeated."""
    syndrome = _REMAINDERS[words & 0xFFF] ^ _REMAINDERS[(1 << 12) + (words >> 12)]
    return (words[:, None] ^ _ERRORS[syndrome]) >> 11


def golay_keys(fingerprints: np.ndarray) -> np.ndarray:
    """18 keys of each fingerprint; equal ones stand for keys it doesn't need."""
    parts = [((fingerprints >> _U64(at)) & _U64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    keys = [((which << 22 | parts[which])[:, None] << 12) | codeword_indices(parts[(which + 1) % 3]) for which in range(3)]
    return np.concatenate(keys, axis=1)


def simhash(texts: Texts, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprint of each text; bit k is set if bit k of over half the shingle hashes is."""
    words = Words(Texts(LOWER[texts.data], texts.bounds))
    out = np.zeros(len(texts), _U64)
    if not len(words):
        return out
    joined, starts, ends = joined_words(words)
    # A text with fewer words than a shingle has one shingle, all of it.
    per_text = np.where(words.counts >= shingle, words.counts - shingle + 1, np.minimum(words.counts, 1))
    through = np.cumsum(per_text)
    first = np.repeat(words.first[:-1] - (through - per_text), per_text) + np.arange(int(through[-1]))
    last = np.minimum(first + shingle - 1, np.repeat(words.first[1:] - 1, per_text))
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(raw[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)], _U64)
    # Bits are counted in bytes of their own over at most 255 hashes, then in whole numbers.
    filled = np.flatnonzero(per_text)
    blocks = -(-per_text[filled] // 255)
    block_first = np.repeat(through[filled] - per_text[filled], blocks) + 255 * ranges(np.zeros(len(blocks), np.int64), blocks)
    counts = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], block_first, axis=0).view(np.uint8).reshape(len(block_first), 64)
    totals = np.add.reduceat(counts.astype(np.int64), np.cumsum(blocks) - blocks, axis=0)
    bits = (2 * totals > per_text[filled][:, None]).astype(_U64)
    out[filled] = (bits << np.arange(64, dtype=_U64)).sum(axis=1, dtype=_U64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, carried columns and ``fp`` (64 bits as a long) of every document."""
    names = [id_col, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col):
            found = pa.array(simhash(Texts.of(piece.column(text_col)), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([*map(piece.column, names), found], [*names, "fp"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, text_col).mapInArrow(run, f"{schema}, fp long")


def golay_candidates(distinct: DataFrame) -> DataFrame:
    """The fingerprints that meet a different one under a Golay key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            keys = np.sort(golay_keys(fp.view(_U64)), axis=1)
            new = np.ones(keys.shape, bool)
            new[:, 1:] = keys[:, 1:] != keys[:, :-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, new.sum(1))), pa.array(keys[new])], ["fp", "key"])

    keyed = checkpointed(distinct.select("fp").mapInArrow(run, "fp long, key long"))
    crowded = keyed.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high").select("key")
    return keyed.join(crowded, "key", "left_semi").select("fp").distinct()


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)``: each fingerprint near a centre and the smallest one near it; enough links to keep all classes whole."""
    if max_bits not in (1, 2):
        raise ValueError("the keys hold for a distance of one or two bits")
    bits = F.array(*[F.lit((1 << k) - (1 << 64 if k == 63 else 0)) for k in range(64)])
    near = golay_candidates(distinct)
    if max_bits == 1:  # two fingerprints one bit apart agree in all others
        rows = near.select("fp", F.explode(bits).alias("bit")).select("fp", "bit", F.expr("fp & ~bit").alias("centre"))
    else:
        rows = near.select("fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), bits)).alias("flip"))
        rows = rows.select("fp", F.lit(0).cast("long").alias("bit"), F.expr("fp ^ flip").alias("centre"))
    groups = rows.groupBy("centre", "bit").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return groups.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a != b").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, carry: tuple[str, ...] = (),
) -> DataFrame:
    """id, carried columns, ``fp``, ``root`` and ``component_id`` of every row.

    Links of at most ``max_bits`` bits make up a class; the root is its smallest fingerprint, the component its smallest id.
    """
    found = checkpointed(fingerprints(docs, id_col, text_col, shingle, carry))
    distinct = checkpointed(found.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(links(distinct, max_bits)).withColumnRenamed("root", "linked")
    classed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("linked", "fp").alias("root"))
    names = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classed.join(names, "root").select("fp", "root", "component_id")
    return found.join(named, "fp").select(id_col, *carry, "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the smallest id, once where rows are repeated."""
    key, number, other_id, other_key = free_names([*docs.columns, "fp", "root", "component_id"], "key", "number", "other_id", "other_key")
    marked = docs.withColumn(key, doc_key(id_col, text_col))
    classes = near_duplicates(marked, id_col, text_col, shingle, max_bits, (key,))
    rows = classes.groupBy("root", id_col, key).agg(F.count("*").alias(number))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(key).alias("key"), F.col(number).alias("rows"))).alias("first"))
    first = checkpointed(first.select(F.col("first.id").alias(other_id), F.col("first.key").alias(other_key), F.col("first.rows").alias(number)))
    kept = marked.join(first, F.col(f"`{id_col}`").eqNullSafe(F.col(other_id)) & (F.col(key) == F.col(other_key))).drop(other_id, other_key)
    once = kept.where(F.col(number) == 1).unionByName(kept.where(F.col(number) > 1).dropDuplicates([id_col, key]))
    return once.select(*[f"`{c}`" for c in docs.columns])


def fingerprint_text(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
