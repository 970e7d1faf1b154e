"""Pages to chunks: cleaning, document type, fixed and boundary chunking, shingles, MinHash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from skuflow.functions import fixed_values as fv
from skuflow.session import compute_partitions

def clean_text(text: Column) -> Column:
    """Three or more newlines become two, runs of spaces one, and the ends are trimmed."""
    collapsed = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), " {2,}", " ")
    return F.btrim(collapsed, F.lit(fv.BLANKS))


def clean_pages(pages: DataFrame, also: Column | None = None) -> DataFrame:
    """Pages with clean text; empty pages are left out, but for rows where ``also`` holds."""
    # Clean text is empty just where the text holds nothing but spaces, which is cheaper to test.
    full = F.length(F.btrim("text", F.lit(fv.BLANKS))) > 0
    kept = pages.where(full if also is None else full | also)
    return kept.withColumn("text", clean_text(F.btrim("text", F.lit(fv.BLANKS))))


def doc_type(source: Column) -> Column:
    name = F.lower(source)
    return (
        F.when(name.startswith("po_") | name.contains("purchase"), "PO")
        .when(name.contains("catalog") | name.contains("supplier"), "catalog")
        .otherwise("unknown")
    )


def chunk_id(source: Column, page: Column, index: Column) -> Column:
    return F.concat(source, F.lit("_p"), page.cast("string"), F.lit("_c"), index.cast("string"))


def _as_chunks(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        chunk_id(F.col("source"), F.col("page"), F.col("chunk_index")).alias("chunk_id"),
        "source", "page", "chunk_index",
        doc_type(F.col("source")).alias("doc_type"),
        "text",
    )


def chunk_fixed(pages: DataFrame, size: int = fv.CHUNK_CHARS, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """Chunks of ``size`` characters, each starting with the last ``overlap`` of the one before.

    The text is cut once into strides and each stride is joined with the head of the next, so the
    work is linear in the length of the text.
    """
    strides = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size - overlap}}}"), F.lit(0))
    chunks = F.zip_with(
        strides,
        F.slice(strides, F.lit(2), F.size(strides)),
        lambda own, following: F.concat(own, F.coalesce(F.substring(following, 1, overlap), F.lit(""))),
    )
    pieces = pages.select(
        "source", "page", F.posexplode(chunks).alias("chunk_index", "text")
    )
    # A last stride no longer than the overlap is already the end of the chunk before.
    return _as_chunks(pieces.where((F.col("chunk_index") == 0) | (F.length("text") > overlap)))


def chunk_boundary(pages: DataFrame, size: int = fv.CHUNK_CHARS, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """Chunks of at most ``size`` characters that end at paragraphs, lines, sentences or words if possible."""

    def split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [split_at_boundaries(text, size, overlap, fv.CHUNK_SEPARATORS) for text in batch["text"]]
            counts = [len(p) for p in parts]
            yield pd.DataFrame(
                {
                    "source": np.repeat(batch["source"].to_numpy(), counts),
                    "page": np.repeat(batch["page"].to_numpy(), counts),
                    "chunk_index": np.concatenate([np.arange(n) for n in counts]) if counts else [],
                    "text": [piece for p in parts for piece in p],
                }
            ).astype({"page": "int32", "chunk_index": "int32"})

    schema = "source string, page int, chunk_index int, text string"
    pieces = pages.select("source", F.col("page").cast("int").alias("page"), "text").mapInPandas(split_batches, schema)
    return _as_chunks(pieces)


def split_at_boundaries(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """One text as chunks: the first separator that occurs cuts it, later ones cut pieces still too long."""
    position = next((i for i, mark in enumerate(separators) if mark == "" or mark in text), len(separators) - 1)
    mark, finer = separators[position], separators[position + 1:]
    chunks: list[str] = []
    short: list[str] = []
    for piece in _cut_before(text, mark):
        if len(piece) < size:
            short.append(piece)
            continue
        chunks += _pack(short, size, overlap)
        short = []
        chunks += split_at_boundaries(piece, size, overlap, finer) if finer else [piece]
    return chunks + _pack(short, size, overlap)


def _cut_before(text: str, mark: str) -> list[str]:
    if mark == "":
        return list(text)
    first, *rest = text.split(mark)
    return [piece for piece in [first, *(mark + part for part in rest)] if piece]


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Join neighbouring pieces up to ``size``; a new chunk starts with up to ``overlap`` of the last."""
    chunks: list[str] = []
    start, length = 0, 0
    for end, piece in enumerate(pieces):
        if start < end and length + len(piece) > size:
            chunks.append("".join(pieces[start:end]).strip())
            while length > overlap or (length > 0 and length + len(piece) > size):
                length -= len(pieces[start])
                start += 1
        length += len(piece)
    chunks.append("".join(pieces[start:]).strip())
    return [chunk for chunk in chunks if chunk]


def first_per_chunk_id(chunks: DataFrame, order: list[str]) -> DataFrame:
    """The first row of every chunk id in the given order."""
    # A minimum over structs combines before the shuffle, so an id with very many rows is no hot group.
    others = [name for name in chunks.columns if name != "chunk_id" and name not in order]
    first = chunks.groupBy("chunk_id").agg(F.min(F.struct(*order, *others)).alias("first"))
    return first.select("chunk_id", "first.*").select(*chunks.columns)


def _each_shingle(text: Column, use: Callable[[Column], Column], words_per_shingle: int = fv.SHINGLE_WORDS) -> Column:
    """``use`` of every word shingle of the lower-cased text, in order, with repeats; a shorter text is one shingle.

    The words are the only element of an array whose transformation names them, so a text is split once; an expression that
    mentions them in several places would split it in each, because functions with lambdas share no subexpressions.
    """
    words = F.split(F.btrim(F.lower(text), F.lit(fv.BLANKS)), f"[{fv.BLANKS}]+")

    def of_words(named: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(named) - words_per_shingle, F.lit(0)))
        joined = F.transform(starts, lambda at: use(F.concat_ws(" ", *[F.get(named, at + k) for k in range(words_per_shingle)])))
        return F.when(named.isNotNull(), joined)

    return F.get(F.transform(F.array(words), of_words), F.lit(0))


def shingle_array(text: Column, words_per_shingle: int = fv.SHINGLE_WORDS) -> Column:
    """Distinct word shingles of the lower-cased text; a shorter text is one shingle."""
    return F.array_distinct(_each_shingle(text, lambda shingle: shingle, words_per_shingle))


def shingle_rows(chunks: DataFrame) -> DataFrame:
    """One row per chunk and distinct shingle."""
    return chunks.select("chunk_id", F.explode(shingle_array(F.col("text"))).alias("shingle"))


def shingle_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of the shingles, ascending."""
    return F.sort_array(F.array_distinct(_each_shingle(text, lambda shingle: F.xxhash64(shingle))))


#: Values of the hash functions are below this prime; products of two fit 62 bits.
MINHASH_PRIME = 2**31 - 1


def minhash_factors(permutations: int) -> list[tuple[int, int]]:
    """(factor, shift) of each hash function x → (factor · x + shift) mod the prime: powers of a generator."""
    return [(pow(48271, 2 * k + 1, MINHASH_PRIME), pow(48271, 2 * k + 2, MINHASH_PRIME)) for k in range(permutations)]


def shingle_number(shingle: Column) -> Column:
    """A shingle as a number below the prime, from its MD5, alike on every engine."""
    return F.conv(F.substring(F.md5(shingle), 1, 8), 16, 10).cast("long") % MINHASH_PRIME


def minhash_signature(chunks: DataFrame, permutations: int = fv.MINHASH_PERMUTATIONS) -> DataFrame:
    """(chunk_id, signature): the smallest value of each of ``permutations`` hash functions over a chunk's shingles.

    The functions run over flat arrays of all shingles of a batch of chunks; repeats don't change a minimum. Cutting shingles
    is dearer than moving texts, so the chunks are dealt out to all cores first.
    """
    factors = minhash_factors(permutations)

    kind = chunks.schema["chunk_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("numbers")
            ends = pc.list_value_length(numbers).to_numpy().cumsum()
            # A few hundred thousand shingles at a time stay in the processor's cache.
            cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, _SHINGLES_AT_ONCE))).tolist()
            for begin, end in zip(cuts, [*cuts[1:], len(ends)], strict=True):
                part = numbers.slice(begin, end - begin)
                x = part.flatten().to_numpy()
                first = np.append(0, pc.list_value_length(part).to_numpy().cumsum()[:-1])
                least = np.stack([np.minimum.reduceat(_modulo(x * factor + shift), first) for factor, shift in factors], axis=1)
                offsets = pa.array(np.arange(0, least.size + 1, permutations), pa.int32())
                signature = pa.ListArray.from_arrays(offsets, pa.array(least.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("chunk_id").slice(begin, end - begin), signature], ["chunk_id", "signature"])

    dealt = chunks.select("chunk_id", "text").repartition(compute_partitions(chunks.sparkSession), "chunk_id")
    # A chunk id that repeats has the shingles of all its rows.
    texts = dealt.groupBy("chunk_id").agg(F.collect_list("text").alias("texts")).where(F.size("texts") > 0)
    numbers = F.flatten(F.transform("texts", lambda text: _each_shingle(text, shingle_number)))
    return texts.select("chunk_id", numbers.alias("numbers")).mapInArrow(sign, f"chunk_id {kind}, signature array<long>")


_SHINGLES_AT_ONCE = 100_000


def _modulo(values: np.ndarray) -> np.ndarray:
    """``values`` below 2^62 modulo the prime 2^31 - 1, whose multiples of 2^31 fold onto the lower bits."""
    for _ in range(2):
        values = (values & MINHASH_PRIME) + (values >> 31)
    values[values == MINHASH_PRIME] = 0
    return values
