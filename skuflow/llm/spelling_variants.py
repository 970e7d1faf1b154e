"""Spelling variants: words one edit apart, found through a reduced alphabet, and the form that each one stands for.

Letters are hashed to a few symbols. Two words one edit apart have reduced words that are equal or one edit apart, so
the full one-edit neighbourhood of every distinct reduced word is generated, joined with the reduced vocabulary, and
the words behind each match are verified by their own letters. Neighbourhoods grow with the length of a word times the few
symbols, not with the alphabet.

A reduced word that more than ``CROWD`` words share is crowded. Crowded words still meet the words of all reduced words
that are not, at most ``CROWD`` of each; among themselves they meet under a larger alphabet, in the end under that of the letters
themselves, where each reduced word is one word. So no word is compared with more than a bounded number of others at a time, and no
link is lost.

Texts are cut where they lie; counts of words are shuffled, then the vocabulary, which grows much more slowly than the corpus.

Defined cases: a null text has no words; a null id is written as nothing where the id matters; repeated rows count each time;
words only hold a-z and U+00C0 to U+00FF, capitals beyond A-Z stay as they are; an empty table gives no rows. Only the id and text
columns are read, so that others may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.llm.tables import checkpointed

#: Letters of words, A-Z lowered.
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
#: Sizes of the reduced alphabets; the last one tells all letters apart.
SYMBOLS = (8, 30, len(LETTERS))
#: Words of one reduced word that are compared with each other.
CROWD = 50
#: Distinct words that a task counts before it passes them on.
HELD = 300_000


def _runs(least: int) -> re.Pattern[bytes]:
    """Maximal runs of at least ``least`` letters in lowered UTF-8; shorter ones have no match at any of their places."""
    return re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % max(least, 1))


def without_letter(run: bytes, at: int) -> bytes:
    word = run.decode()
    return (word[:at] + word[at + 1 :]).encode()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, slip: int | None = None) -> DataFrame:
    """``word, n``: how often each word of at least ``least_length`` letters occurs in all texts.

    With ``slip``, a run of a document loses a letter where the CRC-32 of ``<id>:<run>`` is a multiple of it: the letter
    at that number modulo the run's length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _runs(least_length)
        total: Counter[bytes] = Counter()
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                raw = text.as_buffer()
                if raw is None:
                    continue
                found = Counter(runs.findall(raw.to_pybytes().lower()))
                if slip:
                    prefix = zlib.crc32((key.as_py() or "").encode() + b":")
                    crc = zlib.crc32
                    slipped = [(run, h) for run in found if not (h := crc(run, prefix)) % slip]
                    for run, h in slipped:
                        size = len(run.decode())
                        if size > least_length:
                            total[without_letter(run, h % size)] += found[run]
                        del found[run]
                total.update(found)
            if len(total) > HELD:
                yield _counted(total)
                total.clear()
        yield _counted(total)

    texts = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(total: Counter[bytes]) -> pa.RecordBatch:
    words = pa.array([*total], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array([*total.values()], pa.int64())], ["word", "n"])


def symbols_of(size: int) -> str:
    """The symbol of each letter: a hash of its code point, the letter itself if there are as many symbols as letters."""
    if size >= len(LETTERS):
        return LETTERS
    return "".join(LETTERS[((ord(c) * 0x9E3779B1 & 0xFFFFFFFF) >> 12) % size] for c in LETTERS)


def neighbourhood(word: str, symbols: str) -> Column:
    """The reduced word and all that one deleted, replaced or inserted symbol makes of it."""
    w, every = F.col(word), F.array(*map(F.lit, symbols))
    upto = lambda i: F.substr(w, F.lit(1), i)
    rest = lambda i: F.substr(w, i + 1)
    places = F.sequence(F.lit(1), F.length(w))
    deleted = F.transform(places, lambda i: F.concat(upto(i - 1), rest(i)))
    replaced = F.transform(places, lambda i: F.transform(every, lambda s: F.concat(upto(i - 1), s, rest(i))))
    inserted = F.transform(F.sequence(F.lit(0), F.length(w)), lambda i: F.transform(every, lambda s: F.concat(upto(i), s, rest(i))))
    return F.array_distinct(F.concat(deleted, F.flatten(replaced), F.flatten(inserted)))


def _linked(words: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of words one edit apart of which at least one is not crowded; the crowded words."""
    letters = symbols_of(size)
    reduced = checkpointed(words.withColumn("r", F.translate("word", LETTERS, letters)))
    sizes = reduced.groupBy("r").agg((F.count("*") > CROWD).alias("crowded"))
    symbols = "".join(sorted(set(letters)))
    # Both ends of a link generate each other: one of them is enough.
    near = sizes.select("r", "crowded", F.explode(neighbourhood("r", symbols)).alias("other")).where("other >= r")
    met = near.join(sizes.select(F.col("r").alias("other"), F.col("crowded").alias("other_crowded")), "other").where("not (crowded and other_crowded)")
    first = met.select("r", "other").join(reduced.select("r", F.col("word").alias("a"), F.col("n").alias("a_n")), "r")
    second = first.join(reduced.select(F.col("r").alias("other"), F.col("word").alias("b"), F.col("n").alias("b_n")), "other")
    links = second.where("(r != other or a < b) and levenshtein(a, b, 1) = 1").select("a", "a_n", "b", "b_n")
    crowded = reduced.join(sizes.where("crowded").select("r"), "r", "left_semi").select(*words.columns)
    return links, crowded


def near_words(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: every pair of ``words`` (distinct, with their n) one edit apart, once."""
    parts, rest = [], words
    for size in SYMBOLS:
        links, rest = _linked(rest, size)
        parts.append(checkpointed(links))
        if size == SYMBOLS[-1]:
            break
        rest = checkpointed(rest)
        if rest.isEmpty():
            break
    return reduce(DataFrame.unionByName, parts)


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last word that each word's forms lead to; n grows with every step, so they end.

    Each round doubles the steps taken.
    """
    steps = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if steps.join(further, "root", "left_semi").isEmpty():
            return steps
        moved = steps.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        steps = checkpointed(moved)


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of distinct words with their n.

    A word's form is its near word of largest n, the first in code-point order of several, if that n is at least ``ratio``
    times its own.
    """
    words = checkpointed(words.select("word", "n"))
    links = near_words(words)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = F.min(F.struct((-F.col("b_n")).alias("lost"), F.col("b").alias("form")))
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left")
    strong = -F.col("best.lost") >= ratio * F.col("n")
    forms = checkpointed(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.lost")).alias("form_n"),
    ))
    rooted = forms.join(_roots(forms.where("form is not null")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
