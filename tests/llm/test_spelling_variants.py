import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skuflow.llm import spelling_variants as sv


def brute_words(rows):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                total[run] += 1
    return total


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_variants(total, ratio=5):
    out, form = {}, {}
    for w, n in total.items():
        near = [x for x in total if one_edit(w, x)]
        best = min(near, key=lambda x: (-total[x], x), default=None)
        form[w] = best if best is not None and total[best] >= ratio * n else None
        out[w] = (n, len(near))
    rows = []
    for w, (n, near) in out.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, near, total[form[w]] if form[w] else None))
    return sorted(rows)


def rows_of(found):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect())


def test_words_and_slips_of_whole_texts(spark):
    rng = random.Random(1)
    letters = "aAbzZÀéÿ×÷ .1ā¿_"
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 3000)))) for k in range(150)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (900, None), (901, ""), (902, "x" * 200_000 + " " + "Straße " * 5000)]
    docs = spark.createDataFrame([(k, t, 7, "x") for k, t in rows], "doc_id long, text string, key int, word string").repartition(5)
    got = {r.word: r.n for r in sv.word_counts(docs, slip=199).collect()}
    assert got == brute_words(rows)


@pytest.mark.parametrize("crowd", [50, 3, 1])
def test_against_brute_force_with_crowded_reduced_words(spark, monkeypatch, crowd):
    monkeypatch.setattr(sv, "CROWD", crowd)
    rng = random.Random(crowd)
    total = {}
    for _ in range(40):
        word = "".join(rng.choice("abcdehiéÿ") for _ in range(rng.randint(6, 9)))
        for _ in range(12):
            at, kind = rng.randrange(len(word)), rng.randrange(3)
            other = word[:at] + ["", rng.choice("abzÀ"), word[at] + rng.choice("abzø")][kind] + word[at + 1 :]
            total[other] = rng.choice([5, 5, 6, 25, 30, 150, 800])
    for x in "abcdefghijklmnopqrstuvwxyz":  # one reduced word for many
        total["aaaaa" + x] = rng.choice([5, 25, 125])
    words = spark.createDataFrame([*total.items()], "word string, n long").repartition(4)
    assert rows_of(sv.spelling_variants(words)) == brute_variants(total)


def test_chains_lead_to_the_last_word(spark):
    total = {"abcdef" + "g" * k: 5 ** (8 - k) for k in range(8)}
    words = spark.createDataFrame([*total.items()], "word string, n long")
    got = {r.word: (r.form, r.root) for r in sv.spelling_variants(words).collect()}
    assert got["abcdef"] == (None, "abcdef")
    assert all(got["abcdef" + "g" * k] == ("abcdef" + "g" * (k - 1), "abcdef") for k in range(1, 8))


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sv.spelling_variants(sv.word_counts(empty).where("n >= 5")).collect() == []


def test_neighbourhoods_are_full(spark):
    table = spark.createDataFrame([("aba",)], "r string")
    got = table.select(sv.neighbourhood("r", "ab")).first()[0]
    want = {"aba"} | {"ba", "aa", "ab"} | {"bba", "aaa", "abb"} | {"aaba", "baba", "abba", "abaa", "abab"}
    assert set(got) == want and len(got) == len(want)


def test_words_stay_where_symbols_differ(spark):
    assert len(set(sv.symbols_of(8))) == 8 and sv.symbols_of(90) == sv.LETTERS
    assert spark.range(1).select(F.translate(F.lit("aÿ"), sv.LETTERS, sv.symbols_of(30))).first()[0] != "aÿ"
