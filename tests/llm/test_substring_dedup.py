import random
import re

import numpy as np
import pytest

from skuflow.llm import substring_dedup
from skuflow.llm.fm_index import FMIndex


def longest(text, pattern, limit):
    best = 0
    for start in range(len(text)):
        k = 0
        while k < min(limit, len(pattern)) and start + k < len(text) and text[start + k] == pattern[k]:
            k += 1
        best = max(best, k)
    return best


def test_matching_statistics_follow_the_definition():
    rng = np.random.default_rng(0)
    for _ in range(25):
        size, limit = int(rng.integers(2, 6)), int(rng.integers(2, 12))
        text = rng.integers(1, size, rng.integers(3, 100))
        text[rng.integers(0, len(text), 3)] = 0
        text[-1] = 0
        index = FMIndex(text, size)
        streams = [rng.integers(1, size + 1, rng.integers(1, 30)) for _ in range(5)]
        ends = np.cumsum([len(s) for s in streams])
        lengths, rows = index.matching_statistics(np.concatenate(streams), ends, limit)
        plain = [int(x) or -1 for x in text]
        for stream, end in zip(streams, ends, strict=True):
            for k in range(len(stream)):
                pattern = [int(x) if x < size else -2 for x in stream[k:]]
                at = end - len(stream) + k
                assert lengths[at] == longest(plain, pattern, limit)
                place = index.suffixes[rows[at]]
                assert plain[place : place + lengths[at]] == pattern[: lengths[at]]


def brute(rows):
    last = substring_dedup.LAST
    texts = [(i, last if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least: dict[tuple, int] = {}
    for _, place, words in texts:
        for k in range(len(words) - 49):
            window = tuple(words[k : k + 50])
            least[window] = min(least.get(window, last), place)
    out = []
    for doc_id, place, words in texts:
        gone = {j for k in range(len(words) - 49) if least[tuple(words[k : k + 50])] < place for j in range(k, k + 50)}
        out.append((doc_id, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(map(str, out))


@pytest.mark.parametrize("sizes", [{}, {"anchor_words": 60}, {"anchor_words": 200, "shard_words": 500}])
def test_follows_all_windows(spark, sizes):
    rng = random.Random(4)
    passages = [" ".join(f"p{j}w{k}" for k in range(n)) for j, n in enumerate((60, 50, 49, 120, 400, 55))]
    rows = []
    for i in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 80))) for _ in range(rng.randint(0, 4))]
        rows.append((i, " \n".join(parts)))
    rows += [(200, "x " * 300), (201, "x " * 200), (202, None), (203, ""), (204, " "), (None, passages[3]), (None, passages[3])]
    rows += [(205, rows[5][1]), (205, rows[5][1]), (206, passages[4] + " z"), (206, passages[4] + " y"), (-5, passages[0]), (207, "é 　 " * 60)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, anchor int, place int")
    assert sorted(str(tuple(r)) for r in substring_dedup.substring_dedup(docs, **sizes).collect()) == brute(rows)


def test_empty_table(spark):
    assert substring_dedup.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
