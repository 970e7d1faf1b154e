import random
import re

import pyarrow as pa

from skuflow.llm import decontamination as d
from skuflow.llm.queries import QUERIES

FIXTURE = "/root/testdata/sf0.01"


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[-1], row[k + 1]))
        row = new
    return row[-1]


def test_common_subsequence_follows_the_table():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randint(1, 40))]
        b = [rng.randrange(8) for _ in range(rng.randint(0, 60))]
        assert d.common_subsequence(d.word_masks(a), len(a), b) == plain_common(a, b)


def test_copies_and_paraphrases_are_found_and_others_left_alone(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    common = [word() for _ in range(30)]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n)]
    items = [prose(rng.randint(14, 90)) for _ in range(40)]
    rows, want = [], set()
    for k, item in enumerate(items):
        changed = [w for w in (rng.choice(common) if rng.random() < 0.12 else w for w in item[:-5])] + item[-5:]
        for j, passage in enumerate((item, changed)):
            host = prose(rng.randint(0, 300))
            at = rng.randint(0, len(host))
            rows.append((len(rows), " ".join(host[:at] + [w.upper() if j else w + "," for w in passage] + host[at:])))
            want.add((len(rows) - 1, k))
    clean = [(1000 + k, " ".join(prose(rng.randint(0, 200)))) for k in range(100)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in [*rows, *clean, (2000, None), (2001, ""), (None, " ".join(items[3])), (0, rows[0][1])]], "doc_id long, text string, item_id string, words int")
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    found = d.benchmark_matches(docs, bench).collect()
    assert len(found) == len(rows) + 104
    got = {(r.doc_id, m.item_id) for r in found for m in r.matches}
    assert (None, 3) in got and got - {(None, 3)} <= want
    assert {x for x in want if x[0] % 2 == 0} <= got  # every copy
    assert len(got) >= 0.95 * len(want)  # and the paraphrases
    assert sum(r.doc_id == 0 and len(r.matches) == 1 for r in found) == 2


def test_every_copy_is_found_with_thousands_of_items(spark, monkeypatch):
    """Short items in long documents of the benchmark's own vocabulary."""
    rng = random.Random(4)
    vocabulary = ["w" + "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [prose(rng.randint(15, 59 if k % 2 else 18)) for k in range(2000)]
    rows, want = [], set()
    for k in range(120):
        host, at = prose(400), rng.randint(0, 400)
        rows.append((k, " ".join(host[:at] + items[k] + host[at:])))
        want.add((k, k))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, m.item_id) for r in d.benchmark_matches(docs, bench).collect() for m in r.matches}
    assert want <= got, f"{len(want & got)} of {len(want)}"
    # Nor do copies need a cosine.
    space = d.latent_space(docs, bench, "text", "text")
    block = next(d.blocks(bench, space, "item_id", "text"))
    monkeypatch.setattr(d, "COSINE", 1.1)
    found = d.match_piece(d.lowered_words(pa.array([text for _, text in rows])), space, block)
    assert all(k in [m["item_id"] for m in found[k]] for k, _ in rows)


def test_several_blocks_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{FIXTURE}/documents.parquet").select("doc_id", "text").limit(400)
    bench = spark.read.parquet(f"{FIXTURE}/benchmark.parquet")
    pairs = lambda: {(r.doc_id, m.item_id) for r in d.benchmark_matches(docs, bench).collect() for m in r.matches}
    whole = pairs()
    monkeypatch.setattr(d, "BLOCK_WORDS", 12_000)
    assert pairs() == whole and whole


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert d.benchmark_matches(docs, bench).first().matches == []
    full = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert d.benchmark_matches(docs.limit(0), full).collect() == []


def test_query_finds_every_copy_of_an_item(spark):
    """Recall against a search of every item in every document."""
    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_decontamination"](spark, FIXTURE).collect()}
    clean = lambda t: f" {' '.join(re.findall(r'[0-9a-z\x80-\U0010ffff]+', t.lower()))} "
    items = [(r.item_id, clean(r.text)) for r in spark.read.parquet(f"{FIXTURE}/benchmark.parquet").collect()]
    want = {(r.doc_id, i) for r in spark.read.parquet(f"{FIXTURE}/documents.parquet").collect() for text in [clean(r.text)] for i, item in items if item in text}
    assert len(want & got) >= 0.9 * len(want) and len(want) > 5
    assert len(got) <= len(want) + 2
