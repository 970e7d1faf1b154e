import re

import numpy as np
import xxhash

from skuflow.llm import simhash
from skuflow.llm.components import components
from skuflow.llm.queries import QUERIES

FIXTURE = "/root/testdata/sf0.01"


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(prints, bits):
    """Smallest index reachable, by comparing all pairs."""
    values = np.array(prints, np.uint64)
    root = list(range(len(values)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= bits) + k + 1:
            a, b = find(k), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(values))]


def test_golay_words_one_bit_apart_share_an_index():
    words = np.random.default_rng(0).integers(0, 1 << 23, 3000)
    near = simhash.codeword_indices(words)
    assert ((words[:, None] ^ simhash._ERRORS[simhash._REMAINDERS[words & 0xFFF] ^ simhash._REMAINDERS[(1 << 12) + (words >> 12)]]) >= 0).all()
    for bit in range(23):
        other = simhash.codeword_indices(words ^ (1 << bit))
        assert all(set(a) & set(b) for a, b in zip(near.tolist(), other.tolist(), strict=True))


def test_keys_meet_at_two_bits():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2)
    keys = simhash.golay_keys(prints).tolist()
    for _ in range(100):
        a, b = (np.uint64(1) << np.uint64(k) for k in rng.integers(0, 64, 2))
        other = simhash.golay_keys(prints ^ a ^ b).tolist()
        assert all(set(x) & set(y) for x, y in zip(keys, other, strict=True))


def test_links_keep_classes_whole(spark):
    rng = np.random.default_rng(2)
    prints = [int(x) for x in rng.integers(0, 1 << 62, 40)]
    for _ in range(300):  # chains and clusters of one to four bits
        prints.append(prints[rng.integers(0, len(prints))] ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(1, 5)).tolist())))
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    for bits in (1, 2):
        roots = {r.node: r.root for r in components(simhash.links(table, bits)).collect()}
        got: dict[int, set] = {}
        for p in signed:
            got.setdefault(roots.get(p, p), set()).add(p)
        want: dict[int, set] = {}
        for p, root in zip(signed, classes(prints, bits), strict=True):
            want.setdefault(root, set()).add(p)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}
    assert components(edges.limit(0)).collect() == []


def test_edge_cases_and_one_row_of_each_class(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, text), (3, text.upper()), (3, text.upper()), (None, text), (7, None), (8, ""), (9, " \n"), (10, "a"), (11, "other words in here altogether"), (None, "lonely text of no id at all")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, root int")
    got = simhash.near_duplicates(docs.select("doc_id", "text")).collect()
    by_id = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by_id == {5: 3, 3: 3, 7: 7, 8: 7, 9: 7, 10: 10, 11: 11}
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["3", "None"]
    kept = simhash.keep_one(docs.withColumnRenamed("fp", "a").withColumnRenamed("root", "b")).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted([("3", text.upper()), ("7", "None"), ("10", "a"), ("11", rows[8][1]), ("None", rows[9][1])])
    assert simhash.near_duplicates(docs.select("doc_id", "text").limit(0)).collect() == []


def test_query_follows_all_pairs(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{FIXTURE}/documents.parquet").collect())
    prints = [fingerprint(t) for _, t in docs]
    want = {docs[k][0]: (f"{prints[k]:016x}", docs[root][0]) for k, root in enumerate(classes(prints, 2))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash"](spark, FIXTURE).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)
