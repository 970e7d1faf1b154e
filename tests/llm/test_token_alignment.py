import hashlib
import random
from collections import Counter
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skuflow.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def visible(token):
    """Bytes of a byte-level token: the decoder's table, worked out the plain way."""
    table, extra = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            table[chr(b)] = b
        else:
            table[chr(256 + extra)] = b
            extra += 1
    return bytes(table[c] for c in token)


def brute(rows):
    left = Tokenizer.from_file(A)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=B)
    found = []
    for key, text in rows:
        a, b, groups = [], [], []
        if text:
            a = [(i, visible(left.id_to_token(i))) for i in left.encode(" " + text, add_special_tokens=False).ids]
            for i in right.encode(text):
                piece = right.id_to_piece(i)
                b.append((i, bytes.fromhex(piece[3:5]) if right.is_byte(i) else piece.replace("▁", " ").encode()))
            want = (" " + text).encode()
            if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
                a, b = [], []
        ends = [Counter(), Counter()]
        marked = [[], []]
        for side, tokens in enumerate((a, b)):
            at = 0
            for i, raw in tokens:
                at += len(raw)
                marked[side].append((at, i))
        common = sorted({e for e, _ in marked[0]} & {e for e, _ in marked[1]})
        begin = 0
        for end in common:
            groups.append(tuple([i for e, i in side if begin < e <= end] for side in marked))
            begin = end
        found.append((key, a, b, groups))
    counts = Counter(p for _, _, _, groups in found for p in {(x, y) for g in groups for x in g[0] for y in g[1]})
    best = {a: max(n for _, n in own) for a, own in groupby(sorted((p[0], n) for p, n in counts.items()), key=lambda x: x[0])}
    out = []
    for key, a, b, groups in found:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((key, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def run(spark, rows, chunk, parts=4):
    docs = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], "doc_id long, text string, key string, chunk int, pairs int").repartition(parts)
    found = ta.token_alignment(docs, A, B, chunk=chunk)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def texts():
    rng = random.Random(4)
    parts = ["hello", " world", "the quick brown fox", "Straße", "été", "日本語", "😀", "  ", "\n\n", "\t", "0123456789", "aaaaaaaaaaaaaaaaaaa", "<|endoftext|>", "</s>", "<0x0A>", "▁", "ﬁ", " ", "é", "\x00", "'ll", "don't", "zq" * 30, "x\n  y", "a\u00a0 b", "\u3000 c", "“q” ", "\u0085 ", "\u2003  z", " \u00a0", "¿ñ ", "ą ", "€ "]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    return [*out, None, "", " ", "x", "the " * 4000, "=-" * 3000, "Ж" * 2500, *["one text again and again"] * 15]


@pytest.mark.parametrize("chunk", [8 << 20, 2000])
def test_against_brute_force(spark, chunk):
    rows = list(enumerate(texts()))
    rows += [(5, rows[5][1]), (None, rows[6][1])]
    assert run(spark, rows, chunk) == brute(rows)


@pytest.mark.parametrize("most", [1 << 21, 7])
def test_large_groups_and_links_a_few_at_a_time(most):
    """Two vocabularies that rarely agree; equal ids of a large group are counted before they are paired."""
    left, right = ta._side(None, [b"a" * 7, b"a"]), ta._side(None, [b"a" * 11, b"a", b"a" * 4])
    a = [[0] * 22, [0, 1], [], [0] * 10 + [1] * 7, [1] * 12 + [0] * 30]
    b = [[0] * 14, [2, 2], [], [0] * 7, [0] * 20 + [1, 1]]
    lists = lambda ids: pa.array(ids, pa.large_list(pa.int32()))
    one, other = ta.grouped(lists(a), lists(b), left, right)
    pairs, links = ta.linked_pairs(one, other, 3, len(a), most)
    for k in range(len(a)):
        want = Counter()
        for g in np.unique(one.groups[one.docs == k]):
            want.update(x * 3 + y for x in one.ids[one.groups == g].tolist() for y in other.ids[other.groups == g].tolist())
        assert dict(zip(pairs[k].as_py(), links[k].as_py(), strict=True)) == want
    assert (np.bincount(one.groups) * np.bincount(other.groups)).max() > ta.LARGE


def test_no_documents(spark):
    assert ta.token_alignment(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
