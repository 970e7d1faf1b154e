import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from skuflow.llm import byte_bpe
from skuflow.llm.queries import QUERIES
from skuflow.llm.text_arrays import Texts

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def vocabulary(ranks):
    return byte_bpe.Vocabulary(ranks)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal(vocabulary, ranks):
    assert sorted(vocabulary.tokens) == sorted(ranks)
    for n in (1, 2, 3, 50):
        hashes = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
        assert sorted(byte_bpe.PerfectHash.build(hashes).slots(hashes).tolist()) == list(range(n))


def test_texts_of_every_kind(vocabulary, library):
    rng = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", " ", "　", "a", "é", "ß", "1", "²", "!", "'", "—", "😀", "\x1c", "\x85", "漢字", "́", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["", None, "a" * 3000, " " * 500, "''s's\n's", "it's we're I'll"]
    ids, bounds = byte_bpe.encode_texts(Texts.of(pa.array(texts)), vocabulary)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode_ordinary(text or ""), text


def test_round_trip_of_a_table(spark, vocabulary, library):
    rows = [(1, "some text", "x"), (1, "some text", "x"), (None, "naïve", None), (2, None, "y"), (3, "", "z"), (4, "w" * 100_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded_id string")
    encoded = byte_bpe.encode(docs, vocabulary)
    found = byte_bpe.decode(encoded, vocabulary).collect()
    assert encoded.columns == ["doc_id", "decoded_id", "ids"]
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in found) == sorted((str(i), t or "") for i, t, _ in rows)
    assert byte_bpe.encode(docs.limit(0), vocabulary).collect() == []


def test_decoding_looks_up_some_ids_at_a_time(vocabulary):
    rng = np.random.default_rng(3)
    sizes = [*rng.integers(0, 3000, 1500), 0, 2 * byte_bpe.LOOKED_UP, 0, 0]
    ids = rng.integers(0, 256, sum(sizes)).astype(np.int32)
    bounds = np.append(0, np.cumsum(sizes))
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), lists], ["doc_id", "ids"]).slice(1)
    tracemalloc.start()
    at = 1
    for part in byte_bpe.decode_rows(batch, vocabulary, "ids", "decoded"):
        for row in part.to_pylist():
            assert row["doc_id"] == at
            assert row["decoded"] == b"".join(vocabulary.token_bytes[vocabulary.token_ends[i] - 1 : vocabulary.token_ends[i]].tobytes() for i in ids[bounds[at] : bounds[at + 1]])
            at += 1
        # Arrays of eight bytes for every id of the batch would need more.
        most = tracemalloc.get_traced_memory()[1]
        if len(part) > 1:
            assert most < 8 * 2 * len(ids), most
        tracemalloc.reset_peak()
    tracemalloc.stop()
    assert at == len(sizes)


def test_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op7_byte_bpe"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
