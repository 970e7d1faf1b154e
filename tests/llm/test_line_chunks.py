import hashlib

import numpy as np
import pyarrow as pa

from skuflow.llm import line_chunks
from skuflow.llm.text_arrays import Texts, chain, span_hash


def _hash(lines):
    raw = [line.encode() for line in lines]
    ends = np.cumsum([len(x) for x in raw])
    return span_hash(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends)


def cut(text):
    """Chunks of a text, line by line."""
    lines = text.split("\n") if text else []
    out, current = [], []
    hashes = _hash(lines) if lines else []
    last_cut = None
    for k, line in enumerate(lines):
        current.append(line)
        wanted = k > 0 and int(chain(hashes[k - 1 : k], hashes[k : k + 1])[0]) % line_chunks.DIVISOR == 0
        if not wanted:
            last_cut = None
            continue
        accepted = last_cut is None or not last_cut
        last_cut = accepted
        if accepted and len(lines) - k - 1 != 1 and k < len(lines) - 1:
            out.append(current)
            current = []
    if current:
        out.append(current)
    return out


def brute(rows):
    """What is left of each (id, text), by looking at every chunk in order."""
    seen, result = {}, {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0)):
        kept, removed = [], 0
        for position, chunk in enumerate(cut(text or "")):
            body = "\n".join(chunk)
            if len(chunk) > 1 and body.strip(" \t\n\x0b\x0c\r"):
                if body in seen and seen[body] != (doc_id, position):
                    removed += len(chunk)
                    continue
                seen[body] = (doc_id, position)
            kept.append(body)
        result[(doc_id, text)] = (None if text is None else "\n".join(kept), removed)
    return result


def test_chunks_cut_as_line_by_line():
    rng = np.random.default_rng(3)
    texts = ["\n".join(rng.choice(["a", "b b", "", "c", "ä", "d d d", "e"], rng.integers(0, 30))) for _ in range(300)]
    texts += ["", "\n", "x", "\n\n\n", "a\n", "\na"]
    chunks = line_chunks.Chunks(Texts.of(pa.array(texts)))
    raw = b"".join(t.encode() for t in texts)
    for at, text in enumerate(texts):
        got = [raw[chunks.starts[k] : chunks.ends[k]].decode() for k in range(chunks.first[at], chunks.first[at + 1])]
        assert got == ["\n".join(c) for c in cut(text)], text
        assert chunks.line_counts[at] == (len(text.split("\n")) if text else 0)


def test_repeated_chunks_go_and_the_first_stays(spark):
    rng = np.random.default_rng(5)
    passage = "\n".join(f"passage line number {k}" for k in range(12))
    pool = [f"line {k} of the pool" for k in range(60)]
    rows = [(int(k), "\n".join(rng.choice(pool, rng.integers(1, 12)))) for k in range(80)]
    rows += [(100 + k, f"own line {k}\n{passage}\nand the end {k}") for k in range(12)]
    rows += [(200, None), (201, ""), (202, "single"), (203, "single"), (204, "\n\n\n\n"), (205, "\n\n\n\n"), (None, passage), (100, f"own line 0\n{passage}\nand the end 0")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, size int")
    got = line_chunks.remove_repeats(docs).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    left = sorted((str(r.doc_id), str(r.text), r.n_removed, r.key, r.size) for r in got)
    assert left == sorted((str(i), str(want[i, t][0]), want[i, t][1], "x", 1) for i, t in rows)
    assert sum(r.n_removed for r in got) > 20


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_chunks.remove_repeats(docs).collect() == []


def test_query_follows_the_brute_force(spark):
    from skuflow.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = brute([(r.doc_id, r.text) for r in docs])
    got = {r.doc_id: r for r in QUERIES["op10_line_chunks"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for r in docs:
        text, removed = want[r.doc_id, r.text]
        assert (got[r.doc_id].n_removed, got[r.doc_id].kept_sha256) == (removed, hashlib.sha256(text.encode()).hexdigest())
