from pyspark.sql import functions as F

import corpus_pipeline

FIXTURE = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_their_own_decisions(spark):
    docs = spark.read.parquet(f"{FIXTURE}/documents.parquet")
    from tests.llm import test_line_chunks, test_simhash

    language, lines, near, bench, tokens = (f for _, f in corpus_pipeline.STAGES)
    first = language(spark, docs, FIXTURE).cache()
    assert first.columns == docs.columns and 0.97 * docs.count() <= first.count() <= docs.count()

    second = lines(spark, first, FIXTURE).cache()
    want = test_line_chunks.brute([(r.doc_id, r.text) for r in first.collect()])
    left = {r.doc_id: (r.text, r.n_chars) for r in second.collect()}
    assert second.columns == docs.columns
    assert left == {i: (text, len(text)) for (i, _), (text, removed) in want.items() if not removed or text.strip(" \t\n\x0b\x0c\r")}

    third = near(spark, second, FIXTURE).cache()
    rows = sorted((r.doc_id, r.text) for r in second.collect())
    roots = test_simhash.classes([test_simhash.fingerprint(t) for _, t in rows], 2)
    assert {r.doc_id for r in third.collect()} == {rows[k][0] for k in set(roots)} and third.columns == docs.columns

    fourth = bench(spark, third, FIXTURE).cache()
    assert fourth.columns == docs.columns and 0 < fourth.count() <= third.count()
    items = [r.text for r in spark.read.parquet(f"{FIXTURE}/benchmark.parquet").collect()]
    assert not any(item in r.text for r in fourth.collect() for item in items)

    fifth = tokens(spark, fourth, FIXTURE).collect()
    assert len(fifth) == fourth.count() and all(r.restored and r.n_tokens == len(r.ids) for r in fifth)
    assert {r.doc_id for r in corpus_pipeline.run(spark, FIXTURE).select("doc_id").collect()} == {r.doc_id for r in fifth}


def test_nulls_and_no_rows(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "the of and to in is", "en", None, 3), (2, "", "en", "s", 0), (3, "the of and to in is", "en", "s", 19)], columns)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FIXTURE)
            assert docs.count() >= 0, name


def test_columns_with_any_name_pass_through(spark):
    """Names that the stages use themselves, in either case; their values stay."""
    names = ["repeats", "IDS", "n_tokens", "restored", "__key", "__rows", "__language", "key", "number", "other_id", "Marks", "language", "score", "lines", "removed", "matches", "raw", "decoded", "fp", "root", "n", "place"]
    docs = spark.read.parquet(f"{FIXTURE}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(5))
    odd = docs.select("*", *[F.concat(F.lit(name), F.col("doc_id").cast("string")).alias(name) for name in names])
    plain, step = docs, odd
    for name, stage in corpus_pipeline.STAGES:
        plain, step = stage(spark, plain, FIXTURE).cache(), stage(spark, step, FIXTURE).cache()
        assert plain.count() == step.count(), name
        if name != "byte-level BPE":
            assert step.columns == odd.columns
    last = [n for n in names if n.lower() not in ("ids", "n_tokens", "restored")]
    rows = step.collect()
    assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in last)
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted((r.doc_id, r.n_tokens) for r in plain.collect()) and len(rows) > 30
