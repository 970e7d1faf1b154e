import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skuflow.llm import language_id, quality_gam
from skuflow.llm.queries import QUERIES
from skuflow.llm.tables import crc_of
from skuflow.llm.text_arrays import Texts

FIXTURE = "/root/testdata/sf0.01"


def test_additive_model_learns_single_features_and_a_pair():
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.625) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells; the cuts lie on eighths, as pair bins do
    model = quality_gam.fit_gam(x[:2000], y[:2000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    step = (x[:, 2] > 0.3).astype(float)
    single = quality_gam.fit_gam(x[:2000], step[:2000])
    assert ((single.score(x[2000:]) > 0.5) == step[2000:]).mean() > 0.97


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(3)
    x = rng.random((400, len(quality_gam.FEATURES)))
    model = quality_gam.fit_gam(x, (x[:, 0] + x[:, 3] > 1).astype(float))
    for row, score in zip(x[:20], model.score(x[:20]), strict=True):
        total = model.base + sum(t[np.searchsorted(e, v)] for e, t, v in zip(model.edges, model.tables, row, strict=True))
        total += sum(t[np.searchsorted(model.pair_edges[a], row[a]), np.searchsorted(model.pair_edges[b], row[b])] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-8


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a text", 0), (3, "x" * 300_000, 0), (3, "x" * 300_000, 0)], "doc_id long, text string, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_gam.quality_classifier(docs, none, crc_of("doc_id", 4) != 2).collect()
    assert len(rows) == 5 and all(r.score == 0.5 for r in rows)
    assert quality_gam.quality_classifier(docs.limit(0), none, F.lit(True)).collect() == []


def test_quality_of_held_out_documents(spark):
    rows = QUERIES["op2_quality_classifier"](spark, FIXTURE)
    labels = spark.read.parquet(f"{FIXTURE}/labels.parquet").select("doc_id", "quality")
    held = rows.where("held_out").join(labels, "doc_id").collect()
    assert len(held) > 60 and np.mean([r.predicted == r.quality for r in held]) > 0.93
    assert rows.count() == spark.read.parquet(f"{FIXTURE}/documents.parquet").count()


def test_trigram_counts_by_hand():
    texts = ["ab c", "", "AbC", "é!"]
    x = language_id.trigram_counts(Texts.of(pa.array(texts)))
    assert x.sum(1).tolist() == [2, 0, 1, 1]  # "ab ", "b c"; none; "abc"; two bytes and a mark
    assert x[2].argmax() == language_id.trigram_counts(Texts.of(pa.array(["abc"])))[0].argmax()


def test_machines_vote_within_the_family(spark):
    rows = [(k, f"the and of {k} which is", "en") for k in range(30)] + [(100 + k, f"der und das {k} nicht ist", "de") for k in range(30)]
    rows += [(200 + k, f"le et la {k} une est", "fr") for k in range(30)] + [(300 + k, "qq zz xx", "xx") for k in range(30)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string")
    model = language_id.train(docs, F.lit(True), "doc_id", "text", "lang")
    assert model.families.names == ["germanic", "romance", "xx"] and model.languages["germanic"].names == ["de", "en"]
    found = language_id.identify(docs.select("doc_id", "text", "lang"), model).collect()
    assert all(r.lang_pred == r.lang and 0 < r.score <= 1 for r in found)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (None, "the and of"), (4, "漢字")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(odd, model).collect()}
    assert [got[1], got[2], got[3], got[None]] == ["und"] * 3 + ["en"] and got[4] != "und"
    untrained = language_id.train(docs.limit(0), F.lit(True), "doc_id", "text", "lang")
    assert {r.lang_pred for r in language_id.identify(odd, untrained).collect()} == {"und"}


def test_language_of_held_out_documents(spark):
    rows = QUERIES["op4_language_id"](spark, FIXTURE)
    known = spark.read.parquet(f"{FIXTURE}/documents.parquet").select("doc_id", "lang")
    held = rows.where("held_out").join(known, "doc_id").collect()
    assert len(held) > 250 and np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_every_language_is_learned(spark):
    """Hundreds of languages that no family lists: each has a family, its sample and its machines."""
    words = [f"{a}{b}{c}" for a in "bcdfgklm" for b in "aeiou" for c in "nprstvwz"]
    rows = [(k * 100 + n, " ".join(words[k % len(words)] + words[(k * 7 + 3) % len(words)] for _ in range(6)), f"x{k:03d}") for k in range(250) for n in range(3)]
    rows += [(90_000 + n, "the and of which is", "en") for n in range(4000)]  # one language holds most rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    model = language_id.train(docs, F.lit(True), "doc_id", "text", "lang", limit=400)
    learned = {name for machines in model.languages.values() for name in machines.names}
    assert learned == {r[2] for r in rows} and len(model.families.names) <= language_id.OWN_FAMILIES + 1
    found = language_id.identify(docs.where("lang != 'en' or doc_id < 90010"), model).collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.9


def test_predictions_by_plain_dot_products(spark):
    """Predictions of whole texts from trigram counts, dot products and votes worked out one at a time."""
    docs = spark.read.parquet(f"{FIXTURE}/documents.parquet")
    model = language_id.train(docs, crc_of("doc_id", 3) != 1, "doc_id", "text", "lang")

    def vote(machines, x):
        votes = dict.fromkeys(range(len(machines.names)), 0.0)
        if len(votes) == 1:
            return {0: 1.0}
        column = 0
        for a in range(len(votes)):
            for b in range(a + 1, len(votes)):
                margin = sum(v * float(machines.weights[at, column]) for at, v in x.items())
                p = 1 / (1 + math.exp(-language_id.SHARPNESS * margin))
                votes[a], votes[b], column = votes[a] + p, votes[b] + 1 - p, column + 1
        return {k: v / (len(votes) - 1) for k, v in votes.items()}

    for r in language_id.identify(docs.select("doc_id", "text").limit(40), model).collect():
        counts = Counter()
        data = [(b | 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalpha() else 32 for b in r.text.encode()]
        for a, b, c in zip(data, data[1:], data[2:], strict=False):
            if (a, b, c) != (32, 32, 32):
                counts[((a | b << 8 | c << 16) * 2654435761 & 0xFFFFFFFF) >> 20] += 1
        length = math.sqrt(sum(counts.values()))
        x = {at: math.sqrt(n) / length for at, n in counts.items()}
        families = vote(model.families, x)
        family = max(families, key=families.get)
        machines = model.languages[model.families.names[family]]
        votes = vote(machines, x)
        best = max(votes, key=votes.get)
        assert r.lang_pred == machines.names[best] and abs(r.score - families[family] * votes[best]) < 1e-4
