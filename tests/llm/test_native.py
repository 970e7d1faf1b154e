import random
import re
from collections import Counter

import pytest

from skuflow.llm import license_scan, pii


def luhn(digits):
    values = [int(c) for c in reversed(digits)]
    return sum(v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(values)) % 10 == 0


def spans(text):
    """Base kinds by the contract's own patterns."""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if low <= len(digits) <= high and (kind == "phone" or luhn(digits)):
                out.append((kind, m))
    return ",".join(f"{kind}:{m.start()}:{m.end()}" for kind, m in out)


def test_base_spans_follow_the_patterns(spark):
    rng = random.Random(1)
    parts = ["a", "b@c.d", "1.2.3.4", "255", ".", " ", "-", "+1", "4111111111111111", "5", "(", ")", "_x@y.zz", "@", "", "é", "😀", "%", "\n", "000256.1.1.1", "49", "", " 4111-1111-1111-1111 "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += [None, "", "1" * 20_000, "a" * 100_000, "a@b" + ".c" * 20_000, "1.2.3.4 " * 2000, "+1" + " " * 20_000]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, email string, ip int").repartition(8)
    base = [k.name for k in pii.KINDS if k.base]
    got = {r[0]: r[1] for r in pii.personal_data(docs).select("doc_id", pii.span_text(base)).collect()}
    for k, text in enumerate(texts):
        assert got[k] == spans(text or ""), repr(text)[:300]


@pytest.mark.parametrize(("text", "want"), [
    ("iban DE89370400440532013000.", "iban:5:27"), ("iban DE89370400440532013001.", ""), ("GB82 WEST 1234 5698 7654 32", "iban:0:27"),
    ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "secret:9:49"), ('about "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', ""),
    ("my ssn is 123-45-6789", "ssn:10:21"), ("part 123-45-6789", ""), ("ssn 000-45-6789", ""),
])
def test_checksums_and_context(spark, text, want):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    added = [k.name for k in pii.KINDS if not k.base]
    assert pii.personal_data(docs).select(pii.span_text(added)).first()[0] == want


def test_context_raises_the_score(spark):
    docs = spark.createDataFrame([(1, "call +1 (017) 555-7713"), (2, "so +1 (017) 555-7713")], "doc_id long, text string")
    got = {r.doc_id: r.phone[0].score for r in pii.personal_data(docs).collect()}
    assert got == {1: 0.8, 2: 0.6}


def test_personal_data_runs_in_the_jvm_and_on_no_rows(spark):
    found = pii.personal_data(spark.createDataFrame([], "doc_id long, text string"))
    assert found.collect() == []
    assert not re.search("Python|Pandas|Arrow|Exchange", found._jdf.queryExecution().executedPlan().toString())


def brute_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_phrases_stand_where_their_words_do(spark):
    rng = random.Random(3)
    words = ["CC", "by", "cc-by", "general", "Public", "license", "all", "rights", "reserved.", "x", "K", "é", "İ", "\n", "--"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, "", "All rights reserved." * 3000]
    docs = spark.createDataFrame([(k, t, "x", 2) for k, t in enumerate(texts)], "doc_id long, text string, templates string, n_words int")
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    for k, text in enumerate(texts):
        own = brute_words(text)
        assert got[k].n_words == len(own)
        for phrase, label in license_scan.PHRASES:
            parts = phrase.split()
            assert got[k][label] == [i for i in range(len(own) - len(parts) + 1) if own[i : i + len(parts)] == parts]


def templates_found(texts):
    """(label, score) of each text, by trying every template at every place where two of its four rarest words stand right."""
    files = [brute_words(t) for t in texts]
    counts = Counter(w for f in files for w in set(f))
    out = []
    for words in files:
        found = []
        for template in license_scan.TEMPLATES:
            parts, phrase = brute_words(template.text), template.phrase.split()
            at = next(k for k in range(len(parts)) if parts[k : k + len(phrase)] == phrase)
            rarest = sorted(set(parts) & set(words), key=lambda w: (counts[w], w))[:4]
            best = 0
            for begin in range(-len(parts), len(words)):
                there = [w for k, w in enumerate(parts) if 0 <= begin + k < len(words) and words[begin + k] == w]
                if len(set(there) & set(rarest)) >= 2 and begin + at >= 0 and words[begin + at : begin + at + len(phrase)] == phrase:
                    best = max(best, len(there))
            if best:
                found.append((template.label, best / len(parts)))
        out.append(found)
    return out


def test_templates_by_relative_position(spark):
    rng = random.Random(5)
    headers = [t.text for t in license_scan.TEMPLATES]
    texts = []
    for _ in range(200):
        words = rng.choice(headers).split()
        for _ in range(rng.choice([0, 1, 1, 3, 6])):
            words[rng.randrange(len(words))] = rng.choice(["changed", "the", "license"])
        texts.append(" ".join(rng.choice(["filler", "the", "license", "under"]) for _ in range(rng.randint(0, 20))) + " " + " ".join(words) + " end")
    texts += ["", None, "license mit apache gnu", "mit license", "Released under the MIT License."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.templates] for r in license_scan.license_scan(docs).collect()}
    assert [got[k] for k in range(len(texts))] == templates_found(texts)


def test_a_header_in_over_a_third_of_the_files_is_found(spark):
    """Labels don't depend on how frequent a licence is."""
    apache = next(t.text for t in license_scan.TEMPLATES if t.label == "apache-2.0")
    texts = [f"file {k} " + ("Released under the MIT license." if k % 2 else apache if k % 3 else "no header") for k in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.templates] for r in license_scan.license_scan(docs).collect()}
    for k in got:
        assert got[k] == ([("mit", 1.0)] if k % 2 else [("apache-2.0", 1.0)] if k % 3 else [])


def test_a_file_with_every_header_gets_every_label(spark):
    """However many licence words a file has, rare ones before or not, each header in it is found."""
    rng = random.Random(7)
    headers = [t.text for t in license_scan.TEMPLATES]
    prose = " ".join(license_scan.vocabulary())
    texts = [" end. ".join(rng.sample(headers, len(headers))) for _ in range(3)] + [f"{prose} {h} end" for h in headers]
    texts += [headers[0]] * 30  # its words are the most frequent ones
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for row in license_scan.license_scan(docs).collect():
        best = got.setdefault(row.doc_id, {})
        for label, score in map(tuple, row.templates):
            best[label] = max(score, best.get(label, 0.0))
    for k, text in enumerate(texts):
        for template in license_scan.TEMPLATES:
            if template.text in text:
                assert got[k][template.label] == 1.0, (text, template)


def test_license_scan_runs_in_the_jvm_and_on_no_rows(spark):
    found = license_scan.license_scan(spark.createDataFrame([], "doc_id long, text string"))
    assert found.collect() == []
    found = license_scan.license_scan(spark.createDataFrame([(1, "mit license")], "doc_id long, text string"))
    assert not re.search("Python|Pandas|ArrowEval", found._jdf.queryExecution().executedPlan().toString())
