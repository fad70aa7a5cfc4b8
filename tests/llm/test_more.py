"""What the other tests leave: spans beside spans, urls of archives, rules as they come out, long and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from tidelog.llm import pii, rules, sentencepieces, warc


def kinds(text):
    return [(k, text[s:e]) for k, s, e, _ in pii.find_spans(text.encode())]


def test_ibans():
    assert kinds("DE89370400440532013000 EUR 20") == [("iban", "DE89370400440532013000")]
    assert kinds("DE89 3704 0044 0532 0130 00 BIC COBADEFF") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("GR16 0110 1250 0000 0001 2300 695 GB82 WEST 1234 5698 7654 32") == [("iban", "GR16 0110 1250 0000 0001 2300 695"), ("iban", "GB82 WEST 1234 5698 7654 32")]
    for wrong in ("DE89370400440532013001", "DE893704004405320130001", "ZZ89370400440532013000", "DE89 3704", "XDE89370400440532013000"):
        assert not [k for k, _ in kinds(wrong) if k == "iban"]
    assert all(15 <= n <= 34 for n in pii.IBAN_LENGTH.values())


def test_context_on_both_sides():
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert kinds(f"{secret} is the token") == kinds(f"token {secret}") == [("secret", secret)]
    assert kinds(f"{secret}{' .' * 40} token") == []


def test_urls_come_back(spark):
    urls = ["http://a/b%20c", "http://a/b c", "q=a%2Fb%26c", "-", "", None, "http://é/日", "a\nb", "http://a/?x=1&y=%"]
    rows = [(i, u, "<p>", "x", "y") for i, u in enumerate(urls)] + [(99, "u", "é" * 3_000_000, "x", "y")]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string, uri string, digest string"))
    assert {r.page_id: r.url for r in got.collect()} == {i: u for i, u, *_ in rows}
    assert {r.payload_bytes for r in got.where("page_id = 99").collect()} == {6_000_000}


def test_rules_as_conditions(spark):
    """The learned list holds of the same rows in Spark as its conditions do in numpy, first rule first."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learned = rules.learn_from(docs, labels)
    assert learned and all(1 <= len(r) <= rules.CONDITIONS for r in learned)
    rows = rules.counted(docs).toPandas()
    x = rules.matrix(rows[list(rules.STATS)].to_numpy())
    first = np.zeros(len(x), int)
    for k, rule in reversed(list(enumerate(learned, 1))):
        first[np.logical_and.reduce([c.holds(x) for c in rule])] = k
    got = {r.doc_id: (r.kept, r.base_failed, r.rule) for r in rules.apply_rules(docs, labels).collect()}
    for doc_id, k in zip(rows.doc_id, first):
        kept, failed, rule = got[doc_id]
        assert rule == (k or None) and kept == (not failed and not k)


def test_samples_of_rules_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3} of some words", "c") for i in range(400)] + [(i, "x ### y", "c") for i in range(2, 30)], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(1, 1, 5), (2, 0, 5), (2, 1, 5), (3, 0, 5), (None, 0, 5)], "doc_id long, quality int, n_words int")
    assert len(rules.labelled(docs, labels, 2)) <= 2 and len(rules.labelled(docs, labels, 100)) == 5
    assert rules.apply_rules(docs, labels).count() == 428


def test_pieces_of_long_texts(spark):
    docs = spark.createDataFrame([(1, "x" * 300_000, "a"), (2, "the word " * 100_000, "a"), (None, None, None)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in sentencepieces.encode_decode(docs, sentencepieces.load()).collect()}
    assert all(r.round_trip for r in rows.values()) and rows[None].n_tokens == 0 and rows[2].n_tokens >= 200_000
    assert sentencepieces.encode_decode(docs.limit(0), sentencepieces.load()).count() == 0
    back = docs.where("doc_id = 2").select(F.length(sentencepieces.decode(sentencepieces.encode(F.col("text"), sentencepieces.load()), sentencepieces.load())))
    assert back.first()[0] == 900_000
