"""Every stage against brute force, to the end on odd, repeated and no rows, and the whole run."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import common, pii, pipeline, sentencepieces, simhash

from test_llm import ODD, SF, brute_components, brute_contamination, brute_fingerprint, texts_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_key string, found string, count long, row string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, one doc_id with two texts, and further columns with names that the plans use."""
    more = [(8, "one two three four five six", "en"), (8, "quite another text altogether here", "en"), (None, "Der Hund", "de"), (None, None, None), (9, "The cat sat on the mat.", "en")]
    return spark.createDataFrame([(*r, "s", 1, "k", "f", 2, "r") for r in [*ODD, *more]], DOCS)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, str(SF)).cache()
        if name != "SentencePiece encoding and decoding":
            assert kept.columns == list(corpus_pipeline.COLUMNS)
        if name == "SimHash near-dedup":
            want = brute_components({i: brute_fingerprint(t) for i, t in texts_of(before).items()})
            assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c}
        elif name == "benchmark decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert {r.doc_id for r in kept.collect()} == {i for i, t in texts_of(before).items() if not brute_contamination(t, items)[-1]}
        elif name == "PII":
            texts = texts_of(before)
            assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {i: ((x := pii._redacted(t.encode())), len(x)) for i, t in texts.items()}
    model, texts = sentencepieces.Model(sentencepieces.load()), texts_of(before)
    for r in kept.collect():
        assert r.round_trip and r.n_tokens == len(r.ids) and model.decode(r.ids).decode() == texts[r.doc_id].replace("▁", " ")
    assert kept.count() > 0.5 * docs.count()


def test_run(spark):
    rows = corpus_pipeline.run(spark, str(SF)).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len({r.doc_id for r in rows}) == len(rows) and {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(rows) > 0.5 * docs.count()


def told(df):
    return sorted((repr(r.doc_id), repr(r.text)) for r in df.collect())


def test_language_of_odd_rows(spark, odd):
    kept = pipeline.identify_language(spark, odd, str(SF))
    assert all(r.text and r.text.strip() and r.lang in ("en", "de", "fr") for r in kept.collect())
    assert kept.columns == list(corpus_pipeline.COLUMNS)


def test_near_duplicates_of_odd_rows(spark, odd):
    kept = pipeline.drop_near_duplicates(spark, odd, str(SF)).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    # of each component one row: by the brute force over distinct texts
    texts = {t: brute_fingerprint(t) for _, t in rows}
    names = {t: k for k, t in enumerate(sorted(texts, key=repr))}
    component = brute_components({names[t]: f for t, f in texts.items()})
    best = {}
    for i, t in rows:
        best.setdefault(component[names[t]], []).append(i)
    least = sorted(repr(min((i for i in ids if i is not None), default=None)) for ids in best.values())
    assert sorted(repr(r.doc_id) for r in kept) == least


def test_contaminated_odd_rows(spark, odd, tmp_path):
    """A null doc_id's row goes by its text; a clean text of a contaminated one's doc_id stays."""
    text = "one two three four five six"
    spark.createDataFrame([(1, text), (2, "Der Hund"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = pipeline.drop_contaminated(spark, odd, str(tmp_path))
    assert told(kept) == sorted((repr(r.doc_id), repr(r.text)) for r in odd.collect() if r.text not in (text, "Der Hund"))


def test_redacted_and_encoded_odd_rows(spark, odd):
    redacted = pipeline.redact_personal_data(spark, odd, str(SF))
    assert told(redacted) == sorted((repr(r.doc_id), repr(r.text)) for r in odd.collect())
    rows = pipeline.encode_pieces(spark, redacted, str(SF)).collect()
    assert len(rows) == odd.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}


@pytest.mark.parametrize("k", range(5))
def test_empty_table(spark, odd, k):
    assert corpus_pipeline.STAGES[k][1](spark, odd.limit(0), str(SF)).count() == 0


def test_all_rows_alike(spark):
    rows = [(random.Random(1).randrange(5), "the same text of a few words", "en", "s", 1)] * 50 + [(7, "the same text of a few words", "en", "s", 1)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, str(SF)).collect()] == [rows[0][0]]
    assert simhash.grouped(docs).where("first").count() == 50


def test_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(type("Session", (), {"sparkContext": Context()})())
    assert common.work_dir(spark, "x").startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))


def test_stage_plans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    plan = pipeline.encode_pieces(spark, docs, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1 and "n_chars" not in plan
