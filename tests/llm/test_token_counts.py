"""Rollups with several writers, folds at once, and odd and empty tables."""

from pyspark.sql import functions as F

from tidelog.llm import sentencepieces, token_counts

def record():
    return token_counts.record("source", "lang", F.lit("v1"), "n")


def totals(rollup):
    return {(r.source, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_folds_and_writers_at_once(spark, tmp_path):
    root = (tmp_path / "r").as_uri()
    docs = spark.createDataFrame([("a", "en", 5), ("a", "en", 7), ("b", "en", 1)], "source string, lang string, n long")
    one, two = token_counts.Rollup(spark, root), token_counts.Rollup(spark, root)
    assert one.commit("1", token_counts.inserts(docs, record())) and two.commit("2", token_counts.inserts(docs.limit(1), record()))
    want = {("a", "v1"): (3, 17), ("b", "v1"): (1, 1)}
    assert totals(one) == want
    # two folds that both saw both batches, and a batch between them
    _, live, _ = one._replayed()
    folders = []
    for k, rollup in enumerate((one, two)):
        folders.append(f"deltas/fold-test-{k}")
        rollup._total(live.values()).write.parquet(rollup.folder.path(folders[-1]))
    assert one._append({"replaces": sorted(live), "folder": folders[0]}, lambda now, _: True)
    assert two.commit("3", token_counts.deletes(docs.where("source = 'b'"), record()))
    assert two._append({"replaces": sorted(live), "folder": folders[1]}, lambda now, _: True)  # in the log, but void
    assert totals(one) == totals(two) == {("a", "v1"): (3, 17)}
    # two writers of one batch, both past the first look
    fold = {"batch": "4", "folder": folders[0]}
    assert one._append(fold, lambda *_: True) and two._append(fold, lambda *_: True)
    assert totals(one) == {("a", "v1"): (6, 34), ("b", "v1"): (1, 1)}
    assert one.compact() and totals(one) == {("a", "v1"): (6, 34), ("b", "v1"): (1, 1)}
    assert not one.commit("4", token_counts.inserts(docs, record())) and not two.commit("1", token_counts.inserts(docs, record()))


def test_names_are_taken_once(spark, tmp_path):
    from tidelog.sources.files import Folder

    folder = Folder(spark, tmp_path.as_uri())
    assert folder.publish("x", {"a": 1}) and not folder.publish("x", {"a": 2}) and folder.read("x") == {"a": 1}
    assert [n for n in folder.names("") if n.startswith("aside")] == []


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 9, "r")], "doc_id long, text string, lang string, source string, pieces long, tokenizer string")
    rows = token_counts.maintain(docs, sentencepieces.load()).collect()
    assert [(r.source, r.n_docs) for r in rows] == [("s", 1)] and rows[0].n_tokens != 9
    assert token_counts.maintain(docs.limit(0), sentencepieces.load()).count() == 0
