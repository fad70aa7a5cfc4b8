"""Token counts as rollups maintained by signed deltas.

A batch is a set of changes, each with an old and a new record (source, lang,
tokenizer, n_tokens) of a document: no old one is an insert, no new one a
delete, both a revision, which may move a document to another source, language
or tokenizer version. A batch's changes are summed to one signed row for each
key and written to a folder of their own; the batch counts once its commit is in
the log, a file under the next number, which only one writer can create. Running
a batch again, or a second writer with the same batch, changes nothing. Totals
are the sum of the deltas of all commits; ``compact`` folds those that are live
into one, which is void if another fold took one of them first.

Case handling: null source, lang or tokenizer is a key of its own; null counts
are 0; empty batches commit and add nothing; repeated changes count as often as
they stand there (a batch is idempotent, a row isn't); keys whose documents and
tokens come to zero are left out of the totals; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import sentencepieces
from tidelog.llm.common import prepare, stored, work_dir
from tidelog.sources.files import Folder

KEY = ("source", "lang", "tokenizer")
RECORD = "struct<source: string, lang: string, tokenizer: string, n_tokens: bigint>"


def record(source: Column | str, lang: Column | str, tokenizer: Column, n_tokens: Column | str) -> Column:
    named = [x if isinstance(x, Column) else F.col(x) for x in (source, lang, tokenizer, n_tokens)]
    return F.struct(*(c.alias(n) for c, n in zip(named, (*KEY, "n_tokens")))).cast(RECORD)


def inserts(docs: DataFrame, new: Column) -> DataFrame:
    return docs.select(F.lit(None).cast(RECORD).alias("old"), new.alias("new"))


def deletes(docs: DataFrame, old: Column) -> DataFrame:
    return docs.select(old.alias("old"), F.lit(None).cast(RECORD).alias("new"))


def revisions(docs: DataFrame, old: Column, new: Column) -> DataFrame:
    return docs.select(old.alias("old"), new.alias("new"))


def delta(changes: DataFrame) -> DataFrame:
    """Signed sums of the changes by key; summed in each task before the shuffle."""
    signed = changes.select(F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("old").alias("r")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("r")))).alias("x")).where("x.r is not null")
    tokens = F.col("x.sign") * F.coalesce("x.r.n_tokens", F.lit(0))
    return signed.groupBy(*(F.col(f"x.r.{k}").alias(k) for k in KEY)).agg(F.sum(F.col("x.sign").cast("long")).alias("n_docs"), F.sum(tokens).alias("n_tokens"))


class Rollup:
    """Totals in a folder of the shared file system, by a log of numbered commits."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)
        self.folder.make("commits")

    def _replayed(self) -> tuple[int, dict[int, str], set[str]]:
        """The last commit's number, the delta folders that count by commit, and all batches; commits are taken in order.

        A batch that an earlier commit has, and a fold of what isn't live any more, are void.
        """
        live: dict[int, str] = {}
        batches: set[str] = set()
        names = self.folder.names("commits")
        for name in names:
            number, commit = int(name.removesuffix(".json")), self.folder.read(f"commits/{name}")
            if "batch" in commit and commit["batch"] not in batches:
                batches.add(commit["batch"])
                live[number] = commit["folder"]
            elif "replaces" in commit and live.keys() >= set(commit["replaces"]):
                for k in commit["replaces"]:
                    del live[k]
                live[number] = commit["folder"]
        return (int(names[-1].removesuffix(".json")) if names else 0), live, batches

    def _append(self, commit: dict, valid) -> bool:
        """Commit under the next free number, while ``valid`` holds of what is live and known by then."""
        while True:
            last, live, batches = self._replayed()
            if not valid(live, batches):
                return False
            if self.folder.publish(f"commits/{last + 1:010d}.json", commit):
                return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch once; False if it was there before."""
        if batch in self._replayed()[2]:
            return False
        folder = f"deltas/{batch}-{uuid.uuid4().hex}"
        delta(changes).write.parquet(self.folder.path(folder))
        return self._append({"batch": batch, "folder": folder}, lambda live, batches: batch not in batches)

    def _total(self, folders: Iterable[str]) -> DataFrame:
        paths = [self.folder.path(f) for f in folders]
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all commits; keys at zero are left out."""
        return self._total(self._replayed()[1].values())

    def compact(self) -> bool:
        """Fold all live commits into one; False if another fold was first. Batches stay known."""
        _, live, _ = self._replayed()
        folder = f"deltas/fold-{uuid.uuid4().hex}"
        self._total(live.values()).write.parquet(self.folder.path(folder))
        return self._append({"replaces": sorted(live), "folder": folder}, lambda now, _: now.keys() >= live.keys())


def word_count(text: Column) -> Column:
    """Runs of other than white space, the first tokenizer's tokens."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def counted(docs: DataFrame, model: bytes) -> DataFrame:
    """Counts of each document by both tokenizers, as a stored table."""
    prepare(docs.sparkSession)
    return stored(docs.select("doc_id", "source", "lang", word_count(F.col("text")).alias("words"), sentencepieces.count(F.col("text"), model).alias("pieces")), "counts")


def maintain(docs: DataFrame, model: bytes, version: str = "piece_bpe_32k") -> DataFrame:
    """The totals after three batches over all documents: insert them by words, revise their counts to the model's pieces, delete those without a token.

    Each batch is committed twice; the second time does nothing.
    """
    rows = counted(docs, model)
    words = record("source", "lang", F.lit("words"), "words")
    pieces = record("source", "lang", F.lit(version), "pieces")
    rollup = Rollup(docs.sparkSession, work_dir(docs.sparkSession, "rollup"))
    for batch, changes in (("insert", inserts(rows, words)), ("revise", revisions(rows, words, pieces)), ("delete", deletes(rows.where("pieces = 0"), pieces))):
        rollup.commit(batch, changes)
        rollup.commit(batch, changes)
    rollup.compact()
    return rollup.totals()
