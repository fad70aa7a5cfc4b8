"""Benchmark decontamination by winnowing, with DataFrame and SQL functions only.

Of every ``W`` successive hashes of ``K`` words the least is kept (the leftmost,
if several are), on both sides, so two texts that share a window of ``SPAN``
words keep a hash at the same place of it: an anchor. Documents with a hash of
an item's anchor are candidates. Anchors of candidates are joined to those of
items by hash and extended: the words around both are compared, to either side
as far as a window that holds the anchor can reach, and an agreement of a
window's length or more is a hit. An item's anchors that stand in the same words
are one, so what a repeated phrase costs grows with the document, not with the
product of its places in both.

A window is 13 successive words of an item, or the whole of a shorter item with
any words. Items shorter than 13 words are found by their first six words (all
of them, if fewer) among all the document's shingles of that length; that part
of the plan is there only if such items are.

The documents' text is read twice, at the start and, for the candidates, at the
end; a bitmap of fixed size keeps most others out of that join's shuffle. The
planner broadcasts the items' side while its file is under the broadcast limit
and sorts and merges beyond it, where adaptive execution splits a hash that many
documents have.

Case handling: null text has no words; null doc_id or item_id is a value like
any other (written ``null`` in the digest's list); repeated documents each get
their row, repeated items count once; without items or documents nothing is
hit; further columns are ignored, whatever their names; a very long text is one
row whose arrays are linear in its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import prepare, stored

#: Words of a window, of a hashed shingle, and shingles among which the least is kept.
SPAN, K = 13, 6
W = SPAN - K + 1
#: Words before an anchor that a window which holds it can reach.
REACH = SPAN - K
#: Bits of the filter of candidates: a row of 64 each, so its broadcast has BUCKETS / 64 rows of 16 bytes at most, 4 MB.
BUCKETS = 1 << 24
#: Separators between words once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text with A-Z, and nothing else, lower-cased; none for null.

    ``lower`` does the same to a text of ASCII alone, and does it faster. The
    split is bound once and its empty ends cut off.
    """
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    parts = F.array(F.split(F.coalesce(lowered, F.lit("")), BETWEEN))
    first, last = (lambda p: (p[0] == "").cast("int")), (lambda p: (F.element_at(p, -1) == "").cast("int"))
    return F.transform(parts, lambda p: F.slice(p, first(p) + 1, F.greatest(F.size(p) - first(p) - last(p), F.lit(0))))[0]


def _shifted(what: str, of: str, by: int, to: str | None = None) -> str:
    """``what`` of a (an entry of ``of``) and b (the entry of ``to`` that stands ``by`` places further on)."""
    return f"zip_with({of}, slice({to or of}, {by + 1}, 1000000000), (a, b) -> {what})"


def _kept(df: DataFrame) -> DataFrame:
    """Adds ``grams``, hashes of all K-word shingles, and ``kept``, the least of each window, for texts of SPAN words or more.

    Both are made by doubling (pairs, then pairs of pairs), which takes six passes over the words.
    """
    paired = df.withColumn("two", F.expr(_shifted("xxhash64(a, b)", "words", 1))).withColumn("four", F.expr(_shifted("xxhash64(a, b)", "two", 2)))
    grams = paired.withColumn("grams", F.expr(f"if(size(words) < {SPAN}, array(), slice({_shifted('xxhash64(a, b)', 'four', 4, 'two')}, 1, size(words) - {K - 1}))"))
    least = grams.withColumn("m2", F.expr(_shifted("least(a, b)", "grams", 1))).withColumn("m4", F.expr(_shifted("least(a, b)", "m2", 2)))
    return least.withColumn("kept", F.expr(f"if(size(grams) = 0, array(), slice({_shifted('least(a, b)', 'm4', 4)}, 1, size(grams) - {W - 1}))"))


def _anchored(df: DataFrame) -> DataFrame:
    """Adds ``anchors`` (hash, place), the leftmost least of each window, to what ``_kept`` gives."""
    placed = df.withColumn("places", F.expr(f"array_distinct(transform(kept, (x, i) -> i + array_position(slice(grams, i + 1, {W}), x) - 1))"))
    return placed.withColumn("anchors", F.expr("transform(places, p -> struct(grams[p] as hash, p as place))"))


def _shingles(n: int) -> str:
    """All shingles of n words of a text, hashed apart from those of other lengths."""
    return f"if(size(words) < {n}, array(), slice(transform(words, (x, i) -> xxhash64({n}, slice(words, i + 1, {n}))), 1, size(words) - {n - 1}))"


#: The words around an anchor that a window with it can reach, and how many of them stand before it.
AROUND = (
    f"slice(words, cast(greatest(a.place - {REACH}, 0) as int) + 1, cast(least(a.place, {REACH}) as int) + {SPAN}) as around",
    f"cast(least(a.place, {REACH}) as int) as before",
)


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct items with words: their id as text, their words, window length and anchors."""
    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words(F.col(text_col).cast("string")).alias("words"))
    made = _anchored(_kept(named.where("size(words) > 0").distinct()))
    short = F.expr(f"array(struct(xxhash64(least({K}, size(words)), slice(words, 1, {K})) as hash, 0L as place))")
    return made.select("item", "words", F.least(F.size("words"), F.lit(SPAN)).alias("span"), F.when(F.size("words") >= SPAN, F.col("anchors")).otherwise(short).alias("anchors"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each document.

    ``contaminated``: something is hit and ``share * n_hit >= n_words``.
    """
    return keyed_contamination(docs, items, id_col, text_col, item_col, item_text_col, share).drop("text_key")


def keyed_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: int = 20) -> DataFrame:
    """As ``contamination``, with text_key, a hash of the text."""
    prepare(docs.sparkSession)
    item_table = stored(_items(items, item_col, item_text_col), "items")
    marks = item_table.select("item", "span", "words", F.explode("anchors").alias("a")).selectExpr("item", "span", "a.hash", *AROUND)
    marks = stored(marks.groupBy("hash", "span", "around", "before").agg(F.collect_set("item").alias("items")).withColumnsRenamed({"around": "item_around", "before": "item_before"}), "marks")
    wanted = marks.select("hash").distinct()
    shorts = sorted({min(K, r[0]) for r in item_table.where(F.col("span") < SPAN).select("span").distinct().collect()})  # 12 rows at most

    doc = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = _kept(doc.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words")))
    parts = [F.col("kept"), *(F.expr(_shingles(n)) for n in shorts)]
    base = stored(hashed.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), F.array_distinct(F.concat(*parts)).alias("kept")), "kept")
    found = stored(base.select("doc_id", "text_key", F.explode("kept").alias("hash")).join(wanted, "hash", "left_semi").select("doc_id", "text_key").distinct(), "found")

    bucket = lambda key: F.xxhash64("doc_id", key).bitwiseAND(F.lit(BUCKETS - 1))
    taken = found.select(bucket("text_key").alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
    marked = doc.withColumn("b", bucket(F.xxhash64("text"))).withColumn("word", F.shiftright("b", 6))
    doc = marked.join(F.broadcast(taken), "word").where("shiftright(bits, cast(b & 63 as int)) & 1 = 1").select("doc_id", F.xxhash64("text").alias("text_key"), "text")

    def matched(rows: DataFrame, others: DataFrame, how: str) -> DataFrame:
        """Joined by document; a null doc_id is a value."""
        others = others.withColumnsRenamed({"doc_id": "other_id", "text_key": "other_key"})
        return rows.join(others, F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("text_key") == F.col("other_key")), how).drop("other_id", "other_key")

    held = matched(doc, found, "left_semi").dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", words(F.col("text")).alias("words"))
    every = [F.col("anchors"), *(F.expr(f"transform({_shingles(n)}, (x, i) -> struct(x as hash, cast(i as bigint) as place))") for n in shorts)]
    held = stored(_anchored(_kept(held)).select("doc_id", "text_key", "words", F.concat(*every).alias("anchors")), "held")
    anchors = held.select("doc_id", "text_key", F.explode("anchors").alias("a")).select("doc_id", "text_key", "a.hash", "a.place").join(wanted, "hash", "left_semi")
    placed = anchors.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("hash", "place")).alias("anchors"))
    around = matched(held.drop("anchors"), placed, "inner").select("doc_id", "text_key", "words", F.explode("anchors").alias("a")).selectExpr("doc_id", "text_key", "a.hash", "a.place", *AROUND)

    aligned = around.join(marks, "hash").withColumn("back", F.least("before", "item_before"))
    same = "array_join(zip_with(slice(around, before - back + 1, 1000), slice(item_around, item_before - back + 1, 1000), (x, y) -> if(x <=> y, '1', '0')), '')"
    extended = aligned.withColumn("same", F.expr(same)).withColumn("start", F.expr("locate(repeat('1', span), same)")).where("start > 0")
    stop = "if(locate('0', same, start) = 0, length(same) + 1, locate('0', same, start))"
    hits = extended.selectExpr("doc_id", "text_key", "items", f"struct(place - back + start - 1 as lo, place - back + {stop} - 1 as hi) as hit")
    union = "aggregate(array_sort(hits), struct(0L as n, 0L as reach), (z, x) -> struct(z.n + greatest(0L, x.hi - greatest(x.lo, z.reach)) as n, greatest(z.reach, x.hi) as reach)).n"
    told = hits.groupBy("doc_id", "text_key").agg(F.collect_set("hit").alias("hits"), F.collect_set("items").alias("items"))
    told = stored(told.select("doc_id", "text_key", F.expr(union).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items")), "hits")

    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    joined = matched(base.select("doc_id", "text_key", "n_words"), told, "left")
    return joined.select("doc_id", "text_key", "n_words", n.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), ((n > 0) & (share * n >= F.col("n_words"))).alias("contaminated"))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
i AS (SELECT item, w, len(w) AS n, least({SPAN}, len(w)) AS t FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, t, array_to_string(w[p:p + t - 1], ' ') AS s FROM i, unnest(range(1, n - t + 2)) AS u(p)),
dw AS (SELECT r, p, t, array_to_string(w[p:p + t - 1], ' ') AS s FROM d, (SELECT DISTINCT t FROM i) AS l, unnest(range(1, len(w) - t + 2)) AS u(p)),
hit AS (SELECT r, p, t, item FROM dw JOIN iw USING (t, s)),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + t)) AS x(q) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) AS y GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r)
"""
