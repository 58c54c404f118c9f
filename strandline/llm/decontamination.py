"""Benchmark decontamination by a distributed positional inverted index.

One pass over the corpus stores the postings (term, document, position) of the
tokens that occur in test items, in segments sorted by term; a last posting of
an empty term holds every document's length.  A phrase is looked up from its
rarest term: that term's postings, shifted back by its offset, are the places
where the phrase may begin; they are intersected with the shifted postings of
the second rarest term, and what is left with those of all other terms.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import durable, small

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window; an item of fewer is one window.
WINDOW = 10


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased; the fast path is for texts of ASCII alone."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def text_words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def item_windows(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, window, terms): windows of ``WINDOW`` words, or one of all words.

    ``window`` identifies its words: equal windows of several items are equal.
    Items without words have none.
    """
    words = items.select(F.col(item_id).cast("string").alias("item"), text_words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - WINDOW + 1))
    cut = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, WINDOW))).alias("terms"))
    return cut.select("item", F.array_join("terms", " ").alias("window"), "terms").distinct()


def build_index(docs: DataFrame, doc_id: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """The stored postings (doc, doc_id, term, pos) of ``vocabulary`` (word, term).

    ``doc`` numbers the rows, so rows with equal or null ids stay apart.  Term
    -1 stands once in each row, at the position past its last word, and alone
    holds the id.
    """
    ends = vocabulary.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(-1).cast("long").alias("term"))
    numbered = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    tokens = numbered.select("doc", "doc_id", F.posexplode(F.concat(text_words(F.col("text")), F.array(F.lit("")))).alias("pos", "word"))
    postings = tokens.join(small(vocabulary.unionByName(ends)), "word").select("term", "doc", "pos", F.when(F.col("term") == -1, F.col("doc_id")).alias("doc_id"))
    return durable(postings.sortWithinPartitions("term", "doc", "pos"), "postings")


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, doc, start, length) of every exact occurrence.

    ``phrases`` holds (phrase, terms): distinct phrases and their term numbers.
    """
    # Rows of a frequent term among the phrases meet its count in one task, so counts are broadcast where they are few.
    counts = small(durable(index.filter("term >= 0").groupBy("term").agg(F.count("*").alias("n")), "term-counts"))
    parts = phrases.select("phrase", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term"))
    parts = durable(
        parts.join(counts, "term", "left")
        .withColumn("rank", F.row_number().over(Window.partitionBy("phrase").orderBy(F.coalesce("n", F.lit(0)), "offset")))
        # A term without postings means no occurrence.
        .withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(Window.partitionBy("phrase")))
        .filter("least > 0").select("phrase", "length", "offset", "term", "rank"),
        "phrase-parts",
    )
    first = parts.filter("rank = 1").select("phrase", "length", "term", "offset")
    begun = index.select("term", "doc", "pos").join(small(first), "term").select("phrase", "length", "doc", (F.col("pos") - F.col("offset")).alias("start")).filter("start >= 0")
    # Second rarest: an equi-join on the shifted place.  Phrases of one word have none.
    second = parts.filter("rank = 2").select("phrase", "term", "offset")
    wanted = begun.join(small(second), "phrase").select("phrase", "length", "doc", "start", "term", (F.col("start") + F.col("offset")).alias("pos"))
    listed = index.select("term", "doc", "pos").join(small(second.select("term").distinct()), "term", "left_semi")
    pairs = durable(wanted.join(listed, ["doc", "term", "pos"]).select("phrase", "length", "doc", "start").unionByName(begun.filter("length = 1")), "phrase-pairs")
    # All the others at once: each place asks for its terms and must get them all.
    others = parts.filter("rank > 2").select("phrase", "term", "offset")
    asked = pairs.filter("length > 2").join(small(others), "phrase").select("phrase", "length", "doc", "start", "term", (F.col("start") + F.col("offset")).alias("pos"))
    held = index.select("term", "doc", "pos").filter("term >= 0").join(small(pairs.select("doc").distinct()), "doc", "left_semi")
    whole = asked.join(held, ["doc", "term", "pos"]).groupBy("phrase", "length", "doc", "start").agg(F.count("*").alias("n")).filter("n = length - 2").drop("n")
    return whole.unionByName(pairs.filter("length <= 2"))


def proximity_matches(index: DataFrame, phrases: DataFrame, slack: int) -> DataFrame:
    """(phrase, doc, pos): postings of a phrase's rarest term near all its other terms.

    Near means at most ``slack`` positions away, in any order.  Positions are
    cut into blocks of ``slack`` so that the join is on equal blocks.
    """
    counts = small(durable(index.filter("term >= 0").groupBy("term").agg(F.count("*").alias("n")), "term-counts"))
    parts = phrases.select("phrase", F.explode(F.array_distinct("terms")).alias("term")).join(counts, "term", "left")
    order = Window.partitionBy("phrase").orderBy(F.coalesce("n", F.lit(0)), "term")
    parts = durable(parts.withColumn("rank", F.row_number().over(order)).withColumn("terms", F.count("*").over(Window.partitionBy("phrase"))), "proximity-parts")
    postings = index.select("term", "doc", "pos")
    anchors = postings.join(small(parts.filter("rank = 1").select("phrase", "term", "terms")), "term").select("phrase", "terms", "doc", F.col("pos").alias("at"))
    asked = anchors.join(small(parts.filter("rank > 1").select("phrase", "term")), "phrase").select("*", F.explode(F.array(*[F.floor(F.col("at") / slack) + i for i in (-1, 0, 1)])).alias("block"))
    near = asked.join(postings.withColumn("block", F.floor(F.col("pos") / slack)), ["doc", "term", "block"]).filter(F.abs(F.col("pos") - F.col("at")) <= slack)
    found = near.groupBy("phrase", "terms", "doc", "at").agg(F.countDistinct("term").alias("n")).filter("n = terms - 1")
    return found.unionByName(anchors.filter("terms = 1").withColumn("n", F.lit(0).cast("long"))).select("phrase", "doc", F.col("at").alias("pos"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``.

    A word is hit if it lies in an occurrence of a window of ``items``
    (item_id, text).  Null and empty texts have no words.  Without items
    nothing is hit, and the digest is that of the empty text.  A null item id
    reads ``null``.  Extra columns are ignored.
    """
    windows = durable(item_windows(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text"), "item_id", "text"), "windows")
    words = durable(windows.select(F.explode("terms").alias("word")).distinct().select("word", F.xxhash64("word").bitwiseAND(F.lit(2**62 - 1)).alias("term")), "vocabulary")
    coded = windows.select("window", F.posexplode("terms").alias("at", "word")).distinct().join(words, "word").groupBy("window").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("terms"))
    phrases = durable(coded.select(F.col("window").alias("phrase"), "terms"), "phrases")
    index = build_index(docs, "doc_id", "text", words)
    matches = durable(phrase_matches(index, phrases), "phrase-matches")
    # Words covered by the union of spans: each span adds what lies past all before it.
    past = Window.partitionBy("doc").orderBy("start", "length", "phrase").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    hits = (
        matches.withColumn("past", F.coalesce(F.max(end).over(past), F.lit(0)))
        .groupBy("doc").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "past"))).cast("long").alias("n_hit"))
    )
    held = (
        matches.select("doc", F.col("phrase").alias("window")).distinct()
        .join(small(windows.select("window", "item")), "window").select("doc", "item").distinct()
        .groupBy("doc").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    )
    found = hits.join(held, "doc")
    return (
        index.filter("term = -1").select("doc", "doc_id", F.col("pos").cast("long").alias("n_words"))
        .join(found, "doc", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` without any occurrence of a window of ``items``, all columns kept.

    Rows of one id go or stay together.
    """
    hit = contamination(docs, items).filter("contaminated").select("doc_id").distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["doc_id"]), "left_anti")


#: The same in DuckDB, by comparing every run of words with all windows.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i+9], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dg AS (SELECT doc, i, n, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT doc, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc, i, dg.n, item FROM dg JOIN bw ON dg.g = bw.g AND dg.n = bw.n),
hit AS (SELECT doc, count(DISTINCT p) AS n_hit FROM (SELECT doc, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc),
it AS (SELECT doc, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc, item FROM m) GROUP BY doc)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc) LEFT JOIN it USING (doc)
"""
