"""Ranked lexical search by pipelined term partitioning.

One pass over the texts makes an index cut two ways: into blocks of documents,
and by term into lists of postings.  Terms belong to owners, rarest terms to
the first.  Items travel in bundles: a bundle carries, for each block, a sparse
accumulator of document scores through the owners' stages, one ``cogroup`` of
accumulators and the owner's lists a stage, in which integer contributions are
added.  After each stage the least score that can still be among an item's
best is known, so a document that cannot reach it with all that later owners
can add is left out; this never changes the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import LOWER, TEXT_WORDS, bounded_batches, durable, pieces, small, utf8, words
from strandline.llm.decontamination import text_words

#: Documents of a block, and postings after which a block ends early.
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 1 << 20
#: Items of a bundle: 2 to this power at most.
BUNDLE_BITS = 6
#: Terms that are looked up in the tasks that read texts; more are joined to the lists of all terms.
LOOKUP_TERMS = 1 << 20
#: Owners by the share of documents that hold a term: up to each share, and one for all others.
OWNER_SHARES = (1 / 4096, 1 / 256, 1 / 16)
#: Documents returned for an item.
BEST = 20
#: Fixed values of the score.
SCALE, TF_SCALE, K1, LENGTH_SHARE, WEIGHT_SCALE = 1_000_000_000, 1000, 12, 25, 1000


def _hashes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, hash, rows) of the terms of pieces of a column."""
    data, offsets = utf8(texts)
    for first, last in pieces(offsets):
        part = LOWER[data[offsets[first] : offsets[last]]]
        found = words(part, offsets[first : last + 1] - offsets[first], TEXT_WORDS)
        yield found.row, found.hash.view(np.int64), last - first


def item_terms(items: DataFrame) -> DataFrame:
    """(q, bundle, word, term, times): distinct terms of stored ``items`` (q, item_id, text)."""
    counted = durable(items.select("q", F.explode(text_words(F.col("text"))).alias("word")).groupBy("q", "word").agg(F.count("*").alias("times")), "ranking-items")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for _, h, _ in _hashes(batch.column("word"))]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], ["word", "term"])

    coded = durable(counted.select("word").distinct().mapInArrow(code, "word string, term long"), "ranking-vocabulary")
    return durable(counted.join(small(coded), "word").withColumn("bundle", F.shiftright("q", BUNDLE_BITS)), "ranking-terms")


def build_index(docs: DataFrame, vocabulary: DataFrame, block_docs: int = BLOCK_DOCS, lookup_terms: int = LOOKUP_TERMS) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text) for the terms of ``vocabulary`` (term).

    A row holds, for a block of documents and a term, the places of documents
    in the block, the term's occurrences and the documents' lengths.  The row
    of a block without a term holds the ids and lengths of all its documents.
    """
    known = None
    if vocabulary.count() <= lookup_terms:
        known = np.unique(vocabulary.toArrow().column("term").to_numpy())
    ids = docs.schema["doc_id"].dataType

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, length, held = TaskContext.get().partitionId() << 24, 0, 0
        own: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        parts: list[tuple[np.ndarray, ...]] = []

        def listed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values.astype(np.int32)))

        def flush() -> Iterator[pa.RecordBatch]:
            size = np.concatenate(sizes)
            term, at, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(term, kind="stable")
            term, at, times = term[order], at[order], times[order]
            ends = np.flatnonzero(np.concatenate((term[1:] != term[:-1], np.ones(min(1, len(term)), bool)))) + 1
            n = len(ends)
            none = pa.nulls(n, own[0].type)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), pa.array(term[ends - 1]), listed(at, ends), listed(times, ends), listed(size[at], ends), pa.ListArray.from_arrays(pa.array(np.zeros(n + 1), pa.int32()), none[:0])],
                ["block", "term", "at", "times", "size", "ids"],
            )
            every = pa.concat_arrays(own)
            whole = np.array([len(every)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([None], pa.int64()), listed(size[:0], whole * 0), listed(size[:0], whole * 0), listed(size, whole), pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every)],
                ["block", "term", "at", "times", "size", "ids"],
            )

        for batch in batches:
            done = 0
            for row, term, rows in _hashes(batch.column("text")):
                size = np.bincount(row, minlength=rows)
                distinct, code = (known, np.minimum(np.searchsorted(known, term), max(0, len(known) - 1))) if known is not None else np.unique(term, return_inverse=True)
                hit = distinct[code] == term if len(distinct) else np.zeros(len(term), bool)
                pair, times = np.unique(row[hit] * max(1, len(distinct)) + code[hit], return_counts=True)
                at, code = pair // max(1, len(distinct)), pair % max(1, len(distinct))
                first = 0
                while first < rows:  # a piece may hold the end of one block and the start of the next
                    last = min(rows, first + block_docs - length)
                    a, b = np.searchsorted(at, (first, last))
                    parts.append((distinct[code[a:b]], at[a:b] - first + length, times[a:b]))
                    sizes.append(size[first:last])
                    own.append(batch.column("doc_id").slice(done + first, last - first))
                    length, held, first = length + last - first, held + b - a, last
                    if length == block_docs or held >= BLOCK_POSTINGS:
                        yield from flush()
                        block, length, held, own, sizes, parts = block + 1, 0, 0, [], [], []
                done += rows
        if length:
            yield from flush()

    bounded_batches(docs.sparkSession)
    schema = f"block long, term long, at array<int>, times array<int>, size array<int>, ids array<{ids.simpleString()}>"
    index = docs.select("doc_id", "text").mapInArrow(post, schema)
    if known is None:
        every = durable(index, "ranking-every")
        index = every.join(vocabulary.select("term").distinct(), "term", "left_semi").select(every.columns).unionByName(every.filter("term is null"))
    return durable(index, "ranking-index")


def _stage(owner: int, lists: DataFrame, state: DataFrame, docs: int, tokens: int, block_docs: int) -> DataFrame:
    """Accumulators ``state`` after the lists of an owner are added."""

    def add(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        sums: dict[int, np.ndarray] = {}
        kept: list[tuple[int, np.ndarray, np.ndarray]] = []
        for q, at, score in zip(*(left.column(c) for c in ("q", "at", "score")), strict=True):
            sums[q.as_py()] = dense = np.zeros(block_docs, np.int64)
            dense[at.values.to_numpy()] = score.values.to_numpy()
        needs: dict[int, tuple[int, int]] = {}
        for at, times, size, asks in zip(*(right.column(c) for c in ("at", "times", "size", "asks")), strict=True):
            place, tf, n = (x.values.to_numpy().astype(np.int64) for x in (at, times, size))
            damped = TF_SCALE * tf + K1 * (100 - LENGTH_SHARE + (LENGTH_SHARE * docs * n) // tokens)
            share = (SCALE * tf) // damped
            for ask in asks.as_py():
                dense = sums.setdefault(ask["q"], np.zeros(0, np.int64))
                if not len(dense):
                    dense = sums[ask["q"]] = np.zeros(block_docs, np.int64)
                dense[place] += ask["weight"] * share
                needs[ask["q"]] = (ask["least"], ask["rest"])
        for q, dense in sums.items():
            least, rest = needs.get(q, (0, 0))
            at = np.flatnonzero((dense > 0) & (dense + rest >= least))
            if len(at):
                kept.append((q, at, dense[at]))
        offsets = pa.array(np.cumsum([0, *(len(at) for _, at, _ in kept)]), pa.int32())
        best = [np.sort(score)[::-1][:BEST] for _, _, score in kept]
        none = [np.zeros(0, np.int64)]
        return pa.Table.from_arrays(
            [
                pa.array([key[0].as_py()] * len(kept), pa.int64()), pa.array([key[1].as_py()] * len(kept), pa.int64()), pa.array([q for q, _, _ in kept], pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*(at for _, at, _ in kept), *none]).astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*(score for _, _, score in kept), *none]))),
                pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, best)]), pa.int32()), pa.array(np.concatenate([*best, *none]))),
            ],
            ["bundle", "block", "q", "at", "score", "best"],
        )

    schema = "bundle long, block long, q long, at array<int>, score array<long>, best array<long>"
    grouped = state.select("bundle", "block", "q", "at", "score").groupBy("bundle", "block").cogroup(lists.groupBy("bundle", "block"))
    return durable(grouped.applyInArrow(add, schema), f"ranking-stage-{owner}")


def rank_documents(docs: DataFrame, items: DataFrame, best: int = BEST, owner_shares: tuple[float, ...] = OWNER_SHARES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` highest-scoring documents of each item, up to 20.

    Every row of ``docs`` (doc_id, text) is a document of its own and every row
    of ``items`` (item_id, text) an item, also where ids repeat or are null.
    Null and empty texts have no terms: such an item has no rows, and such a
    document is found by none and counts nowhere.  Equal scores go by doc_id,
    null first, then by place in the table.  Terms are told apart by 64-bit
    hashes.  Without documents or items there are no rows; extra columns are
    ignored.
    """
    if not 0 < best <= BEST:
        raise ValueError(f"best must be 1 to {BEST}")
    numbered = durable(items.select(F.monotonically_increasing_id().alias("q"), "item_id", "text"), "ranking-numbered")
    terms = item_terms(numbered)
    index = build_index(docs, terms.select("term").distinct(), block_docs)
    sizes = index.filter("term is null").select("size").agg(
        F.sum(F.size(F.filter("size", lambda n: n > 0))).alias("docs"),
        F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda total, n: total + n)).alias("tokens"),
    ).first()
    n_docs, tokens = sizes["docs"] or 0, sizes["tokens"] or 0
    held = index.filter("term is not null").groupBy("term").agg(F.sum(F.size("at")).alias("df"), F.max(F.array_max("times")).cast("long").alias("most"))
    weight = F.floor(WEIGHT_SCALE * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    owner = sum((F.when(F.col("df") > share * n_docs, 1).otherwise(0) for share in owner_shares), F.lit(0))
    most = F.expr(f"({SCALE}L * most) div ({TF_SCALE}L * most + {K1 * (100 - LENGTH_SHARE)}L)")
    weighed = durable(
        terms.join(small(durable(held, "ranking-df")), "term")
        .select("q", "bundle", "term", (F.col("times") * weight).alias("weight"), owner.alias("owner"), most.alias("most"))
        .filter("weight > 0").withColumn("most", F.col("weight") * F.col("most")), "ranking-weights")
    # What the owners after each stage can add to a document's score, at most.
    stages = range(len(owner_shares) + 1)
    rests = durable(weighed.groupBy("q").agg(*(F.sum(F.when(F.col("owner") > t, F.col("most")).otherwise(0)).alias(f"rest{t}") for t in stages)), "ranking-rests")
    least = rests.select("q", F.lit(0).cast("long").alias("least"))
    state = docs.sparkSession.createDataFrame([], "bundle long, block long, q long, at array<int>, score array<long>, best array<long>")
    for t in stages:
        bounds = durable(rests.join(least, "q"), "ranking-bounds")
        asks = weighed.filter(F.col("owner") == t).join(small(bounds), "q").groupBy("bundle", "term").agg(F.collect_list(F.struct("q", "weight", "least", F.col(f"rest{t}").alias("rest"))).alias("asks"))
        lists = index.filter("term is not null").join(small(durable(asks, "ranking-asks")), "term").select("bundle", "block", "at", "times", "size", "asks")
        if t:
            needed = F.col("least") - F.col(f"rest{t - 1}")
            live = F.filter(F.arrays_zip("at", "score"), lambda x: x["score"] >= needed)  # noqa: B023
            state = state.join(small(bounds), "q").withColumn("live", live).filter(F.size("live") > 0).select("bundle", "block", "q", F.col("live.at").alias("at"), F.col("live.score").alias("score"))
        state = _stage(t, lists, state, n_docs, max(1, tokens), block_docs)
        order = Window.partitionBy("q").orderBy(F.col("reached").desc())
        reached = state.select("q", F.explode("best").alias("reached")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
        last = reached.filter(F.col("rank") == best).select("q", F.col("reached").alias("least"))
        least = durable(rests.select("q").join(last, "q", "left").select("q", F.coalesce("least", F.lit(0)).alias("least")), "ranking-least")
    scored = state.join(small(least), "q").select("q", "block", "least", F.explode(F.arrays_zip("at", "score")).alias("x")).select("q", "block", "least", "x.at", "x.score").filter("score >= least")
    ids = index.filter("term is null").select("block", "ids")
    found = ids.join(small(durable(scored.drop("least"), "ranking-found")), "block").select("q", "block", "at", "score", F.element_at("ids", F.col("at") + 1).alias("doc_id"))
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first(), "block", "at")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.join(numbered.select("q", "item_id"), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: The same in DuckDB, term at a time over all documents.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
it AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS term FROM i) GROUP BY ALL),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS tokens FROM d WHERE len(w) > 0),
tf AS (SELECT doc, doc_id, n, term, count(*) AS tf FROM (SELECT doc, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, n_docs),
scores AS (SELECT q, item_id, doc, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // tokens))))) AS BIGINT) AS score
  FROM it JOIN weights USING (term) JOIN tf USING (term), total GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST, doc) AS INT) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
