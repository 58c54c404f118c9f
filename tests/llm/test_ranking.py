"""Ranked search against a plain scan, over many blocks and bundles, and on edge rows."""

import collections
import math
import random
import re

import pytest

from strandline.llm import ranking

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, rank int, score long, q long, block long"


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


def scan(docs, items, best=20):
    """Each item's best documents by a scan of all: a list of (doc_id, score) for each item."""
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, tokens = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = collections.Counter(w for _, b in bags for w in b)
    out = []
    for _, text in items:
        found = []
        for place, (i, bag) in enumerate(bags):
            score = 0
            for w in terms(text):
                if bag[w]:
                    m = 100 - 25 + (25 * bag.total() * n_docs) // tokens
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * bag[w]) // (1000 * bag[w] + 12 * m))
            if score > 0:
                found.append((-score, i is not None, i or 0, place))
        out.append([(i if known else None, -s) for s, known, i, _ in sorted(found)[:best]])
    return out


def ranked(spark, docs, items, parts=5, **more):
    rows = ranking.rank_documents(spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in docs], SCHEMA).repartition(parts), spark.createDataFrame(items, "item_id string, text string"), **more).collect()
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["item_id"], r["rank"])):
        assert r["rank"] == len(got[r["item_id"]]) + 1
        got[r["item_id"]].append((r["doc_id"], r["score"]))
    return got


@pytest.mark.parametrize(("shares", "block"), [((0.02, 0.1, 0.4), 16), ((), 1000), ((0.5, 0.5), 1)])
def test_ranks_equal_a_scan(spark, shares, block):
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 40, 400])))) for i in range(300)] + [(1000 + i, "w1 w2 W2, rare") for i in range(60)]
    items = [(f"i{k}", " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 40])))) for k in range(150)] + [("rare", "RARE rare w1"), ("none", "nowhere at all")]
    got = ranked(spark, docs, items, owner_shares=shares, block_docs=block)
    for (name, _), want in zip(items, scan(docs, items), strict=True):
        assert got[name] == want


def test_all_terms_posted_when_the_vocabulary_is_large(spark):
    docs = spark.createDataFrame([(i, f"a b{i} c d") for i in range(20)], "doc_id long, text string")
    words = ranking.item_terms(spark.createDataFrame([(0, "x", "a b3 zz")], "q long, item_id string, text string")).select("term").distinct()
    by_lookup, by_join = (ranking.build_index(docs, words, 8, n).orderBy("block", "term").collect() for n in (10, 0))
    assert [r for r in by_join if r["term"] is None] == [r for r in by_lookup if r["term"] is None]
    assert by_lookup == by_join and len(by_join) > 2


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "a a b"), (3, "a a b"), (None, "a a b"), (4, "É é \x00 日本 x" + " x" * 50_000), (5, "b " * 30)]
    items = [("e", None), ("f", "..."), ("g", "A A b"), ("h", "日本"), ("i", "É x")]
    got = ranked(spark, docs, items)
    assert [got[n] for n, _ in items] == scan(docs, items)
    assert not ranked(spark, docs, []) and not ranked(spark, [], items, 1) and not ranked(spark, [(1, None)], items, 1)
    assert [d for d, _ in ranked(spark, docs, items, best=2)["g"]] == [None, 3]
    with pytest.raises(ValueError):
        ranked(spark, docs, items, best=21)
    repeated = ranking.rank_documents(spark.createDataFrame(docs[2:], "doc_id long, text string"), spark.createDataFrame([(None, "b"), (None, "b")], "item_id string, text string"))
    assert repeated.count() == 8
