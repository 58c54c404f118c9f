"""Toxicity by weak supervision.

Many voters look at a text: word lists of several languages, word lists and
word beginnings mined from labelled training rows, and patterns.  Each votes
toxic, clean or nothing.  A generative label model, fitted by expectation
maximisation on the counts of vote patterns over the whole training fold,
estimates how each voter votes under either class and which voters follow each
other: a tree of correlations is part of the model.  Its posteriors label a bounded sample, and a linear classifier
on the presence of mined and lexicon words and on the votes of the lexicons and
patterns is trained on them.  The classifier alone scores texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import LOWER, TEXT_WORDS, bounded_batches, durable, mix, pieces, utf8, word_sums, words
from strandline.llm.folds import fold, sample_rows

# Common insults, by language.
LEXICONS = {
    "en": "idiot idiots moron morons loser losers stupid pathetic worthless scum trash clown disgusting filthy dumb fool liar coward jerk freak",
    "fr": "idiote crétin imbécile débile abruti connard salaud minable ordure pourriture stupide nul",
    "de": "idiotin dummkopf trottel arschloch dreckskerl abschaum versager widerlich erbärmlich blödmann",
    "es": "estúpido imbécil tonto basura asqueroso inútil cretino payaso patético miserable escoria",
}
#: Folds of training rows: crc32 of the id, modulo; the fold 0 is held out.
FOLDS = 5
#: Labelled rows from which features are mined, rows that train the classifier, and features kept: bounds.
MINED_ROWS, TRAINING_ROWS, FEATURES = 20_000, 20_000, 4_096
#: Rows with a feature at least, to mine it.
LEAST_ROWS = 5
#: Standard errors and log odds at least, to mine a feature.
SURE, LEAST_ODDS = 1.64, 2.0
#: Bytes of the word beginnings used as features besides whole words (0).
KINDS = (0, 4, 5, 6)
#: Voters of mined features: groups for each kind.
GROUPS = 3
#: Rounds of expectation maximisation, and those before which correlations are estimated.
ROUNDS, TREE_ROUNDS = 8, (0, 2, 4)
#: Rows that a voter's own shares count for in its tables, and information (nats) an edge of the tree must have.
BACK_OFF, LEAST_GAIN = 20.0, 0.02


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind, (row, hash) of the words of lower-cased bytes."""
    start, end, row, sums, unshift = word_sums(data, offsets, TEXT_WORDS)
    found = []
    for kind in KINDS:
        if kind:
            long = end - start > kind
            a, r = start[long], row[long]
            b = a + kind
        else:
            a, b, r = start, end, row
        found.append((r, mix((sums[b] - sums[a]) * unshift[a] + np.uint64(kind + 1))))
    return found


def _hash_words(words: str) -> np.ndarray:
    raw = words.encode()
    return np.unique(features(LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]))[0][1])


def _family(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The smallest hash of five words in a row, or of all where there are fewer."""
    least = np.full(len(offsets) - 1, np.iinfo(np.uint64).max, np.uint64)
    for first, last in pieces(offsets):
        w = words(LOWER[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first], TEXT_WORDS)
        if len(w.hash) >= 5:
            h = mix(sum((w.hash[i : len(w.hash) - 4 + i] * np.uint64(2 * i + 3) for i in range(5)), np.zeros(len(w.hash) - 4, np.uint64)))
            whole = w.row[:-4] == w.row[4:]
            np.minimum.at(least, first + w.row[:-4][whole], h[whole])
        short = np.bincount(w.row, minlength=last - first) < 5
        total = np.zeros(last - first, np.uint64)
        np.add.at(total, w.row, w.hash)
        least[first:last][short] = total[short]
    return least


@dataclass
class Lookup:
    """Sorted feature hashes with a bitmap before the search."""

    keys: np.ndarray

    def __post_init__(self):
        self.bitmap = np.zeros(1 << 16, bool)
        self.bitmap[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in ``keys``) of the hashes that are keys."""
        maybe = np.flatnonzero(self.bitmap[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if len(self.keys) == 0 or len(maybe) == 0:
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == hashes[maybe]
        return row[maybe[hit]], at[hit]


def _presence(data: np.ndarray, offsets: np.ndarray, lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key) pairs of a column's lower-cased bytes, by row."""
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, last in pieces(offsets):
        for r, h in features(LOWER[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first]):
            r, k = lookup.find(r, h)
            rows.append(r + first)
            keys.append(k)
    pairs = np.unique(np.concatenate(rows) * (len(lookup.keys) + 1) + np.concatenate(keys))
    return pairs // (len(lookup.keys) + 1), pairs % (len(lookup.keys) + 1)


def mine(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, kind, log odds) of the features that mark one class in labelled training rows.

    A bounded sample of labelled rows is joined to the texts (broadcast: its
    size is the bound).  Of rows with one smallest shingle (copies, mostly) only
    the first counts, else every word of a copied text would seem telling.
    Counts by feature are summed by Spark; the driver gets the ``FEATURES``
    whose log odds are surest, by the lower end of their interval.
    """
    picked = F.broadcast(sample_rows(labels, MINED_ROWS, labels.count(), 1).limit(2 * MINED_ROWS))

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(_family(*utf8(batch.column("text"))).view(np.int64))], names=["doc_id", "text", "label", "family"])

    texts = docs.join(picked, "doc_id").select("doc_id", "text", "label")
    kind = texts.schema["doc_id"].dataType.simpleString()
    texts = durable(texts.mapInArrow(families, f"doc_id {kind}, text string, label int, family long"), "toxicity-sample")
    first = texts.groupBy("family", "label").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "label")
    sample = F.broadcast(durable(first, "toxicity-first"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            toxic = np.asarray(batch.column("label").to_numpy(zero_copy_only=False), np.int64)
            for first, last in pieces(offsets):
                own = LOWER[data[offsets[first] : offsets[last]]]
                for kind, (r, h) in zip(KINDS, features(own, offsets[first : last + 1] - offsets[first]), strict=True):
                    order = np.lexsort((r, h))
                    r, h = r[order], h[order]
                    new = np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1]))) if len(h) else np.zeros(0, bool)
                    keys, at = np.unique(h[new], return_inverse=True)
                    bad = np.bincount(at, weights=toxic[first + r[new]], minlength=len(keys)).astype(np.int64)
                    n = np.bincount(at, minlength=len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), kind, np.int32)), pa.array(n), pa.array(bad)], names=["h", "kind", "n", "bad"])

    labelled = texts.join(sample, ["doc_id", "label"]).select("text", "label")
    totals = sample.agg(F.count("*").alias("n"), F.sum("label").alias("bad")).first()
    all_bad, all_good = totals["bad"] or 0, totals["n"] - (totals["bad"] or 0)
    good = F.col("n") - F.col("bad")
    odds = F.log((F.col("bad") + 0.5) / (all_bad + 1.0)) - F.log((good + 0.5) / (all_good + 1.0))
    best = (
        labelled.mapInArrow(count, "h long, kind int, n long, bad long")
        .groupBy("h", "kind").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        .filter(F.col("n") >= LEAST_ROWS)
        .select("h", "kind", odds.alias("odds"), (F.abs(odds) - SURE * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (good + 0.5))).alias("low"))
        .filter(F.col("low") > LEAST_ODDS)
        .orderBy(F.col("low").desc(), "h").limit(FEATURES)
        .select("h", "kind", "odds").collect()
    )
    best.sort(key=lambda b: b["h"] % (1 << 64))
    return (
        np.array([b["h"] % (1 << 64) for b in best], np.uint64),
        np.array([b["kind"] for b in best], np.int64),
        np.array([b["odds"] for b in best], float),
    )


@dataclass
class Voters:
    """All voters: fixed lexicons, groups of mined features, patterns."""

    keys: np.ndarray
    kinds: np.ndarray
    odds: np.ndarray

    def __post_init__(self):
        fixed = {name: _hash_words(words) for name, words in LEXICONS.items()}
        #: Voters that are inputs of the classifier: lexicons and patterns; mined features are inputs themselves.
        self.inputs = np.array([*range(len(fixed)), *range(len(fixed) + len(KINDS) * GROUPS, len(fixed) + len(KINDS) * GROUPS + 4)])
        self.names = [f"lexicon:{n}" for n in fixed] + [f"mined:{k}:{g}" for k in KINDS for g in range(GROUPS)] + ["shouting", "exclaims", "no toxic feature", "calm"]
        everything = np.unique(np.concatenate([self.keys, *fixed.values()]))
        self.lookup = Lookup(everything)
        #: For each key, the lexicon voters that it fires.
        self.fires = np.zeros((len(everything), len(self.names)), bool)
        for i, own in enumerate(fixed.values()):
            self.fires[np.searchsorted(everything, own), i] = True
        at = np.searchsorted(everything, self.keys)
        for i, kind in enumerate(KINDS):
            own = (self.kinds == kind) & (self.odds > 0)
            self.fires[at[own], len(fixed) + i * GROUPS + (self.keys[own] % np.uint64(GROUPS)).astype(int)] = True

    @property
    def size(self) -> int:
        return len(self.lookup.keys) + len(self.inputs)

    def votes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows by voters (1 toxic, 0 clean, 2 no vote), and the (row, input) pairs of the classifier, by row."""
        n = len(offsets) - 1
        fired = np.zeros((n, len(self.names)), bool)
        rows, keys = _presence(data, offsets, self.lookup)
        np.logical_or.at(fired, rows, self.fires[keys])
        out = np.full((n, len(self.names)), 2, np.uint8)
        out[fired] = 1
        upper, letters, marks = (np.zeros(n, np.int64) for _ in range(3))
        for first, last in pieces(offsets):
            own, cut = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            for total, x in ((upper, (own >= 65) & (own <= 90)), (letters, ((own | 32) >= 97) & ((own | 32) <= 122)), (marks, own == 33)):
                total[first:last] = np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int32)))[cut])
        size = np.maximum(1, np.diff(offsets))
        out[:, -4] = np.where(upper > 0.5 * np.maximum(letters, 20), 1, 2)
        out[:, -3] = np.where(marks * 50 > size, 1, 2)
        out[:, -2] = np.where(~fired.any(axis=1), 0, 2)
        out[:, -1] = np.where((marks == 0) & (upper * 10 < letters), 0, 2)
        # A lexicon's vote is an input too: it weighs words of the lexicon that the sample lacks.
        voted, voter = np.nonzero(out[:, self.inputs] != 2)
        rows, keys = np.concatenate([rows, voted]), np.concatenate([keys, len(self.lookup.keys) + voter])
        order = np.argsort(rows, kind="stable")
        return out, rows[order], keys[order]


@dataclass
class LabelModel:
    """A prior and, for each class, how voters vote given the vote of the voter they lean on.

    ``parent`` names that voter (-1: none).  The voters form a tree, so the
    product over voters is a probability of all votes together, and a voter
    that only repeats another one adds nothing.
    """

    prior: float
    parent: np.ndarray
    table: np.ndarray  # class, voter, vote of the parent, vote

    @property
    def weights(self) -> np.ndarray:
        return np.log(self.table[1]) - np.log(self.table[0])

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        voters = np.arange(len(self.parent))
        above = np.where(self.parent < 0, 0, votes[:, np.maximum(self.parent, 0)])
        return np.log(self.prior / (1 - self.prior)) + self.weights[voters, above, votes].sum(axis=1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) of each row of votes."""
        return 1 / (1 + np.exp(-np.clip(self.log_odds(votes), -40, 40)))


def _table(counts: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Conditional tables from (class, voter, vote of the parent, vote) counts; rare rows lean on the voter's own shares."""
    own = counts.sum(axis=2) + 0.5
    own /= own.sum(axis=2, keepdims=True)
    table = (counts + BACK_OFF * own[:, :, None, :]) / (counts.sum(axis=3, keepdims=True) + BACK_OFF)
    return np.where((parent < 0)[None, :, None, None], own[:, :, None, :], table)


def _expected(patterns: DataFrame, model: LabelModel | None, places: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Expected counts (class, place) over (votes, label, n): summed in each task, then by Spark.

    ``places`` gives the places that each row of votes counts at; without a
    model the labels are the classes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size)
        for batch in batches:
            rows = batch.column("votes").to_pylist()
            if not rows:
                continue
            votes = (np.frombuffer("".join(rows).encode(), np.uint8) - 48).astype(np.int64).reshape(len(rows), -1)
            n = np.asarray(batch.column("n").to_numpy(zero_copy_only=False), float)
            p = np.asarray(batch.column("label").to_numpy(zero_copy_only=False), float) if model is None else model.posterior(votes)
            at = places(votes)
            total[:size] += np.bincount(at.ravel(), np.repeat(n * (1 - p), at.shape[1]), size)
            total[size:] += np.bincount(at.ravel(), np.repeat(n * p, at.shape[1]), size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(2 * size)
    for r in patterns.select("votes", "label", "n").mapInArrow(count, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(2, size)


def _counts(patterns: DataFrame, model: LabelModel | None, parent: np.ndarray) -> np.ndarray:
    """Expected (class, voter, vote of the parent, vote) counts."""
    voters = len(parent)

    def places(votes: np.ndarray) -> np.ndarray:
        above = np.where(parent < 0, 0, votes[:, np.maximum(parent, 0)])
        return np.arange(voters) * 9 + above * 3 + votes

    return _expected(patterns, model, places, voters * 9).reshape(2, voters, 3, 3)


def _tree(patterns: DataFrame, model: LabelModel, voters: int) -> np.ndarray:
    """The parent of each voter in the tree of the strongest correlations within classes (Chow and Liu).

    The driver gets 9 counts for each pair of voters and class, whatever the
    size of the corpus.
    """
    first, second = np.triu_indices(voters, 1)
    places = lambda votes: np.arange(len(first)) * 9 + votes[:, first] * 3 + votes[:, second]
    found = _expected(patterns, model, places, max(1, len(first) * 9))
    joint = np.zeros((voters, voters, 2, 9))
    if len(first):
        joint[first, second] = found.reshape(2, len(first), 9).transpose(1, 0, 2)
    total = max(1.0, joint[0, 1].sum()) if voters > 1 else 1.0
    gain = np.zeros((voters, voters))
    for a in range(voters):
        for b in range(a + 1, voters):
            for own in joint[a, b].reshape(2, 3, 3) / total:
                outer = own.sum(axis=1, keepdims=True) * own.sum(axis=0, keepdims=True) / max(own.sum(), 1e-300)
                gain[a, b] += (own[own > 0] * np.log(own[own > 0] / outer[own > 0])).sum()
    gain += gain.T
    # The largest tree, grown from the first voter; edges without information are left out.
    parent, inside = np.full(voters, -1), [0]
    while len(inside) < voters:
        rest = [i for i in range(voters) if i not in inside]
        a, b = max(((a, b) for a in inside for b in rest), key=lambda e: gain[e])
        parent[b] = a if gain[a, b] > LEAST_GAIN else -1
        inside.append(b)
    return parent


def fit_label_model(patterns: DataFrame, voters: int, prior: float) -> LabelModel:
    """Expectation maximisation over (votes, label, n): one aggregation a round.

    ``votes`` is a string of digits.  Labelled rows give the voters' first
    accuracies; without labels the first round takes voters to be right in
    most cases.  Then every round gives every row, labelled or not, its
    posterior.  Voters begin as independent; before some of the rounds the tree
    of their correlations is estimated anew.
    """
    alone = np.full(voters, -1)
    start = np.zeros((2, voters, 3, 3))
    start[0, :, 0], start[1, :, 0] = (0.3, 0.02, 0.68), (0.1, 0.4, 0.5)
    counts = 20 * start + _counts(patterns.filter(F.col("label").isNotNull()), None, alone)
    model = LabelModel(prior, alone, _table(counts, alone))
    for i in range(ROUNDS):
        if i in TREE_ROUNDS:
            parent = _tree(patterns, model, voters)
            model = LabelModel(model.prior, parent, _table(_counts(patterns, model, parent), parent))
        counts = _counts(patterns, model, model.parent)
        size = counts[:, 0].sum(axis=(1, 2))
        model = LabelModel(float(np.clip((size[1] + 0.5) / (size.sum() + 1), 1e-4, 0.9)), model.parent, _table(counts, model.parent))
    return model


@dataclass
class Classifier:
    """Logistic regression on the presence of words and votes."""

    voters: Voters
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        _, rows, keys = self.voters.votes(data, offsets)
        logit = self.bias + np.bincount(rows, weights=self.weights[keys], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _train(voters: Voters, docs: list[np.ndarray], target: np.ndarray, rounds: int = 300) -> Classifier:
    """Full-batch gradient descent with momentum and a small quadratic penalty."""
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    key = np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64)
    weights, bias = np.zeros(voters.size), 0.0
    speed, bias_speed, n = np.zeros_like(weights), 0.0, max(1, len(docs))
    seen = np.maximum(1.0, np.bincount(key, minlength=len(weights)))
    for _ in range(rounds):
        logit = bias + np.bincount(row, weights=weights[key], minlength=len(docs))
        error = 1 / (1 + np.exp(-np.clip(logit, -40, 40))) - target
        # Steps of rare features are longer than their share of rows alone would make them.
        slope = np.bincount(key, weights=error[row], minlength=len(weights)) / np.sqrt(seen * n) + 1e-3 * weights
        speed, bias_speed = 0.9 * speed - 1.0 * slope, 0.9 * bias_speed - 0.3 * error.sum() / n
        weights, bias = weights + speed, bias + bias_speed
    return Classifier(voters, weights, float(bias))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Labels are learned from rows of ``labels`` outside fold 0 whose label is
    not null.  Null texts are empty; an empty text gets the score of a text
    without any feature.  Labels enter by the mined features and the label
    model's first accuracies; the classifier learns its posteriors.  Without labels the
    voters are the lexicons and patterns.  Other columns of ``docs`` are ignored.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & (fold(F.col("doc_id"), folds) != 0)).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = durable(known, "toxicity-labels")
    voters = Voters(*mine(docs, known))
    classes = known.agg(F.count("*").alias("n"), F.sum("label").alias("bad")).first()
    prior = ((classes["bad"] or 0) + 1) / (classes["n"] + 10)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            votes, rows, keys = voters.votes(data, offsets)
            cuts = np.searchsorted(rows, np.arange(len(votes) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([(v + 48).tobytes().decode() for v in votes], pa.string()), lists], names=["doc_id", "votes", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    training = docs.filter(fold(F.col("doc_id"), folds) != 0)
    voted = durable(training.mapInArrow(vote, f"doc_id {kind}, votes string, keys array<int>").join(known, "doc_id", "left"), "toxicity-votes")
    patterns = durable(voted.groupBy("votes", "label").agg(F.count("*").alias("n")), "toxicity-patterns")
    model = fit_label_model(patterns, len(voters.names), prior)
    sample = sample_rows(voted, TRAINING_ROWS, voted.count(), 2).limit(2 * TRAINING_ROWS).select("votes", "keys").collect()
    votes = np.array([[int(c) for c in r["votes"]] for r in sample], np.int64).reshape(len(sample), len(voters.names))
    target = model.posterior(votes)
    classifier = _train(voters, [np.array(r["keys"], np.int64) for r in sample], target)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(classifier.scores(*utf8(batch.column("text"))))], names=["doc_id", "score"])

    scored = docs.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the classifier doesn't call toxic, all columns kept."""
    rejected = score_toxicity(docs, labels).filter("predicted = 1").select("doc_id").distinct()
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["doc_id"]), "left_anti")
