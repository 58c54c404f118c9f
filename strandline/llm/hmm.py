"""Hidden Markov language model with distributed Baum-Welch training.

Latent states emit word classes: each frequent word is a class of its own,
other words are classed by their ending.  Inside a class a word's probability
is its smoothed share of the class's tokens, from counts over the whole
training fold, so the model gives every token string a probability.  Expected
counts of states are summed across partitions each round; a few rounds on a
bounded sample give a starting model, then every round sees every training text.
The scaled forward recursion then gives the exact probability of each text,
however long.

Counts of rare words never meet in one place: they are joined to the texts by
word.  Words that make up at least one token in ``TABLE_SHARE`` are at most
that many, and are looked up in the tasks.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import BLANK_WORDS, LOWER, bounded_batches, durable, mix, pieces, utf8, word_sums
from strandline.llm.folds import fold, sample_rows

FOLDS, HELD_OUT = 7, 2
STATES = 8
#: Classes of words that have none of their own, by their last bytes.
ENDINGS, ENDING_BYTES = 512, 3
#: A word has a class of its own from one token in so many; is looked up in tasks from one in so many.
CLASS_SHARE, TABLE_SHARE = 4096, 1 << 20
#: Training texts that give the starting model, a bound, and rounds on them.
SEED_TEXTS, SEED_ROUNDS = 3_000, 5
#: Rounds on all training texts end when the log probability gains less than this share, and at the latest after so many.
LEAST_GAIN, MOST_ROUNDS = 5e-4, 12
#: Tokens that are in memory at once: of a buffer of texts, and of one recursion.
BUFFER_TOKENS, GROUP_TOKENS = 4_000_000, 400_000
#: Steps of the backward walk that are in memory at once.
SEGMENT = 65_536


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, ending class) of the words of a piece of bytes, lower-cased first."""
    own = LOWER[data]
    start, end, row, sums, unshift = word_sums(own, offsets, BLANK_WORDS)
    tail = np.maximum(start, end - ENDING_BYTES)
    word = mix((sums[end] - sums[start]) * unshift[start])
    return row, word, (mix((sums[end] - sums[tail]) * unshift[tail]) % np.uint64(ENDINGS)).astype(np.int32)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, ending, n): tokens of each word, by a 64-bit hash, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            parts = []
            for first, last in pieces(offsets):
                _, word, ending = _tokens(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                keys, at, n = np.unique(word, return_index=True, return_counts=True)
                parts.append((keys, ending[at], n))
            if parts:
                keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([p[2] for p in parts]), len(keys)).astype(np.int64)
                ending = np.zeros(len(keys), np.int32)
                ending[at] = np.concatenate([p[1] for p in parts])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ending), pa.array(n)], names=["word", "ending", "n"])

    return texts.select("text").mapInArrow(count, "word long, ending int, n long").groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What tasks know of words: frequent words, their counts and classes; sums of classes."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray  # -1: by ending
    class_log: np.ndarray  # log10 of tokens + words + 1 of each ending class
    texts: int
    tokens: int
    distinct: int

    @property
    def end(self) -> int:
        return ENDINGS + int((self.classes >= 0).sum())

    @property
    def size(self) -> int:
        return self.end + 1

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.words, words), max(0, len(self.words) - 1))
        return (at, self.words[at] == words) if len(self.words) else (at, np.zeros(len(words), bool))


def fit_vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """The driver gets at most ``TABLE_SHARE`` words and ``ENDINGS`` sums."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = total["n"] + texts, total["v"] + (texts > 0)
    table = counts.filter(F.col("n") * TABLE_SHARE >= tokens).select("word", "n").toArrow()
    words, n = table.column("word").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(words)
    words, n = words[order], n[order]
    classes = np.full(len(words), -1, np.int64)
    own = n * CLASS_SHARE >= tokens
    classes[own] = ENDINGS + np.arange(own.sum())
    class_log = np.zeros(ENDINGS)
    for r in counts.filter(F.col("n") * CLASS_SHARE < tokens).groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_log[r["ending"]] = np.log10(r["n"] + r["v"] + 1)
    return Vocabulary(words, n, classes, class_log, texts, tokens, distinct)


def code_texts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Each row as classes of its tokens, with the sums that need no join.

    ``codes`` holds 16-bit classes, the end last.  ``base_log`` sums
    log10(c + 1) over looked-up words and the end, ``word_log`` what words
    inside ending classes add to the score; ``rare`` lists the other words.
    """
    v = vocabulary
    end_log = float(np.log10(v.texts + 1))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.log10(v.counts + 1.0)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            n = batch.num_rows
            sums = {k: np.zeros(n) for k in ("base_log", "word_log")}
            n_tokens, known, codes, rare = np.ones(n, np.int64), np.full(n, int(v.texts > 0)), [], []
            sums["base_log"] += end_log
            for first, last in pieces(offsets):
                row, word, ending = _tokens(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                keys, place, back = np.unique(word, return_index=True, return_inverse=True)
                at, hit = v.find(keys)
                log = np.where(hit, logs[at] if len(logs) else 0.0, 0.0)
                own = np.where(hit, v.classes[at] if len(v.classes) else -1, -1)
                cls = np.where(own >= 0, own, ending[place])
                in_class = np.where(own >= 0, 0.0, log - v.class_log[np.minimum(cls, ENDINGS - 1)])
                m = last - first
                n_tokens[first:last] += np.bincount(row, minlength=m)
                known[first:last] += np.bincount(row, hit[back], m).astype(np.int64)
                sums["base_log"][first:last] += np.bincount(row, log[back], m)
                sums["word_log"][first:last] += np.bincount(row, in_class[back], m)
                cut = np.searchsorted(row, np.arange(m + 1))
                coded = cls[back].astype(np.uint16)
                codes.extend(np.append(coded[a:b], np.uint16(v.end)).tobytes() for a, b in zip(cut, cut[1:], strict=False))
                lost = ~hit[back]
                far, far_cut = word[lost].view(np.int64), np.searchsorted(row[lost], np.arange(m + 1))
                rare.extend(far[a:b] for a, b in zip(far_cut, far_cut[1:], strict=False))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("doc_id"), batch.column("fold"), pa.array(n_tokens), pa.array(known.astype(np.int64)), pa.array(sums["base_log"]), pa.array(sums["word_log"]), pa.array(codes, pa.binary()), pa.array(rare, pa.list_(pa.int64()))],
                names=["doc", "doc_id", "fold", "n_tokens", "known", "base_log", "word_log", "codes", "rare"])

    rows = docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", fold(F.col("doc_id"), FOLDS).cast("int").alias("fold"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(code, f"doc long, doc_id {kind}, fold int, n_tokens long, known long, base_log double, word_log double, codes binary, rare array<long>")


@dataclass
class Model:
    """Start, transition and emission probabilities; emissions are class by state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(frequencies: np.ndarray, seed: int = 3) -> Model:
    """States that tend to stay, with emissions around the class frequencies."""
    rng = np.random.default_rng(seed)
    move = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(move, 0.9)
    emit = (frequencies[:, None] + 0.1) * np.exp(rng.normal(0, 0.7, (len(frequencies), STATES)))
    return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))


def _groups(texts: list[np.ndarray]) -> Iterator[list[int]]:
    """Texts of like length, longest first, at most ``GROUP_TOKENS`` with padding or one."""
    order, group = sorted(range(len(texts)), key=lambda i: -len(texts[i])), []
    for i in order:
        if group and (len(group) + 1) * len(texts[group[0]]) > GROUP_TOKENS:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def _padded(texts: list[np.ndarray], group: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes by step and text, and how many texts are that long."""
    sizes = np.array([len(texts[i]) for i in group])
    codes = np.zeros((sizes[0], len(group)), np.uint16)
    for k, i in enumerate(group):
        codes[: sizes[k], k] = texts[i]
    return codes, np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")


def forward(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log of each text's probability, by the scaled forward recursion."""
    out = np.zeros(len(texts))
    for group in _groups(texts):
        codes, active = _padded(texts, group)
        log, alpha = np.zeros(len(group)), None
        for t, n in enumerate(active.tolist()):
            alpha = (model.start if t == 0 else alpha[:n] @ model.move) * model.emit[codes[t, :n]]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            log[:n] += np.log(scale)
        out[group] = log
    return out


def _ahead(model: Model, codes: np.ndarray, sizes: list[int], first: int, last: int, alpha: np.ndarray | None) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """Scaled forward vectors and emissions of steps ``first`` to ``last``, after ``alpha``, and the log of their scales."""
    alphas, scaled, log = [], [], 0.0
    for t in range(first, last):
        n = sizes[t]
        e = model.emit[codes[t, :n]]
        alpha = (model.start if t == 0 else alpha[:n] @ model.move) * e
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        e /= scale[:, None]
        log += float(np.log(scale).sum())
        alphas.append(alpha)
        scaled.append(e)
    return alphas, scaled, log


def expected(model: Model, texts: list[np.ndarray]) -> tuple[Model, float]:
    """Expected counts of starts, moves and emissions (forward and backward), and the log probability of the texts.

    Steps are taken in segments: of a very long text only the forward vector
    before each segment is kept, and a segment is walked again on the way back.
    """
    start, move, emit, total = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros_like(model.emit), 0.0
    for group in _groups(texts):
        codes, active = _padded(texts, group)
        sizes = active.tolist()
        firsts, before = list(range(0, len(sizes), SEGMENT)), [None]
        for first in firsts[:-1]:
            before.append(_ahead(model, codes, sizes, first, first + SEGMENT, before[-1])[0][-1])
        ahead = None
        for first in reversed(firsts):
            last = min(first + SEGMENT, len(sizes))
            alphas, scaled, log = _ahead(model, codes, sizes, first, last, before.pop())
            total += log
            gammas = []
            for t in range(last - 1, first - 1, -1):
                beta = np.ones((sizes[t], STATES))
                if ahead is not None:
                    move += alphas[t - first][: len(ahead)].T @ ahead
                    beta[: len(ahead)] = ahead @ model.move.T
                gammas.append(alphas[t - first] * beta)
                ahead = scaled[t - first] * beta
            if first == 0:
                start += gammas[-1].sum(axis=0)
            seen = np.concatenate([codes[t, : sizes[t]] for t in range(last - 1, first - 1, -1)])
            gamma = np.concatenate(gammas)
            for k in range(STATES):
                emit[:, k] += np.bincount(seen, gamma[:, k], len(emit))
    return Model(start, move * model.move, emit), total


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches gathered up to ``BUFFER_TOKENS``, so texts of like length meet."""
    held, texts, n = [], [], 0
    for batch in batches:
        own = [np.frombuffer(c.as_py(), np.uint16) for c in batch.column("codes")]
        held.append(batch)
        texts += own
        n += sum(map(len, own))
        if n >= BUFFER_TOKENS:
            yield held, texts
            held, texts, n = [], [], 0
    if held:
        yield held, texts


def train_round(coded: DataFrame, model: Model) -> tuple[Model, float]:
    """One round of Baum-Welch: counts summed by Spark, then normalised with a little smoothing.

    Also the natural log of the texts' probability under ``model``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, log = Model(np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros_like(model.emit)), 0.0
        for _, texts in _buffers(batches):
            got, own = expected(model, texts)
            total, log = Model(total.start + got.start, total.move + got.move, total.emit + got.emit), log + own
        flat = np.concatenate([total.start, total.move.ravel(), total.emit.ravel(), [log]])
        at = np.flatnonzero(np.abs(flat) > 1e-12)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "n"])

    table = coded.select("codes").mapInArrow(count, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(STATES + STATES**2 + model.emit.size + 1)
    flat[table.column("at").to_numpy()] = table.column("n").to_numpy()
    start, move, emit = flat[:STATES] + 0.1, flat[STATES : STATES + STATES**2].reshape(STATES, STATES) + 0.1, flat[STATES + STATES**2 : -1].reshape(-1, STATES) + 0.01
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)), float(flat[-1])


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows outside the held-out fold train the model.  Null reads as empty text,
    which has one token, the end.  Without training rows all counts are zero
    and the states are those of the first model.  Words are told apart by
    64-bit hashes.  Other columns are ignored.  A bounded sample gives the
    starting model (all rows where their ids leave it empty); then every round
    sees every training text.  A warning says if the rounds ended before the
    log probability settled.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    training = docs.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    counts = durable(count_words(training), "hmm-counts")
    vocabulary = fit_vocabulary(counts, training.count())
    coded = durable(code_texts(docs, vocabulary), "hmm-coded")
    learned = coded.filter(F.col("fold") != HELD_OUT).select("doc_id", "codes")
    seeds = durable(sample_rows(learned, SEED_TEXTS, vocabulary.texts, 1), "hmm-seeds")
    if not seeds.limit(1).count():
        # Few ids, as when all rows share one, may all fall outside the sample.
        seeds = learned
    frequencies = np.zeros(vocabulary.size)
    own = vocabulary.classes >= 0
    frequencies[vocabulary.classes[own]] = vocabulary.counts[own]
    frequencies[:ENDINGS] = 10.0**vocabulary.class_log
    frequencies[vocabulary.end] = vocabulary.texts
    model = first_model(frequencies)
    if vocabulary.texts:
        for _ in range(SEED_ROUNDS):
            model, _ = train_round(seeds, model)
        before = None
        for _ in range(MOST_ROUNDS):
            model, log = train_round(learned, model)
            if before is not None and log - before < LEAST_GAIN * abs(log):
                break
            last, before = before, log
        else:
            warnings.warn(f"the log probability still gained {log - last:.4g} in the last of {MOST_ROUNDS} rounds", stacklevel=2)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in _buffers(batches):
            log, at = forward(model, texts) / np.log(10), 0
            for batch in held:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "doc_id", "fold", "n_tokens", "known", "base_log", "word_log")), pa.array(log[at : at + batch.num_rows])], names=["doc", "doc_id", "fold", "n_tokens", "known", "base_log", "word_log", "state_log"])
                at += batch.num_rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = coded.select("doc", "doc_id", "fold", "n_tokens", "known", "base_log", "word_log", "codes").mapInArrow(score, f"doc long, doc_id {kind}, fold int, n_tokens long, known long, base_log double, word_log double, state_log double")
    few = counts.filter(F.col("n") * TABLE_SHARE < vocabulary.tokens).select("word", "n")
    rare = coded.select("doc", F.explode("rare").alias("word")).join(few, "word").groupBy("doc").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("n") + 1)).alias("rare_log"))
    joined = scored.join(rare, "doc", "left")
    log = F.coalesce("rare_log", F.lit(0.0))
    return joined.select(
        "doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base_log") + log - F.col("n_tokens") * float(np.log10(vocabulary.tokens + vocabulary.distinct + 1))).alias("base_score"),
        (F.col("state_log") + F.col("word_log") + log).alias("score"),
    )
